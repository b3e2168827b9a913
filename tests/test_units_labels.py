"""Units beside letters outside ASCII, and labels of tables with very many columns."""

from pyspark.sql import functions as F

from sheetloom.operators import layout, numbers


def test_unit_word_next_to_other_letters(spark):
    rows = spark.createDataFrame([("integer", "12 é" + "m trois"), ("integer", "12 em trois"), ("integer", "12 mañana")], ["fmt", "context"])
    got = [r.unit for r in rows.select(numbers.number_unit(F.col("fmt"), F.col("context")).alias("unit")).collect()]
    assert got == ["million", None, None]


def test_labels_beyond_256_characters(spark):
    n = 60_000 - 64
    rows = spark.range(1, n).select("id", layout.letter(F.col("id")).alias("label")).filter(F.col("id").isin(1, 128, 191, 192, 196, 448, 16384))
    assert {r.id: r.label for r in rows.collect()} == {i: chr(64 + i) for i in (1, 128, 191, 192, 196, 448, 16384)}

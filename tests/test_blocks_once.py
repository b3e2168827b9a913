"""Blocks are stretches of a page's ordered words, cut in one fold."""

from pyspark.sql import functions as F

from sheetloom import schemas
from sheetloom.functions.folds import fold_runs
from sheetloom.operators import layout


def test_runs_equal_a_plain_loop(spark):
    df = spark.createDataFrame([([i * i % 7 for i in range(n)],) for n in (0, 1, 511, 512, 513, 1300)], "xs array<int>")
    run = lambda first, n, total: F.struct(first.alias("at"), n.alias("n"), total.alias("total"))
    runs = fold_runs(
        F.col("xs"), "struct<at:int,n:int,total:int>", lambda s, x: s["total"] + x < 9,
        lambda s, x: run(F.coalesce(s["at"] + s["n"], F.lit(0)), F.lit(1), x), lambda s, x: run(s["at"], s["n"] + 1, s["total"] + x))
    for row in df.select("xs", runs.alias("runs")).collect():
        expected = []
        for i, x in enumerate(row.xs):
            if expected and expected[-1][2] + x < 9:
                at, n, total = expected.pop()
                expected.append((at, n + 1, total + x))
            else:
                expected.append((i, 1, x))
        assert [tuple(r) for r in row.runs] == expected


def test_block_texts(spark):
    plain = layout.block_texts(spark.createDataFrame([], schemas.WORDS))._jdf.queryExecution().optimizedPlan().toString()
    assert plain.count("collect_list(") == 1
    rows = [(1, 1, ln, k, t, x, y, x + 10.0, y + 10.0, 12.0 + ln, "Arial") for ln, k, t, x, y in [(0, 0, "a", 0.0, 0.0), (0, 1, "b", 20.0, 0.0), (9, 0, "c", 0.0, 300.0), (0, 2, "d", 300.0, 1.0)]]
    got = layout.block_texts(spark.createDataFrame(rows, schemas.WORDS)).orderBy("block_no").collect()
    assert [tuple(r)[2:] for r in got] == [
        (1, 0.0, 0.0, 30.0, 10.0, "a b", 12.0, "Arial"), (2, 300.0, 1.0, 310.0, 11.0, "d", 12.0, "Arial"), (3, 0.0, 300.0, 10.0, 310.0, "c", 21.0, "Arial")]
    no = {(r.line_no, r.word_no): r.block_no for r in layout.words_to_blocks(spark.createDataFrame(rows, schemas.WORDS)).collect()}
    assert no == {(0, 0): 1, (0, 1): 1, (0, 2): 2, (9, 0): 3}

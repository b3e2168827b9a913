"""Cell normalisation: filters, typing, display values and style cleaning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetloom.functions import cells as fc
from sheetloom.functions import fixed


def normalize_cells(cells: DataFrame) -> DataFrame:
    """Keep cells with content; a pure filter, so it runs in the scan stage."""
    return cells.filter(fc.has_content()).withColumn("value", fc.value_text())


def a1_encode(df: DataFrame, row: str = "r", col: str = "c") -> DataFrame:
    return df.withColumn("ref", fc.a1(F.col(row), F.col(col)))


def a1_decode(df: DataFrame, ref: str = "ref") -> DataFrame:
    """Row and column of a reference; a bad reference gives (0, 0)."""
    return df.withColumn("row", fc.a1_row(F.col(ref))).withColumn("col", fc.a1_col(F.col(ref)))


def region_ref(df: DataFrame) -> DataFrame:
    return df.withColumn(
        "region_ref",
        F.concat(fc.a1(F.col("r1"), F.col("c1")), F.lit(":"), fc.a1(F.col("r2"), F.col("c2"))),
    )


def cell_type(cells: DataFrame) -> DataFrame:
    """Declared type with booleans kept apart from numbers, plus one flag per type."""
    typed = cells.withColumn("data_type", F.coalesce("vtype", F.lit("null")))
    flags = {t: F.col("data_type") == t for t in ("number", "boolean", "date", "string", "error")}
    return typed.withColumns(
        {f"is_{t}": e for t, e in flags.items()} | {"is_formula": F.col("formula").isNotNull()}
    )


def iso_value(df: DataFrame, ts: str) -> DataFrame:
    """ISO-8601 text of a timestamp; the fraction appears only when it is not zero."""
    base = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    return df.withColumn(
        "iso", F.when(F.date_format(ts, "SSSSSS") == "000000", base).otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    )


def formula_kind(cells: DataFrame) -> DataFrame:
    f = F.col("formula")
    return cells.filter(f.isNotNull()).withColumn(
        "formula_type", F.when(F.startswith(f, F.lit("{")) & F.endswith(f, F.lit("}")), "array").otherwise("normal")
    )


def meaningful_value(df: DataFrame, text: str = "value") -> DataFrame:
    """Loose test: not blank.  Strict test: also no lone punctuation mark."""
    t = F.trim(text)
    digits = F.translate(t, ".-,", "").rlike(r"^\d+$")
    strict = digits | (F.length(t) > 1) | t.rlike(r"^[\p{L}\p{N}]$")
    return df.withColumn("meaningful", F.coalesce(F.length(t) > 0, F.lit(False))).withColumn(
        "meaningful_strict", F.coalesce((F.length(t) > 0) & strict, F.lit(False))
    )


def numeric_loose(df: DataFrame, text: str = "vtext") -> DataFrame:
    return df.withColumn("numeric_loose", fc.numeric_loose(F.col(text)))


def numeric_strict(df: DataFrame, text: str = "vtext") -> DataFrame:
    return df.withColumn("numeric_strict", fc.numeric_strict(F.col(text)))


def date_like(df: DataFrame, text: str = "value") -> DataFrame:
    return df.withColumn("date_like", fc.looks_like_date(F.trim(text)))


def temporal_like(df: DataFrame, text: str = "value") -> DataFrame:
    return df.withColumn("temporal_hits", fc.temporal_hits(F.col(text)))


def is_error_text(text: Column) -> Column:
    low = F.lower(text)
    words = low.rlike("|".join(fixed.ERROR_TERMS))
    endings = low.rlike("(" + "|".join(fixed.ERROR_ENDINGS) + ")$") | low.isin(fixed.ERROR_WHOLE)
    return F.coalesce(words | endings | F.trim(text).isin(fixed.ERROR_MARKS), F.lit(False))


def error_text_filter(df: DataFrame, text: str = "text") -> DataFrame:
    """Flag error text; a cell is dropped only when such text is shorter than 50."""
    return df.withColumn("is_error", is_error_text(F.col(text))).withColumn(
        "dropped", F.col("is_error") & (F.length(text) < 50)
    )


def prune_empty(cells: DataFrame) -> DataFrame:
    """Leaf (key, value) rows of a cell without null, blank, false and short error leaves."""
    leaves = {
        "value": fc.value_text(),
        "formula": F.col("formula"),
        "data_type": F.col("vtype"),
        "style": F.col("style"),
        "bold": F.when(F.col("bold"), F.lit("true")),
        "has_comment": F.when(F.col("has_comment"), F.lit("true")),
    }
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), v.cast("string").alias("leaf")) for k, v in leaves.items()])
    out = cells.select("workbook_id", "sheet_id", "r", "c", F.inline(pairs))
    keep = (F.length(F.trim("leaf")) > 0) & ~(is_error_text(F.col("leaf")) & (F.length("leaf") < 50))
    return out.filter(keep)


STYLE_SCHEMA = (
    "font STRUCT<name STRING, size DOUBLE, bold BOOLEAN, italic BOOLEAN, underline STRING, strike BOOLEAN, "
    "scheme STRING, color STRUCT<rgb STRING, theme INT, tint DOUBLE>>, "
    "fill STRUCT<fill_type STRING, start_color STRUCT<rgb STRING, theme INT, tint DOUBLE>, "
    "end_color STRUCT<rgb STRING, theme INT, tint DOUBLE>>, "
    "border STRUCT<left STRUCT<style STRING>, right STRUCT<style STRING>, top STRUCT<style STRING>, "
    "bottom STRUCT<style STRING>, diagonal STRUCT<style STRING>, diagonal_direction STRING>, "
    "alignment STRUCT<horizontal STRING, vertical STRING, text_rotation INT, wrap_text BOOLEAN, "
    "shrink_to_fit BOOLEAN, indent DOUBLE, relative_indent INT, justify_last_line BOOLEAN, reading_order DOUBLE>, "
    "protection STRUCT<locked BOOLEAN, hidden BOOLEAN>, number_format STRING"
)


def _nb(c: Column) -> Column:
    return F.when(F.length(F.trim(c)) > 0, c)


def _drop_empty(c: Column, *fields: Column) -> Column:
    return F.when(F.coalesce(*[f.cast("string") for f in fields]).isNotNull(), c)


def clean_style(df: DataFrame, style: str = "style") -> DataFrame:
    """Drop default and blank parts of a style JSON; null when nothing is left.

    A default fill (colour 00000000 without tint) and zero or false alignment
    parts vanish; unknown keys are not read at all.
    """
    s = F.from_json(F.col(style), STYLE_SCHEMA)
    font, fill, border, align = s["font"], s["fill"], s["border"], s["alignment"]
    font_parts = {k: _nb(font[k]) for k in ("name", "underline", "scheme")}
    font_parts |= {k: font[k] for k in ("size", "bold", "italic", "strike", "color")}
    start = fill["start_color"]
    default_fill = F.coalesce((start["rgb"] == "00000000") & (F.coalesce(start["tint"], F.lit(0.0)) == 0.0), F.lit(False))
    fill_parts = {"fill_type": _nb(fill["fill_type"]), "start_color": start, "end_color": fill["end_color"]}
    border_parts = {k: _nb(border[k]["style"]) for k in ("left", "right", "top", "bottom", "diagonal")}
    border_parts["diagonal_direction"] = _nb(border["diagonal_direction"])
    align_parts = {k: align[k] for k in ("horizontal", "vertical")}
    for k in ("text_rotation", "indent", "relative_indent", "reading_order"):
        align_parts[k] = F.when(align[k] != 0, align[k])
    for k in ("wrap_text", "shrink_to_fit", "justify_last_line"):
        align_parts[k] = F.when(align[k], align[k])

    def build(parts: dict[str, Column]) -> Column:
        return _drop_empty(F.struct(*[v.alias(k) for k, v in parts.items()]), *parts.values())

    prot = s["protection"]
    out = {
        "font": build(font_parts),
        "fill": F.when(~default_fill, build(fill_parts)),
        "border": build(border_parts),
        "alignment": build(align_parts),
        "protection": _drop_empty(prot, prot["locked"], prot["hidden"]),
        "number_format": F.when(F.length(s["number_format"]) > 0, s["number_format"]),
    }
    return df.withColumn("clean", _drop_empty(F.struct(*[v.alias(k) for k, v in out.items()]), *out.values())).withColumn(
        "clean_style", F.to_json("clean")
    )


def _rgb_hex(r: Column, g: Column, b: Column) -> Column:
    return F.concat(F.lit("FF"), *[F.lpad(F.hex(x.cast("long")), 2, "0") for x in (r, g, b)])


def normalize_color(df: DataFrame, text: str | None = None, packed: str | None = None, parts: str | None = None) -> DataFrame:
    """One of three colour spellings to ``FFRRGGBB``: text passes, packed ints and [r, g, b] are printed in hex."""
    options = []
    if parts:
        p = F.col(parts)
        options.append(_rgb_hex(p[0], p[1], p[2]))
    if text:
        options.append(F.col(text))
    if packed:
        n = F.col(packed)
        byte = lambda shift: F.shiftright(n, shift).bitwiseAND(F.lit(255))
        options.append(_rgb_hex(byte(16), byte(8), byte(0)))
    return df.withColumn("rgb", F.coalesce(*options))


def frozen_parse(df: DataFrame, ref: str = "ref") -> DataFrame:
    """Frozen rows / columns of a pane reference; ranges of cells and unreadable text freeze nothing."""
    x = F.col(ref)
    letters = F.coalesce(
        F.when(x.rlike(r"^[A-Za-z]{1,3}:\d+$"), F.regexp_extract(x, r"^([A-Za-z]+):", 1)),
        F.when(~x.contains(":") & x.rlike(r"^[A-Z]{1,3}\d+"), F.regexp_extract(x, r"^([A-Z]+)\d+", 1)),
        F.when(x.rlike(r"^[A-Za-z]{1,3}$"), x),
    )
    row = F.coalesce(F.regexp_extract(x, r"^[A-Za-z]+:?(\d+)", 1).try_cast("int"), F.lit(1))
    codes = F.filter(F.split(F.upper(letters), ""), lambda ch: ch != "")
    col = F.aggregate(codes, F.lit(0), lambda acc, ch: acc * 26 + F.ascii(ch) - 64)
    valid = letters.isNotNull()
    return df.withColumn("frozen_rows", F.when(valid, F.greatest(row - 1, F.lit(0))).otherwise(0)).withColumn(
        "frozen_cols", F.when(valid, F.greatest(col - 1, F.lit(0))).otherwise(0)
    )


def complex_formula(formula: Column) -> Column:
    return F.coalesce(formula.rlike("(?i)" + "|".join(fixed.COMPLEX_FORMULA)), F.lit(False))


def formula_category(formula: Column) -> Column:
    up = F.upper(formula)
    return (
        F.when(F.coalesce(formula, F.lit("")) == "", "empty")
        .when(up.contains("SUM"), "sum")
        .when(up.contains("IF"), "conditional")
        .when(up.rlike("VLOOKUP|HLOOKUP|INDEX|MATCH"), "lookup")
        .when(up.rlike("[$:]"), "reference")
        .otherwise("other")
    )


def formula_class(cells: DataFrame) -> DataFrame:
    f = F.col("formula")
    return cells.filter(f.isNotNull()).withColumn("is_complex", complex_formula(f)).withColumn("category", formula_category(f))


def _one_decimal(x: Column, suffix: str) -> Column:
    """One decimal with ties to even, as most printf implementations print binary fractions."""
    return F.format_string("%.1f" + suffix, F.rint(x * 10) / 10)


def format_bytes(n: Column, with_gb: bool = False) -> Column:
    """Bytes as B / KB / MB, or the four-step form that also prints one decimal for plain bytes."""
    k = 1024.0
    if with_gb:
        return (
            F.when(F.coalesce(n, F.lit(0)) == 0, "0 B")
            .when(n < k, _one_decimal(n.cast("double"), " B"))
            .when(n < k * k, _one_decimal(n / k, " KB"))
            .when(n < k * k * k, _one_decimal(n / (k * k), " MB"))
            .otherwise(_one_decimal(n / (k * k * k), " GB"))
        )
    return (
        F.when(n < k, F.format_string("%d B", n.cast("long")))
        .when(n < k * k, _one_decimal(n / k, " KB"))
        .otherwise(_one_decimal(n / (k * k), " MB"))
    )


def format_duration(s: Column) -> Column:
    minutes, rest = F.floor(s / 60), s % 60
    return (
        F.when(s < 1, F.format_string("%dms", (s * 1000).cast("long")))
        .when(s < 60, _one_decimal(s, "s"))
        .when((s < 3600) & (rest < 1), F.format_string("%dm", minutes))
        .when(s < 3600, F.format_string("%dm %ds", minutes, F.bround(rest, 0).cast("long")))
        .otherwise(F.format_string("%dh %dm", F.floor(s / 3600), F.floor((s % 3600) / 60)))
    )


def format_label(text: Column) -> Column:
    """A label that looks like an ISO stamp shows its date only."""
    stamp = text.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}")
    return F.when(text.isNull(), "").when(stamp, F.substring(text, 1, 10)).otherwise(text)


def format_units(df: DataFrame, size: str, seconds: str, stamp: str) -> DataFrame:
    return df.withColumns(
        {
            "size_text": format_bytes(F.col(size)),
            "size_text_gb": format_bytes(F.col(size), with_gb=True),
            "duration_text": format_duration(F.col(seconds)),
            "label_text": format_label(F.col(stamp)),
        }
    )

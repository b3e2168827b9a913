"""Run-length and style dictionary encoding of sheet rows.

A sheet row holds at most 16,384 columns, so windows over one row are bounded by
the format; grouping by (sheet, row, run) afterwards needs no second shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sheetloom.functions import cells as fc
from sheetloom.schemas import SHEET

ROW = [*SHEET, "r"]
VALUE = ["vtype", "vtext", "vnum", "vbool"]
BODY = [*VALUE, "style", "formula"]


def rle_encode(cells: DataFrame, min_run: int = 3, null_run: int = 2, max_width: int = 20, very_wide: int = 1000) -> DataFrame:
    """Runs of adjacent columns with equal value, style and formula.

    Rows up to ``max_width`` stored cells stay as they are.  Null runs need
    ``null_run`` cells, others ``min_run``, and two suffice in very wide rows.
    Shorter runs come back as single cells.
    """
    w = W.partitionBy(*ROW).orderBy("c")
    same = F.lag("c").over(w) == F.col("c") - 1
    for b in BODY:
        same = same & F.lag(b).over(w).eqNullSafe(F.col(b))
    width = F.count(F.lit(1)).over(W.partitionBy(*ROW))
    tagged = cells.select(*ROW, "c", *BODY).withColumn("_new", ~F.coalesce(same, F.lit(False))).withColumn("_width", width)
    runs = (
        tagged.withColumn("_run", F.max(F.when(F.col("_new"), F.col("c"))).over(w.rowsBetween(W.unboundedPreceding, 0)))
        .groupBy(*ROW, "_run")
        .agg(F.count(F.lit(1)).alias("_len"), F.first("_width").alias("_width"), *[F.first(b).alias(b) for b in BODY])
    )
    need = F.when(F.col("vtype") == "null", null_run).when(F.col("_width") > very_wide, 2).otherwise(min_run)
    packed = (F.col("_width") > max_width) & (F.col("_len") >= need)
    starts = F.when(packed, F.array("_run")).otherwise(F.sequence(F.col("_run"), (F.col("_run") + F.col("_len") - 1).cast("int")))
    return runs.withColumn("run_length", F.when(packed, F.col("_len")).otherwise(1).cast("int")).select(
        *ROW, F.explode(starts).alias("c"), "run_length", *BODY
    )


def rle_decode(runs: DataFrame) -> DataFrame:
    rest = [x for x in runs.columns if x not in ("c", "run_length")]
    return runs.select(*rest, F.explode(F.sequence("c", (F.col("c") + F.col("run_length") - 1).cast("int"))).alias("c"))


def rle_stats(runs: DataFrame) -> DataFrame:
    """One row: rows shortened, cells before and after, runs and the saved share in percent."""
    rows = runs.groupBy(*ROW).agg(
        F.sum("run_length").alias("before"), F.count(F.lit(1)).alias("after"), F.count_if(F.col("run_length") > 1).alias("runs")
    )
    return rows.agg(
        F.count_if(F.col("after") < F.col("before")).alias("rows_compressed"),
        F.sum("before").alias("cells_before"),
        F.sum("after").alias("cells_after"),
        F.sum("runs").alias("runs_created"),
    ).withColumn("ratio_percent", F.round((1 - F.col("cells_after") / F.col("cells_before")) * 100, 2))


def rle_counts(runs: DataFrame) -> DataFrame:
    """Stored, non-null and numeric cells per sheet and per workbook (row without a sheet), run lengths counted."""
    n = F.col("run_length")
    return (
        runs.groupBy(*SHEET)
        .agg(
            F.count(F.lit(1)).alias("stored"),
            F.sum(F.when(F.col("vtype") != "null", n).otherwise(0)).alias("non_null"),
            F.sum(F.when(F.col("vtype") == "number", n).otherwise(0)).alias("numeric"),
        )
        .rollup("workbook_id", "sheet_id")
        .agg(*[F.sum(x).alias(x) for x in ("stored", "non_null", "numeric")])
        .filter("workbook_id is not null")
    )


def row_pattern_stats(runs: DataFrame, min_stored: int = 10) -> DataFrame:
    """Per row with more than ``min_stored`` stored cells: logical cells, distinct values, saved percent."""
    rows = runs.groupBy(*ROW).agg(
        F.sum("run_length").alias("logical"), F.count(F.lit(1)).alias("stored"),
        F.count_if(F.col("run_length") > 1).alias("rle_cells"),
        F.count_distinct(F.coalesce(fc.value_text(), F.lit("\u0000"))).alias("unique_values"),
    )
    return rows.filter(F.col("stored") > min_stored).withColumn(
        "compression", F.round((1 - F.col("stored") / F.col("logical")) * 100, 6)
    )


def _quoted(c: Column) -> Column:
    """JSON string with all escapes; null stays null."""
    listed = F.to_json(F.array(c.cast("string")))
    return F.when(c.isNotNull(), F.substring(listed, F.lit(2), F.length(listed) - 2))


def json_value() -> Column:
    """JSON text of a cell value."""
    return (
        F.when(fc.is_text(), _quoted(F.col("vtext")))
        .when(F.col("vtype") == "boolean", F.lower(F.col("vbool").cast("string")))
        .otherwise(F.coalesce(fc.value_text(), F.lit("null")))
    )


def compact_cell() -> Column:
    """``[col, value, style?, formula?]`` with placeholders only where a later part follows; runs end in their length."""
    run = F.col("run_length") > 1
    f, s = F.col("formula"), F.col("style")
    style_slot = F.when(s.isNotNull() | f.isNotNull() | run, F.coalesce(_quoted(s), F.lit("null")))
    formula_slot = F.when(f.isNotNull() | run, F.coalesce(_quoted(f), F.lit("null")))
    return F.concat(
        F.lit("["), F.concat_ws(",", F.col("c").cast("string"), json_value(), style_slot, formula_slot, F.when(run, F.col("run_length").cast("string"))), F.lit("]")
    )


def verbose_cell() -> Column:
    opt = lambda name, col: F.coalesce(F.concat(F.lit(f',"{name}":'), _quoted(F.col(col))), F.lit(""))
    return F.concat(
        F.lit('{"coordinate":"'), fc.a1(F.col("r"), F.col("c")), F.lit('","row":'), F.col("r").cast("string"), F.lit(',"column":'),
        F.col("c").cast("string"), F.lit(',"data_type":"'), F.col("vtype"), F.lit('","value":'), json_value(), opt("style", "style"), opt("formula", "formula"), F.lit("}"),
    )


def encoding_size_compare(cells: DataFrame) -> DataFrame:
    """JSON bytes per sheet under three encodings and the whole percent saved against the verbose one."""
    one = cells.withColumn("run_length", F.lit(1))
    size = lambda df, c, name: df.groupBy(*SHEET).agg(F.sum(F.octet_length(c)).alias("bytes")).withColumn("strategy", F.lit(name))
    plain = one.groupBy(*SHEET).agg(F.sum(F.octet_length(verbose_cell())).alias("verbose"), F.sum(F.octet_length(compact_cell())).alias("compact"))
    runs = size(rle_encode(cells), compact_cell(), "rle").select(*SHEET, F.col("bytes").alias("rle"))
    wide = plain.join(runs, SHEET)
    long = wide.select(*SHEET, "verbose", F.expr("stack(3, 'verbose', verbose, 'compact', compact, 'rle', rle) as (strategy, bytes)"))
    return long.withColumn("reduction_percent", ((1 - F.col("bytes") / F.col("verbose")) * 100).cast("int")).drop("verbose")


# ---- styles ----------------------------------------------------------------


def style_dictionary(cells: DataFrame) -> DataFrame:
    """Distinct styles of each workbook numbered s1, s2, ... by first row-major appearance.

    The aggregation keeps one row per (workbook, style) - a workbook file holds at
    most 65,490 cell formats - before any ordering happens.
    """
    first = cells.filter(F.length("style") > 0).groupBy("workbook_id", "style").agg(F.min(F.struct("sheet_id", "r", "c")).alias("seen"))
    w = W.partitionBy("workbook_id").orderBy("seen")
    return first.withColumn("style_id", F.concat(F.lit("s"), F.row_number().over(w).cast("string"))).select("workbook_id", "style", "style_id")


def with_style_id(cells: DataFrame) -> DataFrame:
    return cells.join(style_dictionary(cells), ["workbook_id", "style"], "left")


def row_shared_style(cells: DataFrame) -> DataFrame:
    """The style of a row whose styled cells all agree."""
    return (
        cells.groupBy(*ROW).agg(F.min("style").alias("row_style"), F.max("style").alias("_hi"))
        .filter(F.col("row_style") == F.col("_hi")).drop("_hi")
    )


def drop_redundant_style(cells: DataFrame) -> DataFrame:
    """Move a shared style to the row; one shuffle by row serves the test and the rewrite."""
    w = W.partitionBy(*ROW)
    lo, hi = F.min("style").over(w), F.max("style").over(w)
    return cells.withColumn("row_style", F.when(lo == hi, lo)).withColumn(
        "style", F.when(~F.col("style").eqNullSafe(F.col("row_style")), F.col("style"))
    )


DEFAULTS_SCHEMA = (
    "font STRUCT<name STRING, size DOUBLE, bold BOOLEAN, italic BOOLEAN, underline STRING, strike BOOLEAN, color STRING>, "
    "fill STRUCT<type STRING, color STRING>, border STRUCT<left STRING, right STRING, top STRING, bottom STRING>, "
    "alignment STRUCT<horizontal STRING, vertical STRING, wrap_text BOOLEAN>, number_format STRING"
)


def style_default_elision(df: DataFrame, style: str = "style") -> DataFrame:
    """Leave out default style parts; null when only defaults are given."""
    s = F.from_json(F.col(style), DEFAULTS_SCHEMA)
    true = lambda c: F.when(c, c)
    color = lambda c: F.nullif(F.nullif(c, F.lit("00000000")), F.lit(""))
    text = lambda c, d: F.nullif(F.nullif(c, F.lit(d)), F.lit(""))
    f, fl, b, a = s["font"], s["fill"], s["border"], s["alignment"]
    parts = {
        "font": {"name": text(f["name"], "Calibri"), "size": F.nullif(f["size"], F.lit(11.0)), "bold": true(f["bold"]), "italic": true(f["italic"]),
                 "underline": text(f["underline"], "none"), "strike": true(f["strike"]), "color": color(f["color"])},
        "fill": {"type": text(fl["type"], "none"), "color": F.when(fl["type"] != "none", color(fl["color"]))},
        "border": {k: text(b[k], "") for k in ("left", "right", "top", "bottom")},
        "alignment": {"horizontal": text(a["horizontal"], "general"), "vertical": text(a["vertical"], "bottom"), "wrap_text": true(a["wrap_text"])},
    }
    built = {
        k: F.when(F.coalesce(*[v.cast("string") for v in p.values()]).isNotNull(), F.struct(*[v.alias(n) for n, v in p.items()]))
        for k, p in parts.items()
    }
    built["number_format"] = text(s["number_format"], "General")
    return df.withColumn("lean", F.struct(*[v.alias(k) for k, v in built.items()])).withColumn(
        "lean_style", F.nullif(F.to_json("lean"), F.lit("{}"))
    )


# ---- nested row output and checks -------------------------------------------


def write_compact_sheets(runs: DataFrame) -> DataFrame:
    """Nested rows ``{r, style?, cells}`` as one JSON text per sheet row, ready for ``write.text`` / ``write.json``.

    The row (bounded at 16,384 columns) is the unit of output; a whole sheet is
    never gathered, files partitioned by workbook keep its rows together.
    """
    d = drop_redundant_style(runs)
    cell = F.struct(F.col("c"), compact_cell().alias("cell"))
    return d.groupBy(*ROW).agg(F.sort_array(F.collect_list(cell)).alias("cs"), F.first("row_style").alias("row_style")).select(
        *ROW,
        F.concat(
            F.lit('{"r":'), F.col("r").cast("string"),
            F.coalesce(F.concat(F.lit(',"style":'), _quoted(F.col("row_style"))), F.lit("")),
            F.lit(',"cells":['), F.array_join(F.transform("cs", lambda x: x["cell"]), ","), F.lit("]}"),
        ).alias("json"),
    )


def roundtrip_diff(before: DataFrame, after: DataFrame, cols: list[str]) -> DataFrame:
    """Multiset difference both ways with one aggregation: counts of lost and of invented rows."""
    signed = before.select(*cols, F.lit(1).alias("_s")).unionByName(after.select(*cols, F.lit(-1).alias("_s")))
    net = signed.groupBy(*cols).agg(F.sum("_s").alias("d"), F.sum(F.abs("_s")).alias("n"))
    return net.agg(
        F.sum(F.greatest("d", F.lit(0))).alias("missing"),
        F.sum(F.greatest(-F.col("d"), F.lit(0))).alias("extra"),
        F.sum("n").alias("compared"),
    )


def data_class() -> Column:
    return (
        F.when(F.length("formula") > 0, "formula")
        .when(~fc.has_content(), "empty")
        .when(fc.is_text(), "string")
        .when(F.col("vtype").isin("number", "boolean"), "number")
        .otherwise("other")
    )


def data_loss_by_type(full: DataFrame, kept: DataFrame) -> DataFrame:
    """Cells of each value class in a full and a reduced encoding, and the share lost."""
    a = full.groupBy(data_class().alias("class")).agg(F.count(F.lit(1)).alias("full"))
    b = kept.groupBy(data_class().alias("class")).agg(F.count(F.lit(1)).alias("kept"))
    return a.join(b, "class", "left").fillna(0, ["kept"]).withColumn("lost", F.col("full") - F.col("kept")).withColumn(
        "lost_percent", F.round(F.col("lost") / F.col("full") * 100, 6)
    )

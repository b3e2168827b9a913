"""Row, column and sheet profiles, extents, trimming and gap filling.

Profiles are hash aggregations with map-side combine; only profile rows (one per
sheet row or column) are ever put in order, through the block scans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sheetloom.functions import cells as fc
from sheetloom.functions import fixed
from sheetloom.functions.scan import with_neighbours
from sheetloom.operators.normalize import complex_formula, formula_category, normalize_cells
from sheetloom.schemas import SHEET

ROW = [*SHEET, "r"]
COL = [*SHEET, "c"]


def row_profile(cells: DataFrame, sheets: DataFrame) -> DataFrame:
    """All per-row facts the detectors need, in one hash aggregation over the cells.

    The facts about the leftmost cell are packed behind its column number into one
    BIGINT minimum: every buffer is then fixed-width, so Spark hash-aggregates
    instead of sorting all cells, and first-column tests need no join of cells
    with sheets.  Only text can look like a date, so numbers skip the patterns.
    """
    txt, num = fc.is_text(), fc.is_number()
    no = F.lit(False)
    n = cells.filter(fc.has_content()).select(
        *ROW, "c", num.alias("num"), txt.alias("txt"),
        F.coalesce(fc.numeric_loose(F.col("vtext")), no).alias("loose"),
        F.coalesce(fc.numeric_strict(F.col("vtext")), no).alias("strict"),
        (F.length("vtext") > 3).alias("long"),
        fc.looks_like_date(F.trim("vtext")).alias("date"),
        fc.temporal_hits(F.col("vtext")).alias("hits"),
        F.coalesce(F.lower("vtext").rlike("|".join(fixed.FINANCE_TERMS)), no).alias("fin"),
    )
    bit = lambda c, k: F.col(c).cast("long") * k
    lead = F.col("c").cast("long") * 16 + bit("txt", 8) + bit("strict", 4) + bit("date", 2) + bit("fin", 1)
    prof = n.groupBy(*ROW).agg(
        F.count(F.lit(1)).alias("n"),
        F.min("c").alias("c1"),
        F.max("c").alias("c2"),
        F.count_if(F.col("num") | F.col("loose")).alias("n_loose"),
        F.count_if(F.col("num") | F.col("strict")).alias("n_strict"),
        F.count_if(F.col("txt") & ~F.col("strict")).alias("n_text"),
        F.count_if(F.col("txt") & F.col("long") & ~F.col("loose")).alias("n_label"),
        F.count_if("date").alias("_dates"),
        F.sum("hits").alias("n_temporal"),
        F.min(lead).alias("_lead"),
    )
    bounds = sheets.select(*SHEET, "min_row", "max_row", "min_col", "max_col")
    at_edge = F.col("c1") == F.col("min_col")
    has = lambda k: F.col("_lead").bitwiseAND(F.lit(k).cast("long")) > 0
    return (
        prof.join(bounds, SHEET)
        .filter(F.col("r").between(F.col("min_row"), F.col("max_row")))
        .withColumns(
            {
                "first_str": at_edge & has(8),
                "first_txt": at_edge & has(8) & ~has(4),
                "first_finance": at_edge & has(8) & has(1),
                "n_right": F.col("n") - at_edge.cast("int"),
                "n_date": F.col("_dates") - (at_edge & has(2)).cast("int"),
                "mostly_numeric": F.col("n_loose") > F.col("n") / 2,
                "has_labels": F.col("n_label") > 2,
                "mixed": (F.col("n_strict") > 0) & (F.col("n_text") > 0),
                "num_ratio": F.col("n_strict") / F.col("n"),
                "text_ratio": F.col("n_text") / F.col("n"),
                "span": F.col("c2") - F.col("c1") + 1,
                "temporal": F.col("n_temporal") / F.col("n") > 0.25,
            }
        )
        .withColumn("density", F.col("n") / (F.col("max_col") - F.col("min_col") + 1))
        .drop("_lead", "_dates")
    )


def row_content_pattern(prof: DataFrame) -> DataFrame:
    return prof.select(*ROW, F.col("n").alias("col_count"), "mostly_numeric", F.col("has_labels").alias("has_text_labels"))


def row_column_pattern(prof: DataFrame) -> DataFrame:
    return prof.select(
        *ROW, F.col("n").alias("col_count"), F.col("num_ratio").alias("numeric_ratio"), "text_ratio",
        F.col("span").alias("column_span"), F.col("density").alias("data_density"),
    )


def row_mixed(prof: DataFrame) -> DataFrame:
    return prof.select(*ROW, "mixed", F.col("first_txt").alias("first_col_text"))


def row_date_ratio(prof: DataFrame) -> DataFrame:
    ratio = F.when(F.col("n_right") > 0, F.col("n_date") / F.col("n_right"))
    return prof.select(*ROW, ratio.alias("date_ratio"), F.coalesce(ratio > 0.3, F.lit(False)).alias("has_dates"))


def row_temporal(prof: DataFrame) -> DataFrame:
    return prof.select(*ROW, (F.col("n_temporal") / F.col("n")).alias("temporal_ratio"), "temporal")


def occupied_rows_cols(cells: DataFrame) -> DataFrame:
    """Occupied rows and columns of every sheet in one pass (axis, position)."""
    pairs = F.array(
        F.struct(F.lit("row").alias("axis"), F.col("r").alias("position")),
        F.struct(F.lit("col").alias("axis"), F.col("c").alias("position")),
    )
    return normalize_cells(cells).select(*SHEET, F.inline(pairs)).distinct()


def python_type() -> Column:
    """Value class where whole and broken numbers count as different types."""
    x = F.col("vnum")
    return (
        F.when(F.col("vtype") == "boolean", "bool")
        .when((F.col("vtype") == "number") & (x == F.floor(x)), "int")
        .when(F.col("vtype") == "number", "float")
        .when(fc.is_text(), "str")
    )


def column_types(cells: DataFrame) -> DataFrame:
    """Per column: value count, distinct types, inconsistency and type counts."""
    t = python_type()
    per = (
        cells.select(*COL, t.alias("t")).filter(F.col("t").isNotNull()).groupBy(*COL)
        .agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("t") == k).alias(f"n_{k}") for k in ("int", "float", "str", "bool")])
    )
    kinds = sum(((F.col(f"n_{k}") > 0).cast("int") for k in ("float", "str", "bool")), (F.col("n_int") > 0).cast("int"))
    return per.withColumn("n_types", kinds).withColumn(
        "inconsistency", F.when(F.col("n") <= 1, 0.0).otherwise((F.col("n_types") - 1) / F.col("n"))
    )


def column_inconsistency(cells: DataFrame, sheets: DataFrame, first: int | None = None) -> DataFrame:
    """Sheet means of column inconsistency: over all columns, and over the ``first`` columns of a sheet if given."""
    cols = column_types(cells).filter(F.col("n") > 1).join(sheets.select(*SHEET, "min_col"), SHEET)
    early = F.lit(True) if first is None else F.col("c") < F.col("min_col") + first
    x = F.col("inconsistency")
    return cols.groupBy(*SHEET).agg(
        F.count(F.lit(1)).alias("columns"),
        F.round(F.least(F.avg(x), F.lit(1.0)), 9).alias("mean_inconsistency"),
        F.round(F.coalesce(F.avg(F.when(early, x)), F.lit(0.0)), 9).alias("mean_early"),
        F.count_if(early & (x > 0.3)).alias("high_early"),
    )


def _axis_gaps(cells: DataFrame) -> DataFrame:
    """Gaps of more than one between rows / columns that hold any non-null value."""
    cells = cells.filter(python_type().isNotNull())
    rows = cells.groupBy(*ROW).agg(F.lit("row").alias("axis")).withColumnRenamed("r", "position")
    cols = cells.groupBy(*SHEET, "c").agg(F.lit("col").alias("axis")).withColumnRenamed("c", "position")
    used = rows.unionByName(cols).select(*SHEET, "axis", "position")
    seen = with_neighbours(used, [*SHEET, "axis"], "position", ["position"])
    return seen.withColumn("gap", F.col("position") - F.col("prev.position") - 1).filter(F.col("gap") > 1)


def largest_gaps(cells: DataFrame, k: int = 5) -> DataFrame:
    """The k largest gaps of each axis.

    ``row_number() <= k`` lets Spark keep only k rows per group before the shuffle
    (window group limit), so a sheet with many gaps does not gather in one task.
    """
    w = W.partitionBy(*SHEET, "axis").orderBy(F.desc("gap"), "position")
    return _axis_gaps(cells).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def sheet_sparsity(cells: DataFrame, sheets: DataFrame) -> DataFrame:
    data = cells.groupBy(*SHEET).agg(F.count_if(fc.has_content()).alias("data_cells"), F.count(F.lit(1)).alias("stored_cells"))
    gaps = _axis_gaps(cells).groupBy(*SHEET).agg(
        F.count_if(F.col("axis") == "row").alias("row_gaps"), F.count_if(F.col("axis") == "col").alias("col_gaps")
    )
    area = (F.col("max_row") - F.col("min_row") + 1).cast("long") * (F.col("max_col") - F.col("min_col") + 1)
    return (
        sheets.select(*SHEET, area.alias("addressable")).join(data, SHEET).join(gaps, SHEET, "left")
        .fillna(0, ["row_gaps", "col_gaps"])
        .withColumn("sparsity", F.round(F.lit(1.0) - F.col("data_cells") / F.col("addressable"), 9))
        .withColumn("clustered", (F.col("row_gaps") > 3) | (F.col("col_gaps") > 3))
    )


def formula_profile(cells: DataFrame) -> DataFrame:
    f = F.col("formula")
    cat = formula_category(f)
    return (
        cells.groupBy(*SHEET)
        .agg(
            F.count(F.lit(1)).alias("stored_cells"),
            F.count(f).alias("formulas"),
            F.count_if(complex_formula(f)).alias("complex_formulas"),
            *[F.count_if(f.isNotNull() & (cat == k)).alias(f"n_{k}") for k in ("sum", "conditional", "lookup", "reference", "other")],
        )
        .withColumn("formula_ratio", F.round(F.col("formulas") / F.col("stored_cells"), 9))
        .withColumn(
            "complex_ratio",
            F.when(F.col("formulas") > 0, F.round(F.col("complex_formulas") / F.col("formulas"), 9)).otherwise(0.0),
        )
    )


def _truthy() -> Column:
    return (
        F.when(fc.is_text(), F.length("vtext") > 0)
        .when(F.col("vtype") == "number", F.coalesce(F.col("vnum") != 0, F.lit(False)))
        .when(F.col("vtype") == "boolean", F.coalesce(F.col("vbool"), F.lit(False)))
        .otherwise(False)
    )


def header_levels(cells: DataFrame, sheets: DataFrame, head: int | None = None) -> DataFrame:
    """Highest row (of the first ``head``, if given) that is mostly text, and the gap share over the rows up to it (typed values)."""
    top = F.col("r") >= 1 if head is None else F.col("r").between(1, head)
    rows = cells.filter(top).groupBy(*ROW).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(fc.is_text()).alias("texts"), F.count_if(_truthy()).alias("filled")
    )
    level = F.when(F.col("texts") / F.col("n") > 0.7, F.col("r"))
    levels = rows.groupBy(*SHEET).agg(F.greatest(F.lit(1), F.coalesce(F.max(level), F.lit(1))).alias("levels"))
    above = rows.join(levels, SHEET).filter(F.col("r") <= F.col("levels")).groupBy(*SHEET).agg(F.sum("filled").alias("filled"))
    width = (F.col("max_col") - F.col("min_col") + 1).cast("double")
    gap = F.col("levels") * 0.1 - F.coalesce("filled", F.lit(0)) / width * 0.1
    return (
        sheets.join(levels, SHEET, "left").join(above, SHEET, "left")
        .withColumn("levels", F.coalesce("levels", F.lit(1)))
        .select(*SHEET, F.col("levels").alias("header_levels"), F.round(F.least(gap, F.lit(1.0)), 9).alias("inconsistency"))
    )


def header_levels_meta(cells: DataFrame, sheets: DataFrame, head: int | None = None) -> DataFrame:
    """The metadata form: every non-empty row (of the first ``head``, if given) counts as a level."""
    top = F.col("r") >= 1 if head is None else F.col("r").between(1, head)
    rows = cells.filter(top).groupBy(*ROW).agg(F.count(F.lit(1)).alias("present"), F.count(python_type()).alias("valued"))
    width = F.col("max_col") - F.col("min_col") + 1
    joined = rows.filter(F.col("valued") > 0).join(sheets.select(*SHEET, "min_col", "max_col"), SHEET)
    return joined.groupBy(*SHEET).agg(
        F.count(F.lit(1)).alias("header_levels"),
        F.round(F.least(F.sum((width - F.col("present")) / width), F.lit(1.0)), 9).alias("inconsistency"),
    )


def merge_profile(merges: DataFrame) -> DataFrame:
    rows, cols = F.col("r2") - F.col("r1") + 1, F.col("c2") - F.col("c1") + 1
    big = ((rows > 2) | (cols > 2)).cast("double")
    both = F.when((rows > 1) & (cols > 1), 0.5).otherwise(0.0)
    return merges.groupBy(*SHEET).agg(
        F.count(F.lit(1)).alias("merges"),
        F.sum(big.cast("long")).alias("complex_merges"),
        F.sum(big + both).alias("complex_weight"),
        F.max(rows).alias("max_rows_spanned"),
        F.max(cols).alias("max_cols_spanned"),
    )


# ---- extents ---------------------------------------------------------------


def data_extent(runs: DataFrame) -> DataFrame:
    """Last meaningful row and column of each sheet; a run counts to its end column."""
    end = F.col("c") + F.col("run_length") - 1
    return runs.filter(fc.has_content()).groupBy(*SHEET).agg(F.max("r").alias("max_r"), F.max(end).alias("max_c"))


def trim_trailing(runs: DataFrame) -> DataFrame:
    """Drop cells beyond the extent and clip the runs that cross it."""
    cut = runs.join(data_extent(runs), SHEET).filter((F.col("r") <= F.col("max_r")) & (F.col("c") <= F.col("max_c")))
    return cut.withColumn("run_length", F.least("run_length", F.col("max_c") - F.col("c") + 1)).drop("max_r", "max_c")


def trimmed_dimensions(runs: DataFrame, sheets: DataFrame) -> DataFrame:
    """Declared bounds with the extent as new end; sheets without data keep theirs."""
    return sheets.join(data_extent(runs), SHEET, "left").withColumns(
        {"max_row": F.coalesce("max_r", "max_row"), "max_col": F.coalesce("max_c", "max_col")}
    ).drop("max_r", "max_c")


def trim_policy(runs: DataFrame, sheets: DataFrame, sparsity: DataFrame, buffer: int = 5) -> DataFrame:
    """Sparse or clustered sheets keep a buffer around all stored cells, others are trimmed to the extent."""
    stored = runs.groupBy(*SHEET).agg(F.max("r").alias("sr"), F.max(F.col("c") + F.col("run_length") - 1).alias("sc"))
    keep = (F.col("sparsity") > 0.7) | F.col("clustered")
    j = (
        sheets.join(sparsity.select(*SHEET, "sparsity", "clustered"), SHEET)
        .join(stored, SHEET).join(data_extent(runs), SHEET, "left")
    )
    return j.select(
        *SHEET,
        F.when(keep, "conservative").otherwise("moderate").alias("policy"),
        F.when(keep, F.greatest(F.col("sr") + buffer, "max_row")).otherwise(F.coalesce("max_r", "max_row")).alias("new_max_row"),
        F.when(keep, F.greatest(F.col("sc") + buffer, "max_col")).otherwise(F.coalesce("max_c", "max_col")).alias("new_max_col"),
    )


def addressable_reduction(before: DataFrame, after: DataFrame) -> DataFrame:
    """Area before and after trimming per sheet and, in the row without a sheet, over all sheets."""
    def area(df: DataFrame, name: str) -> DataFrame:
        return df.select(
            *SHEET, ((F.col("max_row") - F.col("min_row") + 1).cast("long") * (F.col("max_col") - F.col("min_col") + 1)).alias(name)
        )

    j = area(before, "full").join(area(after, "kept"), SHEET)
    one = j.withColumn("big", (1 - F.col("kept") / F.col("full") > 0.9).cast("long"))
    return (
        one.rollup("workbook_id", "sheet_id").agg(F.sum("full").alias("full"), F.sum("kept").alias("kept"), F.sum("big").alias("major"))
        .filter("not (workbook_id is not null and sheet_id is null)")
        .withColumn("reduction", F.round(F.lit(1.0) - F.col("kept") / F.col("full"), 9))
    )


def fill_row_gaps(cells: DataFrame, sheets: DataFrame, min_width: int = 100) -> DataFrame:
    """Null cells between the first and last stored column of each row of a wide sheet.

    Only the gap before each cell is generated, from its left neighbour in the row
    (a sheet row has at most 16,384 columns), so nothing is joined back to a grid.
    """
    wide = sheets.filter(F.col("max_col") > min_width).select(*SHEET)
    w = W.partitionBy(*ROW).orderBy("c")
    gaps = (
        cells.select(*ROW, "c").join(wide, SHEET, "left_semi").withColumn("_p", F.lag("c").over(w))
        .filter(F.col("c") - F.col("_p") > 1)
        .select(*ROW, F.explode(F.sequence(F.col("_p") + 1, F.col("c") - 1)).alias("c"))
        .withColumn("vtype", F.lit("null"))
    )
    return cells.unionByName(gaps, allowMissingColumns=True)


def sheet_dimensions(cells: DataFrame, sheets: DataFrame) -> DataFrame:
    """Declared bounds where given, else the observed ones."""
    seen = cells.groupBy(*SHEET).agg(F.min("r").alias("r1"), F.min("c").alias("c1"), F.max("r").alias("r2"), F.max("c").alias("c2"))
    j = seen.join(sheets.select(*SHEET, "min_row", "min_col", "max_row", "max_col"), SHEET, "full")
    return j.select(
        *SHEET, F.coalesce("min_row", "r1").alias("min_row"), F.coalesce("min_col", "c1").alias("min_col"),
        F.coalesce("max_row", "r2").alias("max_row"), F.coalesce("max_col", "c2").alias("max_col"),
    )

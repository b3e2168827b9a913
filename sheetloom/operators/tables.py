"""Table detection on row profiles.

Every detector returns region rows (sheet, method, r1, c1, r2, c2) for all sheets
at once.  Cells are read once, by the row profile; the ordered steps run as block
scans and the look-ahead rules as plain aggregates over stop rows, so no sheet is
ever walked in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetloom.functions.durable import durable
from sheetloom.functions.scan import range_join, with_neighbours, with_row_number, with_segment_start
from sheetloom.operators.normalize import normalize_cells
from sheetloom.operators.profiles import row_profile
from sheetloom.schemas import SHEET

ROW = [*SHEET, "r"]
BOUNDS = ["min_row", "max_row", "min_col", "max_col"]
OUT = [*SHEET, "method", "r1", "c1", "r2", "c2"]


def _regions(df: DataFrame, method: str, r1, c1, r2, c2, *extra: Column) -> DataFrame:
    ends = [c if isinstance(c, Column) else F.col(c) for c in (r1, c1, r2, c2)]
    named = [e.cast("int").alias(n) for e, n in zip(ends, ("r1", "c1", "r2", "c2"))]
    return df.select(*SHEET, F.lit(method).alias("method"), *named, *extra)


def row_sequence(prof: DataFrame) -> DataFrame:
    """Row profiles with their predecessor, the blank gap before them and the two kinds of break.

    The detectors each read this several times, so it is written once: the cells
    themselves are scanned a single time whatever is detected afterwards.
    """
    d = with_neighbours(prof, SHEET, "r", ["r", "n", "mostly_numeric", "has_labels", "num_ratio", "span", "density"])
    p = F.col("prev")
    gap = F.col("r") - p["r"] - 1
    differs = (
        (F.abs(p["n"] - F.col("n")) > 2)
        | (p["mostly_numeric"] != F.col("mostly_numeric"))
        | (F.col("has_labels") & ~p["has_labels"])
        | ((gap >= 1) & F.col("mixed") & F.col("first_txt"))
    )
    shift = (
        (F.abs(p["n"] - F.col("n")) > 5)
        | (F.abs(p["num_ratio"] - F.col("num_ratio")) > 0.4)
        | (F.abs(p["span"] - F.col("span")) > 10)
        | (F.abs(p["density"] - F.col("density")) > 0.3)
    )
    return durable(d.withColumns({"prev_r": p["r"], "gap": gap, "boundary": differs, "shift": shift}).drop("prev"))


def table_boundary(seq: DataFrame) -> DataFrame:
    """Consecutive data rows around a blank gap and whether the gap separates two tables."""
    return seq.filter(F.col("gap") >= 1).select(*ROW, "prev_r", "gap", "boundary")


def regions_frozen(sheets: DataFrame) -> DataFrame:
    return _regions(sheets.filter((F.col("frozen_rows") > 0) | (F.col("frozen_cols") > 0)), "frozen_panes", "min_row", "min_col", "max_row", "max_col")


def regions_financial(seq: DataFrame) -> DataFrame:
    """Sheets whose label-only rows mostly name finance sections, as one table over all data rows."""
    label_row, data_row = F.col("first_str") & (F.col("n_right") == 0), F.col("first_str") & (F.col("n_right") > 2)
    finance = F.col("first_finance")
    per = seq.groupBy(*SHEET).agg(
        F.count_if(label_row).alias("labels"), F.count_if(label_row & finance).alias("finance"), F.count_if(data_row).alias("data"),
        F.count(F.lit(1)).alias("rows"), F.min("r").alias("ra"), F.max("r").alias("rb"), F.min("c1").alias("ca"), F.max("c2").alias("cb"),
    )
    hit = (F.col("labels") >= 2) & (F.col("data") >= 3) & (F.col("finance") >= F.col("labels") * 0.6) & (F.col("rows") >= 3)
    return _regions(per.filter(hit), "financial_statement_layout", "ra", "ca", "rb", "cb")


def regions_blank_rows(seq: DataFrame) -> DataFrame:
    """Split at gaps of four rows, or of one where the content changes; columns tightened per piece."""
    start = F.col("gap").isNull() | ((F.col("gap") >= 1) & ((F.col("gap") >= 4) | F.col("boundary")))
    seg = with_segment_start(seq, SHEET, "r", start).groupBy(*SHEET, "seg", "max_row").agg(
        F.max("r").alias("last"), F.min("c1").alias("ca"), F.max("c2").alias("cb"), F.count(F.lit(1)).alias("n")
    )
    per = seg.groupBy(*SHEET).agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("pieces"), F.max("seg").alias("final"))
    per = per.filter((F.col("rows") >= 4) & (F.col("pieces") >= 2))
    end = F.when(F.col("seg") == F.col("final"), F.col("max_row")).otherwise(F.col("last"))
    return _regions(seg.join(per, SHEET), "blank_row_separation", "seg", "ca", end, "cb")


def _with_end(seq: DataFrame, stop: Column) -> DataFrame:
    """Attach ``end``: the last data row before the next stop row after each row, else the last data row.

    The end rows are those whose next row is a stop; a reverse block scan finds the
    nearest one at or after each row, so no sheet is gathered.
    """
    d = with_neighbours(seq.withColumn("_halt", stop), SHEET, "r", ["r", "_halt"], prev=None, nxt="_nxt").withColumn("_neg", -F.col("r"))
    d = with_segment_start(d, SHEET, "_neg", F.coalesce(F.col("_nxt._halt"), F.lit(True)), "_end")
    return d.withColumn("end", (-F.col("_end")).cast("int")).drop("_halt", "_nxt", "_neg", "_end")


def regions_temporal(seq: DataFrame, head: int | None = None) -> DataFrame:
    """From each date header (of the first ``head`` rows, if given) to the next date row or two-row gap."""
    d = _with_end(seq, F.col("temporal") | F.coalesce(F.col("gap") >= 2, F.lit(False))).filter(F.col("temporal") & (F.col("end") > F.col("r")))
    if head is not None:
        d = d.filter(F.col("r") < F.col("min_row") + head)
    return _regions(d, "temporal_headers", "r", "min_col", "end", "max_col")


def regions_content(seq: DataFrame) -> DataFrame:
    per = seq.groupBy(*SHEET, *BOUNDS).agg(F.count(F.lit(1)).alias("rows"), F.min("c1").alias("ca"), F.max("c2").alias("cb"))
    return _regions(per.filter((F.col("rows") >= 3) & (F.col("ca") < F.col("cb"))), "content_structure", "min_row", "min_col", "max_row", "max_col")


def regions_multirow(seq: DataFrame, head: int | None = None) -> DataFrame:
    """Blocks of two or more header-like rows, each running to the next such block or three-row gap.

    With ``head`` only the first rows of a sheet can form a block.
    """
    label_like = F.col("has_labels") & ~F.col("mostly_numeric")
    marks = seq.filter(label_like).select(*SHEET, F.explode(F.array(F.col("r"), F.col("r") - 1, F.col("r") - 2)).alias("r"))
    ahead = marks.groupBy(*ROW).agg(F.count(F.lit(1)).alias("ahead"))
    d = seq.join(ahead, ROW, "left").withColumn("hl", label_like & (F.col("n") >= 3))
    d = _with_end(d, (F.col("hl") & (F.coalesce("ahead", F.lit(0)) >= 2)) | F.coalesce(F.col("gap") >= 3, F.lit(False)))
    if head is not None:
        d = d.withColumn("hl", F.col("hl") & (F.col("r") < F.col("min_row") + head))
    d = with_neighbours(d, SHEET, "r", ["r", "hl", "end"], prev="_before", nxt="_after")
    joins = lambda x, step: F.coalesce(x["hl"] & (x["r"] == F.col("r") + step), F.lit(False))
    d = with_segment_start(d.withColumn("_first", F.col("hl") & ~joins(F.col("_before"), -1)), SHEET, "r", F.col("_first"), "a")
    # At the last row of a block: the next data row opens the data.
    d = d.filter(F.col("hl") & ~joins(F.col("_after"), 1) & (F.col("r") > F.col("a")) & F.col("_after").isNotNull())
    return _regions(d.withColumn("_to", F.col("_after.end")), "multirow_headers", "a", "min_col", "_to", "max_col",
                    (F.col("r") - F.col("a") + 1).alias("header_rows"), F.col("_after.r").alias("data_start_row"))


def _first_wide_gap(start: str = "seg") -> Column:
    """Row before the first two-row gap inside a piece."""
    return F.min(F.when((F.col("gap") >= 2) & (F.col("r") > F.col(start)), F.struct("r", "prev_r")))["prev_r"]


def regions_column_shift(seq: DataFrame) -> DataFrame:
    """Split where count, numeric share, span or density jump; a piece ends before its first two-row gap."""
    start = F.col("gap").isNull() | F.col("shift")
    seg = with_segment_start(seq, SHEET, "r", start).groupBy(*SHEET, "seg", *BOUNDS).agg(
        _first_wide_gap().alias("cut"), F.count(F.lit(1)).alias("n")
    )
    per = seg.groupBy(*SHEET).agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("pieces"))
    seg = with_neighbours(seg.drop("n"), SHEET, "seg", ["seg"], prev=None, nxt="nxt")
    d = seg.join(per.filter((F.col("rows") >= 3) & (F.col("pieces") >= 2)), SHEET)
    end = F.coalesce("cut", F.col("nxt.seg") - 1, "max_row")
    return _regions(d, "column_continuity", "seg", "min_col", end, "max_col")


def regions_gaps(seq: DataFrame, threshold: int = 3, last_end: str = "walk") -> DataFrame:
    """Split at gaps of at least ``threshold`` rows.

    The last piece ends before its first two-row gap (``walk``) or at the sheet end
    (``max_row``); in that second form a sheet with one data row is one region.
    """
    start = F.col("gap").isNull() | (F.col("gap") >= threshold)
    seg = with_segment_start(seq, SHEET, "r", start).groupBy(*SHEET, "seg", *BOUNDS).agg(
        F.max("r").alias("last"), _first_wide_gap().alias("cut"), F.count(F.lit(1)).alias("n")
    )
    per = seg.groupBy(*SHEET).agg(F.sum("n").alias("rows"), F.max("seg").alias("final"))
    d = seg.drop("n").join(per, SHEET)
    tail = F.coalesce("cut", "max_row") if last_end == "walk" else F.col("max_row")
    end = F.when(F.col("seg") == F.col("final"), tail).otherwise(F.col("last"))
    if last_end == "walk":
        return _regions(d.filter(F.col("rows") >= 2), "gaps", "seg", "min_col", end, "max_col")
    first = F.when(F.col("rows") < 2, F.col("min_row")).otherwise(F.col("seg"))
    return _regions(d, "gaps", first, "min_col", end, "max_col")


def stored_row_sequence(cells: DataFrame, sheets: DataFrame) -> DataFrame:
    """Rows holding any stored cell, with their gaps (input of the explicit splitter)."""
    rows = cells.select(*ROW).distinct().join(sheets.select(*SHEET, *BOUNDS), SHEET)
    d = with_neighbours(rows, SHEET, "r", ["r"])
    return d.withColumn("prev_r", F.col("prev.r")).withColumn("gap", F.col("r") - F.col("prev.r") - 1).drop("prev")


def table_end_by_gap(seq: DataFrame) -> DataFrame:
    """For every data row taken as a start: last row before the next two-row gap, else the sheet end.

    A reverse block scan over negated positions finds the nearest following gap.
    """
    d = with_neighbours(seq.select(*ROW, "max_row"), SHEET, "r", ["r"], prev=None, nxt="nxt")
    d = d.withColumn("_neg", -F.col("r"))
    d = with_segment_start(d, SHEET, "_neg", F.col("nxt.r") - F.col("r") - 1 >= 2, "_stop")
    return d.select(*ROW, F.coalesce(-F.col("_stop"), F.col("max_row")).cast("int").alias("table_end"))


def clip_regions(regions: DataFrame, sheets: DataFrame) -> DataFrame:
    j = regions.join(sheets.select(*SHEET, *BOUNDS), SHEET)
    return j.withColumns(
        {"r1": F.greatest("r1", "min_row"), "r2": F.least("r2", "max_row"), "c1": F.greatest("c1", "min_col"), "c2": F.least("c2", "max_col")}
    ).filter("r1 <= r2 and c1 <= c2").drop(*BOUNDS)


def region_columns(regions: DataFrame, prof: DataFrame) -> DataFrame:
    """Occupied column range of each region's rows, else the region's own columns."""
    rows = prof.select(*ROW, F.col("c1").alias("_a"), F.col("c2").alias("_b"))
    hits = range_join(rows, regions.select(*SHEET, "r1", "r2"), SHEET, "r", "r1", "r2")
    used = hits.groupBy(*SHEET, "r1", "r2").agg(F.min("_a").alias("_a"), F.max("_b").alias("_b"))
    return regions.join(used, [*SHEET, "r1", "r2"], "left").withColumns(
        {"c1": F.coalesce("_a", "c1"), "c2": F.coalesce("_b", "c2")}
    ).drop("_a", "_b")


def regions_default(seq: DataFrame) -> DataFrame:
    return _regions(seq.select(*SHEET, *BOUNDS).distinct(), "default", "min_row", "min_col", "max_row", "max_col")


def column_overlap(cells: DataFrame) -> DataFrame:
    """Shared columns of each data row and the one before it, over the larger count (rows are at most 16,384 wide)."""
    rows = normalize_cells(cells).groupBy(*ROW).agg(F.collect_set("c").alias("cols"))
    d = with_neighbours(rows, SHEET, "r", ["r", "cols"]).filter(F.col("prev").isNotNull())
    ratio = F.size(F.array_intersect("cols", "prev.cols")) / F.greatest(F.size("cols"), F.size("prev.cols"))
    return d.select(*ROW, F.col("prev.r").alias("prev_r"), ratio.alias("overlap"), (ratio > 0.5).alias("same_table"))


def detect_tables(cells: DataFrame, sheets: DataFrame, use_gaps: bool = False, gap_threshold: int = 3) -> DataFrame:
    """Run the methods in priority order; the first that finds anything in a sheet wins there."""
    seq = row_sequence(row_profile(cells, sheets))
    if use_gaps:
        methods = [
            regions_gaps(seq, gap_threshold), regions_blank_rows(seq), regions_column_shift(seq),
            regions_temporal(seq), regions_multirow(seq), regions_content(seq), regions_default(seq),
        ]
    else:
        has_data = seq.select(*SHEET).distinct()
        methods = [
            regions_frozen(sheets).join(has_data, SHEET, "left_semi"), regions_financial(seq), regions_blank_rows(seq), regions_temporal(seq),
            regions_content(seq), regions_multirow(seq), regions_column_shift(seq), regions_default(seq),
        ]
    every = None
    for rank, m in enumerate(methods):
        m = m.withColumn("_prio", F.lit(rank))
        every = m if every is None else every.unionByName(m, allowMissingColumns=True)
    every = durable(every)  # region rows only; read twice below
    best = every.groupBy(*SHEET).agg(F.min("_prio").alias("_prio"))
    won = clip_regions(every.join(best, [*SHEET, "_prio"]).drop("_prio"), sheets)
    return with_row_number(won, SHEET, "r1", "table_no", tie=("c1",))

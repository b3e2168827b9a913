"""Header rows and columns, titles, labels and nested views of detected tables.

A table is a region row with ``table_no``.  Cells meet regions through binned
range joins (sheet, row block); label arrays only ever hold the header cells of
one row or column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sheetloom.functions import cells as fc
from sheetloom.functions import fixed
from sheetloom.functions.scan import range_join, with_row_number
from sheetloom.operators.encoding import json_value
from sheetloom.operators.normalize import normalize_cells
from sheetloom.operators.profiles import python_type
from sheetloom.schemas import SHEET

ROW = [*SHEET, "r"]
REG = [*SHEET, "table_no"]
HEAD = ["h_row", "n_hr", "h_col", "n_hc", "data_r", "data_c"]


def header_extent(regions: DataFrame, sheets: DataFrame, mode: str = "resolver") -> DataFrame:
    """Header rows are the frozen rows, else the first row; columns likewise.

    ``resolver`` always has at least one header row, ``region`` only in regions longer than one row.
    """
    j = regions.join(sheets.select(*SHEET, "frozen_rows", "frozen_cols"), SHEET)

    def count(frozen: str, lo: str, hi: str) -> Column:
        size = F.col(hi) - F.col(lo) + 1
        one = F.lit(1) if mode == "resolver" else F.when(size > 1, 1).otherwise(0)
        return F.when(F.col(frozen) > 0, F.least(F.col(frozen), size)).otherwise(one).cast("int")

    return (
        j.withColumn("h_row", F.col("r1")).withColumn("h_col", F.col("c1"))
        .withColumn("n_hr", count("frozen_rows", "r1", "r2")).withColumn("n_hc", count("frozen_cols", "c1", "c2"))
        .withColumn("data_r", F.col("r1") + F.col("n_hr")).withColumn("data_c", F.col("c1") + F.col("n_hc"))
        .drop("frozen_rows", "frozen_cols")
    )


def is_title_text(text: Column) -> Column:
    t = F.trim(text)
    numeric = F.translate(t, ".-/", "").rlike(r"^\d+$")
    dated = F.lower(t).rlike("|".join(fixed.TITLE_DATE_WORDS))
    return F.coalesce(F.length(t).between(3, 100) & ~numeric & ~dated & t.rlike(r"\p{L}"), F.lit(False))


def title_like(df: DataFrame, text: str = "value") -> DataFrame:
    return df.withColumn("title_like", is_title_text(F.col(text)))


def table_title(regions: DataFrame, cells: DataFrame) -> DataFrame:
    """The row above, else the first row, when it holds one text at the leftmost column and nothing else."""
    cand = regions.select(*REG, "c1", "c2", F.explode(F.array(F.col("r1") - 1, F.col("r1"))).alias("r"))
    hits = normalize_cells(cells).select(*ROW, "c", fc.is_text().alias("txt"), F.trim("value").alias("t")).join(cand, ROW)
    rows = hits.filter(F.col("c").between(F.col("c1"), F.col("c2"))).groupBy(*REG, "r").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.when((F.col("c") == F.col("c1")) & F.col("txt"), F.col("t"))).alias("t")
    )
    ok = rows.filter((F.col("n") == 1) & is_title_text(F.col("t")))
    best = ok.groupBy(*REG).agg(F.min(F.struct("r", "t")).alias("b"))
    return regions.join(best.select(*REG, F.col("b.t").alias("title"), F.col("b.r").alias("title_row")), REG, "left")


def cut_title_row(regions: DataFrame) -> DataFrame:
    """Start below a title that is the region's own first row; headers keep their rows."""
    return regions.withColumn("orig_r1", F.col("r1")).withColumn(
        "r1", F.when(F.col("title_row") == F.col("r1"), F.col("r1") + 1).otherwise(F.col("r1")).cast("int")
    )


def describe_tables(regions: DataFrame, cells: DataFrame, sheets: DataFrame) -> DataFrame:
    """Regions with header extent, title and the title row cut off."""
    return cut_title_row(table_title(header_extent(regions, sheets), cells))


def cells_in_region(cells: DataFrame, regions: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    g = regions.select(*REG, "r1", "r2", "c1", "c2", *extra)
    return range_join(cells, g, SHEET, "r", "r1", "r2").filter(F.col("c").between(F.col("c1"), F.col("c2")))


def _header_cells(tables: DataFrame, cells: DataFrame) -> DataFrame:
    """Valued cells of the header rows inside the column range, with their level."""
    rows = tables.filter("n_hr > 0").select(
        *REG, "c1", "c2", "h_row", F.explode(F.sequence(F.col("h_row"), F.col("h_row") + F.col("n_hr") - 1)).alias("r")
    )
    valued = cells.select(*ROW, "c", fc.value_text().alias("value")).filter(F.col("value").isNotNull())
    hit = valued.join(rows, ROW).filter(F.col("c").between(F.col("c1"), F.col("c2")))
    return hit.select(*REG, "r", "c", "value", (F.col("r") - F.col("h_row") + 1).alias("level"))


def column_labels(tables: DataFrame, cells: DataFrame, mode: str = "compact") -> DataFrame:
    """One row per table column.  Modes: compact (`` | ``, ``Column X``), verbose (reversed, blank, ``unlabeled``), plain."""
    parts = _header_cells(tables, cells).groupBy(*REG, "c").agg(F.sort_array(F.collect_list(F.struct("r", "value"))).alias("hs"))
    texts = F.transform("hs", lambda h: h["value"])
    joined = F.array_join(F.reverse(texts), " ") if mode == "verbose" else F.array_join(texts, " | ")
    default = F.concat(F.lit("Column "), fc.column_letters(F.col("c"))) if mode == "compact" else F.lit("unlabeled")
    cols = tables.select(*REG, F.explode(F.sequence("c1", "c2")).alias("c"))
    return cols.join(parts, [*REG, "c"], "left").select(*REG, "c", F.coalesce(joined, default).alias("label"))


def row_labels(tables: DataFrame, cells: DataFrame, mode: str = "compact", row_label_mode: str = "cell") -> DataFrame:
    """One row per stored data row: the texts of its header columns.

    ``row_label_mode='frozen'`` repeats the header text of the header columns on every row
    of tables with frozen rows (more than the default single header row is not required).
    """
    picked = cells.select(*ROW, "c", fc.value_text().alias("value"))
    hit = cells_in_region(picked, tables, ("h_col", "n_hc", "data_r")).filter("r >= data_r")
    in_head = F.col("c") < F.col("h_col") + F.col("n_hc")
    rows = hit.groupBy(*REG, "r").agg(
        F.sort_array(F.collect_list(F.when(in_head & F.col("value").isNotNull(), F.struct("c", "value")))).alias("hs")
    )
    default = F.concat(F.lit("Row "), F.col("r").cast("string")) if mode == "compact" else F.lit("unlabeled")
    own = F.when(F.size("hs") > 0, F.array_join(F.transform("hs", lambda h: h["value"]), " | "))
    if row_label_mode == "frozen":
        heads = _header_cells(tables, cells).join(tables.select(*REG, "h_col", "n_hc"), REG)
        heads = heads.filter(F.col("c") < F.col("h_col") + F.col("n_hc")).groupBy(*REG, "c").agg(
            F.array_join(F.transform(F.reverse(F.sort_array(F.collect_list(F.struct("r", "value")))), lambda h: h["value"]), " ").alias("t")
        )
        per = heads.groupBy(*REG).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("c", "t"))), lambda h: h["t"]), " | ").alias("own"))
        return rows.join(per, REG, "left").select(*REG, "r", F.coalesce("own", default).alias("label"))
    return rows.select(*REG, "r", F.coalesce(own, default).alias("label"))


def indent_level(indent: Column) -> Column:
    return F.greatest(F.lit(0), F.floor(F.coalesce(indent, F.lit(0)) / 2)).cast("int")


def header_hierarchy(tables: DataFrame, cells: DataFrame) -> DataFrame:
    """Header levels of every table column and row with coordinate and indent level."""
    col = _header_cells(tables, cells).select(
        *REG, F.lit("column").alias("axis"), F.col("c").alias("position"), "level", "value",
        fc.a1(F.col("r"), F.col("c")).alias("coordinate"), F.lit(0).alias("indent_level"),
    )
    picked = cells.select(*ROW, "c", "indent", fc.value_text().alias("value")).filter(F.col("value").isNotNull())
    row = cells_in_region(picked, tables, ("h_col", "n_hc")).filter(F.col("c") < F.col("h_col") + F.col("n_hc")).select(
        *REG, F.lit("row").alias("axis"), F.col("r").alias("position"), (F.col("c") - F.col("h_col") + 1).alias("level"), "value",
        fc.a1(F.col("r"), F.col("c")).alias("coordinate"), indent_level(F.col("indent")).alias("indent_level"),
    )
    return col.unionByName(row)


def data_cells(tables: DataFrame, cells: DataFrame) -> DataFrame:
    """Cells of the data area: everything but empty ones, bold text and text of ten characters or less."""
    v = cells.withColumn("value", fc.value_text()).filter(F.length("value") > 0)
    plain = (F.col("vtype") != "string") | (~F.coalesce("bold", F.lit(False)) & (F.length("value") > 10))
    return cells_in_region(v.filter(plain), tables, ("data_r", "data_c")).filter("r >= data_r and c >= data_c")


def attach_headers(tables: DataFrame, cells: DataFrame) -> DataFrame:
    """Data cells with column and row header paths and a summary of both."""
    h = header_hierarchy(tables, cells)
    item = F.struct("level", "value", "coordinate", "indent_level")
    per = h.groupBy(*REG, "axis", "position").agg(F.sort_array(F.collect_list(item)).alias("hs"))
    cols = per.filter("axis = 'column'").select(*REG, F.col("position").alias("c"), F.col("hs").alias("column_headers"))
    rows = per.filter("axis = 'row'").select(*REG, F.col("position").alias("r"), F.col("hs").alias("row_headers"))
    d = data_cells(tables, cells).select(*REG, "r", "c", "value").join(cols, [*REG, "c"], "left").join(rows, [*REG, "r"], "left")
    levels = lambda c: F.coalesce(F.size(c), F.lit(0))
    path = lambda c: F.transform(c, lambda x: x["value"])
    return d.withColumns(
        {
            "full_column_path": path("column_headers"),
            "full_row_path": path("row_headers"),
            "primary_column_header": F.get("column_headers", 0)["value"],
            "primary_row_header": F.get("row_headers", 0)["value"],
            "column_levels": F.when(F.col("column_headers").isNull(), 0).otherwise(levels("column_headers")),
            "row_levels": F.when(F.col("row_headers").isNull(), 0).otherwise(levels("row_headers")),
            "max_indent": F.coalesce(F.array_max(F.transform("row_headers", lambda x: x["indent_level"])), F.lit(0)),
        }
    )


def table_meta(tables: DataFrame, cells: DataFrame, merges: DataFrame) -> DataFrame:
    """Method, non-null and numeric cell counts, merge flag and the region before the title was cut."""
    c = cells.select(*ROW, "c", (F.col("vtype") == "number").alias("num"), python_type().isNotNull().alias("valued"))
    counts = cells_in_region(c.filter("valued"), tables).groupBy(*REG).agg(
        F.count(F.lit(1)).alias("cells"), F.count_if("num").alias("numeric_cells")
    )
    merged = merges.select(*SHEET).distinct().withColumn("merged", F.lit(True))
    return (
        tables.join(counts, REG, "left").join(merged, SHEET, "left").fillna(0, ["cells", "numeric_cells"])
        .select(*REG, "method", "title", "r1", "c1", "r2", "c2", "orig_r1", "cells", "numeric_cells", F.coalesce("merged", F.lit(False)).alias("merged"))
    )


def _first_rows(cells: DataFrame) -> DataFrame:
    return cells.groupBy(*SHEET).agg(F.min("r").alias("first_r"))


def simple_table_view(cells: DataFrame) -> DataFrame:
    """The whole sheet as one table: each later row as an array padded with blanks from column 1 on."""
    body = cells.join(_first_rows(cells), SHEET).filter("r > first_r")
    rows = body.groupBy(*ROW).agg(
        F.max("c").alias("width"), F.collect_list(F.struct("c", F.coalesce(fc.value_text(), F.lit("")).alias("v"))).alias("vs")
    )
    found = F.map_from_entries("vs")
    return rows.withColumn("found", found).select(
        *ROW, F.transform(F.sequence(F.lit(1), "width"), lambda i: F.coalesce(F.try_element_at("found", i), F.lit(""))).alias("row_values")
    )


def simple_table_cells(cells: DataFrame) -> DataFrame:
    """Cells of the later rows with the first row's text of their column and the text of column 1 of their row."""
    v = cells.select(*ROW, "c", fc.value_text().alias("value"))
    first = _first_rows(cells)
    heads = v.join(first.withColumnRenamed("first_r", "r"), ROW).select(*SHEET, "c", F.coalesce("value", F.lit("")).alias("column_header"))
    body = v.join(first, SHEET).filter("r > first_r").drop("first_r")
    w = W.partitionBy(*ROW)
    body = body.withColumn("row_header", F.max(F.when(F.col("c") == 1, F.coalesce("value", F.lit("None")))).over(w))
    return body.join(heads, [*SHEET, "c"])


def records_view(tables: DataFrame, cells: DataFrame) -> DataFrame:
    """Data rows as label -> value records; of columns with equal labels the last one counts."""
    labels = column_labels(tables, cells)
    v = cells.select(*ROW, "c", fc.value_text().alias("value")).filter(F.col("value").isNotNull())
    hit = cells_in_region(v, tables, ("data_r",)).filter("r >= data_r").join(labels, [*REG, "c"])
    last = hit.groupBy(*REG, "r", "label").agg(F.max(F.struct("c", "value")).alias("x"))
    return last.groupBy(*REG, "r").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("label", F.col("x.value").alias("value"))))).alias("record")
    )


def table_counts_meta(tables: DataFrame, cells: DataFrame, merges: DataFrame) -> DataFrame:
    """Stored cells per table and a merge flag that is null instead of false."""
    counts = cells_in_region(cells.select(*ROW, "c"), tables).groupBy(*REG).agg(F.count(F.lit(1)).alias("cell_count"))
    merged = merges.select(*SHEET).distinct().withColumn("has_merged_cells", F.lit(True))
    return tables.select(*REG, "method").join(counts, REG).join(merged, SHEET, "left")


def label_lookup(tables: DataFrame, cells: DataFrame) -> DataFrame:
    """Labels of a cell by its offset from the data start and the region's first column, null outside the lists."""
    rows = with_row_number(row_labels(tables, cells), REG, "r", "rn").select(*REG, (F.col("rn") - 1).alias("off"), F.col("label").alias("row_label"))
    cols = column_labels(tables, cells).select(*REG, "c", F.col("label").alias("col_label"))
    d = cells_in_region(cells.select(*ROW, "c"), tables, ("data_r",)).withColumn("off", (F.col("r") - F.col("data_r")).cast("long"))
    return d.join(rows, [*REG, "off"], "left").join(cols, [*REG, "c"], "left").select(*REG, "r", "c", "row_label", "col_label")


def trim_region_right(regions: DataFrame, cells: DataFrame, keep: int = 3) -> DataFrame:
    """Pull the right edge in to the last column with more than one meaningful cell (one suffices near the left)."""
    t = F.trim(fc.value_text())
    strict = F.length(t) > 0
    strict = strict & (F.translate(t, ".-,", "").rlike(r"^\d+$") | (F.length(t) > 1) | t.rlike(r"^[\p{L}\p{N}]$"))
    cols = cells_in_region(cells.filter(strict).select(*ROW, "c"), regions).groupBy(*REG, "c").agg(F.count(F.lit(1)).alias("n"), F.first("c1").alias("c1"))
    last = cols.filter((F.col("n") > 1) | (F.col("c") - F.col("c1") < keep)).groupBy(*REG).agg(F.max("c").alias("last"))
    d = regions.join(last, REG, "left").withColumn("last", F.coalesce("last", "c1"))
    widen = (F.col("last") - F.col("c1") < 2) & (F.col("c2") - F.col("c1") >= 2)
    return d.withColumn("c2", F.when(widen, F.least("c2", F.col("c1") + 2)).otherwise(F.col("last"))).drop("last")


def write_table_objects(tables: DataFrame, cells: DataFrame, rows_per_object: int = 4096) -> DataFrame:
    """Nested row and column objects of each table as ``coordinate -> value`` JSON.

    A row object is bounded by the sheet width.  A column is cut into objects of
    ``rows_per_object`` rows, so a long column is never gathered into one value.
    """
    v = cells.filter("vtype <> 'null'").select(*ROW, "c", json_value().alias("j"))
    hit = cells_in_region(v, tables)
    entry = lambda order: F.struct(F.col(order), F.concat(F.lit('"'), fc.a1(F.col("r"), F.col("c")), F.lit('":'), F.col("j")).alias("e"))
    text = lambda order: F.concat(F.lit("{"), F.array_join(F.transform(F.sort_array(F.collect_list(entry(order))), lambda x: x["e"]), ","), F.lit("}"))
    rows = hit.groupBy(*REG, "r").agg(text("c").alias("cells")).select(
        *REG, F.lit("row").alias("axis"), F.col("r").alias("index"), F.lit(0).cast("long").alias("part"), "cells"
    )
    part = F.floor(F.col("r") / rows_per_object).cast("long")
    cols = hit.withColumn("part", part).groupBy(*REG, "c", "part").agg(text("r").alias("cells")).select(
        *REG, F.lit("column").alias("axis"), F.col("c").alias("index"), "part", "cells"
    )
    return rows.unionByName(cols)


# ---- per-file counts ---------------------------------------------------------


def route_by_size(cells: DataFrame, bytes_per_cell: int = 200, limit: int = 5 * 1024 * 1024) -> DataFrame:
    """Estimated size per workbook and whether its full result or only a summary is kept."""
    per = cells.groupBy("workbook_id").agg(F.count(F.lit(1)).alias("stored"))
    size = F.col("stored") * bytes_per_cell
    return per.withColumn("estimated_bytes", size).withColumn("route", F.when(size > limit, "summary").otherwise("full"))


def workbook_stats(cells: DataFrame, sheets: DataFrame, merges: DataFrame, tables: DataFrame) -> DataFrame:
    value = fc.value_text()
    a = cells.groupBy("workbook_id").agg(
        F.count(F.lit(1)).alias("total_cells"), F.count_if(F.length(value) > 0).alias("non_empty_cells"),
        F.count_if(F.length("formula") > 0).alias("formula_cells"), F.count_if(F.col("vtype") == "number").alias("total_numbers"),
    )
    b = sheets.groupBy("workbook_id").agg(
        F.count(F.lit(1)).alias("total_sheets"), F.count_if((F.col("frozen_rows") > 0) | (F.col("frozen_cols") > 0)).alias("frozen_sheets")
    )
    c = merges.groupBy("workbook_id").agg(F.count(F.lit(1)).alias("merged_cells"))
    d = tables.groupBy("workbook_id").agg(F.count(F.lit(1)).alias("total_tables"))
    return b.join(a, "workbook_id", "left").join(c, "workbook_id", "left").join(d, "workbook_id", "left").fillna(0)


def file_counts(cells: DataFrame, sheets: DataFrame, tables: DataFrame) -> DataFrame:
    w = workbook_stats(cells, sheets, sheets.limit(0), tables)
    return w.select("workbook_id", F.col("total_sheets").alias("sheet_count"), F.col("total_tables").alias("table_count"), F.col("total_numbers").alias("numeric_cells"))


def large_file_summary(tables: DataFrame, cells: DataFrame, sheets: DataFrame) -> DataFrame:
    """Tables, row and column labels and numeric cells per sheet, with the workbook total in the row without a sheet."""
    rows = range_join(cells.select(*ROW).distinct(), tables.select(*REG, "data_r", "r2"), SHEET, "r", "data_r", "r2")
    n_rows = rows.groupBy(*SHEET).agg(F.count(F.lit(1)).alias("row_labels"))
    n_cols = tables.groupBy(*SHEET).agg(F.count(F.lit(1)).alias("tables"), F.sum(F.col("c2") - F.col("c1") + 1).alias("col_labels"))
    nums = cells.groupBy(*SHEET).agg(F.count_if(F.col("vtype") == "number").alias("numeric_cells"))
    j = sheets.select(*SHEET).join(n_cols, SHEET, "left").join(n_rows, SHEET, "left").join(nums, SHEET, "left").fillna(0)
    return (
        j.rollup(*SHEET).agg(*[F.sum(x).alias(x) for x in ("tables", "row_labels", "col_labels", "numeric_cells")])
        .filter("workbook_id is not null")
    )

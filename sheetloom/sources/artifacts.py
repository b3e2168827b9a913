"""Readers of stored JSON artefacts, file listings and run metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetloom.functions import cells as fc
from sheetloom.functions import fixed
from sheetloom.schemas import SHEET

VERBOSE_SCHEMA = (
    "workbook_id BIGINT, sheet_id BIGINT, name STRING, "
    "cells MAP<STRING, STRUCT<value: STRING, data_type: STRING, formula: STRING, row: INT, column: INT>>"
)
PDF_SCHEMA = (
    "doc_id BIGINT, pdf_processing_result STRUCT<text_content: STRUCT<pages: ARRAY<STRUCT<page_number: INT, sections: ARRAY<STRUCT<"
    "section_id: STRING, content: STRING, numbers: ARRAY<STRUCT<value: DOUBLE, original_text: STRING, format: STRING>>>>>>>>"
)


def read_verbose_cells(spark: SparkSession, path: str) -> DataFrame:
    """Verbose sheet JSON lines to typed cell rows; the schema is given, so no inference pass runs."""
    d = spark.read.schema(VERBOSE_SCHEMA).json(path)
    d = d.select(*SHEET, F.explode("cells").alias("ref", "cell"))
    t, v = F.coalesce("cell.data_type", F.lit("string")), F.col("cell.value")
    return d.select(
        *SHEET, F.coalesce("cell.row", fc.a1_row(F.col("ref"))).alias("r"), F.coalesce("cell.column", fc.a1_col(F.col("ref"))).alias("c"), t.alias("vtype"),
        F.when(t.isin("string", "date", "error"), v).alias("vtext"), F.when(t == "number", v.try_cast("double")).alias("vnum"),
        F.when(t == "boolean", v.try_cast("boolean")).alias("vbool"), F.col("cell.formula").alias("formula"),
    )


def read_compact_cells(spark: SparkSession, path: str) -> DataFrame:
    """Compact row JSON ``{r, style?, cells: [[col, value, style?, formula?, run?]]}`` to cell runs.

    Cells are positional arrays of mixed types, which a VARIANT keeps apart.  Lines that
    are no JSON give no rows; ``rejected_lines`` lists them.
    """
    d = spark.read.text(path).select(F.try_parse_json("value").alias("v"))
    get = lambda v, p, t: F.try_variant_get(v, p, t)
    d = d.select(
        get("v", "$.workbook_id", "bigint").alias("workbook_id"), get("v", "$.sheet_id", "bigint").alias("sheet_id"), get("v", "$.r", "int").alias("r"),
        get("v", "$.style", "string").alias("row_style"), F.explode(get("v", "$.cells", "array<variant>")).alias("cell"),
    )
    kind = F.schema_of_variant(get("cell", "$[1]", "variant"))
    kind = F.when(kind.isNull() | (kind == "VOID"), "null").when(kind == "STRING", "string").when(kind == "BOOLEAN", "boolean").otherwise("number")
    d = d.withColumn("vtype", kind)
    return d.select(
        *SHEET, "r", get("cell", "$[0]", "int").alias("c"), "vtype",
        F.when(F.col("vtype") == "string", get("cell", "$[1]", "string")).alias("vtext"),
        F.when(F.col("vtype") == "number", get("cell", "$[1]", "double")).alias("vnum"),
        F.when(F.col("vtype") == "boolean", get("cell", "$[1]", "boolean")).alias("vbool"),
        F.coalesce(get("cell", "$[2]", "string"), "row_style").alias("style"), get("cell", "$[3]", "string").alias("formula"),
        F.coalesce(get("cell", "$[4]", "int"), F.lit(1)).alias("run_length"),
    )


def rejected_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line) of every line that is not JSON."""
    d = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"))
    return d.filter(F.try_parse_json("line").isNull() & (F.length(F.trim("line")) > 0))


def _documents(spark: SparkSession, path: str) -> DataFrame:
    """One VARIANT per file; files that are no JSON give none."""
    d = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.try_parse_json("value").alias("v"))
    return d.filter(F.col("v").isNotNull())


def read_workbooks(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Workbook JSON files ``{workbook: {sheets: [{name, cells: {A1: {...}}}]}}`` to (sheets, cells).

    Sheets and cells are unfolded from the VARIANT row by row, never gathered in a map.
    Cell values keep their type; style, comment and hyperlink stay JSON texts.
    """
    text = lambda v, p: F.to_json(F.try_variant_get(v, p, "variant"))
    sheet_rows = spark.sql(
        "SELECT file, CAST(s.pos AS INT) AS sheet_no, s.value AS sheet FROM {d}, LATERAL variant_explode_outer(try_variant_get(v, '$.workbook.sheets', 'variant')) AS s",
        d=_documents(spark, path),
    ).filter("sheet IS NOT NULL")
    get = lambda p, t, v="sheet": F.try_variant_get(v, p, t)
    sheets = sheet_rows.select(
        "file", "sheet_no", get("$.name", "string").alias("name"), get("$.state", "string").alias("state"),
        *(get(f"$.dimensions.{k}", "int").alias(k) for k in ("min_row", "min_col", "max_row", "max_col")), get("$.frozen_panes.frozen_rows", "int").alias("frozen_rows"),
        get("$.frozen_panes.frozen_cols", "int").alias("frozen_cols"),
    )
    cell_rows = spark.sql(
        "SELECT file, sheet_no, c.key AS ref, c.value AS cell FROM {d}, LATERAL variant_explode(try_variant_get(sheet, '$.cells', 'variant')) AS c", d=sheet_rows
    )
    kind = F.schema_of_variant(F.try_variant_get("cell", "$.value", "variant"))
    vtype = (
        F.when(get("$.is_error", "boolean", "cell"), "error").when(get("$.is_date", "boolean", "cell"), "date").when(kind.isNull() | (kind == "VOID"), "null")
        .when(kind == "STRING", "string").when(kind == "BOOLEAN", "boolean").otherwise("number")
    )
    cells = cell_rows.withColumn("vtype", vtype).select(
        "file", "sheet_no", F.coalesce(get("$.row", "int", "cell"), fc.a1_row(F.col("ref"))).alias("r"), F.coalesce(get("$.column", "int", "cell"), fc.a1_col(F.col("ref"))).alias("c"),
        "vtype", F.when(F.col("vtype").isin("string", "date", "error"), get("$.value", "string", "cell")).alias("vtext"),
        F.when(F.col("vtype") == "number", get("$.value", "double", "cell")).alias("vnum"), F.when(F.col("vtype") == "boolean", get("$.value", "boolean", "cell")).alias("vbool"),
        get("$.formula", "string", "cell").alias("formula"), *(F.nullif(text("cell", f"$.{k}"), F.lit("null")).alias(k) for k in ("style", "comment", "hyperlink")),
    )
    return sheets, cells


def read_compact_sheets(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Compact sheet JSON files (one sheet, or ``{workbook: {sheets: [...]}}``) to (sheets, merges, cell runs).

    A row's style holds for its cells without their own; a fifth part of a cell is its run length.
    """
    whole = spark.sql(
        "SELECT file, CAST(s.pos AS INT) AS sheet_no, s.value AS sheet FROM {d}, LATERAL variant_explode("
        "coalesce(try_variant_get(v, '$.workbook.sheets', 'variant'), try_variant_get(v, '$.sheets', 'variant'), parse_json('[' || to_json(v) || ']'))) AS s",
        d=_documents(spark, path),
    )
    get = lambda p, t, v="sheet": F.try_variant_get(v, p, t)
    sheets = whole.select(
        "file", "sheet_no", get("$.name", "string").alias("name"), *(get(f"$.dimensions[{i}]", "int").alias(k) for i, k in enumerate(("min_row", "min_col", "max_row", "max_col"))),
        F.coalesce(get("$.frozen[0]", "int"), F.lit(0)).alias("frozen_rows"), F.coalesce(get("$.frozen[1]", "int"), F.lit(0)).alias("frozen_cols"),
    )
    merges = whole.select("file", "sheet_no", F.explode(get("$.merged", "array<array<int>>")).alias("m")).select("file", "sheet_no", *(F.get("m", i).alias(k) for i, k in enumerate(("r1", "c1", "r2", "c2"))))
    cells = spark.sql(
        "SELECT file, sheet_no, try_variant_get(w.value, '$.r', 'int') AS r, try_variant_get(w.value, '$.style', 'string') AS row_style, c.value AS cell FROM {d}, "
        "LATERAL variant_explode(try_variant_get(sheet, '$.rows', 'variant')) AS w, LATERAL variant_explode(try_variant_get(w.value, '$.cells', 'variant')) AS c",
        d=whole,
    )
    kind = F.schema_of_variant(F.try_variant_get("cell", "$[1]", "variant"))
    cells = cells.withColumn("vtype", F.when(kind.isNull() | (kind == "VOID"), "null").when(kind == "STRING", "string").when(kind == "BOOLEAN", "boolean").otherwise("number")).select(
        "file", "sheet_no", "r", get("$[0]", "int", "cell").alias("c"), "vtype", F.when(F.col("vtype") == "string", get("$[1]", "string", "cell")).alias("vtext"),
        F.when(F.col("vtype") == "number", get("$[1]", "double", "cell")).alias("vnum"), F.when(F.col("vtype") == "boolean", get("$[1]", "boolean", "cell")).alias("vbool"),
        F.coalesce(get("$[2]", "string", "cell"), "row_style").alias("style"), get("$[3]", "string", "cell").alias("formula"), F.coalesce(get("$[4]", "int", "cell"), F.lit(1)).alias("run_length"),
    )
    return sheets, merges, cells


def read_pdf_result(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Document result JSON lines to (sections, numbers) rows."""
    d = spark.read.schema(PDF_SCHEMA).json(path)
    pages = d.select("doc_id", F.explode("pdf_processing_result.text_content.pages").alias("p"))
    secs = pages.select("doc_id", F.col("p.page_number").alias("page_no"), F.posexplode("p.sections").alias("i", "s"))
    secs = secs.withColumn("section_no", F.col("i") + 1)
    key = ["doc_id", "page_no", "section_no"]
    nums = secs.select(*key, F.explode("s.numbers").alias("n")).select(*key, "n.value", "n.original_text", "n.format")
    return secs.select(*key, F.col("s.section_id").alias("section_id"), F.col("s.content").alias("content")), nums


def extension(name: Column) -> Column:
    return F.when(name.contains("."), F.lower(F.substring_index(name, ".", -1))).otherwise("")


def content_type(name: Column) -> Column:
    kinds = F.create_map(*[F.lit(x) for kv in fixed.CONTENT_TYPES.items() for x in kv])
    return F.coalesce(F.try_element_at(kinds, extension(name)), F.lit(fixed.DEFAULT_CONTENT_TYPE))


def file_manifest(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """Files below a folder with size, time, type and whether uploads accept them; the content column is never read."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder)
    key = F.substring_index("path", "/", -1)
    return d.select(
        key.alias("key"), F.element_at(F.split("path", "/"), -2).alias("storage_type"), F.col("length").alias("size"), "modificationTime",
        content_type(key).alias("content_type"), extension(key).isin(fixed.UPLOAD_EXTENSIONS).alias("uploadable"),
    )


def list_runs(runs: DataFrame) -> DataFrame:
    """Newest first, runs without a creation time last."""
    return runs.orderBy(F.coalesce("created_at", F.lit("")).desc())


def run_slug(df: DataFrame, name: str = "filename", ts: str = "ts", max_len: int = 24) -> DataFrame:
    """Directory name of a run: cleaned, cut stem and UTC stamp (a partition column for run output)."""
    stem = F.regexp_replace(F.substring_index(F.col(name), "/", -1), r"(?<=[^.])\.[^.]*$", "")
    slug = F.substring(F.regexp_replace(F.regexp_replace(F.lower(stem), r"[^\p{L}\p{N}]+", "-"), "^-+|-+$", ""), 1, max_len)
    slug = F.when(slug == "", "run").otherwise(slug)
    return df.withColumn("run_dir", F.concat_ws("-", slug, F.date_format(ts, "yyyyMMdd-HHmmss")))


def run_bundle(meta: DataFrame, processed: DataFrame, tables: DataFrame, cached: DataFrame | None = None, key: str = "processing_id") -> DataFrame:
    """A run's metadata with its artefacts, missing ones null; a stored result wins over the cached copy."""
    d = meta.join(processed, key, "left").join(tables, key, "left")
    if cached is None:
        return d
    return d.join(cached.withColumnRenamed("result", "_cached"), key, "left").withColumn("result", F.coalesce("result", "_cached")).drop("_cached")

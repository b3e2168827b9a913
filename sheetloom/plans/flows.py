"""Queries of the readers, run metadata and streaming twins."""

import uuid

from pyspark.sql import functions as F

from sheetloom.functions.durable import shared_folder
from sheetloom.operators import encoding, numbers
from sheetloom.plans.ctes import SHARED
from sheetloom.plans.encoding import enc
from sheetloom.plans.numbers import ID
from sheetloom.plans.registry import query
from sheetloom.plans.reports import run_meta
from sheetloom.schemas import SHEET
from sheetloom.sources import artifacts as src
from sheetloom.streaming import flows

S = "workbook_id, sheet_id"


def fresh(t, name: str) -> str:
    return f"{shared_folder(t.spark)}/{name}-{uuid.uuid4().hex}"


def verbose_files(t):
    """Verbose JSON lines, one sheet each (the sheets of these inputs are small)."""
    cell = F.struct(
        encoding.fc.value_text().alias("value"), F.col("vtype").alias("data_type"), "formula", F.when(F.col("c") % 2 == 0, F.col("r")).alias("row"), F.when(F.col("c") % 2 == 0, F.col("c")).alias("column")
    )
    d = t.cells.withColumn("ref", encoding.fc.a1(F.col("r"), F.col("c"))).groupBy(*SHEET).agg(F.map_from_entries(F.collect_list(F.struct("ref", cell.alias("cell")))).alias("cells"))
    path = fresh(t, "verbose")
    d.write.json(path)
    return path


def compact_files(t):
    rows = encoding.write_compact_sheets(enc(t))
    text = F.concat(F.lit('{"workbook_id":'), F.col("workbook_id").cast("string"), F.lit(',"sheet_id":'), F.col("sheet_id").cast("string"), F.lit(","), F.substring("json", 2, 1 << 30))
    path = fresh(t, "compact")
    rows.select(text.alias("value")).write.text(path)
    return path


def pdf_files(t):
    found = numbers.resolve_overlaps(t.sections).groupBy("doc_id", "page_no").agg(
        F.sort_array(F.collect_list(F.struct("start", "value", F.col("text").alias("original_text"), F.col("fmt").alias("format")))).alias("ns"))
    d = t.sections.join(found, ["doc_id", "page_no"], "left")
    nums = F.transform("ns", lambda n: F.struct(n["value"].alias("value"), n["original_text"].alias("original_text"), n["format"].alias("format")))
    sec = F.struct(F.lit("s1").alias("section_id"), "content", nums.alias("numbers"))
    page = F.struct(F.col("page_no").alias("page_number"), F.array(sec).alias("sections"))
    path = fresh(t, "pdf")
    d.select("doc_id", F.struct(F.struct(F.array(page).alias("pages")).alias("text_content")).alias("pdf_processing_result")).write.json(path)
    return path


query("read_verbose_cells", lambda t: src.read_verbose_cells(t.spark, verbose_files(t)), "cells",
      f"SELECT {S}, r, c, vtype, vtext, vnum, vbool, formula FROM cells")
query("read_compact_cells", lambda t: src.read_compact_cells(t.spark, compact_files(t)).select(*SHEET, "r", "c", "vtype", "vnum", "style", "formula", "run_length"), "rle",
      f"""SELECT {S}, r, c, vtype, vnum, coalesce(style, CASE WHEN one THEN st END) AS style, formula, run_length FROM (SELECT *, count(DISTINCT style) OVER (PARTITION BY {S}, r) = 1 AS one, max(style) OVER (PARTITION BY {S}, r) AS st FROM rle) x""")
query("read_pdf_result", lambda t: src.read_pdf_result(t.spark, pdf_files(t))[1].withColumn("value", F.round("value", 9)), "kept",
      "SELECT doc_id, page_no, CAST(section_no AS INT) AS section_no, round(value, 9) AS value, text AS original_text, fmt AS format FROM kept")
query("list_runs", lambda t: src.list_runs(run_meta(t).select("processing_id", "filename", F.when(F.col("processing_id") % 7 != 0, F.date_format("created_at", "yyyy-MM-dd HH:mm:ss")).alias("created_at"))), "runs",
      "SELECT processing_id, filename, CASE WHEN processing_id % 7 <> 0 THEN strftime(created_at, '%Y-%m-%d %H:%M:%S') END AS created_at FROM runs")
NAME = "CASE WHEN o_orderkey % 50 = 0 THEN '__.xlsx' ELSE 'up/' || o_orderpriority || ' (' || CAST(o_orderkey AS STRING) || ')  Été.Report v2.xlsx' END"
query("run_slug", lambda t: src.run_slug(t.spark.sql(f"SELECT o_orderkey, {NAME} AS filename, o_orderdate AS ts FROM {{o}}", o=t.orders)).select("o_orderkey", "run_dir"), "orders",
      f"""SELECT o_orderkey, coalesce(nullif(substr(regexp_replace(regexp_replace(lower(regexp_replace(replace(f, 'up/', ''), '\\.[^.]*$', '')), '[^\\p{{L}}\\p{{N}}]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 24), ''), 'run') || '-' || strftime(o_orderdate, '%Y%m%d-%H%M%S') AS run_dir
 FROM (SELECT *, {NAME} AS f FROM orders) x""")


def _artefacts(t, status: str, name: str, column: str):
    return t.processing.filter(F.col("status") == status).groupBy("processing_id").agg(F.concat(F.lit(name), F.max("seq").cast("string")).alias(column))


query("run_bundle",
      lambda t: src.run_bundle(run_meta(t).select("processing_id", "filename"), _artefacts(t, "completed", "full-", "result").filter("processing_id % 3 <> 0"), _artefacts(t, "processing", "table-", "tables"), _artefacts(t, "failed", "cache-", "result")), "runs processing",
      """SELECT processing_id, filename, coalesce(a, c) AS result, b AS tables FROM (SELECT processing_id, filename FROM runs) r
 LEFT JOIN (SELECT processing_id, 'full-' || max(seq) AS a FROM processing WHERE status='completed' AND processing_id % 3 <> 0 GROUP BY ALL) x USING (processing_id)
 LEFT JOIN (SELECT processing_id, 'table-' || max(seq) AS b FROM processing WHERE status='processing' GROUP BY ALL) y USING (processing_id)
 LEFT JOIN (SELECT processing_id, 'cache-' || max(seq) AS c FROM processing WHERE status='failed' GROUP BY ALL) z USING (processing_id)""")


def ingest(t):
    source, target = fresh(t, "arriving"), fresh(t, "ingested")
    t.sections.write.parquet(source)
    # A batch of four files for every core: fewer would leave cores idle while the last file of each batch runs.
    files = 4 * t.spark.sparkContext.defaultParallelism
    flows.ingest_stream(t.spark, source, t.sections.schema, lambda d: numbers.resolve_overlaps(d).select(*ID, F.round("value", 9).alias("value"), "confidence"), target, fresh(t, "progress"), files)
    return t.spark.read.parquet(target)


query("ingest_stream", ingest, "kept", f"SELECT {', '.join(ID)}, round(value, 9) AS value, confidence FROM kept")
SHARED["last"] = (
    """SELECT processing_id, coalesce(status, 'completed') AS status, type, filename, ts, seq FROM processing QUALIFY row_number() OVER (PARTITION BY processing_id ORDER BY ts DESC, seq DESC) = 1""", ["processing"])
query("latest_status", lambda t: flows.latest_status(t.processing, t.customer.select(F.col("c_custkey").alias("processing_id"))).select("processing_id", "status", "type", "filename", "seq"), "last customer",
      "SELECT c_custkey AS processing_id, coalesce(status, 'not_found') AS status, type, filename, seq FROM customer LEFT JOIN last ON processing_id = c_custkey")


def status_stream(t):
    source, target = fresh(t, "events"), fresh(t, "status")
    d = t.processing.withColumn("ts", F.col("ts").cast("timestamp"))
    d.write.parquet(source)
    flows.latest_status_stream(t.spark, source, d.schema, target, fresh(t, "progress"))
    return flows.latest_status(t.spark.read.parquet(f"{target}/*")).select("processing_id", "status", "type", "filename", "seq")


query("latest_status_stream", status_stream, "last", "SELECT processing_id, status, type, filename, seq FROM last")


def _records(t):
    return flows.latest_status(t.processing).withColumns({
        "processed_key": F.when(F.col("seq") % 2 == 0, F.concat(F.lit("p/"), F.col("seq").cast("string"))), "table_key": F.when(F.col("seq") % 4 == 0, F.concat(F.lit("t/"), F.col("seq").cast("string"))),
        "file_id": F.when(F.col("seq") % 3 == 0, F.concat(F.lit("f"), F.col("seq").cast("string")))})


query("completion_messages", lambda t: flows.completion_messages(_records(t)), "last",
      """SELECT CAST(processing_id AS VARCHAR) AS key, '{"type":"' || type || '","filename":"' || filename || '","processing_id":"' || processing_id || '","status":"' || status || '","results_endpoints":{"full":"/api/results/' || processing_id || '/full","table":"/api/results/'
 || processing_id || '/table","meta":"/api/results/' || processing_id || '/meta","status":"/api/status/' || processing_id || '/"}' || CASE WHEN seq % 2 = 0 THEN ',"storage_keys":{"processed_json":{"key":"p/' || seq || '","storage_type":"processed_json"}'
 || CASE WHEN seq % 4 = 0 THEN ',"table_data":{"key":"t/' || seq || '","storage_type":"table_data"}' ELSE '' END || '}' ELSE '' END || CASE WHEN seq % 3 = 0 THEN ',"cache_handle":{"file_id":"f' || seq || '"}' ELSE '' END || '}' AS value FROM last WHERE status IN ('completed', 'failed')""")

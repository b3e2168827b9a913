"""Queries of the run-length and style encodings."""

from pyspark.sql import functions as F

from sheetloom.operators import encoding as op
from sheetloom.operators import profiles
from sheetloom.plans.ctes import LETTERS, SHARED, VALUE
from sheetloom.plans.registry import query
from sheetloom.schemas import SHEET

S, R = "workbook_id, sheet_id", "workbook_id, sheet_id, r"
RC = [*SHEET, "r", "c"]
BODY = "vtype, vnum, style, formula"

SHARED["rlerun"] = (
    f"""SELECT {R}, run, {BODY}, CAST(count(*) AS INT) AS len, any_value(width) AS width FROM (
 SELECT *, max(CASE WHEN fresh THEN c END) OVER (PARTITION BY {R} ORDER BY c) AS run FROM (
  SELECT {R}, c, {BODY}, count(*) OVER (PARTITION BY {R}) AS width,
   NOT coalesce(lag(c) OVER w = c - 1 AND lag(vtype) OVER w IS NOT DISTINCT FROM vtype AND lag(vnum) OVER w IS NOT DISTINCT FROM vnum
    AND lag(style) OVER w IS NOT DISTINCT FROM style AND lag(formula) OVER w IS NOT DISTINCT FROM formula, false) AS fresh
  FROM wide WINDOW w AS (PARTITION BY {R} ORDER BY c)) a) b GROUP BY ALL""",
    ["wide"],
)
PACK = "(width > 20 AND len >= CASE WHEN vtype = 'null' THEN 2 WHEN width > 1000 THEN 2 ELSE 3 END)"
SHARED["rle"] = (
    f"""SELECT {R}, run AS c, len AS run_length, {BODY} FROM rlerun WHERE {PACK}
 UNION ALL SELECT {R}, CAST(unnest(range(run, run + len)) AS INT), 1, {BODY} FROM rlerun WHERE NOT {PACK}""",
    ["rlerun"],
)
Q = "CASE WHEN {0} IS NOT NULL THEN CAST(to_json({0}) AS VARCHAR) END"
JV = f"""CASE WHEN vtype IN ('string','date','error') THEN {Q.format('vtext')} WHEN vtype='boolean' THEN CAST(vbool AS VARCHAR) ELSE coalesce({VALUE}, 'null') END"""
CELL = f"""('[' || c || ',' || {JV} || CASE WHEN style IS NOT NULL OR formula IS NOT NULL OR run_length > 1 THEN ',' || coalesce({Q.format('style')}, 'null') ELSE '' END
 || CASE WHEN formula IS NOT NULL OR run_length > 1 THEN ',' || coalesce({Q.format('formula')}, 'null') ELSE '' END || CASE WHEN run_length > 1 THEN ',' || run_length ELSE '' END || ']')"""
VERB = f"""('{{"coordinate":"' || {LETTERS.format('c')} || r || '","row":' || r || ',"column":' || c || ',"data_type":"' || vtype || '","value":' || {JV}
 || coalesce(',"style":' || {Q.format('style')}, '') || coalesce(',"formula":' || {Q.format('formula')}, '') || '}}')"""
SHARED["styles"] = (
    """SELECT workbook_id, style, 's' || row_number() OVER (PARTITION BY workbook_id ORDER BY seen) AS style_id FROM (
 SELECT workbook_id, style, min((sheet_id, r, c)) AS seen FROM cells WHERE length(style) > 0 GROUP BY ALL) x""",
    ["cells"],
)
SHARED["rowstyle"] = (
    f"SELECT {R}, min(style) AS row_style FROM cells GROUP BY ALL HAVING count(DISTINCT style) = 1",
    ["cells"],
)

enc = lambda t: op.rle_encode(t.wide)

query("rle_encode", lambda t: enc(t).select(*RC, "run_length", "vtype", "vnum", "style", "formula"), "rle", f"SELECT {R}, c, run_length, {BODY} FROM rle")
query("rle_decode", lambda t: op.rle_decode(enc(t)).select(*RC, "vtype", "vnum", "style", "formula"), "wide", f"SELECT {R}, c, {BODY} FROM wide")
query("rle_stats", lambda t: op.rle_stats(enc(t)), "rle",
      f"""SELECT *, round((1 - cells_after / cells_before) * 100, 2) AS ratio_percent FROM (SELECT count(*) FILTER (after < before) AS rows_compressed, CAST(sum(before) AS BIGINT) AS cells_before,
 CAST(sum(after) AS BIGINT) AS cells_after, CAST(sum(runs) AS BIGINT) AS runs_created
 FROM (SELECT {R}, sum(run_length) AS before, count(*) AS after, count(*) FILTER (run_length > 1) AS runs FROM rle GROUP BY ALL) x) y""")
query("rle_counts", lambda t: op.rle_counts(enc(t)), "rle",
      f"""SELECT {S}, count(*) AS stored, CAST(coalesce(sum(run_length) FILTER (vtype <> 'null'), 0) AS BIGINT) AS non_null,
 CAST(coalesce(sum(run_length) FILTER (vtype = 'number'), 0) AS BIGINT) AS numeric FROM rle GROUP BY GROUPING SETS (({S}), (workbook_id))""")
query("row_pattern_stats", lambda t: op.row_pattern_stats(enc(t)), "rle",
      f"""SELECT *, round((1 - stored / logical) * 100, 6) AS compression FROM (SELECT {R}, CAST(sum(run_length) AS BIGINT) AS logical, count(*) AS stored, count(*) FILTER (run_length > 1) AS rle_cells,
 count(DISTINCT coalesce(vnum, -1)) AS unique_values FROM rle GROUP BY ALL HAVING count(*) > 10) x""")
query("encoding_size_compare", lambda t: op.encoding_size_compare(t.wide), "wide rle",
      f"""SELECT {S}, strategy, bytes, CAST(trunc((1 - bytes / vb) * 100) AS INT) AS reduction_percent FROM (
 SELECT {S}, vb, unnest(['verbose','compact','rle']) AS strategy, unnest([vb, compact, rle]) AS bytes FROM (
 SELECT {S}, CAST(sum(strlen({VERB})) AS BIGINT) AS vb, CAST(sum(strlen({CELL})) AS BIGINT) AS compact FROM (SELECT *, 1 AS run_length FROM wide) w GROUP BY ALL) a
 JOIN (SELECT {S}, CAST(sum(strlen({CELL})) AS BIGINT) AS rle FROM (SELECT *, NULL AS vtext, NULL::BOOLEAN AS vbool FROM rle) e GROUP BY ALL) b USING ({S})) x""")
query("style_dictionary", lambda t: op.with_style_id(t.cells).select(*RC, "style_id"), "cells styles",
      f"SELECT {R}, c, style_id FROM cells LEFT JOIN styles USING (workbook_id, style)")
query("row_shared_style", lambda t: op.row_shared_style(t.cells), "rowstyle", "SELECT * FROM rowstyle")
query("drop_redundant_style", lambda t: op.drop_redundant_style(t.cells).select(*RC, "style", "row_style"), "cells rowstyle",
      f"SELECT {R}, c, CASE WHEN style IS DISTINCT FROM row_style THEN style END AS style, row_style FROM cells LEFT JOIN rowstyle USING ({R})")

RAW = """SELECT o_orderkey, '{"font":{"name":"' || CASE WHEN o_orderkey%3=0 THEN 'Calibri' ELSE 'Arial' END || '","size":' || CAST(10+o_orderkey%3 AS STRING)
 || ',"bold":' || CASE WHEN o_orderkey%2=0 THEN 'true' ELSE 'false' END || '},"fill":{"type":"' || CASE WHEN o_orderstatus='O' THEN 'none' ELSE 'solid' END
 || '","color":"' || CASE WHEN o_orderkey%5=0 THEN '00000000' ELSE 'FFCCCCCC' END || '"},"border":{"left":"' || CASE WHEN o_orderkey%4=0 THEN 'thin' ELSE '' END
 || '"},"alignment":{"horizontal":"' || CASE WHEN o_orderkey%4=1 THEN 'general' ELSE 'left' END || '","vertical":"bottom"},"number_format":"'
 || CASE WHEN o_orderkey%9=0 THEN '0.00' ELSE 'General' END || '"}' AS style FROM {o}"""


def _raw(t):
    return t.spark.sql(RAW.replace("{o}", "\x00").replace("{", "{{").replace("}", "}}").replace("\x00", "{o}"), o=t.orders)


query("style_default_elision",
      lambda t: op.style_default_elision(_raw(t)).selectExpr(
          "o_orderkey", "lean.font.name as font_name", "lean.font.size as font_size", "lean.font.bold as font_bold", "lean.fill.type as fill_type",
          "lean.fill.color as fill_color", "lean.border.left as border_left", "lean.alignment.horizontal as horizontal", "lean.alignment.vertical as vertical",
          "lean.number_format as number_format"),
      "orders",
      """SELECT o_orderkey, CASE WHEN o_orderkey%3<>0 THEN 'Arial' END AS font_name, CASE WHEN o_orderkey%3<>1 THEN CAST(10+o_orderkey%3 AS DOUBLE) END AS font_size,
 CASE WHEN o_orderkey%2=0 THEN true END AS font_bold, CASE WHEN o_orderstatus<>'O' THEN 'solid' END AS fill_type,
 CASE WHEN o_orderstatus<>'O' AND o_orderkey%5<>0 THEN 'FFCCCCCC' END AS fill_color, CASE WHEN o_orderkey%4=0 THEN 'thin' END AS border_left,
 CASE WHEN o_orderkey%4<>1 THEN 'left' END AS horizontal, CAST(NULL AS VARCHAR) AS vertical, CASE WHEN o_orderkey%9=0 THEN '0.00' END AS number_format FROM orders""")
query("write_compact_sheets", lambda t: op.write_compact_sheets(t.cells.withColumn("run_length", F.lit(1))), "cells rowstyle",
      f"""SELECT {R}, '{{"r":' || r || coalesce(',"style":' || {Q.format('any_value(row_style)')}, '') || ',"cells":[' || string_agg({CELL}, ',' ORDER BY c) || ']}}' AS json
 FROM (SELECT * REPLACE (CASE WHEN style IS DISTINCT FROM row_style THEN style END AS style), 1 AS run_length FROM cells LEFT JOIN rowstyle USING ({R})) x GROUP BY {R}""")
query("roundtrip_diff", lambda t: op.roundtrip_diff(t.wide, op.rle_decode(enc(t)), [*RC, *op.BODY]), "wide",
      "SELECT CAST(0 AS BIGINT) AS missing, CAST(0 AS BIGINT) AS extra, 2 * count(*) AS compared FROM wide")
query("data_loss_by_type",
      lambda t: op.data_loss_by_type(t.cells, profiles.trim_trailing(t.cells.withColumn("run_length", F.lit(1)))), "cells extent",
      f"""SELECT *, "full" - kept AS lost, round(("full" - kept) / "full" * 100, 6) AS lost_percent FROM (
 SELECT CASE WHEN length(formula) > 0 THEN 'formula' WHEN vtype='null' OR length(trim(coalesce(vtext,'x'))) = 0 THEN 'empty' WHEN vtext IS NOT NULL THEN 'string' ELSE 'number' END AS class,
  count(*) AS "full", count(*) FILTER (r <= max_r AND c <= max_c) AS kept FROM cells LEFT JOIN extent USING ({S}) GROUP BY ALL) x""")

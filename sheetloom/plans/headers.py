"""Queries of titles, headers, labels, table views and per-file counts."""

from pyspark.sql import functions as F

from sheetloom.functions.durable import durable
from sheetloom.operators import headers as op
from sheetloom.operators import profiles, tables
from sheetloom.plans.ctes import LETTERS, SHARED, VALUE
from sheetloom.plans.encoding import JV
from sheetloom.plans.registry import query
from sheetloom.schemas import SHEET

S, R, T = "workbook_id, sheet_id", "workbook_id, sheet_id, r", "workbook_id, sheet_id, table_no"
REG = op.REG
A1 = f"{LETTERS.format('c')} || r"
DATES = "2024|2025|2026|jan|feb|mar"
TITLE = rf"""(length(t) BETWEEN 3 AND 100 AND NOT regexp_matches(replace(replace(replace(t,'.',''),'-',''),'/',''), '^\d+$')
 AND NOT regexp_matches(lower(t), '{DATES}') AND regexp_matches(t, '[A-Za-z]'))"""

SHARED["reg"] = (
    f"""SELECT {T}, method, r1, c1, r2, c2, r1 AS h_row, c1 AS h_col, n_hr, n_hc, r1 + n_hr AS data_r, c1 + n_hc AS data_c FROM (
 SELECT d.*, CASE WHEN frozen_rows > 0 THEN least(frozen_rows, r2-r1+1) ELSE 1 END AS n_hr, CASE WHEN frozen_cols > 0 THEN least(frozen_cols, c2-c1+1) ELSE 1 END AS n_hc
 FROM detected d JOIN sheets USING ({S})) x""", ["detected", "sheets"])
SHARED["titles"] = (
    f"""SELECT {T}, arg_min(t, r) AS title, min(r) AS title_row FROM (
 SELECT {T}, n.r, count(*) AS k, max(CASE WHEN n.c = g.c1 AND vtype IN ('string','date','error') THEN trim(vtext) END) AS t
 FROM norm n JOIN reg g USING ({S}) WHERE n.r IN (g.r1 - 1, g.r1) AND n.c BETWEEN g.c1 AND g.c2 GROUP BY ALL) x WHERE k = 1 AND {TITLE} GROUP BY ALL""", ["norm", "reg"])
SHARED["tab"] = (
    f"SELECT reg.* REPLACE (CASE WHEN title_row = r1 THEN r1 + 1 ELSE r1 END AS r1), reg.r1 AS orig_r1, title, title_row FROM reg LEFT JOIN titles USING ({T})", ["reg", "titles"])
SHARED["inreg"] = (
    f"SELECT tab.*, k.r, k.c, k.vtype, k.vtext, k.vnum, k.vbool, k.bold, k.indent, {VALUE} AS value FROM cells k JOIN tab USING ({S}) WHERE k.r BETWEEN r1 AND r2 AND k.c BETWEEN c1 AND c2", ["cells", "tab"])
SHARED["hcells"] = (
    f"""SELECT tab.workbook_id, tab.sheet_id, table_no, k.r, k.c, {VALUE} AS value, CAST(k.r - h_row + 1 AS INT) AS level, h_col, n_hc FROM cells k JOIN tab USING ({S})
 WHERE k.r BETWEEN h_row AND h_row + n_hr - 1 AND k.c BETWEEN c1 AND c2 AND vtype <> 'null'""", ["cells", "tab"])


def collabels(sep: str, order: str, default: str) -> str:
    return f"""SELECT {T}, c, coalesce(l, {default}) AS label FROM (SELECT {T}, CAST(unnest(range(c1, c2 + 1)) AS INT) AS c FROM tab) g
 LEFT JOIN (SELECT {T}, c, string_agg(value, '{sep}' ORDER BY r {order}) AS l FROM hcells GROUP BY ALL) h USING ({T}, c)"""


SHARED["collab"] = (collabels(" | ", "ASC", f"'Column ' || {LETTERS.format('c')}"), ["tab", "hcells"])
SHARED["rowlab"] = (
    f"""SELECT {T}, r, coalesce(string_agg(value, ' | ' ORDER BY c) FILTER (c < h_col + n_hc), 'Row ' || r) AS label FROM inreg WHERE r >= data_r GROUP BY {T}, r""", ["inreg"])
SHARED["hier"] = (
    f"""SELECT {T}, 'column' AS axis, c AS position, level, value, {A1} AS coordinate, 0 AS indent_level FROM hcells
 UNION ALL SELECT {T}, 'row', r, CAST(c - h_col + 1 AS INT), value, {A1}, CAST(greatest(0, indent // 2) AS INT) FROM inreg WHERE c < h_col + n_hc AND value IS NOT NULL""", ["hcells", "inreg"])
SHARED["dcells"] = (
    "SELECT * FROM inreg WHERE r >= data_r AND c >= data_c AND length(value) > 0 AND (vtype <> 'string' OR (NOT bold AND length(value) > 10))", ["inreg"])


def seq(t):
    return t.stored("seq", lambda: tables.row_sequence(profiles.row_profile(t.cells, t.sheets)))


def regions(t):
    return t.stored("regions", lambda: tables.detect_tables(t.cells, t.sheets))


def tabs(t):
    return t.stored("tables", lambda: op.describe_tables(regions(t), t.cells, t.sheets))


def labelled(t):
    """Detection and labelling from the cells up, without any stored intermediate of other queries."""
    found = durable(op.describe_tables(durable(tables.detect_tables(t.cells, t.sheets)), t.cells, t.sheets))
    labels = op.column_labels(found, t.cells)
    return labels.join(found.select(*REG, "method", "r1", "c1", "r2", "c2"), REG).groupBy(*REG, "method", "r1", "c1", "r2", "c2").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("c", "label"))), lambda x: x["label"]), "; ").alias("column_labels")
    )


query("detect_tables_labelled", labelled, "tab collab",
      f"""SELECT {T}, method, r1, c1, r2, c2, string_agg(label, '; ' ORDER BY c) AS column_labels FROM collab JOIN tab USING ({T}) GROUP BY ALL""")
H = f"{T}, h_row, n_hr, h_col, n_hc, data_r, data_c"
query("header_extent", lambda t: op.header_extent(regions(t), t.sheets).select(*REG, *op.HEAD), "reg", f"SELECT {H} FROM reg")
query("header_extent_region", lambda t: op.header_extent(regions(t), t.sheets, "region").select(*REG, *op.HEAD), "detected sheets",
      f"""SELECT {T}, r1 AS h_row, n_hr, c1 AS h_col, n_hc, r1 + n_hr AS data_r, c1 + n_hc AS data_c FROM (
 SELECT d.*, CASE WHEN frozen_rows > 0 THEN least(frozen_rows, r2-r1+1) WHEN r2 > r1 THEN 1 ELSE 0 END AS n_hr, CASE WHEN frozen_cols > 0 THEN least(frozen_cols, c2-c1+1) WHEN c2 > c1 THEN 1 ELSE 0 END AS n_hc
 FROM detected d JOIN sheets USING ({S})) x""")
query("title_like", lambda t: op.title_like(op.normalize_cells(t.cells)).select(*SHEET, "r", "c", "title_like"), "norm",
      f"SELECT {R}, c, {TITLE} AS title_like FROM (SELECT *, trim(value) AS t FROM norm) x")
query("table_title", lambda t: op.table_title(regions(t), t.cells).select(*REG, "title", "title_row"), "reg titles",
      f"SELECT {T}, title, title_row FROM reg LEFT JOIN titles USING ({T})")
query("cut_title_row", lambda t: tabs(t).select(*REG, "orig_r1", "r1"), "tab", f"SELECT {T}, orig_r1, r1 FROM tab")
query("cells_in_region", lambda t: op.cells_in_region(t.cells, tabs(t)).select(*REG, "r", "c"), "inreg", f"SELECT {T}, r, c FROM inreg")
query("column_labels", lambda t: op.column_labels(tabs(t), t.cells), "collab", "SELECT * FROM collab")
query("column_labels_verbose", lambda t: op.column_labels(tabs(t), t.cells, "verbose"), "tab hcells", collabels(" ", "DESC", "'unlabeled'"))
query("column_labels_plain", lambda t: op.column_labels(tabs(t), t.cells, "plain"), "tab hcells", collabels(" | ", "ASC", "'unlabeled'"))
query("row_labels", lambda t: op.row_labels(tabs(t), t.cells), "rowlab", "SELECT * FROM rowlab")
query("row_labels_frozen", lambda t: op.row_labels(tabs(t), t.cells, "plain", "frozen"), "inreg hcells",
      f"""SELECT {T}, r, coalesce(l, 'unlabeled') AS label FROM (SELECT DISTINCT {T}, r FROM inreg WHERE r >= data_r) x LEFT JOIN (
 SELECT {T}, string_agg(v, ' | ' ORDER BY c) AS l FROM (SELECT {T}, c, string_agg(value, ' ' ORDER BY r DESC) AS v FROM hcells WHERE c < h_col + n_hc GROUP BY ALL) y GROUP BY ALL) z USING ({T})""")
query("header_hierarchy", lambda t: op.header_hierarchy(tabs(t), t.cells), "hier", "SELECT * FROM hier")
query("indent_level", lambda t: t.cells.select(*SHEET, "r", "c", op.indent_level(F.col("indent")).alias("indent_level")), "cells",
      f"SELECT {R}, c, CAST(greatest(0, indent // 2) AS INT) AS indent_level FROM cells")
query("data_cells", lambda t: op.data_cells(tabs(t), t.cells).select(*REG, "r", "c", "value"), "dcells", f"SELECT {T}, r, c, value FROM dcells")
query("attach_headers",
      lambda t: op.attach_headers(tabs(t), t.cells).select(
          *REG, "r", "c", F.array_join("full_column_path", " > ").alias("full_column_path"), F.array_join("full_row_path", " > ").alias("full_row_path"),
          "primary_column_header", "primary_row_header", "column_levels", "row_levels", "max_indent"),
      "dcells hier",
      f"""SELECT {T}, r, c, cp AS full_column_path, rp AS full_row_path, c1h AS primary_column_header, r1h AS primary_row_header, coalesce(cl, 0) AS column_levels, coalesce(rl, 0) AS row_levels,
 coalesce(mi, 0) AS max_indent FROM dcells
 LEFT JOIN (SELECT {T}, position AS c, string_agg(value, ' > ' ORDER BY level) AS cp, arg_min(value, level) AS c1h, CAST(count(*) AS INT) AS cl FROM hier WHERE axis='column' GROUP BY ALL) a USING ({T}, c)
 LEFT JOIN (SELECT {T}, position AS r, string_agg(value, ' > ' ORDER BY level) AS rp, arg_min(value, level) AS r1h, CAST(count(*) AS INT) AS rl, max(indent_level) AS mi FROM hier WHERE axis='row' GROUP BY ALL) b USING ({T}, r)""")
query("table_meta", lambda t: op.table_meta(tabs(t), t.cells, t.merges), "tab inreg merges",
      f"""SELECT {T}, method, title, r1, c1, r2, c2, orig_r1, coalesce(k, 0) AS cells, coalesce(m, 0) AS numeric_cells, EXISTS (SELECT 1 FROM merges g WHERE g.sheet_id = tab.sheet_id) AS merged
 FROM tab LEFT JOIN (SELECT {T}, count(*) AS k, count(*) FILTER (vtype='number') AS m FROM inreg WHERE value IS NOT NULL GROUP BY ALL) x USING ({T})""")
query("simple_table_view", lambda t: op.simple_table_view(t.cells).select(*SHEET, "r", F.array_join("row_values", "|").alias("row_text")), "cells",
      f"""SELECT {R}, string_agg(coalesce({VALUE}, ''), '|' ORDER BY c) AS row_text FROM cells JOIN (SELECT {S}, min(r) AS fr FROM cells GROUP BY ALL) f USING ({S}) WHERE r > fr GROUP BY {R}""")
query("simple_table_cells", lambda t: op.simple_table_cells(t.cells), "cells",
      f"""SELECT {R}, c, value, coalesce(h, '') AS column_header, coalesce(k, 'None') AS row_header FROM (
 SELECT *, max(CASE WHEN r = fr THEN value END) OVER (PARTITION BY {S}, c) AS h, count(*) FILTER (r = fr) OVER (PARTITION BY {S}, c) AS heads, max(CASE WHEN c = 1 THEN value END) OVER (PARTITION BY {R}) AS k
 FROM (SELECT {R}, c, {VALUE} AS value, min(r) OVER (PARTITION BY {S}) AS fr FROM cells) a) b WHERE r > fr AND heads > 0""")
query("records_view",
      lambda t: op.records_view(tabs(t), t.cells).select(*REG, "r", F.array_join(F.transform(F.map_entries("record"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "; ").alias("record")),
      "inreg collab",
      f"""SELECT {T}, r, string_agg(label || '=' || v, '; ' ORDER BY label) AS record FROM (SELECT {T}, r, label, arg_max(value, c) AS v FROM inreg JOIN collab USING ({T}, c)
 WHERE r >= data_r AND value IS NOT NULL GROUP BY ALL) x GROUP BY ALL""")
query("table_counts_meta", lambda t: op.table_counts_meta(tabs(t), t.cells, t.merges), "inreg merges",
      f"""SELECT {T}, method, count(*) AS cell_count, CASE WHEN EXISTS (SELECT 1 FROM merges g WHERE g.sheet_id = inreg.sheet_id) THEN true END AS has_merged_cells FROM inreg GROUP BY {T}, method""")
query("label_lookup", lambda t: op.label_lookup(tabs(t), t.cells), "inreg rowlab collab",
      f"""SELECT i.workbook_id, i.sheet_id, i.table_no, i.r, i.c, l.label AS row_label, k.label AS col_label FROM inreg i
 LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY {T} ORDER BY r) - 1 AS off FROM rowlab) l
  ON l.workbook_id=i.workbook_id AND l.sheet_id=i.sheet_id AND l.table_no=i.table_no AND l.off = i.r - i.data_r
 LEFT JOIN collab k ON k.workbook_id=i.workbook_id AND k.sheet_id=i.sheet_id AND k.table_no=i.table_no AND k.c = i.c""")
query("trim_region_right", lambda t: op.trim_region_right(regions(t), t.cells).select(*REG, "r1", "c1", "r2", "c2"), "reg cells",
      f"""SELECT {T}, r1, c1, r2, CASE WHEN l - c1 < 2 AND c2 - c1 >= 2 THEN least(c2, c1 + 2) ELSE l END AS c2 FROM (
 SELECT {T}, r1, c1, r2, reg.c2, coalesce(mx, c1) AS l FROM reg LEFT JOIN (SELECT {T}, max(c) AS mx FROM (
  SELECT {T}, k.c, c1, count(*) AS n FROM cells k JOIN reg USING ({S}) WHERE k.r BETWEEN r1 AND r2 AND k.c BETWEEN c1 AND c2
   AND (length(trim({VALUE})) > 1 OR regexp_matches(trim({VALUE}), '^[A-Za-z0-9]$')) GROUP BY ALL) a WHERE n > 1 OR c - c1 < 3 GROUP BY ALL) b USING ({T})) y""")
query("write_table_objects", lambda t: op.write_table_objects(tabs(t), t.cells), "inreg",
      f"""SELECT {T}, 'row' AS axis, r AS "index", CAST(0 AS BIGINT) AS part, '{{' || string_agg('"' || {A1} || '":' || {JV}, ',' ORDER BY c) || '}}' AS cells FROM inreg WHERE vtype <> 'null' GROUP BY {T}, r
 UNION ALL SELECT {T}, 'column', c, CAST(floor(r / 4096) AS BIGINT) AS p, '{{' || string_agg('"' || {A1} || '":' || {JV}, ',' ORDER BY r) || '}}' FROM inreg WHERE vtype <> 'null' GROUP BY {T}, c, p""")
query("route_by_size", lambda t: op.route_by_size(t.cells, limit=600_000), "cells",
      "SELECT workbook_id, count(*) AS stored, count(*) * 200 AS estimated_bytes, CASE WHEN count(*) * 200 > 600000 THEN 'summary' ELSE 'full' END AS route FROM cells GROUP BY ALL")
SHARED["wbstats"] = (
    f"""SELECT workbook_id, total_sheets, frozen_sheets, coalesce(total_cells,0) AS total_cells, coalesce(non_empty_cells,0) AS non_empty_cells, coalesce(formula_cells,0) AS formula_cells, coalesce(total_numbers,0) AS total_numbers,
 coalesce(m,0) AS merged_cells, coalesce(n,0) AS total_tables FROM (SELECT workbook_id, count(*) AS total_sheets, count(*) FILTER (frozen_rows > 0 OR frozen_cols > 0) AS frozen_sheets FROM sheets GROUP BY ALL) a
 LEFT JOIN (SELECT workbook_id, count(*) AS total_cells, count(*) FILTER (length({VALUE}) > 0) AS non_empty_cells, count(formula) AS formula_cells, count(*) FILTER (vtype='number') AS total_numbers FROM cells GROUP BY ALL) b USING (workbook_id)
 LEFT JOIN (SELECT workbook_id, count(*) AS m FROM merges GROUP BY ALL) c USING (workbook_id) LEFT JOIN (SELECT workbook_id, count(*) AS n FROM detected GROUP BY ALL) d USING (workbook_id)""", ["sheets", "cells", "merges", "detected"])
query("workbook_stats", lambda t: op.workbook_stats(t.cells, t.sheets, t.merges, regions(t)), "wbstats", "SELECT * FROM wbstats")
query("file_counts", lambda t: op.file_counts(t.cells, t.sheets, regions(t)), "wbstats",
      "SELECT workbook_id, total_sheets AS sheet_count, total_tables AS table_count, total_numbers AS numeric_cells FROM wbstats")
query("large_file_summary", lambda t: op.large_file_summary(tabs(t), t.cells, t.sheets), "sheets tab inreg cells",
      f"""SELECT {S}, CAST(sum(tables) AS BIGINT) AS tables, CAST(sum(row_labels) AS BIGINT) AS row_labels, CAST(sum(col_labels) AS BIGINT) AS col_labels, CAST(sum(numeric_cells) AS BIGINT) AS numeric_cells FROM (
 SELECT {S}, coalesce(a, 0) AS tables, coalesce(b, 0) AS row_labels, coalesce(k, 0) AS col_labels, coalesce(d, 0) AS numeric_cells FROM sheets
 LEFT JOIN (SELECT {S}, count(*) AS a, sum(c2 - c1 + 1) AS k FROM tab GROUP BY ALL) x USING ({S})
 LEFT JOIN (SELECT {S}, count(*) AS b FROM (SELECT DISTINCT {T}, r FROM inreg WHERE r >= data_r) i GROUP BY ALL) y USING ({S})
 LEFT JOIN (SELECT {S}, count(*) FILTER (vtype='number') AS d FROM cells GROUP BY ALL) z USING ({S})) q GROUP BY GROUPING SETS (({S}), (workbook_id))""")

"""Queries of the table detectors."""

from pyspark.sql import functions as F

from sheetloom.operators import profiles
from sheetloom.operators import tables as op
from sheetloom.plans.ctes import SHARED
from sheetloom.plans.registry import query
from sheetloom.schemas import SHEET

S, R = "workbook_id, sheet_id", "workbook_id, sheet_id, r"
BND = """(gap >= 1 AND (abs(pn - n) > 2 OR pnum <> (n_loose > n/2) OR ((n_label > 2) AND NOT plab) OR (n_strict > 0 AND n_text > 0 AND first_txt > 0)))"""
SHIFT = "(abs(pn - n) > 5 OR abs(pratio - num_ratio) > 0.4::DOUBLE OR abs(pspan - span) > 10 OR abs(pn / 8 - n / 8) > 0.3::DOUBLE)"
FIN = "assets|liabilities|equity|revenue|expenses|income|cash|receivable|payable|inventory|property|debt|retained|earnings|capital|current|non-current|total"
J = f"JOIN sheets USING ({S})"


def seg(flag: str) -> str:
    """Rows with the start of their piece."""
    return f"SELECT *, max(CASE WHEN gap IS NULL OR {flag} THEN r END) OVER (PARTITION BY {S} ORDER BY r) AS sg FROM seq"


SHARED["r_frozen"] = (
    f"SELECT {S}, 'frozen_panes' AS method, min_row AS r1, min_col AS c1, max_row AS r2, max_col AS c2 FROM sheets WHERE frozen_rows > 0 OR frozen_cols > 0", ["sheets"])
SHARED["r_fin"] = (
    f"""SELECT {S}, 'financial_statement_layout' AS method, min(r) AS r1, min(c1) AS c1, max(r) AS r2, max(c2) AS c2 FROM seq GROUP BY ALL
 HAVING count(*) FILTER (first_str > 0 AND n_right = 0) >= 2 AND count(*) FILTER (first_str > 0 AND n_right > 2) >= 3 AND count(*) >= 3
  AND count(*) FILTER (first_str > 0 AND n_right = 0 AND regexp_matches(lower(first_label), '{FIN}')) >= 0.6::DOUBLE * count(*) FILTER (first_str > 0 AND n_right = 0)""", ["seq"])
SHARED["r_blank"] = (
    f"""SELECT {S}, 'blank_row_separation' AS method, sg AS r1, c1, CASE WHEN sg = max(sg) OVER p THEN max_row ELSE rb END AS r2, c2 FROM (
  SELECT {S}, sg, max(r) AS rb, min(c1) AS c1, max(c2) AS c2, count(*) AS k FROM ({seg('(gap >= 1 AND (gap >= 4 OR ' + BND + '))')}) x GROUP BY ALL) y {J}
 WINDOW p AS (PARTITION BY {S}) QUALIFY count(*) OVER p >= 2 AND sum(k) OVER p >= 4""", ["seq", "sheets"])
SHARED["r_temp"] = (
    f"""SELECT {S}, 'temporal_headers' AS method, h AS r1, min_col AS c1, e AS r2, max_col AS c2 FROM (
  SELECT a.workbook_id, a.sheet_id, a.r AS h, coalesce((SELECT min(b.r) FROM seq b WHERE b.workbook_id=a.workbook_id AND b.sheet_id=a.sheet_id AND b.r > a.r AND (b.temporal OR b.gap >= 2)), 1000000) AS stop
  FROM seq a WHERE a.temporal) q JOIN LATERAL (SELECT max(r) AS e FROM seq c WHERE c.workbook_id=q.workbook_id AND c.sheet_id=q.sheet_id AND c.r < stop) l ON true {J} WHERE e > h""", ["seq", "sheets"])
SHARED["r_content"] = (
    f"""SELECT {S}, 'content_structure' AS method, min_row AS r1, min_col AS c1, max_row AS r2, max_col AS c2 FROM (
  SELECT {S} FROM norm GROUP BY ALL HAVING count(DISTINCT r) >= 3 AND count(DISTINCT c) >= 2) x {J}""", ["norm", "sheets"])
SHARED["hlrows"] = (
    f"""SELECT a.workbook_id, a.sheet_id, a.r, a.gap, a.has_labels AND NOT a.mostly_numeric AND a.n >= 3 AS hl,
 (SELECT count(*) FROM seq b WHERE b.workbook_id=a.workbook_id AND b.sheet_id=a.sheet_id AND b.r BETWEEN a.r AND a.r + 2 AND b.has_labels AND NOT b.mostly_numeric) >= 2 AS ahead FROM seq a""", ["seq"])
SHARED["r_multi"] = (
    f"""SELECT {S}, 'multirow_headers' AS method, a AS r1, min_col AS c1, e AS r2, max_col AS c2, CAST(b - a + 1 AS INT) AS header_rows, ds AS data_start_row FROM (
  SELECT {S}, min(r) AS a, max(r) AS b FROM (SELECT *, r - row_number() OVER (PARTITION BY {S} ORDER BY r) AS g FROM hlrows WHERE hl) z GROUP BY {S}, g HAVING count(*) >= 2) blk
 JOIN LATERAL (SELECT min(r) AS ds FROM hlrows d WHERE d.workbook_id=blk.workbook_id AND d.sheet_id=blk.sheet_id AND d.r > b) d1 ON ds IS NOT NULL
 JOIN LATERAL (SELECT coalesce(min(r), 1000000) AS stop FROM hlrows d WHERE d.workbook_id=blk.workbook_id AND d.sheet_id=blk.sheet_id AND d.r > ds AND ((hl AND ahead) OR gap >= 3)) d2 ON true
 JOIN LATERAL (SELECT max(r) AS e FROM hlrows d WHERE d.workbook_id=blk.workbook_id AND d.sheet_id=blk.sheet_id AND d.r < stop) d3 ON true {J} WHERE e >= ds""", ["hlrows", "sheets"])
SHARED["r_shift"] = (
    f"""SELECT {S}, 'column_continuity' AS method, sg AS r1, min_col AS c1, CAST(coalesce(cut, lead(sg) OVER (PARTITION BY {S} ORDER BY sg) - 1, max_row) AS INT) AS r2, max_col AS c2 FROM (
  SELECT {S}, sg, arg_min(pr, r) FILTER (gap >= 2 AND r > sg) AS cut, count(*) AS k FROM ({seg(SHIFT)}) x GROUP BY ALL) y {J}
 QUALIFY count(*) OVER (PARTITION BY {S}) >= 2 AND sum(k) OVER (PARTITION BY {S}) >= 3""", ["seq", "sheets"])
SHARED["r_gaps"] = (
    f"""SELECT {S}, 'gaps' AS method, sg AS r1, min_col AS c1, CASE WHEN sg = max(sg) OVER p THEN coalesce(cut, max_row) ELSE rb END AS r2, max_col AS c2 FROM (
  SELECT {S}, sg, max(r) AS rb, arg_min(pr, r) FILTER (gap >= 2 AND r > sg) AS cut, count(*) AS k FROM ({seg('gap >= 3')}) x GROUP BY ALL) y {J}
 WINDOW p AS (PARTITION BY {S}) QUALIFY sum(k) OVER p >= 2""", ["seq", "sheets"])
SHARED["r_default"] = (f"SELECT {S}, 'default' AS method, min_row AS r1, min_col AS c1, max_row AS r2, max_col AS c2 FROM (SELECT DISTINCT {S} FROM seq) x {J}", ["seq", "sheets"])


def _first_wins(order: list[str]) -> str:
    parts = " UNION ALL ".join(
        f"SELECT {i} AS prio, {S}, method, r1, c1, r2, c2, {'header_rows, data_start_row' if n == 'r_multi' else 'NULL::INT, NULL::INT'} FROM {n}"
        if i or n == "r_multi" else f"SELECT {i} AS prio, {S}, method, r1, c1, r2, c2, NULL::INT AS header_rows, NULL::INT AS data_start_row FROM {n}"
        for i, n in enumerate(order))
    return f"""SELECT {S}, method, r1, c1, r2, c2, header_rows, data_start_row, row_number() OVER (PARTITION BY {S} ORDER BY r1, c1) AS table_no
 FROM (SELECT * FROM ({parts}) u QUALIFY rank() OVER (PARTITION BY {S} ORDER BY prio) = 1) w WHERE r1 <= r2 AND c1 <= c2"""


DEFAULT_ORDER = ["r_frozen", "r_fin", "r_blank", "r_temp", "r_content", "r_multi", "r_shift", "r_default"]
GAPS_ORDER = ["r_gaps", "r_blank", "r_shift", "r_temp", "r_multi", "r_content", "r_default"]
SHARED["detected"] = (_first_wins(DEFAULT_ORDER), DEFAULT_ORDER)
SHARED["detected_gaps"] = (_first_wins(GAPS_ORDER), GAPS_ORDER)

def seq(t):
    return t.stored("seq", lambda: op.row_sequence(profiles.row_profile(t.cells, t.sheets)))


COLS = f"{S}, method, r1, c1, r2, c2"

query("table_boundary", lambda t: op.table_boundary(seq(t)), "seq", f"SELECT {R}, pr AS prev_r, gap, {BND} AS boundary FROM seq WHERE gap >= 1")
query("regions_frozen", lambda t: op.regions_frozen(t.sheets), "r_frozen", "SELECT * FROM r_frozen")
query("regions_financial", lambda t: op.regions_financial(seq(t)), "r_fin", "SELECT * FROM r_fin")
query("regions_blank_rows", lambda t: op.regions_blank_rows(seq(t)), "r_blank", "SELECT * FROM r_blank")
query("regions_temporal", lambda t: op.regions_temporal(seq(t)), "r_temp", "SELECT * FROM r_temp")
query("regions_content", lambda t: op.regions_content(seq(t)), "r_content", "SELECT * FROM r_content")
query("regions_multirow", lambda t: op.regions_multirow(seq(t)), "r_multi", "SELECT * FROM r_multi")
query("regions_column_shift", lambda t: op.regions_column_shift(seq(t)), "r_shift", "SELECT * FROM r_shift")
query("regions_gaps", lambda t: op.regions_gaps(seq(t)), "r_gaps", "SELECT * FROM r_gaps")
query("regions_gaps_to_end", lambda t: op.regions_gaps(op.stored_row_sequence(t.cells.filter("vtype <> 'null'"), t.sheets), 2, "max_row"), "cells sheets",
      f"""SELECT {S}, 'gaps' AS method, CASE WHEN sum(k) OVER p < 2 THEN min_row ELSE sg END AS r1, min_col AS c1, CASE WHEN sg = max(sg) OVER p THEN max_row ELSE rb END AS r2, max_col AS c2 FROM (
  SELECT {S}, sg, max(r) AS rb, count(*) AS k FROM (SELECT *, max(CASE WHEN gap IS NULL OR gap >= 2 THEN r END) OVER (PARTITION BY {S} ORDER BY r) AS sg FROM (
   SELECT *, r - lag(r) OVER (PARTITION BY {S} ORDER BY r) - 1 AS gap FROM (SELECT DISTINCT {R} FROM cells WHERE vtype <> 'null') d) e) f GROUP BY ALL) y {J} WINDOW p AS (PARTITION BY {S})""")
query("table_end_by_gap", lambda t: op.table_end_by_gap(seq(t)), "seq sheets",
      f"""SELECT a.workbook_id, a.sheet_id, a.r, coalesce((SELECT min(b.pr) FROM seq b WHERE b.workbook_id=a.workbook_id AND b.sheet_id=a.sheet_id AND b.r > a.r AND b.gap >= 2), s.max_row) AS table_end
 FROM seq a JOIN sheets s ON s.workbook_id=a.workbook_id AND s.sheet_id=a.sheet_id""")
query("clip_regions", lambda t: op.clip_regions(
        op.regions_gaps(seq(t)).withColumns({"r1": F.col("r1") - 2, "r2": F.col("r2") + 3, "c1": F.col("c1") - 1, "c2": F.col("r1") - 3}), t.sheets), "r_gaps sheets",
      f"""SELECT * FROM (SELECT {S}, method, greatest(r1 - 2, min_row) AS r1, greatest(c1 - 1, min_col) AS c1, least(r2 + 3, max_row) AS r2, least(r1 - 3, max_col) AS c2
 FROM r_gaps {J}) x WHERE r1 <= r2 AND c1 <= c2""")
query("region_columns", lambda t: op.region_columns(op.regions_column_shift(seq(t)), profiles.row_profile(t.cells, t.sheets)), "r_shift prof",
      f"""SELECT g.workbook_id, g.sheet_id, method, r1, coalesce(min(p.c1), any_value(g.c1)) AS c1, r2, coalesce(max(p.c2), any_value(g.c2)) AS c2 FROM r_shift g
 LEFT JOIN prof p ON p.workbook_id=g.workbook_id AND p.sheet_id=g.sheet_id AND p.r BETWEEN r1 AND r2 GROUP BY ALL""")
query("regions_default", lambda t: op.regions_default(seq(t)), "r_default", "SELECT * FROM r_default")
query("column_overlap", lambda t: op.column_overlap(t.cells), "norm",
      f"""SELECT {R}, prev_r, len(list_intersect(cols, pc)) / greatest(len(cols), len(pc)) AS overlap, len(list_intersect(cols, pc)) / greatest(len(cols), len(pc)) > 0.5::DOUBLE AS same_table
 FROM (SELECT *, lag(r) OVER w AS prev_r, lag(cols) OVER w AS pc FROM (SELECT {R}, list(c) AS cols FROM norm GROUP BY ALL) x WINDOW w AS (PARTITION BY {S} ORDER BY r)) y WHERE prev_r IS NOT NULL""")
query("detect_tables", lambda t: op.detect_tables(t.cells, t.sheets), "detected", "SELECT * FROM detected")
query("detect_tables_gaps", lambda t: op.detect_tables(t.cells, t.sheets, use_gaps=True), "detected_gaps", "SELECT * FROM detected_gaps")

"""Queries of the profile, extent and trimming operators."""

from pyspark.sql import functions as F

from sheetloom.operators import profiles as op
from sheetloom.plans.ctes import FILLED, SHARED
from sheetloom.plans.registry import query
from sheetloom.schemas import SHEET

S, R = "workbook_id, sheet_id", "workbook_id, sheet_id, r"
PT = """(CASE WHEN vtype='boolean' THEN 'bool' WHEN vtype='number' AND vnum=floor(vnum) THEN 'int' WHEN vtype='number' THEN 'float'
 WHEN vtype IN ('string','date','error') THEN 'str' END)"""

SHARED["coltypes"] = (
    f"""SELECT *, CASE WHEN n <= 1 THEN CAST(0 AS DOUBLE) ELSE (n_types - 1) / n END AS inconsistency FROM (
 SELECT {S}, c, count(*) AS n, count(*) FILTER (t='int') AS n_int, count(*) FILTER (t='float') AS n_float, count(*) FILTER (t='str') AS n_str,
  count(*) FILTER (t='bool') AS n_bool, CAST(count(DISTINCT t) AS INT) AS n_types FROM (SELECT *, {PT} AS t FROM cells) x WHERE t IS NOT NULL GROUP BY ALL) y""",
    ["cells"],
)
SHARED["axgaps"] = (
    f"""SELECT * FROM (SELECT *, p - lag(p) OVER (PARTITION BY {S}, axis ORDER BY p) - 1 AS gap FROM (
 SELECT DISTINCT {S}, 'row' AS axis, r AS p FROM cells WHERE {PT} IS NOT NULL UNION ALL SELECT DISTINCT {S}, 'col', c FROM cells WHERE {PT} IS NOT NULL) x) y WHERE gap > 1""",
    ["cells"],
)
SHARED["sparse"] = (
    f"""SELECT s.workbook_id, s.sheet_id, CAST((max_row-min_row+1)*(max_col-min_col+1) AS BIGINT) AS addressable, data_cells, stored_cells,
 coalesce(row_gaps, 0) AS row_gaps, coalesce(col_gaps, 0) AS col_gaps,
 round(1.0::DOUBLE - data_cells / ((max_row-min_row+1)*(max_col-min_col+1)), 9) AS sparsity, coalesce(row_gaps,0) > 3 OR coalesce(col_gaps,0) > 3 AS clustered
FROM sheets s JOIN (SELECT {S}, count(*) FILTER ({FILLED}) AS data_cells, count(*) AS stored_cells FROM cells GROUP BY ALL) d USING ({S})
 LEFT JOIN (SELECT {S}, count(*) FILTER (axis='row') AS row_gaps, count(*) FILTER (axis='col') AS col_gaps FROM axgaps GROUP BY ALL) g USING ({S})""",
    ["sheets", "cells", "axgaps"],
)
SHARED["extent"] = (f"SELECT {S}, max(r) AS max_r, max(c) AS max_c FROM norm GROUP BY ALL", ["norm"])
SHARED["formulas"] = (
    rf"""SELECT *, round(formulas / stored_cells, 9) AS formula_ratio, CASE WHEN formulas > 0 THEN round(complex_formulas / formulas, 9) ELSE 0.0::DOUBLE END AS complex_ratio FROM (
 SELECT {S}, count(*) AS stored_cells, count(formula) AS formulas,
 count(*) FILTER (regexp_matches(formula, '(?i)IF.*IF|VLOOKUP|INDEX.*MATCH|SUMPRODUCT|\$[A-Z]+\$\d+:\$[A-Z]+\$\d+')) AS complex_formulas,
 count(*) FILTER (k='sum') AS n_sum, count(*) FILTER (k='conditional') AS n_conditional, count(*) FILTER (k='lookup') AS n_lookup,
 count(*) FILTER (k='reference') AS n_reference, count(*) FILTER (k='other') AS n_other
 FROM (SELECT *, CASE WHEN formula IS NULL THEN NULL WHEN upper(formula) LIKE '%SUM%' THEN 'sum' WHEN upper(formula) LIKE '%IF%' THEN 'conditional'
  WHEN regexp_matches(upper(formula), 'VLOOKUP|HLOOKUP|INDEX|MATCH') THEN 'lookup' WHEN regexp_matches(formula, '[$:]') THEN 'reference' ELSE 'other' END AS k FROM cells) x GROUP BY ALL) y""",
    ["cells"],
)
SHARED["levels"] = (
    f"""SELECT {S}, CAST(header_levels AS INT) AS header_levels, round(least(header_levels * 0.1::DOUBLE - sum(coalesce(filled, 0)) / width * 0.1::DOUBLE, 1.0::DOUBLE), 9) AS inconsistency FROM (
 SELECT *, unnest(range(1, header_levels + 1)) AS lvl FROM (
  SELECT {S}, CAST(greatest(1, coalesce(top, 1)) AS INT) AS header_levels, max_col - min_col + 1 AS width FROM sheets LEFT JOIN (SELECT {S}, max(r) AS top FROM lv WHERE texts / n > 0.7::DOUBLE GROUP BY ALL) q USING ({S})) h) l
 LEFT JOIN (SELECT workbook_id AS w2, sheet_id AS s2, r AS r2, filled FROM lv) f ON w2 = workbook_id AND s2 = sheet_id AND r2 = lvl GROUP BY {S}, header_levels, width""",
    ["sheets", "lv"],
)
SHARED["lv"] = (
    f"""SELECT {R}, count(*) AS n, count(*) FILTER (vtype IN ('string','date','error')) AS texts,
 count(*) FILTER (CASE WHEN vtype IN ('string','date','error') THEN length(vtext) > 0 WHEN vtype='number' THEN vnum <> 0 WHEN vtype='boolean' THEN vbool ELSE false END) AS filled
 FROM cells WHERE r >= 1 GROUP BY ALL""",
    ["cells"],
)
SHARED["levels_meta"] = (
    f"""SELECT {S}, count(*) AS header_levels, round(least(sum((8 - present) / 8), 1.0::DOUBLE), 9) AS inconsistency FROM (
 SELECT {R}, count(*) AS present, count({PT}) AS valued FROM cells WHERE r >= 1 GROUP BY ALL) x WHERE valued > 0 GROUP BY {S}""",
    ["cells"],
)
SHARED["mergeprof"] = (
    f"""SELECT {S}, count(*) AS merges, CAST(sum(CASE WHEN r2-r1+1 > 2 OR c2-c1+1 > 2 THEN 1 ELSE 0 END) AS BIGINT) AS complex_merges,
 CAST(sum(CASE WHEN r2-r1+1 > 2 OR c2-c1+1 > 2 THEN 1 ELSE 0 END + CASE WHEN r2 > r1 AND c2 > c1 THEN 0.5::DOUBLE ELSE 0 END) AS DOUBLE) AS complex_weight,
 max(r2-r1+1) AS max_rows_spanned, max(c2-c1+1) AS max_cols_spanned FROM merges GROUP BY ALL""",
    ["merges"],
)
SHARED["colmean"] = (
    f"""SELECT {S}, count(*) AS columns, round(least(avg(inconsistency), 1.0::DOUBLE), 9) AS mean_inconsistency,
 round(coalesce(avg(inconsistency), 0), 9) AS mean_early, count(*) FILTER (inconsistency > 0.3::DOUBLE) AS high_early
 FROM coltypes WHERE n > 1 GROUP BY {S}""",
    ["coltypes"],
)

prof = lambda t: op.row_profile(t.cells, t.sheets)
runs = lambda t: t.cells.withColumn("run_length", F.lit(1))

query("row_content_pattern", lambda t: op.row_content_pattern(prof(t)), "prof",
      f"SELECT {R}, n AS col_count, n_loose > n / 2 AS mostly_numeric, n_label > 2 AS has_text_labels FROM prof")
query("row_column_pattern", lambda t: op.row_column_pattern(prof(t)), "prof",
      f"""SELECT {R}, n AS col_count, n_strict / n AS numeric_ratio, n_text / n AS text_ratio, c2 - c1 + 1 AS column_span, n / 8 AS data_density FROM prof""")
query("row_mixed", lambda t: op.row_mixed(prof(t)), "prof",
      f"SELECT {R}, n_strict > 0 AND n_text > 0 AS mixed, first_txt > 0 AS first_col_text FROM prof")
query("row_date_ratio", lambda t: op.row_date_ratio(prof(t)), "prof",
      f"SELECT {R}, CASE WHEN n_right > 0 THEN n_date / n_right END AS date_ratio, coalesce(n_right > 0 AND n_date / n_right > 0.3::DOUBLE, false) AS has_dates FROM prof")
query("row_temporal", lambda t: op.row_temporal(prof(t)), "prof",
      f"SELECT {R}, n_temporal / n AS temporal_ratio, n_temporal / n > 0.25::DOUBLE AS temporal FROM prof")
query("occupied_rows_cols", lambda t: op.occupied_rows_cols(t.cells), "norm",
      f"SELECT DISTINCT {S}, 'row' AS axis, r AS position FROM norm UNION ALL SELECT DISTINCT {S}, 'col', c FROM norm")
query("column_types", lambda t: op.column_types(t.cells).withColumn("inconsistency", F.round("inconsistency", 9)), "coltypes",
      f"SELECT {S}, c, n, n_int, n_float, n_str, n_bool, n_types, round(inconsistency, 9) AS inconsistency FROM coltypes")
query("column_inconsistency", lambda t: op.column_inconsistency(t.cells, t.sheets), "colmean", "SELECT * FROM colmean")
query("sheet_sparsity", lambda t: op.sheet_sparsity(t.cells, t.sheets), "sparse", "SELECT * FROM sparse")
query("formula_profile", lambda t: op.formula_profile(t.cells), "formulas", "SELECT * FROM formulas")
query("header_levels", lambda t: op.header_levels(t.cells, t.sheets), "levels", "SELECT * FROM levels")
query("header_levels_meta", lambda t: op.header_levels_meta(t.cells, t.sheets), "levels_meta", "SELECT * FROM levels_meta")
query("merge_profile", lambda t: op.merge_profile(t.merges), "mergeprof", "SELECT * FROM mergeprof")
query("largest_gaps", lambda t: op.largest_gaps(t.cells).select(*SHEET, "axis", "rank", "gap"), "axgaps",
      f"""SELECT {S}, axis, rank, gap FROM (SELECT *, CAST(row_number() OVER (PARTITION BY {S}, axis ORDER BY gap DESC, p) AS INT) AS rank FROM axgaps) x WHERE rank <= 5""")

query("data_extent", lambda t: op.data_extent(runs(t)), "extent", "SELECT * FROM extent")
query("trim_trailing", lambda t: op.trim_trailing(runs(t)).select(*SHEET, "r", "c", "run_length"), "extent",
      f"SELECT {S}, r, c, 1 AS run_length FROM cells JOIN extent USING ({S}) WHERE r <= max_r AND c <= max_c")
query("trim_policy", lambda t: op.trim_policy(runs(t), t.sheets, op.sheet_sparsity(t.cells, t.sheets)), "sparse extent",
      f"""SELECT {S}, CASE WHEN k THEN 'conservative' ELSE 'moderate' END AS policy,
 CASE WHEN k THEN greatest(sr + 5, max_row) ELSE coalesce(max_r, max_row) END AS new_max_row, CASE WHEN k THEN greatest(sc + 5, max_col) ELSE coalesce(max_c, max_col) END AS new_max_col
 FROM (SELECT *, sparsity > 0.7::DOUBLE OR clustered AS k FROM sheets JOIN sparse USING ({S})
  JOIN (SELECT {S}, max(r) AS sr, max(c) AS sc FROM cells GROUP BY ALL) st USING ({S}) LEFT JOIN extent USING ({S})) x""")
query("addressable_reduction",
      lambda t: op.addressable_reduction(t.sheets, op.trimmed_dimensions(runs(t), t.sheets)), "sheets extent",
      f"""SELECT *, round(1.0::DOUBLE - kept / "full", 9) AS reduction FROM (
 SELECT {S}, CAST(sum(fa) AS BIGINT) AS "full", CAST(sum(ka) AS BIGINT) AS kept, CAST(sum(CASE WHEN 1 - ka / fa > 0.9::DOUBLE THEN 1 ELSE 0 END) AS BIGINT) AS major
 FROM (SELECT {S}, max_row * max_col AS fa, coalesce(max_r, max_row) * coalesce(max_c, max_col) AS ka FROM sheets LEFT JOIN extent USING ({S})) x
 GROUP BY GROUPING SETS (({S}), ())) y""")
query("fill_row_gaps",
      lambda t: op.fill_row_gaps(t.wide, t.wide.groupBy(*SHEET).agg(F.max("c").alias("max_col"))).select(*SHEET, "r", "c", "vtype", "vnum"),
      "wide",
      f"""SELECT {R}, c, vtype, vnum FROM wide UNION ALL
 SELECT {R}, unnest(range(p + 1, c)) :: INT AS c, 'null', NULL FROM (SELECT {R}, c, lag(c) OVER (PARTITION BY {R} ORDER BY c) AS p FROM wide
  JOIN (SELECT {S} FROM wide GROUP BY ALL HAVING max(c) > 100) k USING ({S})) x WHERE c - p > 1""")
query("sheet_dimensions", lambda t: op.sheet_dimensions(t.cells.unionByName(t.wide, allowMissingColumns=True), t.sheets), "sheets cells wide",
      f"""SELECT {S}, coalesce(min_row, r1) AS min_row, coalesce(min_col, c1) AS min_col, coalesce(max_row, r2) AS max_row, coalesce(max_col, c2) AS max_col
 FROM (SELECT {S}, min(r) AS r1, min(c) AS c1, max(r) AS r2, max(c) AS c2 FROM (SELECT {R}, c FROM cells UNION ALL SELECT {R}, c FROM wide) u GROUP BY ALL) o FULL JOIN sheets USING ({S})""")

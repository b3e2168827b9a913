"""SQL building blocks shared by the DuckDB counterparts (plain formulations, no block scans)."""

VALUE = """CASE vtype WHEN 'number' THEN CASE WHEN vnum = floor(vnum) THEN CAST(CAST(vnum AS BIGINT) AS VARCHAR) ELSE CAST(vnum AS VARCHAR) END
 WHEN 'boolean' THEN CASE WHEN vbool THEN 'True' ELSE 'False' END WHEN 'null' THEN NULL ELSE vtext END"""
FILLED = """(CASE WHEN vtype IN ('string','date','error') THEN length(trim(coalesce(vtext,''))) > 0
 WHEN vtype = 'number' THEN vnum IS NOT NULL WHEN vtype = 'boolean' THEN vbool IS NOT NULL ELSE false END)"""
LOOSE = r"regexp_matches(replace(replace({0},'.',''),'-',''), '^\d+$')"
STRICT = r"regexp_matches(replace(replace(replace(replace({0},',',''),'$',''),'%',''),' ',''), '^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$')"
DATES = (
    r"regexp_matches({0}, '(?i)\d{{1,2}}[/-]\d{{1,2}}[/-]\d{{2,4}}|\d{{4}}[/-]\d{{1,2}}[/-]\d{{1,2}}|\w{{3}}\s+\d{{1,2}}[,]?\s+\d{{4}}"
    r"|\d{{1,2}}\s+\w{{3}}\s+\d{{4}}|Q[1-4]\s+\d{{4}}|\d{{4}}Q[1-4]')"
)
NUM = "vtype IN ('number','boolean')"
TXT = "vtype IN ('string','date','error')"
LETTERS = """(CASE WHEN {0} > 702 THEN chr(CAST(65 + ((({0}) - 703) // 676) % 26 AS INT)) ELSE '' END
 || CASE WHEN {0} > 26 THEN chr(CAST(65 + ((({0}) - 27) // 26) % 26 AS INT)) ELSE '' END || chr(CAST(65 + (({0}) - 1) % 26 AS INT)))"""

SHARED: dict[str, tuple[str, list[str]]] = {
    "norm": (f"SELECT *, {VALUE} AS value FROM cells WHERE {FILLED}", ["cells"]),
    "prof": (
        f"""SELECT n.workbook_id, n.sheet_id, r, count(*) AS n, min(c) AS c1, max(c) AS c2,
 count(*) FILTER ({NUM} OR {LOOSE.format('vtext')}) AS n_loose,
 count(*) FILTER ({NUM} OR {STRICT.format('vtext')}) AS n_strict,
 count(*) FILTER ({TXT} AND NOT {STRICT.format('vtext')}) AS n_text,
 count(*) FILTER ({TXT} AND length(vtext) > 3 AND NOT {LOOSE.format('vtext')}) AS n_label,
 count(*) FILTER (c > min_col AND {DATES.format('value')}) AS n_date, count(*) FILTER (c > min_col) AS n_right,
 count(*) FILTER (regexp_matches(value, '202[0-9]-\\d{{2}}-\\d{{2}}')) + count(*) FILTER (regexp_matches(value, '(?i)Month \\d+')) AS n_temporal,
 count(*) FILTER (c = min_col AND {TXT}) AS first_str, count(*) FILTER (c = min_col AND {TXT} AND NOT {STRICT.format('vtext')}) AS first_txt,
 max(CASE WHEN c = min_col AND {TXT} THEN trim(vtext) END) AS first_label
FROM norm n JOIN sheets s ON n.workbook_id = s.workbook_id AND n.sheet_id = s.sheet_id
WHERE r BETWEEN min_row AND max_row GROUP BY ALL""".replace("min_col AND", "s.min_col AND"),
        ["norm", "sheets"],
    ),
    # One row per data row with its predecessor's pattern.
    "seq": (
        """SELECT *, n_loose > n / 2 AS mostly_numeric, n_label > 2 AS has_labels, n_strict > 0 AND n_text > 0 AS mixed,
 n_strict / n AS num_ratio, c2 - c1 + 1 AS span, n_temporal / n > 0.25 AS temporal,
 lag(r) OVER w AS pr, r - lag(r) OVER w - 1 AS gap, lag(n) OVER w AS pn, lag(n_loose > n / 2) OVER w AS pnum,
 lag(n_label > 2) OVER w AS plab, lag(n_strict / n) OVER w AS pratio, lag(c2 - c1 + 1) OVER w AS pspan
FROM prof WINDOW w AS (PARTITION BY workbook_id, sheet_id ORDER BY r)""",
        ["prof"],
    ),
}

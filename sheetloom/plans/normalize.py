"""Queries of the cell normalisation operators."""

from pyspark.sql import functions as F

from sheetloom.functions import fixed
from sheetloom.operators import normalize as op
from sheetloom.plans.ctes import DATES, LETTERS, LOOSE, STRICT, VALUE
from sheetloom.plans.registry import query

KEY = ["workbook_id", "sheet_id", "r", "c"]
K = "workbook_id, sheet_id, r, c"
ERR = "|".join(fixed.ERROR_TERMS).replace("'", "''")

query("normalize_cells", lambda t: op.normalize_cells(t.cells).select(*KEY, "value"), "norm", f"SELECT {K}, value FROM norm")

query(
    "a1_encode",
    lambda t: op.region_ref(
        op.a1_encode(t.wide).withColumns({"r1": F.col("r"), "c1": F.lit(1), "r2": F.col("r"), "c2": F.col("c")})
    ).select(*KEY, "ref", "region_ref"),
    "wide",
    f"SELECT {K}, {LETTERS.format('c')} || CAST(r AS VARCHAR) AS ref, 'A' || r || ':' || {LETTERS.format('c')} || r AS region_ref FROM wide",
)
query(
    "a1_decode",
    lambda t: op.a1_decode(
        op.a1_encode(t.wide).select("ref").union(t.orders.select("o_orderpriority"))
    ).groupBy("ref", "row", "col").agg(F.count("*").alias("n")),
    "wide orders",
    f"""SELECT ref, "row", col, count(*) AS n FROM (SELECT {LETTERS.format('c')} || CAST(r AS VARCHAR) AS ref, r AS "row", c AS col FROM wide
 UNION ALL SELECT o_orderpriority, 0, 0 FROM orders) GROUP BY ALL""",
)
query(
    "cell_type",
    lambda t: op.cell_type(t.cells).select(
        *KEY, "data_type", "is_number", "is_boolean", "is_date", "is_string", "is_error", "is_formula"
    ),
    "cells",
    f"""SELECT {K}, vtype AS data_type, vtype='number' AS is_number, vtype='boolean' AS is_boolean, vtype='date' AS is_date,
 vtype='string' AS is_string, vtype='error' AS is_error, formula IS NOT NULL AS is_formula FROM cells""",
)
query(
    "iso_value",
    lambda t: op.iso_value(t.processing.select("seq", "ts"), "ts").select("seq", "iso")
    .union(op.iso_value(t.orders.select((-1 - F.col("o_orderkey")).alias("seq"), "o_orderdate"), "o_orderdate").select("seq", "iso")),
    "processing",
    """SELECT seq, CASE WHEN microsecond(ts) % 1000000 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') END AS iso
 FROM (SELECT seq, ts FROM processing UNION ALL SELECT -1 - o_orderkey, o_orderdate FROM orders) x""",
)
query(
    "formula_kind",
    lambda t: op.formula_kind(t.cells).select(*KEY, "formula_type"),
    "cells",
    f"SELECT {K}, CASE WHEN formula LIKE '{{%}}' THEN 'array' ELSE 'normal' END AS formula_type FROM cells WHERE formula IS NOT NULL",
)
query(
    "meaningful_value",
    lambda t: op.meaningful_value(
        t.cells.withColumn("value", F.when(F.col("c") == 5, F.substring("style", 1, 1)).otherwise(op.fc.value_text()))
    ).select(*KEY, "meaningful", "meaningful_strict"),
    "cells",
    f"""SELECT {K}, coalesce(length(t) > 0, false) AS meaningful, coalesce(length(t) > 0 AND (length(t) > 1 OR regexp_matches(t, '^[A-Za-z0-9]$')), false) AS meaningful_strict
 FROM (SELECT {K}, trim(CASE WHEN c = 5 THEN substr(style, 1, 1) ELSE {VALUE} END) AS t FROM cells) x""",
)
query(
    "numeric_loose",
    lambda t: op.numeric_loose(t.cells).filter("vtext is not null").select(*KEY, "numeric_loose"),
    "cells",
    f"SELECT {K}, {LOOSE.format('vtext')} AS numeric_loose FROM cells WHERE vtext IS NOT NULL",
)
query(
    "numeric_strict",
    lambda t: op.numeric_strict(t.words.select("doc_id", "line_no", "word_no", "text"), "text"),
    "words",
    f"SELECT doc_id, line_no, word_no, text, {STRICT.format('text')} AS numeric_strict FROM words",
)
query(
    "date_like",
    lambda t: op.date_like(op.normalize_cells(t.cells)).select(*KEY, "date_like"),
    "norm",
    f"SELECT {K}, {DATES.format('trim(value)')} AS date_like FROM norm",
)
query(
    "temporal_like",
    lambda t: op.temporal_like(op.normalize_cells(t.cells)).select(*KEY, "temporal_hits"),
    "norm",
    rf"""SELECT {K}, CAST(regexp_matches(value, '202[0-9]-\d{{2}}-\d{{2}}') AS INT) + CAST(regexp_matches(value, '(?i)Month \d+') AS INT) AS temporal_hits FROM norm""",
)
query(
    "error_text_filter",
    lambda t: op.error_text_filter(
        t.processing.selectExpr("seq as id", "coalesce(status, event_type) as text").union(t.documents.select("doc_id", "text"))
        .union(t.cells.filter("vtext is not null").select("sheet_id", "vtext"))
    ).groupBy("id", "is_error", "dropped").agg(F.count("*").alias("n")),
    "processing cells",
    f"""SELECT id, is_error, is_error AND length(text) < 50 AS dropped, count(*) AS n FROM (
 SELECT id, text, regexp_matches(lower(text), '{ERR}') OR regexp_matches(lower(text), '( of type| must be)$') OR lower(text) IN ('of type','must be')
   OR trim(text) IN ('...','---','***','!!!','???') AS is_error
 FROM (SELECT seq AS id, coalesce(status, event_type) AS text FROM processing UNION ALL SELECT doc_id, text FROM documents
       UNION ALL SELECT sheet_id, vtext FROM cells WHERE vtext IS NOT NULL) a) b GROUP BY ALL""",
)
query(
    "prune_empty",
    lambda t: op.prune_empty(t.cells),
    "cells",
    f"""SELECT {K}, "key", leaf FROM (
 SELECT {K}, unnest(['value','formula','data_type','style','bold','has_comment']) AS "key",
  unnest([{VALUE}, formula, vtype, style, CASE WHEN bold THEN 'true' END, CASE WHEN has_comment THEN 'true' END]) AS leaf FROM cells) x
 WHERE length(trim(leaf)) > 0 AND NOT (length(leaf) < 50 AND (regexp_matches(lower(leaf), '{ERR}') OR trim(leaf) IN ('...','---','***','!!!','???')))""",
)

# Style texts with default parts, one per order.
RAW_STYLE = """SELECT o_orderkey, '{"font":{"name":"' || CASE WHEN o_orderkey%3=0 THEN ' ' ELSE 'Arial' END || '","size":' || CAST(8+o_orderkey%5 AS STRING)
 || ',"bold":' || CASE WHEN o_orderkey%2=0 THEN 'true' ELSE 'false' END || '},"fill":{"fill_type":"solid","start_color":{"rgb":"'
 || CASE WHEN o_orderstatus='O' THEN '00000000' ELSE 'FFCCCCCC' END || '","tint":' || CASE WHEN o_orderkey%7=0 THEN '0.5' ELSE '0.0' END
 || '}},"alignment":{"horizontal":' || CASE WHEN o_orderkey%4=0 THEN 'null' ELSE '"left"' END || ',"wrap_text":' || CASE WHEN o_orderkey%6=0 THEN 'true' ELSE 'false' END
 || ',"indent":' || CAST(o_orderkey%3 AS STRING) || '},"number_format":"' || CASE WHEN o_orderkey%9=0 THEN '' ELSE 'General' END || '"}' AS style FROM orders"""


def _raw_styles(t):
    t.orders.createOrReplaceTempView("orders_for_styles")
    return t.spark.sql(RAW_STYLE.replace("FROM orders", "FROM orders_for_styles"))


query(
    "clean_style",
    lambda t: op.clean_style(_raw_styles(t)).selectExpr(
        "o_orderkey", "clean.font.name as font_name", "clean.font.size as font_size", "clean.font.bold as font_bold",
        "clean.fill.fill_type as fill_type", "clean.fill.start_color.rgb as fill_rgb",
        "clean.alignment.horizontal as horizontal", "clean.alignment.indent as indent",
        "clean.alignment.wrap_text as wrap_text", "clean.number_format as number_format",
    ),
    "orders",
    """SELECT o_orderkey, CASE WHEN o_orderkey%3<>0 THEN 'Arial' END AS font_name, CAST(8+o_orderkey%5 AS DOUBLE) AS font_size, o_orderkey%2=0 AS font_bold,
 CASE WHEN NOT (o_orderstatus='O' AND o_orderkey%7<>0) THEN 'solid' END AS fill_type,
 CASE WHEN o_orderstatus<>'O' THEN 'FFCCCCCC' WHEN o_orderkey%7=0 THEN '00000000' END AS fill_rgb,
 CASE WHEN o_orderkey%4<>0 THEN 'left' END AS horizontal, CASE WHEN o_orderkey%3<>0 THEN CAST(o_orderkey%3 AS DOUBLE) END AS indent,
 CASE WHEN o_orderkey%6=0 THEN true END AS wrap_text, CASE WHEN o_orderkey%9<>0 THEN 'General' END AS number_format FROM orders""",
)
query(
    "normalize_color",
    lambda t: op.normalize_color(
        t.orders.selectExpr("o_orderkey", "case when o_orderkey%3=0 then array(o_custkey%256, o_orderkey%256, 7) end as parts",
                            "case when o_orderkey%3=1 then o_orderstatus end as txt", "o_custkey * 977 as packed"),
        "txt", "packed", "parts",
    ).select("o_orderkey", "rgb"),
    "orders",
    """SELECT o_orderkey, CASE o_orderkey%3 WHEN 0 THEN 'FF' || printf('%02X%02X%02X', o_custkey%256, o_orderkey%256, 7) WHEN 1 THEN o_orderstatus
 ELSE 'FF' || printf('%06X', (o_custkey * 977) % 16777216) END AS rgb FROM orders""",
)
query(
    "frozen_parse",
    lambda t: op.frozen_parse(
        t.wide.selectExpr("workbook_id", "sheet_id", "r", "c").transform(op.a1_encode)
        .withColumn("ref", F.expr("case when c % 5 = 0 then ref || ':D9' when c % 7 = 0 then '?' else ref end"))
    ).groupBy("workbook_id", "sheet_id", "r", "c", "frozen_rows", "frozen_cols").agg(F.count("*").alias("n")),
    "wide",
    f"""SELECT {K}, CASE WHEN c%5=0 OR c%7=0 THEN 0 ELSE r-1 END AS frozen_rows, CASE WHEN c%5=0 OR c%7=0 THEN 0 ELSE c-1 END AS frozen_cols, count(*) AS n FROM wide GROUP BY ALL""",
)
query(
    "formula_class",
    lambda t: op.formula_class(t.cells).select(*KEY, "is_complex", "category"),
    "cells",
    rf"""SELECT {K}, regexp_matches(formula, '(?i)IF.*IF|VLOOKUP|INDEX.*MATCH|SUMPRODUCT|\$[A-Z]+\$\d+:\$[A-Z]+\$\d+') AS is_complex,
 CASE WHEN upper(formula) LIKE '%SUM%' THEN 'sum' WHEN upper(formula) LIKE '%IF%' THEN 'conditional'
  WHEN regexp_matches(upper(formula), 'VLOOKUP|HLOOKUP|INDEX|MATCH') THEN 'lookup' WHEN regexp_matches(formula, '[$:]') THEN 'reference' ELSE 'other' END AS category
 FROM cells WHERE formula IS NOT NULL""",
)
query(
    "format_units",
    lambda t: op.format_units(
        t.orders.selectExpr("o_orderkey", "cast(o_totalprice * o_totalprice / 64 as bigint) as size", "o_custkey * 1.25D as secs",
                            "case when o_orderkey % 2 = 0 then date_format(o_orderdate, \"yyyy-MM-dd'T'HH:mm:ss\") else o_orderpriority end as stamp"),
        "size", "secs", "stamp",
    ).select("o_orderkey", "size_text", "size_text_gb", "duration_text", "label_text"),
    "orders",
    """SELECT o_orderkey, CASE WHEN s < 1024 THEN printf('%d B', s) WHEN s < 1048576 THEN printf('%.1f KB', s/1024) ELSE printf('%.1f MB', s/1048576) END AS size_text,
 CASE WHEN s = 0 THEN '0 B' WHEN s < 1024 THEN printf('%.1f B', CAST(s AS DOUBLE)) WHEN s < 1048576 THEN printf('%.1f KB', s/1024)
  WHEN s < 1073741824 THEN printf('%.1f MB', s/1048576) ELSE printf('%.1f GB', s/1073741824) END AS size_text_gb,
 CASE WHEN d < 1 THEN printf('%dms', CAST(floor(d*1000) AS BIGINT)) WHEN d < 60 THEN printf('%.1fs', d)
  WHEN d < 3600 AND d % 60 < 1 THEN printf('%dm', CAST(floor(d/60) AS BIGINT))
  WHEN d < 3600 THEN printf('%dm %ds', CAST(floor(d/60) AS BIGINT), CAST(round_even(d % 60, 0) AS BIGINT))
  ELSE printf('%dh %dm', CAST(floor(d/3600) AS BIGINT), CAST(floor((d % 3600)/60) AS BIGINT)) END AS duration_text,
 CASE WHEN o_orderkey%2=0 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE o_orderpriority END AS label_text
 FROM (SELECT *, CAST(trunc(o_totalprice * o_totalprice / 64) AS BIGINT) AS s, o_custkey * CAST(1.25 AS DOUBLE) AS d FROM orders) x""",
)

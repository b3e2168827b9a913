"""Queries of the number extraction operators."""

from pyspark.sql import functions as F

from sheetloom.functions import fixed
from sheetloom.operators import numbers as op
from sheetloom.plans.ctes import SHARED
from sheetloom.plans.registry import query

D = "doc_id, page_no, section_no"


def _marked(fmt: str, pattern: str, flag: str) -> str:
    """Rows (section, fmt, start, text) of one pattern; RE2 has no look-around, so the percentage tests its neighbours."""
    lead, body = (r"(^|\W)", r"\d+(?:\.\d+)?%") if "(?<!" in pattern else ("()", pattern)
    parts = f"string_split(replace(regexp_replace(content, '{flag}{lead}({body})', '\\1' || chr(1) || '\\2' || chr(2), 'g'), chr(2), chr(1)), chr(1))"
    after = r" AND NOT regexp_matches(coalesce(nxt, ''), '^\w')" if "(?!" in pattern else ""
    return f"""SELECT {D}, '{fmt}' AS fmt, CAST(pos AS INT) AS start, p AS text FROM (
 SELECT *, sum(length(p)) OVER w - length(p) AS pos, lead(p) OVER w AS nxt FROM (SELECT {D}, unnest(ps) AS p, unnest(range(0, len(ps))) AS i FROM (SELECT {D}, {parts} AS ps FROM @src@) a) b
 WINDOW w AS (PARTITION BY {D} ORDER BY i)) c WHERE i % 2 = 1{after}"""


def _cands(patterns: dict, src: str = "sections", flag: str = "(?i)") -> str:
    return "\nUNION ALL ".join(_marked(f, p, flag) for f, p in patterns.items()).replace("@src@", src)


def _terms(words, col):
    return "(" + " + ".join(f"CAST(contains(lower({col}), '{w}') AS INT)" for w in words) + ")"


VALUE = r"""CASE fmt WHEN 'currency' THEN TRY_CAST(regexp_replace(text, '[\$,\s]', '', 'g') AS DOUBLE) WHEN 'percentage' THEN TRY_CAST(replace(text,'%','') AS DOUBLE)
 WHEN 'integer' THEN TRY_CAST(replace(text, ',', '') AS DOUBLE) WHEN 'decimal' THEN TRY_CAST(text AS DOUBLE) WHEN 'scientific_notation' THEN TRY_CAST(text AS DOUBLE)
 WHEN 'fraction' THEN CAST(split_part(text,'/',1) AS DOUBLE) / nullif(CAST(split_part(text,'/',2) AS DOUBLE), 0) WHEN 'ratio' THEN TRY_CAST(replace(text,'x','') AS DOUBLE)
 WHEN 'date_number' THEN TRY_CAST(nullif(regexp_extract(text, '((?:19|20)\d{2})', 1), '') AS DOUBLE) WHEN 'ordinal' THEN TRY_CAST(regexp_replace(text, '(st|nd|rd|th)', '', 'g') AS DOUBLE) END"""
CONTEXT = r"trim(regexp_replace(substr(content, greatest(start - 100, 0) + 1, start + length(text) + 100 - greatest(start - 100, 0)), '\s+', ' ', 'g'))"
CONF = f"""greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.7::DOUBLE + CASE WHEN fmt IN ('currency','percentage') THEN 0.2::DOUBLE WHEN fmt='integer' AND contains(text, ',') THEN 0.1::DOUBLE ELSE 0::DOUBLE END
 + least(0.1::DOUBLE * {_terms(fixed.BUSINESS_TERMS, 'context')}, 0.2::DOUBLE) - least(0.1::DOUBLE * {_terms(fixed.LAYOUT_TERMS, 'context')}, 0.3::DOUBLE)))"""
PRIO = "CASE fmt " + " ".join(f"WHEN '{f}' THEN {i}" for i, f in enumerate(fixed.NUMBER_PRIORITY)) + " END"


def _scored(cand: str) -> str:
    return f"SELECT *, {VALUE} AS value, {CONF} AS confidence FROM (SELECT *, {CONTEXT} AS context FROM {cand} JOIN sections USING ({D})) q"


def _kept(scored: str) -> str:
    return f"""SELECT {D}, k.fmt, k.start, k.text, k.value, k.confidence FROM (SELECT {D}, unnest((list_reduce(ms, lambda a, m: CASE WHEN m.s >= a.e THEN {{'e': m.e, 'k': list_append(a.k, m.k)}} ELSE a END,
  {{'e': 0, 'k': list_filter(list_transform(ms, lambda m: m.k), lambda x: false)}})).k) AS k
 FROM (SELECT {D}, list({{'s': start, 'e': start + length(text), 'k': {{'fmt': fmt, 'start': start, 'text': text, 'value': value, 'confidence': confidence}}}} ORDER BY start, {PRIO}, -length(text)) AS ms
  FROM {scored} WHERE value IS NOT NULL AND confidence >= 0.7::DOUBLE GROUP BY ALL) g) h"""


SHARED["cand"] = (_cands(fixed.NUMBERS_MAIN), ["sections"])
SHARED["scored"] = (_scored("cand"), ["cand", "sections"])
SHARED["kept"] = (_kept("scored"), ["scored"])
SHARED["cand2"] = (_cands(fixed.NUMBERS_LEGACY), ["sections"])
SHARED["scored2"] = (_scored("cand2"), ["cand2", "sections"])
SHARED["kept2"] = (_kept("scored2"), ["scored2"])

ID = [*op.SECTION, "fmt", "start", "text"]
C = f"{D}, fmt, start, text"


def cands(t):
    return op.number_candidates(t.sections)


def with_context(t):
    d = op.number_candidates(t.sections.withColumn("blanks", op.other_blanks(F.col("content"))))
    return d.withColumn("context", op.number_context(F.col("content"), F.col("start"), F.col("text"), blanks=F.col("blanks")))


query("number_candidates", lambda t: cands(t).select(*ID), "cand", f"SELECT {C} FROM cand")
query("number_value", lambda t: cands(t).select(*ID, F.round(op.number_value(F.col("fmt"), F.col("text")), 9).alias("value")), "cand", f"SELECT {C}, round({VALUE}, 9) AS value FROM cand")
query("number_context", lambda t: with_context(t).select(*ID, "context"), "scored", f"SELECT {C}, context FROM scored")
query("number_confidence", lambda t: with_context(t).select(*ID, op.number_confidence(F.col("fmt"), F.col("text"), F.col("context")).alias("confidence")), "scored", f"SELECT {C}, confidence FROM scored")
UNIT = "CASE WHEN fmt='percentage' THEN 'percent' " + " ".join(f"WHEN regexp_matches(lower(context), '{p}') THEN '{u}'" for p, u in fixed.UNITS.items()) + " END"
query("number_unit", lambda t: with_context(t).select(*ID, op.number_unit(F.col("fmt"), F.col("context")).alias("unit")), "scored", f"SELECT {C}, {UNIT} AS unit FROM scored")
query("number_currency", lambda t: cands(t).select(*ID, op.number_currency(F.col("fmt"), F.col("text")).alias("currency")), "cand",
      f"SELECT {C}, CASE WHEN fmt='currency' AND contains(text, '$') THEN 'USD' END AS currency FROM cand")
query("number_position", lambda t: op.number_position(cands(t)).select(*ID, "line_number", "x", "y", "x_end", "y_end"), "cand sections",
      f"""SELECT {C}, CAST(ln AS INT) AS line_number, x, y, x + 6 * length(text) AS x_end, y + 12 AS y_end FROM (
 SELECT *, x0 + 6 * length(list_extract(string_split(pre, chr(10)), -1)) AS x, top + 12 * ln AS y FROM (
  SELECT *, len(string_split(pre, chr(10))) AS ln FROM (SELECT *, substr(content, 1, start) AS pre FROM cand JOIN sections USING ({D})) a) b) c""")
query("resolve_overlaps", lambda t: op.resolve_overlaps(t.sections).select(*ID, F.round("value", 9).alias("value"), "confidence"), "kept",
      f"SELECT {C}, round(value, 9) AS value, confidence FROM kept")
query("extract_numbers", lambda t: op.extract_numbers(t.sections).select(*ID, "unit", "currency", "line_number"), "kept scored",
      f"""SELECT {C}, {UNIT} AS unit, CASE WHEN fmt='currency' THEN 'USD' END AS currency, CAST(len(string_split(substr(content, 1, start), chr(10))) AS INT) AS line_number FROM kept JOIN scored USING ({C})""")
SHARED["simple_src"] = (f"SELECT * FROM sections WHERE length(trim(content)) >= 10 AND {_terms(fixed.LAYOUT_TERMS, 'content')} <= 2", ["sections"])
SHARED["simple"] = (_cands(fixed.NUMBERS_SIMPLE, "simple_src", ""), ["simple_src", "sections"])
query("numbers_simple", lambda t: op.numbers_simple(t.sections).select(*ID), "simple",
      f"""SELECT {C} FROM (SELECT *, lower(substr(content, greatest(start - 50, 0) + 1, start + length(text) + 50 - greatest(start - 50, 0))) AS ctx FROM simple JOIN sections USING ({D})) x
 WHERE NOT regexp_matches(ctx, '{"|".join(fixed.SKIP_CONTEXTS)}') AND NOT (coalesce(TRY_CAST(regexp_replace(text, '[^\\d.]', '', 'g') AS DOUBLE) < 1, false) AND NOT regexp_matches(text, '[$%]'))""")
SHARED["fallback"] = (_cands(fixed.NUMBERS_FALLBACK, "sections", ""), ["sections"])
query("numbers_fallback", lambda t: op.numbers_fallback(t.sections).select(*ID, "value", "confidence", "currency"), "fallback",
      f"""SELECT {C}, coalesce(TRY_CAST(replace(replace(replace(text,'$',''),',',''),'%','') AS DOUBLE), 0) AS value, 0.75::DOUBLE AS confidence, CASE WHEN fmt='currency' THEN 'USD' END AS currency FROM fallback""")
query("numbers_legacy", lambda t: op.resolve_overlaps(t.sections, fixed.NUMBERS_LEGACY).select(*ID, F.round("value", 9).alias("value"), "confidence"), "kept2",
      f"SELECT {C}, round(value, 9) AS value, confidence FROM kept2")
query("number_summaries", lambda t: op.number_summaries(op.resolve_overlaps(t.sections)), "kept",
      """SELECT doc_id, summary, label, count(*) AS n FROM (SELECT doc_id, 'type' AS summary, fmt AS label FROM kept UNION ALL SELECT doc_id, 'page', CAST(page_no AS VARCHAR) FROM kept
 UNION ALL SELECT doc_id, 'confidence', CASE WHEN confidence >= 0.8::DOUBLE THEN 'high' WHEN confidence >= 0.6::DOUBLE THEN 'medium' ELSE 'low' END FROM kept) x GROUP BY ALL""")


def _table_values(t):
    """Order totals stand for the numbers of a document's table."""
    return t.orders.select((F.col("o_orderkey") * 2).alias("doc_id"), F.col("o_totalprice").alias("value")).union(
        t.orders.select(F.col("o_orderkey") * 2, (F.col("o_orderkey") % 3 + 1) * F.lit(1e6)))


query("table_text_overlap", lambda t: op.table_text_overlap(_table_values(t), op.resolve_overlaps(t.sections)), "kept orders",
      """SELECT doc_id, text_numbers, coalesce(shared, 0) AS shared FROM (SELECT doc_id, count(*) AS text_numbers FROM kept GROUP BY ALL) a LEFT JOIN (
 SELECT doc_id, count(*) AS shared FROM (SELECT DISTINCT doc_id, value FROM kept INTERSECT (SELECT o_orderkey*2, o_totalprice FROM orders UNION SELECT o_orderkey*2, (o_orderkey%3+1)*1000000.0::DOUBLE FROM orders)) b GROUP BY ALL) c USING (doc_id)""")
query("overlap_improvement",
      lambda t: op.overlap_improvement(
          op.table_text_overlap(_table_values(t), op.numbers_fallback(t.sections)),
          op.table_text_overlap(_table_values(t), op.resolve_overlaps(t.sections, fixed.NUMBERS_LEGACY))),
      "fallback kept2 orders",
      """WITH tv AS (SELECT o_orderkey*2 AS doc_id, o_totalprice AS value FROM orders UNION SELECT o_orderkey*2, (o_orderkey%3+1)*1000000.0::DOUBLE FROM orders),
 fb AS (SELECT doc_id, coalesce(TRY_CAST(replace(replace(replace(text,'$',''),',',''),'%','') AS DOUBLE), 0) AS value FROM fallback),
 x AS (SELECT doc_id, coalesce(n, 0) AS before FROM (SELECT DISTINCT doc_id FROM fb) a LEFT JOIN (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, value FROM fb INTERSECT SELECT * FROM tv) b GROUP BY ALL) c USING (doc_id)),
 y AS (SELECT doc_id, coalesce(n, 0) AS after FROM (SELECT DISTINCT doc_id FROM kept2) a LEFT JOIN (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, value FROM kept2 INTERSECT SELECT * FROM tv) b GROUP BY ALL) c USING (doc_id))
 SELECT doc_id, before, after, round((before - after) / greatest(before, 1), 6) AS improvement FROM x JOIN y USING (doc_id)""")

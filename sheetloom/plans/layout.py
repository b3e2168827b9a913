"""Queries of the page layout operators."""

from pyspark.sql import functions as F

from sheetloom.operators import layout as op
from sheetloom.operators import numbers
from sheetloom.plans.ctes import SHARED
from sheetloom.plans.registry import query
from sheetloom.schemas import PAGE

P, WK = "doc_id, page_no", "doc_id, page_no, line_no, word_no"
T = "doc_id, page_no, table_no"
KEY = [*PAGE, "table_no"]

RAW = "CASE o_orderkey%5 WHEN 0 THEN '3' WHEN 1 THEN '3-5' WHEN 2 THEN 'abc' WHEN 3 THEN CAST(o_custkey AS STRING) END"
ZT = """SELECT doc_id, page_no, min(x0) AS x0, min(top) AS top, max(x1) AS x1, max(bottom) AS bottom FROM words WHERE line_no % 40 BETWEEN 10 AND 14 GROUP BY doc_id, page_no"""
SHARED["zt"] = (ZT, ["words"])
SHARED["zones"] = (f"SELECT {P}, greatest(x0 - 10, 0) AS x0, greatest(top - 10, 0) AS top, x1 + 10 AS x1, bottom + 10 AS bottom FROM zt", ["zt"])
SHARED["wr"] = (
    f"""SELECT w.*, row_no FROM words w JOIN (SELECT {P}, top, dense_rank() OVER (PARTITION BY {P} ORDER BY anchor) AS row_no FROM (SELECT {P}, x.t AS top, x.a AS anchor FROM (
 SELECT {P}, unnest((list_reduce(tops, lambda s, t: CASE WHEN t - s.a <= 3 THEN {{'a': s.a, 'o': list_append(s.o, {{'t': t, 'a': s.a}})}} ELSE {{'a': t, 'o': list_append(s.o, {{'t': t, 'a': t}})}} END,
  {{'a': -1e9::DOUBLE, 'o': list_filter([{{'t': 0::DOUBLE, 'a': 0::DOUBLE}}], lambda q: false)}})).o) AS x FROM (SELECT {P}, list(DISTINCT top ORDER BY top) AS tops FROM words GROUP BY ALL) g) h) i) j
 ON w.doc_id=j.doc_id AND w.page_no=j.page_no AND w.top=j.top""", ["words"])
SHARED["lines"] = (
    f"""SELECT {P}, row_no, n, first_x, CASE WHEN n < 2 THEN false WHEN n > 2 THEN count(*) FILTER (abs(g - (last_x - first_x) / (n - 1)) < (last_x - first_x) / (n - 1) * 0.5::DOUBLE) >= (n - 1) * 0.6::DOUBLE ELSE n >= 3 END AS tabular FROM (
 SELECT *, x0 - lag(x0) OVER (PARTITION BY {P}, row_no ORDER BY x0, line_no, word_no) AS g, count(*) OVER r AS n, min(x0) OVER r AS first_x, max(x0) OVER r AS last_x FROM wr WINDOW r AS (PARTITION BY {P}, row_no)) x GROUP BY {P}, row_no, n, first_x, last_x""", ["wr"])
SHARED["treg"] = (
    f"""SELECT {P}, st AS start_row, max(rn) AS end_row, count(*) AS rows, row_number() OVER (PARTITION BY {P} ORDER BY st) AS table_no FROM (SELECT {P}, x.r AS rn, x.s AS st FROM (
 SELECT {P}, unnest((list_reduce(rs, lambda s, r: CASE WHEN NOT r.tab THEN {{'act': false, 'w': s.w, 'px': s.px, 'cur': s.cur, 'o': s.o}}
   WHEN s.act AND abs(r.n - s.w) <= 2 AND abs(r.x - s.px) <= 20 THEN {{'act': true, 'w': s.w, 'px': r.x, 'cur': s.cur, 'o': list_append(s.o, {{'r': r.r, 's': s.cur}})}}
   ELSE {{'act': true, 'w': r.n, 'px': r.x, 'cur': r.r, 'o': list_append(s.o, {{'r': r.r, 's': r.r}})}} END,
  {{'act': false, 'w': 0::BIGINT, 'px': 0::DOUBLE, 'cur': 0::BIGINT, 'o': list_filter([{{'r': 0::BIGINT, 's': 0::BIGINT}}], lambda q: false)}})).o) AS x
 FROM (SELECT {P}, list({{'r': row_no, 'n': n, 'x': first_x, 'tab': tabular}} ORDER BY row_no) AS rs FROM lines GROUP BY ALL) g) h) i GROUP BY {P}, st HAVING count(*) >= 2""", ["lines"])
SHARED["tc"] = (
    f"""SELECT w.*, table_no, w.row_no - start_row + 1 AS r, row_number() OVER (PARTITION BY w.doc_id, w.page_no, w.row_no ORDER BY x0, line_no, word_no) AS c
 FROM wr w JOIN treg g ON w.doc_id=g.doc_id AND w.page_no=g.page_no AND w.row_no BETWEEN start_row AND end_row""", ["wr", "treg"])
SW = "the|and|or|but|in|on|at|to|for|of|with|by"
SHARED["prose"] = (
    f"""SELECT {T}, count(DISTINCT width) AS widths, count(*) AS rows, CAST(sum(filled) AS BIGINT) AS filled, CAST(sum(hits) AS BIGINT) AS hits, count(DISTINCT width) > count(*) * 0.5::DOUBLE OR coalesce(sum(hits) / nullif(sum(filled), 0) > 0.4::DOUBLE, true) AS prose FROM (
 SELECT {T}, r, count(*) AS width, count(*) FILTER (length(t) > 0) AS filled, sum(CASE WHEN length(t) > 0 THEN CAST(regexp_matches(t, '{SW}') AS INT) + CAST(length(t) <= 3 AND regexp_matches(t, '^\\p{{L}}+$') AS INT) + CAST(t LIKE '%...' OR length(t) = 1 AS INT) ELSE 0 END) AS hits
 FROM (SELECT *, lower(trim(text)) AS t FROM tc) a GROUP BY ALL) b GROUP BY ALL""", ["tc"])
MEAN = r"(length(trim(text)) > 3 OR (length(trim(text)) > 1 AND (regexp_matches(text, '\d') OR trim(text) IN ('$','%','N/A','TBD'))))"
SHARED["valid"] = (
    f"""SELECT {T}, rows, cols, rows >= 2 AND cols BETWEEN 2 AND 15 AND filled / total >= 0.4::DOUBLE AND m / total >= 0.25::DOUBLE AND NOT prose AS valid FROM (
 SELECT {T}, max(r) AS rows, max(c) AS cols, count(*) AS total, count(*) FILTER (length(trim(text)) > 0) AS filled, count(*) FILTER ({MEAN}) AS m FROM tc GROUP BY ALL) a JOIN (SELECT {T}, prose FROM prose) b USING ({T})""", ["tc", "prose"])
SHARED["tsum"] = (
    f"""SELECT {T}, max(r) AS rows, max(c) AS cols, min(x0) AS x0, min(top) AS top, max(x1) AS x1, max(bottom) AS bottom,
 'page_' || page_no || '_' || max(r) || 'x' || max(c) || '_' || string_agg(trim(text), '|' ORDER BY r, c) FILTER (r <= 2 AND c <= 3) AS signature,
 list(trim(text) ORDER BY c) FILTER (r = 1) AS heads FROM tc GROUP BY ALL""".replace("GROUP BY ALL", f"GROUP BY {T}"), ["tc"])
SHARED["links"] = (
    f"""SELECT {T}, coalesce(page_no = pp + 1 AND cols = pc AND (SELECT count(*) FROM (SELECT unnest(heads) AS a, unnest(ph) AS b, unnest(range(1, cols + 1)) AS i) q WHERE i <= cols AND (lower(a) = lower(b) OR (a IS NULL AND b IS NULL))) / cols >= 0.7::DOUBLE
  AND abs(x0 - px0) <= 20 AND abs(x1 - px1) <= 20, false) AS linked FROM (SELECT *, lag(page_no) OVER w AS pp, lag(cols) OVER w AS pc, lag(heads) OVER w AS ph, lag(x0) OVER w AS px0, lag(x1) OVER w AS px1 FROM tsum WINDOW w AS (PARTITION BY doc_id ORDER BY page_no, table_no)) x""", ["tsum"])
SHARED["chains"] = (
    f"""SELECT {T}, max(CASE WHEN NOT linked THEN ord END) OVER (PARTITION BY doc_id ORDER BY ord) AS chain, ord FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page_no, table_no) AS ord FROM links) x""", ["links"])
SHARED["blk"] = (
    f"""SELECT doc_id, page_no, x.line_no, x.word_no, CAST(x.no AS INT) AS block_no FROM (SELECT {P}, unnest((list_reduce(ws, lambda b, w:
  CASE WHEN b.no > 0 AND ((abs(w.top - b.top) <= 5 AND w.x0 - b.x1 <= 50) OR (w.top >= b.bottom - 3 AND w.top <= b.bottom + 2 + b.bottom - b.top AND abs(w.x0 - b.x0) <= 20) OR (abs(w.top - b.bottom) <= 30 AND w.x0 - b.x1 <= 100))
   THEN {{'x0': least(b.x0, w.x0), 'top': least(b.top, w.top), 'x1': greatest(b.x1, w.x1), 'bottom': greatest(b.bottom, w.bottom), 'no': b.no, 'o': list_append(b.o, {{'line_no': w.line_no, 'word_no': w.word_no, 'no': b.no}})}}
   ELSE {{'x0': w.x0, 'top': w.top, 'x1': w.x1, 'bottom': w.bottom, 'no': b.no + 1, 'o': list_append(b.o, {{'line_no': w.line_no, 'word_no': w.word_no, 'no': b.no + 1}})}} END,
  {{'x0': 0::DOUBLE, 'top': 0::DOUBLE, 'x1': 0::DOUBLE, 'bottom': 0::DOUBLE, 'no': 0::BIGINT, 'o': list_filter([{{'line_no': 0::INT, 'word_no': 0::INT, 'no': 0::BIGINT}}], lambda q: false)}})).o) AS x
 FROM (SELECT {P}, list({{'top': top, 'x0': x0, 'line_no': line_no, 'word_no': word_no, 'x1': x1, 'bottom': bottom}} ORDER BY top, x0, line_no, word_no) AS ws FROM words GROUP BY ALL) g) h""", ["words"])
SHARED["btext"] = (
    f"""SELECT {P}, block_no, min(x0) AS x0, min(top) AS top, max(x1) AS x1, max(bottom) AS bottom, trim(string_agg(text, ' ' ORDER BY top, x0, line_no, word_no)) AS content,
 arg_min(size, (top, x0, line_no, word_no)) AS font_size, arg_min(fontname, (top, x0, line_no, word_no)) AS font_family FROM words JOIN blk USING ({WK}) GROUP BY ALL""", ["words", "blk"])
SHARED["pars"] = (
    f"""SELECT {P}, block_no, bottom, font_size, font_family, CAST(row_number() OVER (PARTITION BY {P}, block_no ORDER BY i) - 1 AS INT) AS par_no, content FROM (
 SELECT * REPLACE (trim(regexp_replace(content, '\\s+', ' ', 'g')) AS content) FROM (SELECT {P}, block_no, bottom, font_size, font_family, unnest(ps) AS content, unnest(range(0, len(ps))) AS i FROM (
  SELECT *, string_split(regexp_replace(regexp_replace(content, '\\n\\s*\\n', chr(1), 'g'), '\\.\\s+([A-Z])', chr(1) || '\\1', 'g'), chr(1)) AS ps FROM btext) a) b) c WHERE length(content) > 0""", ["btext"])
LT = r"""(CASE WHEN regexp_matches(content, '^\s*[\p{L}\p{N}_]+[\.\)]\s+') OR regexp_matches(content, '^\s*[-•*]\s+') THEN CASE WHEN regexp_matches(content, '^\s*\d+[\.\)]') THEN 'ordered' ELSE 'unordered' END END)"""
SHARED["secs"] = (
    f"""SELECT *, CASE WHEN section_type = 'header' THEN nullif(regexp_replace(regexp_replace(trim(content), '^\\d+\\.?\\s*', ''), '^[^\\p{{L}}\\p{{N}}_]+', ''), '') END AS title FROM (
 SELECT *, CASE WHEN word_count <= 10 AND ((upper(content) = content AND regexp_matches(content, '\\p{{L}}')) OR regexp_matches(lower(content), 'table|figure|section|chapter') OR regexp_matches(content, '^\\d+\\.?\\s+[A-Z]')) THEN 'header'
  WHEN list_type IS NOT NULL THEN 'list' WHEN lower(content) LIKE '%table%' AND (contains(content, ':') OR word_count < 15) THEN 'table_caption'
  WHEN regexp_matches(lower(content), 'figure|fig\\.|chart|graph') AND word_count < 15 THEN 'figure_caption'
  WHEN bottom > 700 OR regexp_matches(lower(content), 'page |copyright|©|all rights') THEN 'footer' ELSE 'paragraph' END AS section_type,
  CASE WHEN font_size >= 20 THEN 1 WHEN font_size >= 16 THEN 2 WHEN font_size >= 14 THEN 3 WHEN font_size >= 12 THEN 4 WHEN font_size >= 10 THEN 5 WHEN font_size >= 8 THEN 6 END AS heading_level,
  word_count BETWEEN 3 AND 500 AND contains(content, '.') AND length(regexp_replace(content, '[\\p{{L}}\\p{{N}}\\s]', '', 'g')) / length(content) <= 0.3::DOUBLE AS llm_ready
 FROM (SELECT *, row_number() OVER (PARTITION BY {P} ORDER BY block_no, par_no) AS section_no, {LT} AS list_type FROM (
  SELECT *, CAST(len(list_filter(regexp_split_to_array(content, '\\s+'), lambda q: q <> '')) AS INT) AS word_count FROM pars) a WHERE word_count >= 3) b) c""", ["pars"])
LC = f"""SELECT {P}, line_no, cell_x AS cell_x0, string_agg(text, ' ' ORDER BY x0, word_no) AS text, min(top) AS top, max(x1) AS x1, max(bottom) AS bottom FROM (
 SELECT *, max(CASE WHEN p IS NULL OR x0 - p > {{gap}} THEN x0 END) OVER (PARTITION BY {P}, line_no ORDER BY x0, word_no) AS cell_x FROM (SELECT *, lag(x1) OVER (PARTITION BY {P}, line_no ORDER BY x0, word_no) AS p FROM words) a) b GROUP BY ALL"""
SHARED["lc"] = (LC.format(gap=5), ["words"])
# cells of the reference's own tolerance, at which words one space apart are one cell
SHARED["lc6"] = (LC.format(gap=6), ["words"])
SHARED["edges"] = (
    f"""SELECT {P}, row_number() OVER (PARTITION BY {P} ORDER BY edge) AS col_no, edge FROM (SELECT {P}, list_extract(list(cell_x0 ORDER BY cell_x0), count(*) // 2 + 1) AS edge FROM (
 SELECT *, sum(CASE WHEN p IS NULL OR cell_x0 - p > 4 THEN 1 ELSE 0 END) OVER (PARTITION BY {P} ORDER BY cell_x0, line_no) AS cl FROM (SELECT *, lag(cell_x0) OVER (PARTITION BY {P} ORDER BY cell_x0, line_no) AS p FROM lc) a) b GROUP BY {P}, cl) c""", ["lc"])
SHARED["gridcells"] = (
    f"""SELECT {P}, line_no, col_no, string_agg(text, ' ' ORDER BY cell_x0) AS text FROM (SELECT l.doc_id, l.page_no, l.line_no, l.cell_x0, l.text,
  (SELECT arg_min(e.col_no, (abs(e.edge - l.cell_x0), e.col_no)) FROM edges e WHERE e.doc_id=l.doc_id AND e.page_no=l.page_no) AS col_no FROM lc l) x GROUP BY ALL""", ["lc", "edges"])


def zone_tables(t):
    w = t.words.filter("line_no % 40 between 10 and 14")
    return w.groupBy(*PAGE).agg(F.min("x0").alias("x0"), F.min("top").alias("top"), F.max("x1").alias("x1"), F.max("bottom").alias("bottom"))


# Tables with a row per word stay where their document is; only what is smaller is stored.
def rows(t):
    return op.words_to_rows(t.words)


def lines(t):
    return op.tabular_row(rows(t))


def regs(t):
    return t.stored("word_regions", lambda: op.tabular_regions(lines(t)))


def tcells(t):
    return t.stored("word_table_cells", lambda: op.region_words(t.by_document(regs(t)), rows(t)))


def tsum(t):
    return op.table_summary(tcells(t))


# Blocks and sections are read once by a query, so each query makes them itself.
def blocks(t):
    return op.block_texts(t.words)


def secs(t):
    return op.sections(blocks(t))


def lcells(t):
    return op.line_cells(t.words, 5.0)


query("page_range", lambda t: op.page_range(t.spark.sql(f"SELECT o_orderkey, {RAW} AS page_raw FROM {{o}}", o=t.orders)), "orders",
      f"""SELECT o_orderkey, {RAW} AS page_raw, CAST(unnest(CASE o_orderkey%5 WHEN 0 THEN [3] WHEN 1 THEN [3,4,5] WHEN 3 THEN [o_custkey] ELSE [1] END) AS INT) AS page_no FROM orders""")
query("exclusion_zones", lambda t: op.exclusion_zones(zone_tables(t)), "zones", "SELECT * FROM zones")
query("exclude_words", lambda t: op.exclude_words(t.words, op.exclusion_zones(zone_tables(t))).select(*op.WORD), "words zones",
      f"""SELECT {WK} FROM words w WHERE NOT EXISTS (SELECT 1 FROM zones z WHERE z.doc_id=w.doc_id AND z.page_no=w.page_no AND w.x1 >= z.x0 AND z.x1 >= w.x0 AND w.bottom >= z.top AND z.bottom >= w.top)""")
query("words_to_rows", lambda t: op.words_to_rows(t.words).select(*op.WORD, "row_no"), "wr", f"SELECT {WK}, row_no FROM wr")
query("tabular_row", lambda t: op.tabular_row(rows(t)), "lines", "SELECT * FROM lines")
query("tabular_regions", lambda t: op.tabular_regions(lines(t)), "treg", "SELECT * FROM treg")
query("region_box", lambda t: op.region_box(tcells(t)), "tc", f"SELECT {T}, min(x0) AS x0, min(top) AS top, max(x1) AS x1, max(bottom) AS bottom, max(r) AS rows FROM tc GROUP BY ALL HAVING max(r) >= 2")
query("token_box", lambda t: op.token_box(t.by_document(tcells(t)), t.words), "tc words",
      f"""WITH tok AS (SELECT DISTINCT {T}, trim(text) AS k FROM tc WHERE length(trim(text)) >= 3 OR regexp_matches(trim(text), '[$%/,]')),
 a AS (SELECT {T}, w.x0, w.top, w.x1, w.bottom FROM words w JOIN tok USING ({P}) WHERE w.text = k),
 n AS (SELECT {T}, count(*) AS n FROM a GROUP BY ALL),
 b AS (SELECT {T}, w.x0, w.top, w.x1, w.bottom FROM words w JOIN (SELECT DISTINCT {T} FROM tc) q USING ({P}) WHERE regexp_matches(w.text, '^(\\d{{1,2}}/\\d{{1,2}}/\\d{{2,4}}|\\$\\s*\\d)')
  UNION ALL SELECT {T}, w.x0, w.top, w.x1, w.bottom FROM words w JOIN tok USING ({P}) WHERE w.text = k AND lower(k) IN ('category','metric')),
 u AS (SELECT * FROM a UNION ALL SELECT b.* FROM b LEFT JOIN n USING ({T}) WHERE coalesce(n, 0) < 5)
 SELECT {T}, coalesce(greatest(min(x0) - 2, 0), 153) AS x0, coalesce(greatest(min(top) - 2, 0), 198) AS top, coalesce(max(x1) + 2, 459) AS x1, coalesce(max(bottom) + 2, 594) AS bottom
 FROM (SELECT DISTINCT {T} FROM tc) q LEFT JOIN u USING ({T}) GROUP BY ALL""")
query("cell_text_meaningful", lambda t: op.cell_text_meaningful(t.words.select(*op.WORD, "text")), "words", f"SELECT {WK}, text, coalesce({MEAN}, false) AS meaningful FROM words")
query("looks_like_prose", lambda t: op.looks_like_prose(tcells(t)), "prose", "SELECT * FROM prose")
query("table_valid", lambda t: op.table_valid(tcells(t)), "valid", "SELECT * FROM valid")
query("tables_per_page_cap",
      lambda t: op.tables_per_page_cap(
          regs(t).select(*KEY, (F.when(F.col("doc_id") % 2 == 0, F.col("table_no") % 2).otherwise(1)).cast("int").alias("strategy"))).select(*KEY, "strategy", "rank"),
      "treg",
      f"""SELECT {T}, strategy, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY {P} ORDER BY table_no) AS rank FROM (
 SELECT {T}, CAST(CASE WHEN doc_id % 2 = 0 THEN table_no % 2 ELSE 1 END AS INT) AS strategy FROM treg QUALIFY rank() OVER (PARTITION BY {P} ORDER BY strategy) = 1) x) y""")
query("pdf_table_cells", lambda t: op.pdf_table_cells(tcells(t)), "tc",
      f"""SELECT {T}, r, c, trim(text) AS value, coalesce(h, 'Column ' || chr(CAST(64 + c AS INT))) AS column_label, coalesce(l, 'Row ' || r) AS row_label, r = 1 AS is_header_row,
 max(r) OVER (PARTITION BY {T}) * max(c) OVER (PARTITION BY {T}) AS cell_count FROM tc LEFT JOIN (SELECT {T}, c, trim(text) AS h FROM tc WHERE r = 1) a USING ({T}, c)
 LEFT JOIN (SELECT {T}, r, trim(text) AS l FROM tc WHERE c = 1) b USING ({T}, r)""")
query("dedupe_tables", lambda t: op.dedupe_tables(tsum(t)).select(*KEY, "signature"), "tsum",
      f"""SELECT {T}, signature FROM tsum QUALIFY row_number() OVER (PARTITION BY doc_id, signature ORDER BY page_no, table_no) = 1""")
query("spanning_link", lambda t: op.spanning_link(tsum(t)).select(*KEY, "linked"), "links", "SELECT * FROM links")
query("merge_spanning", lambda t: op.merge_spanning(tsum(t), tcells(t))[0], "chains tsum",
      """SELECT doc_id, chain, min(page_no) AS page_from, max(page_no) AS page_to, count(*) AS parts, min(x0) AS x0, min(top) AS top, max(x1) AS x1, max(bottom) AS bottom, CASE WHEN count(*) > 1 THEN 'table_spanning_pages_' || min(page_no) || '-' || max(page_no) END AS table_id FROM chains JOIN tsum USING (doc_id, page_no, table_no) GROUP BY ALL""")
query("merge_spanning_rows", lambda t: op.merge_spanning(tsum(t), tcells(t))[1], "chains tc",
      f"""SELECT doc_id, chain, page_no, table_no, r, row_number() OVER (PARTITION BY doc_id, chain ORDER BY ord, r) - 1 AS row_index FROM (SELECT DISTINCT {T}, r FROM tc) a JOIN chains USING ({T}) WHERE r > 1 OR chain = ord""")
query("words_to_blocks", lambda t: op.words_to_blocks(t.words), "blk", "SELECT * FROM blk")
query("split_paragraphs", lambda t: op.split_paragraphs(blocks(t)).select(*PAGE, "block_no", "par_no", "content"), "pars", f"SELECT {P}, block_no, par_no, content FROM pars")
query("sections", lambda t: op.sections(blocks(t)).select(*PAGE, "section_no", "section_id", "block_no", "par_no", "word_count", "character_count", "is_bold", "is_italic"), "secs",
      f"""SELECT {P}, section_no, 'page_' || page_no || '_section_' || section_no AS section_id, block_no, par_no, word_count, CAST(length(content) AS INT) AS character_count, contains(font_family, 'Bold') AS is_bold, contains(font_family, 'Italic') AS is_italic FROM secs""")
query("section_type", lambda t: op.sections(blocks(t)).select(*PAGE, "section_no", "section_type"), "secs", f"SELECT {P}, section_no, section_type FROM secs")
query("section_attrs", lambda t: op.sections(blocks(t)).select(*PAGE, "section_no", "title", "list_type", "heading_level", "llm_ready"), "secs",
      f"SELECT {P}, section_no, title, list_type, heading_level, llm_ready FROM secs")
query("line_cells", lambda t: op.line_cells(t.words), "lc6", "SELECT * FROM lc6")
query("column_edges", lambda t: op.column_edges(lcells(t), 2.0), "edges", "SELECT * FROM edges")
query("grid_assign", lambda t: op.grid_of_words(t.words, 5.0, 2.0), "gridcells edges",
      f"""SELECT g.* FROM gridcells g JOIN (SELECT {P} FROM (SELECT {P}, line_no, count(*) AS f FROM gridcells GROUP BY ALL) a JOIN (SELECT {P}, count(*) AS k FROM edges GROUP BY ALL) e USING ({P})
 WHERE k >= 2 GROUP BY {P} HAVING count(*) >= 2 AND count(*) FILTER (f >= 2) >= 2) ok USING ({P})""")
query("toc", lambda t: op.toc(secs(t)), "secs",
      f"""SELECT {P}, section_no, 'page_' || page_no || '_section_' || section_no AS section_id, title, coalesce(heading_level, 1) AS level FROM secs WHERE section_type = 'header' AND title IS NOT NULL""")
KINDS = ", ".join(f"count(*) FILTER (section_type='{k}') AS n_{k}" for k in op.SECTION_TYPES)
SHARED["dsum"] = (
    f"""SELECT *, round(words / sections, 6) AS average_length, round(words / 200, 6) AS reading_minutes FROM (SELECT doc_id, count(*) AS sections, CAST(sum(word_count) AS BIGINT) AS words, count(*) FILTER (llm_ready) AS llm_ready_sections, {KINDS} FROM secs GROUP BY ALL) x""", ["secs"])
query("document_summary", lambda t: op.document_summary(secs(t)), "dsum", "SELECT * FROM dsum")
query("quality_bands", lambda t: op.quality_bands(numbers.resolve_overlaps(t.sections)), "kept",
      "SELECT CASE WHEN confidence >= 0.9::DOUBLE THEN 'high' WHEN confidence >= 0.7::DOUBLE THEN 'medium' ELSE 'low' END AS band, count(*) AS n FROM kept GROUP BY ALL")
SHARED["tconf"] = ("SELECT doc_id, page_no, table_no, rows * cols AS cell_count, 0.5::DOUBLE + (doc_id + table_no) % 5 * 0.1::DOUBLE AS confidence FROM valid", ["valid"])


def tconf(t):
    return op.table_valid(tcells(t)).select(*KEY, (F.col("rows") * F.col("cols")).alias("cell_count"), (F.lit(0.5) + (F.col("doc_id") + F.col("table_no")) % 5 * 0.1).alias("confidence"))


query("quality_scores", lambda t: op.quality_scores(tconf(t), op.document_summary(secs(t))), "tconf dsum",
      """SELECT doc_id, round(tq, 6) AS table_quality, round(xq, 6) AS text_quality, round(coalesce((tq + xq) / 2, tq, xq), 6) AS overall,
 round(least(1::DOUBLE, 0.7::DOUBLE + CASE WHEN k > 0 THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN sections > 0 THEN 0.15::DOUBLE ELSE 0 END), 6) AS simple_score, round(mc, 6) AS mean_confidence FROM (
 SELECT doc_id, sum(confidence * cell_count) / sum(cell_count) AS tq, count(*) AS k, avg(confidence) AS mc FROM tconf GROUP BY ALL) a FULL JOIN (
 SELECT doc_id, sections, least(1::DOUBLE, llm_ready_sections / sections * 0.7::DOUBLE + least(1::DOUBLE, sections / 10) * 0.3::DOUBLE) AS xq FROM dsum) b USING (doc_id)""")
query("sections_with_content", lambda t: op.sections_with_content(t.sections.withColumn("section_id", F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("s"), F.col("doc_id").cast("string")))), numbers.resolve_overlaps(t.sections)),
      "sections kept",
      """SELECT doc_id, page_no AS page, content, coalesce(n, 0) AS numbers, CASE WHEN doc_id % 4 = 0 THEN 's' || doc_id ELSE 'page_' || page_no || '_section_' || section_no END AS section_id
 FROM sections LEFT JOIN (SELECT doc_id, page_no, section_no, count(*) AS n FROM kept GROUP BY ALL) k USING (doc_id, page_no, section_no) WHERE length(trim(content)) > 0 OR n > 0""")

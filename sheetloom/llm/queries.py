"""Registered queries of this subpackage, and SQL where it can express them."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from sheetloom.llm.text import filled, held_out, table

#: Vocabulary of op4; every worker must have the file.
TOKENIZER = os.environ.get("BPE_VOCABULARY")


def vocabulary_path() -> str:
    if TOKENIZER:
        return TOKENIZER
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_exact_dedup(spark, folder):
    from sheetloom.llm.exact_dedup import exact_dedup

    return exact_dedup(table(spark, folder, "documents"))


LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP1 = f"""
WITH d AS (SELECT doc_id, sha256({LOWER}) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
"""


def op4_bpe(spark, folder):
    from sheetloom.llm.bpe import bpe_decode, bpe_encode

    path = vocabulary_path()
    docs = table(spark, folder, "documents").select("doc_id", "text")
    done = bpe_decode(bpe_encode(docs, path).drop("text"), path)
    return done.select(
        "doc_id",
        F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op9_decontaminate(spark, folder):
    from sheetloom.llm.decontaminate import decontaminate, hit_words

    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = decontaminate(docs, table(spark, folder, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        hit_words().alias("n_hit"),
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("hit_items"), ",").cast("binary"), 256).alias("items_sha256"),
        (hit_words() > 0).alias("contaminated"),
    )


# Windows joined by their text: the same rows by a plainer way.
OP9 = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
p AS (SELECT DISTINCT item_id, m, array_to_string(ws[k:k + m - 1], ' ') AS key
      FROM (SELECT item_id, ws, m, unnest(range(1, len(ws) - m + 2)) AS k FROM (SELECT *, least(10, len(ws)) AS m FROM i WHERE len(ws) > 0))),
lengths AS (SELECT DISTINCT m FROM p),
dw AS (SELECT doc_id, m, k, array_to_string(ws[k:k + m - 1], ' ') AS key
       FROM (SELECT doc_id, ws, m, unnest(range(1, len(ws) - m + 2)) AS k FROM w, lengths WHERE len(ws) >= m)),
h AS (SELECT doc_id, item_id, k, m FROM dw JOIN p USING (m, key)),
hw AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + m)) AS pos FROM h) GROUP BY doc_id),
hi AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM h WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN hw ON w.doc_id = hw.doc_id LEFT JOIN hi ON w.doc_id = hi.doc_id
"""

def op8_language(spark, folder):
    from sheetloom.llm.language import identify, train

    docs = table(spark, folder, "documents")
    found = identify(docs.select("doc_id", "text"), train(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "accepted")


def op5_toxicity(spark, folder):
    from sheetloom.llm.toxicity import toxicity, train

    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = toxicity(docs, train(docs, table(spark, folder, "labels")))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op3_simhash(spark, folder):
    from sheetloom.llm.simhash import near_duplicates

    return near_duplicates(table(spark, folder, "documents")).select("doc_id", "fingerprint", "component_id")


def op10_line_dedup(spark, folder):
    from sheetloom.llm.line_dedup import line_dedup

    found = line_dedup(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        "n_lines",
        F.aggregate("runs", F.lit(0).cast("long"), lambda n, r: n + (r["end"] - r["start"])).alias("n_removed"),
        F.size("runs").cast("long").alias("n_runs"),
        F.sha2(filled(F.col("text")).cast("binary"), 256).alias("kept_sha256"),
    )


# Runs of two lines: a window over the text of each line pair instead of names and doubling.
OP10 = """
WITH l AS MATERIALIZED (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS i FROM documents),
p AS (SELECT doc_id, i, line, lead(line) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM l),
q AS (SELECT doc_id, i, row_number() OVER (PARTITION BY line, nxt ORDER BY doc_id, i) AS copy FROM p WHERE nxt IS NOT NULL),
r AS MATERIALIZED (SELECT DISTINCT doc_id, i + k AS i FROM q, (VALUES (0), (1)) AS o(k) WHERE copy > 1),
g AS (SELECT doc_id, i, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS island FROM r),
s AS (SELECT doc_id, count(*) AS n_removed, count(DISTINCT island) AS n_runs FROM g GROUP BY doc_id),
t AS (SELECT l.doc_id, string_agg(line, chr(10) ORDER BY l.i) FILTER (WHERE r.i IS NULL) AS kept, count(*) AS n_lines
      FROM l LEFT JOIN r ON l.doc_id = r.doc_id AND l.i = r.i GROUP BY l.doc_id)
SELECT t.doc_id, n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(n_runs, 0) AS n_runs, sha256(coalesce(kept, '')) AS kept_sha256
FROM t LEFT JOIN s ON t.doc_id = s.doc_id
"""

def op6_pii(spark, folder):
    from sheetloom.llm.pii import KINDS, listed, personal_data

    found = personal_data(table(spark, folder, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    kinds = F.transform(base, lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def op7_substring_dedup(spark, folder):
    from sheetloom.llm.substring_dedup import substring_dedup

    found = substring_dedup(table(spark, folder, "documents").select("doc_id", "text"))
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + (s["end"] - s["start"]))
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op2_lm_scoring(spark, folder):
    from sheetloom.llm.ngram_score import ngram_scores

    return ngram_scores(table(spark, folder, "documents"))


def op11_collocations(spark, folder):
    from sheetloom.llm.collocations import collocations

    return collocations(table(spark, folder, "documents").select("doc_id", "text", "lang"))


# All phrases of one to three words counted at once.
OP11 = r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, doc_id, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, row_number() OVER () AS piece_no, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces),
t AS (SELECT lang, piece_no, unnest(ws) AS x, generate_subscripts(ws, 1) AS i FROM w),
u AS (SELECT lang, x, lead(x) OVER p AS y, lead(x, 2) OVER p AS z FROM t WINDOW p AS (PARTITION BY piece_no ORDER BY i)),
g AS MATERIALIZED (SELECT lang, m, phrase, count(*) AS f FROM (
  SELECT lang, 1 AS m, x AS phrase FROM u UNION ALL SELECT lang, 2, x || ' ' || y FROM u WHERE y IS NOT NULL UNION ALL SELECT lang, 3, x || ' ' || y || ' ' || z FROM u WHERE z IS NOT NULL) a GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM g WHERE m = 1 GROUP BY lang),
c AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS ws FROM g WHERE m > 1 AND f >= 10),
cuts AS (SELECT c.lang, c.m, c.phrase, a, k, array_to_string(ws[1:k], ' ') AS p, array_to_string(ws[k + 1:c.m], ' ') AS q FROM c, (VALUES (1), (2)) AS s(k) WHERE k < c.m),
scored AS (SELECT cuts.lang, cuts.m, cuts.phrase, a, k, gl.f AS l, gr.f AS r, CAST((1000000::HUGEINT * a * a) // (gl.f::HUGEINT * gr.f) AS BIGINT) AS score
      FROM cuts JOIN g gl ON gl.lang = cuts.lang AND gl.phrase = cuts.p JOIN g gr ON gr.lang = cuts.lang AND gr.phrase = cuts.q),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (SELECT lang, array_to_string(ws[o:o + 1], ' ') AS phrase, max(a) AS longer FROM c, (VALUES (1), (2)) AS s(o) WHERE m = 3 GROUP BY ALL)
SELECT best.lang, row_number() OVER (PARTITION BY best.lang ORDER BY score DESC, a DESC, best.phrase) AS rank, best.phrase, a, l, r, n, score
FROM best JOIN n ON n.lang = best.lang LEFT JOIN inside ON m = 2 AND inside.lang = best.lang AND inside.phrase = best.phrase
WHERE longer IS NULL OR 100 * longer < 50 * a QUALIFY rank <= 2000
"""


def op12_spelling(spark, folder):
    from sheetloom.llm.spelling import variants

    return variants(table(spark, folder, "documents"))


def op13_fingerprints(spark, folder):
    from sheetloom.llm.fingerprints import fingerprints

    return fingerprints(table(spark, folder, "documents").select("doc_id", "text"))


QUERIES = {f.__name__: f for f in (op1_exact_dedup, op2_lm_scoring, op3_simhash, op4_bpe, op5_toxicity, op6_pii, op7_substring_dedup, op8_language, op9_decontaminate, op10_line_dedup, op11_collocations, op12_spelling, op13_fingerprints)}
ORACLES = {"op1_exact_dedup": OP1, "op9_decontaminate": OP9, "op10_line_dedup": OP10, "op11_collocations": OP11}

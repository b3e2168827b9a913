"""Pipeline over documents: language, repeated lines, near duplicates, benchmark passages, tokens.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and
returns a DataFrame; ``run`` writes every stage to the shared folder and reads it
back for the next.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetloom.llm.bpe import bpe_round
from sheetloom.llm.decontaminate import decontaminate
from sheetloom.llm.language import identify, train
from sheetloom.llm.line_dedup import LONG_WORDS, line_dedup
from sheetloom.llm.queries import vocabulary_path
from sheetloom.llm.similar import without_similar
from sheetloom.llm.store import stored
from sheetloom.llm.text import set_apart, table


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; null texts, texts without letters and rejected ones go."""
    model = train(docs)
    rows, back = set_apart(docs, "doc_id", "text")
    return back(identify(rows, model).where("accepted"))


def distinct_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs and of single lines over LONG_WORDS words are deleted; a document of which nothing but blanks is left goes.

    n_chars follows the text where it changes.
    """
    rows, back = set_apart(docs, "doc_id", "text")
    found = line_dedup(rows, long_words=LONG_WORDS)
    changed = F.size("runs") > 0
    found = found.where(~changed | F.col("text").rlike(r"\S"))
    if "n_chars" in docs.columns:
        name = rows.columns[docs.columns.index("n_chars")]
        found = found.withColumn(name, F.when(changed, F.char_length("text")).otherwise(F.col(name)).cast(docs.schema["n_chars"].dataType))
    return back(found)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8 or more) stays, the one with the smallest doc_id.

    Pairs come from ball hashing of fingerprints and, beyond its radius, from a prefix filter; all are checked on whole sets.
    """
    return without_similar(docs)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of a benchmark item go."""
    rows, back = set_apart(docs, "doc_id", "text")
    return back(decontaminate(rows, table(spark, sf_dir, "benchmark")).where(F.size("hit_spans") == 0))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids (packed) and whether decoding gives the text back."""
    done = bpe_round(docs.select("doc_id", "text", "lang", "source"), vocabulary_path())
    return done.select("doc_id", "lang", "source", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", (F.coalesce("text", F.lit("")) == F.col("decoded")).alias("round_trip"))


STAGES = [
    ("language", known_language),
    ("line_dedup", distinct_lines),
    ("near_duplicates", distinct_documents),
    ("decontamination", no_benchmark),
    ("tokens", tokens),
]

#: Trained models, fingerprints and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

"""Exact deduplication against a persistent index of text digests.

The index is a Spark table bucketed and sorted by digest.  A batch is reduced to
one row per digest, a sort-merge anti join leaves the digests that the index
does not hold, and those are appended.  The index side of both joins is read in
bucket order: it is neither shuffled nor sorted again.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetloom.llm.store import new_path, stored
from sheetloom.llm.text import SALTS, ascii_lower, filled

SCHEMA = "digest STRING, keep_id BIGINT"


class DigestIndex:
    """Digests of every text seen so far, with the id of the document that stays.

    ``path`` is a folder that all executors share; opening it again continues the
    index.  ``buckets`` must be the same each time: size it so that a bucket of
    digests fits one task (a billion digests in 4,096 buckets are 20 MB each).
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path = spark, path
        self.name = "digests_" + re.sub(r"\W", "", uuid.uuid5(uuid.NAMESPACE_URL, path).hex)
        location = path.replace("'", "\\'")
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} ({SCHEMA}) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {int(buckets)} BUCKETS LOCATION '{location}'"
        )
        self.buckets = buckets

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def add(self, docs: DataFrame) -> DataFrame:
        """Deduplicate a batch of (doc_id, text), append what is new and return one row per document.

        Columns: doc_id, keep_id, group_size (documents of this batch with that
        text), kept, text_sha256.  Of equal texts in a batch the largest doc_id
        stays; a text known from an earlier batch keeps its earlier document.
        A null text counts as empty.  A null doc_id never beats another; rows that
        repeat doc_id and text get the same answer.  An empty batch gives no rows.
        Texts are equal when identical after lower-casing A-Z.  Other columns are
        ignored.
        """
        digests = stored(
            docs.select(
                F.col("doc_id").cast("long").alias("doc_id"),
                F.sha2(ascii_lower(filled(F.col("text"))).cast("binary"), 256).alias("digest"),
                F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).alias("salt"),
            ),
            "digests",
        )
        # A text with a third of all rows is at most SALTS rows after the first aggregation.
        parts = stored(digests.groupBy("digest", "salt").agg(F.count("*").alias("n"), F.max("doc_id").alias("top")), "parts")
        groups = parts.groupBy("digest").agg(F.sum("n").alias("group_size"), F.max("top").alias("top"))
        fresh = groups.select("digest", F.col("top").alias("keep_id")).join(self.rows().select("digest").hint("merge"), "digest", "left_anti")
        (
            fresh.repartition(self.buckets, "digest")
            .write.format("parquet").mode("append").bucketBy(self.buckets, "digest").sortBy("digest").option("path", self.path).saveAsTable(self.name)
        )
        known = groups.select("digest", "group_size").join(self.rows().hint("merge"), "digest")
        answers = parts.select("digest", "salt").join(known, "digest")
        return digests.join(answers, ["digest", "salt"]).select(
            "doc_id",
            "keep_id",
            "group_size",
            F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"),
            F.col("digest").alias("text_sha256"),
        )


def exact_dedup(docs: DataFrame, path: str | None = None, buckets: int = 64) -> DataFrame:
    """One batch against the index at ``path``, or against a new index in the shared folder."""
    spark = docs.sparkSession
    return DigestIndex(spark, path or new_path(spark, "digest-index"), buckets).add(docs)

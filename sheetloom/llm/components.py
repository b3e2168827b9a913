"""Connected components of an edge table by repeated hooking and contraction.

Every round each vertex hooks to the neighbour of smallest hash (or stays, if it
is itself the smallest); edges move to the hooks, loops and repeats go.  Hashes
change from round to round, so long chains shrink by a constant share each time.
Nothing but the number of edges left reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetloom.llm.store import Stored


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(vertex, root) for every vertex of ``edges``; vertices are equal in ``root`` when connected.

    Loops keep a vertex without other edges as its own root.  Repeated edges and
    both directions are fine, an edge with a null end is ignored, no edges give
    no rows.  Joins are plain shuffles of stored tables, so a vertex with a large
    share of the edges is split by adaptive execution.
    """
    pairs = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    work = Stored(pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    ends = pairs.select(F.col("a").alias("vertex")).union(pairs.select("b")).distinct()
    labels = Stored(ends.withColumn("root", F.col("vertex")), "labels")
    turn = 0
    while not work.df.isEmpty():
        turn += 1
        both = work.df.union(work.df.select("b", "a"))
        rank = lambda c: F.struct(F.xxhash64(F.lit(turn), c).alias("h"), c.alias("v"))  # noqa: B023, E731
        least = both.groupBy("a").agg(F.min(rank(F.col("b"))).alias("near"))
        hooks = Stored(least.select(F.col("a").alias("old"), F.least("near", rank(F.col("a")))["v"].alias("new")), "hooks")
        to = lambda c: hooks.df.select(F.col("old").alias(c), F.col("new").alias(f"{c}_new"))  # noqa: B023, E731
        moved = work.df.join(to("a"), "a").join(to("b"), "b").where("a_new <> b_new")
        edges_now = Stored(moved.select(F.least("a_new", "b_new").alias("a"), F.greatest("a_new", "b_new").alias("b")).distinct(), "edges")
        labels_now = Stored(labels.df.join(to("root"), "root", "left").select("vertex", F.coalesce("root_new", "root").alias("root")), "labels")
        for old in (work, labels, hooks):
            old.drop()
        work, labels = edges_now, labels_now
    work.drop()
    return labels.df

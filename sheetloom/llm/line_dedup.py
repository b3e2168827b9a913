"""Deduplication of repeated line runs by distributed prefix doubling over line sequences.

A position is (document, line number).  Its rank at length L is the first position
of the corpus at which the same L lines start, so ranks order copies and are equal
exactly for equal runs.  Ranks at length 1 come from line digests; the rank at
2L comes from the pair of ranks at p and p + L, grouped by Spark.  Positions whose run
is unique leave after every round, for no longer run there can repeat; doubling
ends at the threshold.  Neighbouring positions that repeat an earlier run form the
interval of a maximal repeated run, and its lines are deleted.  Further doubling
would delete the same lines: a longer repeated run is covered by repeated runs of
the threshold.  Lines of more than ``long_words`` words count as runs by themselves.

All of it is DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetloom.llm.store import Stored
from sheetloom.llm.text import filled, set_apart

MIN_LINES = 2
#: For the pipeline: a later copy of a single line of more words goes as well.
LONG_WORDS = 50
FIRST = -(1 << 63)
PLACE = ["__id", "__key", "i"]


def _named(docs: DataFrame) -> DataFrame:
    return docs.withColumns({"__id": F.coalesce(F.col("doc_id").cast("long"), F.lit(FIRST)), "__key": F.xxhash64(filled(F.col("text")))})


def _ranked(positions: DataFrame, by: list[str]) -> Stored:
    """Positions whose columns ``by`` occur again elsewhere, with the first such position as rank.

    The groups are written before they are joined back: both sides of the join are
    then plain shuffles, and a line that a third of all rows share is split by
    adaptive execution.
    """
    groups = Stored(positions.groupBy(*by).agg(F.min(F.struct(*PLACE)).alias("rank"), F.count("*").alias("n")).where("n > 1").drop("n"), "groups")
    found = Stored(positions.join(groups.df, by).select(*PLACE, "rank"), "ranks")
    groups.drop()
    return found


def repeated_starts(docs: DataFrame, min_lines: int, long_words: int | None = None) -> tuple[Stored, Stored | None]:
    """Positions (__id, __key, i) at which a run of ``min_lines`` lines starts, with the first position of that run.

    With ``long_words`` also the positions of single repeated lines of more words.
    """
    lines = _named(docs).select("__id", "__key", F.posexplode(F.split(filled(F.col("text")), "\n", -1)).alias("i", "line"))
    hashes = [F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), F.col("line")).alias("h2")]
    long = F.lit(False) if long_words is None else F.regexp_count("line", F.lit(r"\S+")) > long_words
    # Rows that repeat doc_id and text are one document: a position counts once, however often they come.
    every = lines.select(*PLACE, *hashes, long.alias("long")).groupBy(*PLACE).agg(*(F.max(c).alias(c) for c in ("h1", "h2", "long")))
    positions = Stored(every, "positions")
    now = _ranked(positions.df.select(*PLACE, "h1", "h2"), ["h1", "h2"])
    alone = None if long_words is None else _ranked(positions.df.where("long").select(*PLACE, "h1", "h2"), ["h1", "h2"])
    positions.drop()
    length = 1
    while length < min_lines:
        step = min(length, min_lines - length)
        after = now.df.select("__id", "__key", (F.col("i") - step).alias("i"), F.col("rank").alias("next"))
        longer = _double(now, after)
        now.drop()
        now, length = longer, length + step
    return now, alone


def _double(now: Stored, after: DataFrame) -> Stored:
    pairs = Stored(now.df.join(after, PLACE).select(*PLACE, F.col("rank").alias("r1"), F.col("next").alias("r2")), "pairs")
    longer = _ranked(pairs.df, ["r1", "r2"])
    pairs.drop()
    return longer


def line_dedup(docs: DataFrame, min_lines: int = MIN_LINES, long_words: int | None = None) -> DataFrame:
    """Documents with later copies of repeated runs of ``min_lines`` or more lines deleted from ``text``.

    With ``long_words`` later copies of single lines of more words go too.

    Appends n_lines (of the input text) and runs (deleted line ranges, end exclusive,
    in order); columns of these names are replaced, others stay.  Documents come in
    the order of doc_id (null first), then of the hash of their text; the first copy of a run in that order stays, also
    within one document and where copies overlap.  Rows that repeat doc_id and text
    are one document and get the same answer.  A null text has one empty line, so it
    stays null.  Blank lines are lines.  A text of which nothing is left is empty.
    """
    starts, alone = repeated_starts(docs.select("doc_id", "text"), min_lines, long_words)
    later = lambda found, size: found.df.where(F.struct(*PLACE) > F.col("rank")).select(*PLACE, F.lit(size).alias("size"))
    every = later(starts, min_lines) if alone is None else later(starts, min_lines).unionByName(later(alone, 1))
    # Deleted lines that touch are one run.
    lines = F.flatten(F.collect_list(F.sequence("i", F.col("i") + F.col("size") - 1)))
    islands = every.distinct().groupBy("__id", "__key").agg(F.array_sort(F.array_distinct(lines)).alias("at")).select(
        "__id", "__key", "at", F.filter(F.sequence(F.lit(0), F.size("at") - 1), lambda k: (k == 0) | (F.get("at", k) - F.get("at", k - 1) > 1)).alias("heads")
    )
    last = F.concat(F.slice("heads", 2, F.greatest(F.size("heads") - 1, F.lit(0))), F.array(F.size("at")))
    runs = F.transform(
        F.arrays_zip(F.col("heads").alias("head"), last.alias("stop")),
        lambda z: F.struct(F.get("at", z["head"]).cast("long").alias("start"), (F.get("at", z["stop"] - 1) + 1).cast("long").alias("end")),
    )
    deleted = Stored(islands.select("__id", "__key", runs.alias("__runs")), "runs")
    starts.drop()
    if alone is not None:
        alone.drop()
    apart, back = set_apart(docs.drop("n_lines", "runs"), "doc_id", "text")
    joined = _named(apart).join(deleted.df.hint("merge"), ["__id", "__key"], "left")
    empty = F.expr("CAST(array() AS array<struct<start:bigint,end:bigint>>)")
    joined = joined.withColumns({"__lines": F.split(filled(F.col("text")), "\n", -1), "__runs": F.coalesce("__runs", empty)})
    edges = F.arrays_zip(
        F.concat(F.array(F.lit(0).cast("long")), F.col("__runs.end")).alias("start"), F.concat(F.col("__runs.start"), F.array(F.size("__lines").cast("long"))).alias("end")
    )
    kept = F.flatten(F.transform(edges, lambda e: F.slice("__lines", (e["start"] + 1).cast("int"), (e["end"] - e["start"]).cast("int"))))
    text = F.when(F.size("__runs") == 0, F.col("text")).otherwise(F.array_join(kept, "\n"))
    return back(joined.withColumns({"text": text, "n_lines": F.size("__lines").cast("long"), "runs": F.col("__runs")}), "n_lines", "runs")

"""Phrase collocations by dynamic itemset counting.

The texts are dealt to shards that are scanned in a cycle, one shard a tick.  Single
words are counted from the first tick on.  A longer phrase becomes active as soon as
both its subphrases (all but its last word, all but its first) have reached the
threshold in what has been counted so far, while those are still being counted; it
is counted for one full cycle from then on, that is once in every shard, and then
its count is exact.  So lengths interleave, and a phrase with a rare part is never
counted at all.

Which phrases are active is told to the tasks by Bloom filters of what has reached
the threshold, one per length, of a fixed size and only ever added to.  A tick has two
states of them, the present one and that of one cycle before: a phrase is counted
where its parts pass the present one and do not all pass the earlier one, so its cycle
begins and ends by the same rule in every task.  A phrase that passes by mistake is
counted for a full cycle as well, so mistakes cost time, never results.  Where a
vocabulary outgrows the filter, more passes; ``filter_bits`` is a parameter.

A task turns its texts into word numbers and counts phrases in numpy, a buffer of
tokens at a time, and writes the counts of its tick under the hash of the phrase.
After a tick Spark sums them to find what has reached the threshold; what is known to
have reached it (or passes for it) is not written any more.  The phrases so
found get their text in one more scan, which sums the same occurrences under the text,
so that phrases of one hash stay apart.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetloom.llm.bloom import Filter
from sheetloom.llm.store import Stored, collect_shuffles, new_path
from sheetloom.llm.text import SALTS, filled, pieces

LEAST, LONGEST, SHARDS, TOP = 10, 3, 4, 2000
#: 2 MB: what a task holds per length.
FILTER_BITS = 1 << 24
#: Tokens that a task counts at a time, and bytes of a long text that are split at a time.
BUFFER = 1 << 20
CUT = 1 << 20

_TABLE = bytes(10 if b in b".,;:!?\n\x0b\x0c\r" else b + 32 if 65 <= b <= 90 else b for b in range(256))
#: ``late``: the phrase may have begun its cycle after the first tick of its length.
COUNTS = "size int, hash long, c long, late boolean"
TEXTS = "lang string, size int, phrase string, c long"
#: Between pieces; no UTF-8 text has this byte.
BREAK = b"\xff"


def tokens(text: str):
    """Lists of words with BREAK between pieces, a part of the text at a time."""
    data = text.encode().translate(_TABLE)
    at = 0
    while at < len(data):
        end = len(data)
        if end - at > CUT:
            end = data.rfind(b"\n", at, at + CUT)
            end = end if end > at else data.find(b"\n", at + CUT)
            end = len(data) if end < 0 else end
        yield [*data[at:end].replace(b"\n", b" \xff ").split(), BREAK]
        at = end


def _joined(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Hash of a phrase from that of all but its last word and that of its last word."""
    h = (one * np.uint64(0x9E3779B97F4A7C15)) ^ (two + (one >> np.uint64(31)))
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(27))


def _word_hashes(lang: str, words: list[bytes]) -> np.ndarray:
    seed = xxhash.xxh64_intdigest(lang)
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), np.uint64, len(words))


def _batch(schema: str, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns), names=[f.split()[0] for f in schema.split(", ")])


def _buffer_counts(lang: str, words: list[bytes], sizes: list[int], now: dict[int, Filter], before: dict[int, Filter] | None, first: Filter | None = None) -> list[pa.RecordBatch]:
    """Rows COUNTS of the phrases in a buffer of tokens that are in their cycle and not yet known to have reached the threshold.

    ``first`` is the state of single words at the first tick of pairs.  Without ``before`` rows TEXTS of all phrases that pass, and one of size 0 with the number of words.
    """
    code, distinct = _numbered(pa.array(words, pa.binary()))
    width, word_hash = len(distinct), _word_hashes(lang, distinct.to_pylist())
    no_break = pc.not_equal(distinct, pa.scalar(BREAK, pa.binary())).to_numpy(zero_copy_only=False)
    found = []

    def emit(size, hashes, count, mask, late=None):
        n = int(mask.sum())
        late = np.ones(n, bool) if late is None else late[mask]
        found.append(_batch(COUNTS, pa.array(np.full(n, size, np.int32)), pa.array(hashes[mask].view(np.int64)), pa.array(count[mask].astype(np.int64)), pa.array(late)))

    def emit_texts(size, text, count):
        found.append(_batch(TEXTS, pa.array([lang] * len(text), pa.string()), pa.array(np.full(len(text), size, np.int32)), text.cast(pa.string()), pa.array(count.astype(np.int64))))

    known = now[1].has(word_hash) if 1 in now else np.zeros(width, bool)
    if 1 in sizes:
        count = np.bincount(code, minlength=width)
        if before is None:
            mask = known & no_break
            emit_texts(1, distinct.filter(pa.array(mask)), count[mask])
        else:
            emit(1, word_hash, count, no_break & ~known)
    if before is None:
        found.append(_batch(TEXTS, pa.array([lang]), pa.array([0], pa.int32()), pa.array([""]), pa.array([int(no_break[code].sum())])))
    most = max(sizes)
    if most > 1:
        # By position: number of the phrase there at the present size, whether it may be extended, and whether it could a cycle before.
        # ``text`` has the phrases that pass, ``place`` tells where.
        gram, gram_hash, text, place = code, word_hash, distinct, np.arange(width)
        past_of = lambda size, hashes: before[size].has(hashes) if before else np.zeros(len(hashes), bool)
        ok = known & no_break
        early = first.has(word_hash) if first else np.zeros(width, bool)
        live, past = ok[code], (ok & past_of(1, word_hash))[code]
        for size in range(2, most + 1):
            live, past = live[:-1] & live[1:], past[:-1] & past[1:]
            at = np.flatnonzero(live & ~past if size == most else live)
            if not len(at):
                break
            inverse, pairs = _numbered(pa.array(gram[at] * width + code[at + size - 1]))
            pairs = pairs.to_numpy()
            head, tail = pairs // width, pairs % width
            gram_hash = _joined(gram_hash[head], word_hash[tail])
            known = now[size].has(gram_hash) if size in now else np.zeros(len(pairs), bool)
            count = np.bincount(inverse[~past[at]], minlength=len(pairs))
            if before is None:
                text = pc.binary_join_element_wise(text.take(pa.array(place[head[known]])), distinct.take(pa.array(tail[known])), b" ")
                place = np.cumsum(known) - 1
                emit_texts(size, text, count[known])
            elif size in sizes:
                emit(size, gram_hash, count, (count > 0) & ~known, ~(early[head] & early[tail]) if size == 2 else None)
            if size < most:
                gram = np.zeros(len(live), np.int64)
                gram[at] = inverse
                ok = known
                done = ok & past_of(size, gram_hash)
                further, past_further = np.zeros(len(live), bool), np.zeros(len(live), bool)
                further[at], past_further[at] = ok[inverse], past[at] & done[inverse]
                live, past = further, past_further
    return pa.Table.from_batches(found, found[0].schema).combine_chunks().to_batches() if found else []


def _numbered(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Number of each value, and the distinct values."""
    coded = values.dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary


def _counted(docs: DataFrame, sizes: list[int], sent) -> DataFrame:
    """The counts of a tick."""
    return _scanned(docs, sizes, sent, COUNTS)


def _scanned(docs: DataFrame, sizes: list[int], sent, schema: str) -> DataFrame:
    def run(batches):
        held: dict[str, list[bytes]] = {}
        size = 0
        for batch in pieces(batches):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for part in tokens(text):
                    held.setdefault(lang, []).extend(part)
                    size += len(part)
                    if size > BUFFER:
                        for k, v in held.items():
                            yield from _buffer_counts(k, v, sizes, *sent.value)
                        held, size = {}, 0
        for k, v in held.items():
            yield from _buffer_counts(k, v, sizes, *sent.value)

    return docs.select("lang", "text").mapInArrow(run, schema)


def _sharded(docs: DataFrame, shards: int) -> tuple[DataFrame, callable]:
    """(lang, text) in shards of a written table, and a function that deletes it."""
    spark = docs.sparkSession
    path = new_path(spark, "shards")
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), filled(F.col("text")).alias("text"))
    rows.withColumn("shard", F.pmod(F.xxhash64("text", F.monotonically_increasing_id()), F.lit(shards)).cast("int")).write.partitionBy("shard").parquet(path)
    read = spark.read.schema("lang string, text string, shard int").parquet(path)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return read, lambda: hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


class _Counts:
    """The counts that tasks have written, a folder a tick."""

    def __init__(self, spark):
        self.spark, self.path = spark, new_path(spark, "counts")

    def write(self, rows: DataFrame, tick: int) -> None:
        rows.write.parquet(f"{self.path}/tick={tick}")

    @property
    def df(self) -> DataFrame:
        return self.spark.read.schema(f"{COUNTS}, tick int").parquet(self.path)

    def reached(self, size: int, least: int, since: int = 0, late: Filter | bool = False) -> DataFrame:
        """Hashes of the phrases that have reached the threshold by the ticks from ``since`` on, with ``late`` of those marked late or those that pass it."""
        rows = self.df.where((F.col("size") == size) & (F.col("tick") >= since) & (F.col("late") if late is True else F.lit(True))).select("hash", "c")
        if isinstance(late, Filter):
            sent = self.spark.sparkContext.broadcast(late)  # FILTER_BITS

            def run(batches):
                for batch in batches:
                    yield batch.filter(pa.array(sent.value.has(batch.column(0).to_numpy().view(np.uint64))))

            rows = rows.mapInArrow(run, "hash long, c long")
        return rows.groupBy("hash").agg(F.sum("c").alias("c")).where(F.col("c") >= least).select("hash")

    def met(self, size: int, tick: int, bits: int) -> Filter:
        """The phrases of a tick."""
        found = Filter(bits)
        found.add(self.df.where((F.col("size") == size) & (F.col("tick") == tick)).select("hash"))
        return found

    def drop(self) -> None:
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def phrase_counts(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, shards: int = SHARDS, filter_bits: int = FILTER_BITS) -> tuple[Stored, DataFrame]:
    """Exact counts (lang, size, phrase, count) of all phrases of up to ``longest`` words with ``least`` occurrences, and (lang, n) of all words.

    Every part of such a phrase is in the table as well.
    """
    spark = docs.sparkSession
    table, drop = _sharded(docs, shards)
    filters = {n: Filter(filter_bits) for n in range(1, longest + 1)}
    # What had reached the threshold at each tick, from one cycle before the first on.
    history = [{n: f.copy() for n, f in filters.items()}] * shards
    counts, first = _Counts(spark), None
    for tick in range(longest * shards):
        history.append({n: f.copy() for n, f in filters.items()})
        before, history[tick] = history[tick], None
        # Phrases of a size are first seen after its parts could be reached, and all are done a cycle after the last of these.
        sizes = [n for n in range(1, longest + 1) if n - 1 <= tick < n * shards and (n == 1 or filters[n - 1].filled)]
        if not sizes:
            continue
        if tick == 1:
            first = filters[1].copy()
        sent = spark.sparkContext.broadcast([*({n: state[n] for n in range(1, max(sizes))} for state in (filters, before)), first])  # FILTER_BITS each
        counts.write(_counted(table.where(F.col("shard") == tick % shards), sizes, sent), tick)
        sent.destroy()
        for n in sizes:
            if n < longest:
                # After the first cycle of a length few phrases are met, and only these are looked up; all their counts lie within a cycle.
                late = tick >= n - 1 + shards and (n == 2 or counts.met(n, tick, filter_bits))
                filters[n].add(counts.reached(n, least, max(0, tick - shards + 1), late))
                collect_shuffles(spark)
    filters[longest].add(counts.reached(longest, least))
    counts.drop()
    collect_shuffles(spark)
    sent = spark.sparkContext.broadcast([filters, None])  # FILTER_BITS each
    summed = _scanned(table, list(filters), sent, TEXTS).groupBy("lang", "size", "phrase").agg(F.sum("c").alias("count"))
    found = Stored(summed.where((F.col("count") >= least) | (F.col("size") == 0)), "phrases")
    drop()
    totals = found.df.where("size = 0 AND count > 0").select("lang", F.col("count").alias("n"))
    found.df = found.df.where("size > 0")
    return found, totals


def candidates(counts: DataFrame, longest: int = LONGEST) -> DataFrame:
    """(lang, size, phrase, a, l, r, score) of all phrases of two words or more, by the lowest-scoring cut."""
    of = lambda name: counts.select("lang", F.col("phrase").alias(f"{name}_part"), F.col("count").alias(name))
    cut = counts.where("size > 1").withColumnRenamed("count", "a").withColumn("k", F.explode(F.expr("sequence(1, size - 1)")))
    cut = cut.withColumns({"l_part": F.expr("substring_index(phrase, ' ', k)"), "r_part": F.expr("substring_index(phrase, ' ', k - size)")})
    cut = cut.join(of("l").hint("merge"), ["lang", "l_part"]).join(of("r").hint("merge"), ["lang", "r_part"])
    # Decimals hold the products exactly; the quotient is at most a million.
    exact = F.expr("(CAST(1000000 AS DECIMAL(7,0)) * CAST(a AS DECIMAL(15,0)) * CAST(a AS DECIMAL(15,0))) div (CAST(l AS DECIMAL(15,0)) * CAST(r AS DECIMAL(15,0)))")
    least = F.min(F.struct(exact.alias("score"), "k", "l", "r")).alias("least")
    return cut.groupBy("lang", "size", "phrase", "a").agg(least).select("lang", "size", "phrase", "a", "least.l", "least.r", "least.score")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int | None = TOP, shards: int = SHARDS, filter_bits: int = FILTER_BITS) -> DataFrame:
    """The best ``top`` phrases (None: all) of each language: lang, rank (from 1), phrase, a, l, r, n, score.

    Words, pieces, scores and ranks are those of the query op11.  A phrase goes if a
    longer one that holds it occurs at least half as often.  A null lang is ``und``,
    null and empty texts have no words, repeated rows count each, other columns are
    ignored, an empty table gives no rows.  Ties in score and count go to the smaller
    phrase in byte order.
    """
    counts, totals = phrase_counts(docs, least, longest, shards, filter_bits)
    scored = Stored(candidates(counts.df, longest), "scored")
    inner = [
        F.when(F.col("size") >= start + m, F.expr(f"array_join(slice(split(phrase, ' ', -1), {start + 1}, {m}), ' ')"))
        for m in range(2, longest)
        for start in range(longest - m + 1)
    ]
    if inner:
        longer = scored.df.where("size > 2").select("lang", "size", "a", F.explode(F.array_distinct(F.array_compact(F.array(*inner)))).alias("phrase"))
        longer = longer.where(F.size(F.split("phrase", " ", -1)) < F.col("size")).groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
        left = scored.df.join(longer.hint("merge"), ["lang", "phrase"], "left").where(F.coalesce(2 * F.col("longer") < F.col("a"), F.lit(True)))
    else:
        left = scored.df
    from pyspark.sql import Window as W

    best = [F.col("score").desc(), F.col("a").desc(), "phrase"]
    if top is not None:
        # A language is ranked in parts first, so that no task sorts all its phrases.
        left = left.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
        left = left.withColumn("rank", F.row_number().over(W.partitionBy("lang", "salt").orderBy(*best))).where(F.col("rank") <= top)
        ranked = left.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*best)).cast("long")).where(F.col("rank") <= top)
    else:
        ranked = left.withColumn("rank", F.lit(None).cast("long"))
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

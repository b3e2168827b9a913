"""Stupid-backoff scores of documents from n-gram counts of the whole corpus.

Documents are dealt to blocks by hash.  A block lists the names (64-bit hashes)
of its distinct n-grams of all orders with their counts; the lists are dealt by
ranges of the name, and each range adds them up: together the ranges are the
count table, partitioned by hash.  The totals go back to the blocks that asked, in
the order of their lists, where they are joined to the n-grams of every token
and summed per document.  Each distinct n-gram of a block travels once each way,
however often it occurs there.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetloom.llm.decontaminate import words_of
from sheetloom.llm.text import filled

ORDER = 3
DISCOUNT = 0.4
#: n-grams of two or more words count from this many occurrences on.
LEAST = 2
BLOCK_BYTES = 8 << 20
RANGE_NAMES = 2_500_000
CACHE_WORDS = 200_000

_MULTIPLY = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]
_words: dict[bytes, int] = {}


def _hashed(words: list[bytes]) -> np.ndarray:
    if len(_words) > CACHE_WORDS:
        _words.clear()
    for w in set(words).difference(_words):
        _words[w] = xxhash.xxh64_intdigest(w)
    return np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))


def grams(texts: list[str | None], order: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """(words per text, names of the n-grams that end at each token for n = 1 to order, tokens before each in its text)."""
    parts = [_hashed(words_of(t)) for t in texts]
    sizes = np.array([len(p) for p in parts], np.int64)
    words = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    place = np.arange(len(words)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    now, out = words, [words]
    for n in range(2, order + 1):
        longer = words.copy()
        if len(words) >= n:
            # The history of n - 1 words ends one token earlier.
            joined = now[:-1] * _MULTIPLY[n % 5]
            joined ^= joined >> np.uint64(31)
            longer[1:] = (joined + words[1:]) * _MULTIPLY[(n + 1) % 5]
            longer ^= longer >> np.uint64(29)
        out.append(longer)
        now = longer
    return sizes, out, place


def listed(names: list[np.ndarray], place: np.ndarray) -> np.ndarray:
    """Names of all n-grams that lie within one text, repeats included."""
    return np.concatenate([a if n == 0 else a[place >= n] for n, a in enumerate(names)])


def _borders(distinct: np.ndarray, ranges: int) -> np.ndarray:
    which = ((distinct >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
    return which.astype(np.int64)


def _pack(distinct: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes]:
    steps = np.diff(distinct, prepend=np.uint64(0))
    planes = steps.view(np.uint8).reshape(-1, 8).T
    low = int(np.flatnonzero(planes.any(1)).max(initial=0)) + 1
    head = np.ascontiguousarray(planes[: min(low, 5)]).tobytes()
    tail = zlib.compress(np.ascontiguousarray(planes[min(low, 5) :]).tobytes(), 1)
    return len(head).to_bytes(8, "little") + head + tail, _pack_counts(counts)


def _pack_counts(counts: np.ndarray) -> bytes:
    """One byte each, most of them small and so well compressed; 255 stands for the next of the full counts behind."""
    few = zlib.compress(np.minimum(counts, 255).astype(np.uint8).tobytes(), 6)
    return len(few).to_bytes(8, "little") + few + counts[counts >= 255].astype(np.uint64).tobytes()


def _unpack_counts(blob: bytes) -> np.ndarray:
    size = int.from_bytes(blob[:8], "little")
    counts = np.frombuffer(zlib.decompress(blob[8 : 8 + size]), np.uint8).astype(np.float64)
    counts[counts == 255] = np.frombuffer(blob[8 + size :], np.uint64)
    return counts


def _unpack(blob: bytes) -> np.ndarray:
    size = int.from_bytes(blob[:8], "little")
    raw = blob[8 : 8 + size] + zlib.decompress(blob[8 + size :])
    n = len(raw) // 8
    return np.cumsum(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, n).T).view(np.uint64).ravel(), dtype=np.uint64)


def _ask(order: int, ranges: int):
    def run(block: pa.Table) -> pa.Table:
        _, names, place = grams(block["text"].to_pylist(), order)
        distinct, counts = np.unique(listed(names, place), return_counts=True)
        which = _borders(distinct, ranges)
        edges = np.concatenate([[0], np.flatnonzero(np.diff(which)) + 1, [len(which)]]) if len(which) else np.zeros(1, np.int64)
        rows = {"range": [], "block": [], "names": [], "counts": []}
        for lo, hi in zip(edges, edges[1:]):
            packed = _pack(distinct[lo:hi], counts[lo:hi])
            rows["range"].append(int(which[lo]))
            rows["block"].append(block["block"][0].as_py())
            rows["names"].append(packed[0])
            rows["counts"].append(packed[1])
        return pa.table(rows, pa.schema([("range", pa.int64()), ("block", pa.int64()), ("names", pa.binary()), ("counts", pa.binary())]))

    return run


def _total(asked: pa.Table) -> pa.Table:
    """Add up the counts of one range of names and answer every block in the order of its list."""
    lists = [_unpack(b) for b in asked["names"].to_pylist()]
    counts = np.concatenate([_unpack_counts(c) for c in asked["counts"].to_pylist()])
    _, inverse = np.unique(np.concatenate(lists), return_inverse=True)
    totals = np.bincount(inverse, counts)[inverse]
    ends = np.cumsum([len(x) for x in lists])
    answers = [_pack_counts(totals[e - len(x) : e]) for x, e in zip(lists, ends)]
    return pa.table({"block": asked["block"], "range": asked["range"], "totals": pa.array(answers, pa.binary())})


def scores(names: list[np.ndarray], place: np.ndarray, counts: list[np.ndarray], total: int, least: int, discount: float) -> np.ndarray:
    """Natural logarithm of the stupid-backoff score of every token."""
    out = np.log(np.maximum(counts[0], 1) / total)
    out += np.log(discount) * np.minimum(place, len(names) - 1)
    for n in range(1, len(names)):
        seen = (place >= n) & (counts[n] >= least)
        history = np.concatenate([[1.0], counts[n - 1][:-1]])  # of the n words before the token
        tried = np.minimum(place, len(names) - 1) - n
        out = np.where(seen, np.log(np.maximum(counts[n], 1) / np.maximum(history, 1)) + np.log(discount) * tried, out)
    return out


def _answer(order: int, total: int, least: int, discount: float):
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("log_score", pa.float64())])

    def run(block: pa.Table, answers: pa.Table) -> pa.Table:
        if not block.num_rows:
            return schema.empty_table()
        sizes, names, place = grams(block["text"].to_pylist(), order)
        sums = np.zeros(len(sizes))
        if len(place):
            _, inverse = np.unique(listed(names, place), return_inverse=True)
            by_range = sorted(zip(answers["range"].to_pylist(), answers["totals"].to_pylist()))
            totals = np.concatenate([_unpack_counts(t) for _, t in by_range])[inverse]
            counts, at = [], 0
            for n in range(order):
                within = place >= n
                here = np.zeros(len(place))
                here[within] = totals[at : at + within.sum()]
                at += int(within.sum())
                counts.append(here)
            np.add.at(sums, np.repeat(np.arange(len(sizes)), sizes), scores(names, place, counts, total, least, discount))
        return pa.table([block["doc_id"], pa.array(sizes), pa.array(sums)], schema=schema)

    return run


def _sizes(batches):
    for batch in batches:
        values = batch.column(0).to_pylist()
        yield pa.RecordBatch.from_pydict({"n": [sum(len(words_of(v)) for v in values)], "size": [sum(len(v or "") for v in values)]}, pa.schema([("n", pa.int64()), ("size", pa.int64())]))


def ngram_scores(docs: DataFrame, order: int = ORDER, least: int = LEAST, discount: float = DISCOUNT, block_bytes: int = BLOCK_BYTES, range_names: int = RANGE_NAMES) -> DataFrame:
    """One row per document of (doc_id, text): doc_id, n_words, log_score (sum over its words) and mean_log_score.

    A word's score is count(n-gram) / count(history) for the longest n-gram, up to
    ``order`` words within the text, that the corpus holds ``least`` times or more, times
    ``discount`` for every order passed over; single words score count / words of
    the corpus.  ``least`` of two leaves out n-grams that only this document
    brings in.  Counts cover all words of all documents.  Texts without words and null texts have n_words 0,
    log_score 0 and a null mean.  Repeated rows are scored each and count each;
    null ids are fine, other columns are ignored, an empty table gives no rows.
    """
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), filled(F.col("text")).alias("text"))
    sums = known.select("text").mapInArrow(_sizes, "n long, size long").agg(F.sum("n").alias("n"), F.sum("size").alias("size")).first()
    total, size = sums["n"] or 0, sums["size"] or 0
    blocks = max(1, int(size // block_bytes) + 1)
    ranges = max(1, int(total * order // range_names) + 1)
    dealt = known.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)))
    asked = dealt.groupBy("block").applyInArrow(_ask(order, ranges), "range long, block long, names binary, counts binary")
    answers = asked.groupBy("range").applyInArrow(_total, "block long, range long, totals binary")
    scored = dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_answer(order, total, least, discount), "doc_id long, n_words long, log_score double")
    return scored.withColumn("mean_log_score", F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")))

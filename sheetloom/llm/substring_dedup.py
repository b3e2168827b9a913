"""Removal of long repeated byte strings by distributed prefix doubling.

Names take the place of ranks: the name of 2L bytes at p is made of the names of L
bytes at p and p + L, so that equal strings have equal names (numpy does these
steps for all positions of a batch).  Spark groups names at growing lengths and
drops what is unique after each round:

1. GRAM bytes, at anchors only.  The anchor of a window (a string of ``length``
   bytes) is its GRAM-byte string of smallest name, so equal windows have equal anchors at the
   same distance, and neighbouring windows share one.  Anchors whose name is
   unique leave: none of their windows repeats.
2. The stretch of all windows of an anchor.  Stretches that repeat as a whole
   are repeated windows throughout.
3. The bytes that BLOCK neighbouring windows of an anchor have in common, only
   around anchors whose stretches differ; blocks with a unique common part leave.
   Then all the bytes of a block: blocks that repeat as a whole are done.
4. ``length`` bytes, window by window, only in the blocks that are left: the
   edges of repeated passages.

In 3 and 4 one representative per stretch or block is enough.  Texts cross the
network three times, to meet the positions found for them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetloom.llm.store import Stored, collect_shuffles
from sheetloom.llm.text import filled, pieces, set_apart

LENGTH = 200
GRAM = 64
LONG = 128
BLOCK = 16
BUFFER = 1 << 22
PLACE_BITS = np.uint64(23)
DOC = ["__k1", "__k2"]

_RANDOM = np.random.default_rng(20240229)
_BYTE_NAMES = _RANDOM.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ODD = _RANDOM.integers(0, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(left: np.ndarray, right: np.ndarray, level: int) -> np.ndarray:
    made = left * _ODD[level]
    made ^= made >> np.uint64(29)
    made += right
    made *= _ODD[level + 1]
    made ^= made >> np.uint64(32)
    return made


def names(data: np.ndarray, lengths: tuple[int, ...]) -> dict[int, np.ndarray]:
    """Names of the strings of each power-of-two length, at every position where one fits."""
    now, length, level, out = _BYTE_NAMES[data], 1, 0, {}
    while True:
        if length in lengths:
            out[length] = now
        if length >= max(lengths):
            return out
        now = _mix(now[:-length], now[length:], level) if len(now) > length else now[:0]
        length, level = 2 * length, level + 1


def smallest(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours."""
    now, length = values, 1
    while 2 * length <= width:
        now = np.minimum(now[:-length], now[length:])
        length *= 2
    return np.minimum(now[: len(now) - (width - length)], now[width - length :]) if width > length else now


def anchors(data: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(text number, first window, last window, anchor, its name, stretch name) over texts joined in ``data``.

    ``starts`` has the begin of every text and the end of the last.  Windows never cross texts.
    """
    size = len(data)
    if size < length:
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    found = names(data, (GRAM, LONG))
    gram, long = found[GRAM], found[LONG]
    place = np.arange(len(gram), dtype=np.uint64)
    ordered = (gram >> PLACE_BITS << PLACE_BITS) | place
    least = smallest(ordered, length - GRAM + 1)
    windows = size - length + 1
    anchor = (least[:windows] & ((np.uint64(1) << PLACE_BITS) - np.uint64(1))).astype(np.int64)
    text = np.repeat(np.arange(len(starts) - 1), np.diff(starts))[:windows]
    valid = np.arange(windows) + length <= starts[text + 1]
    change = np.empty(windows, bool)
    change[0] = True
    change[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1]) | (valid[1:] & ~valid[:-1])
    first = np.flatnonzero(change & valid)
    stop = np.append(np.flatnonzero(change | ~valid), windows)
    last = stop[np.searchsorted(stop, first, "right")] - 1
    end = last + length
    middle = np.minimum(first + LONG, end - LONG)
    where = ((last - first) << 16 | (anchor[first] - first)).astype(np.uint64)
    stretch = _mix(_mix(_mix(long[first], long[middle], 8), long[end - LONG], 10), where * _ODD[15], 12)
    owner = text[first]
    return owner, first - starts[owner], last - starts[owner], anchor[first] - starts[owner], gram[anchor[first]].view(np.int64), stretch.view(np.int64)


def _pieces(text: bytes, length: int):
    """(offset, bytes) of bounded size that together hold every window once."""
    step = BUFFER - length + 1
    for at in range(0, max(1, len(text) - length + 1), step):
        yield at, text[at : at + BUFFER]


def _anchor_rows(length: int):
    def flush(held):
        blobs = [b for _, _, _, b in held]
        starts = np.concatenate([[0], np.cumsum([len(b) for b in blobs])])
        owner, lo, hi, place, gram, stretch = anchors(np.frombuffer(b"".join(blobs), np.uint8), starts, length)
        k1, k2, at = (np.array([h[i] for h in held], np.int64) for i in range(3))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (k1[owner], k2[owner], lo + at[owner], hi + at[owner], place + at[owner], gram, stretch)], names=["k1", "k2", "lo", "hi", "at", "gram", "stretch"])

    def run(batches):
        held, size = [], 0
        for batch in pieces(batches):
            for k1, k2, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                for at, piece in _pieces(text, length):
                    if size + len(piece) > BUFFER:
                        yield flush(held)
                        held, size = [], 0
                    held.append((k1, k2, at, piece))
                    size += len(piece)
        if held:
            yield flush(held)

    return run


def _asked(batches, length: int):
    """(k1, k2, begin of the piece, names of LONG bytes, what is wanted of its windows) for every piece with anything wanted."""
    for batch in pieces(batches):
        for k1, k2, text, wanted in zip(*(batch.column(i).to_pylist() for i in range(4))):
            for at, piece in _pieces(text, length):
                here = [w for w in wanted if at <= w["lo"] <= at + len(piece) - length]
                if here:
                    yield k1, k2, at, names(np.frombuffer(piece, np.uint8), (LONG,))[LONG], here


def _block_rows(length: int):
    """Blocks of windows at BLOCK neighbouring distances from their anchor: name of the common bytes, of all bytes, and place."""

    def run(batches):
        for k1, k2, begin, long, wanted in _asked(batches, length):
            lo, hi, at, n = (np.array([w[k] for w in wanted], np.int64) for k in ("lo", "hi", "at", "n"))
            near, far = at - hi, at - lo  # smallest and largest distance
            count = far // BLOCK - near // BLOCK + 1
            own = np.repeat(np.arange(len(lo)), count)
            block = near[own] // BLOCK + np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)
            small, large = np.maximum(near[own], block * BLOCK), np.minimum(far[own], block * BLOCK + BLOCK - 1)
            start, end = at[own] - large - begin, at[own] - small + length - begin
            common, stop = at[own] - block * BLOCK - begin, at[own] - block * BLOCK - BLOCK + 1 + length - begin
            core = _mix(_mix(long[common], long[stop - LONG], 8), block.astype(np.uint64) * _ODD[15], 10)
            union = _mix(_mix(long[start], long[end - LONG], 10), (large << 16 | small).astype(np.uint64) * _ODD[15], 12)
            size = len(own)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (core.view(np.int64), union.view(np.int64), np.full(size, k1), np.full(size, k2), at[own] - large, at[own] - small, n[own] == 1)],
                names=["core", "union", "k1", "k2", "lo", "hi", "single"],
            )

    return run


def _window_rows(length: int):
    """Two names (together the whole window), place and weight of the windows asked for in each text."""

    def run(batches):
        for k1, k2, begin, long, wanted in _asked(batches, length):
            p = np.concatenate([np.arange(w["lo"], w["hi"] + 1) for w in wanted]) - begin
            single = np.concatenate([np.full(w["hi"] - w["lo"] + 1, w["n"] == 1) for w in wanted])
            k = len(p)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (long[p].view(np.int64), long[p + length - LONG].view(np.int64), np.full(k, k1), np.full(k, k2), p + begin, single)], names=["w1", "w2", "k1", "k2", "p", "single"])

    return run


def _covered(runs: list[dict], length: int) -> list[tuple[int, int]]:
    """Byte ranges covered by repeated windows, from ranges of window starts."""
    out: list[list[int]] = []
    for lo, hi in sorted((r["lo"], r["hi"]) for r in runs or []):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi + length)
        else:
            out.append([lo, hi + length])
    return [(a, b) for a, b in out]


def _keyed(docs: DataFrame) -> DataFrame:
    text = filled(F.col("text"))
    return docs.withColumns({"__k1": F.xxhash64(text), "__k2": F.xxhash64(F.lit(1), text)})


PLACE = ["k1", "k2", "lo", "hi"]


def _two_places(by: list[str], place: list[str], rows: DataFrame, *more) -> DataFrame:
    """One row per group: smallest and largest place hash (equal if the group has one place, however often it is listed)."""
    here = F.xxhash64(*place)
    return rows.groupBy(*by).agg(F.min(here).alias("a"), F.max(here).alias("b"), *more)


def repeated_starts(docs: DataFrame, length: int) -> Stored:
    """(__k1, __k2, runs of repeated window starts) of every distinct text that has any."""
    texts = _keyed(docs.select("text")).where(F.octet_length("text") >= length).select(*DOC, F.col("text").cast("binary").alias("bytes"))

    def meet(asked: DataFrame) -> DataFrame:
        return texts.join(asked.withColumnsRenamed({"k1": "__k1", "k2": "__k2"}).hint("merge"), DOC).select(*DOC, "bytes", "wanted")

    every = Stored(texts.mapInArrow(_anchor_rows(length), "k1 long, k2 long, lo long, hi long, at long, gram long, stretch long"), "anchors")
    again = Stored(every.df.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram"), "grams")
    rows = Stored(every.df.join(again.df, "gram"), "repeated")
    every.drop()
    again.drop()
    # Any member stands for its stretch: all have the same windows.
    member = [F.first(c).alias(c) for c in (*PLACE, "at")]
    classes = Stored(rows.df.groupBy("gram", "stretch").agg(F.count("*").alias("n"), *member), "stretches")
    mixed = Stored(classes.df.groupBy("gram").agg(F.count("*").alias("m"), F.min("n").alias("least")).where("m > 1 AND least = 1").select("gram"), "mixed")
    whole = Stored(rows.df.join(classes.df.where("n > 1").select("gram", "stretch"), ["gram", "stretch"]).select(*PLACE).distinct(), "whole")
    asked = Stored(classes.df.join(mixed.df, "gram").groupBy("k1", "k2").agg(F.collect_list(F.struct("lo", "hi", "at", "n")).alias("wanted")), "asked")
    for done in (rows, classes, mixed):
        done.drop()
    collect_shuffles(docs.sparkSession)

    blocks = Stored(meet(asked.df).mapInArrow(_block_rows(length), "core long, union long, k1 long, k2 long, lo long, hi long, single boolean"), "blocks")
    cores = Stored(_two_places(["core"], PLACE, blocks.df).where("a <> b").select("core"), "cores")
    alive = Stored(blocks.df.join(cores.df, "core"), "alive")
    asked.drop()
    blocks.drop()
    cores.drop()
    unions = Stored(_two_places(["core", "union"], PLACE, alive.df, *(F.first(c).alias(c) for c in (*PLACE, "single"))), "unions")
    more = Stored(alive.df.where("single").join(unions.df.where("a <> b").select("core", "union"), ["core", "union"]).select(*PLACE).distinct(), "more")
    edge = Stored(unions.df.groupBy("core").agg(F.count("*").alias("m"), F.bool_or(F.col("single") & (F.col("a") == F.col("b"))).alias("open")).where("m > 1 AND open").select("core"), "edge")
    weight = F.when(F.col("single") & (F.col("a") == F.col("b")), 1).otherwise(2).alias("n")
    asked = Stored(unions.df.join(edge.df, "core").groupBy("k1", "k2").agg(F.collect_list(F.struct("lo", "hi", weight)).alias("wanted")), "asked")
    for done in (alive, unions, edge):
        done.drop()
    collect_shuffles(docs.sparkSession)

    windows = Stored(meet(asked.df).mapInArrow(_window_rows(length), "w1 long, w2 long, k1 long, k2 long, p long, single boolean"), "windows")
    asked.drop()
    twice = Stored(_two_places(["w1", "w2"], ["k1", "k2", "p"], windows.df).where("a <> b").select("w1", "w2"), "twice")
    edges = windows.df.where("single").join(twice.df, ["w1", "w2"]).select("k1", "k2", F.col("p").alias("lo"), F.col("p").alias("hi")).distinct()
    starts = whole.df.unionByName(more.df).unionByName(edges).groupBy(F.col("k1").alias("__k1"), F.col("k2").alias("__k2")).agg(F.collect_list(F.struct("lo", "hi")).alias("__runs"))
    found = Stored(starts, "starts")
    for done in (whole, more, windows, twice):
        done.drop()
    collect_shuffles(docs.sparkSession)
    return found


def substring_dedup(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Append n_bytes, removed (maximal byte ranges, end exclusive) and kept (the other bytes) to every document.

    A byte goes if a string of ``length`` bytes that covers it also starts anywhere
    else, in the same text included; all is judged on the input.  Texts are UTF-8
    bytes and matches never cross them; a null text is empty, and nothing is removed from
    a text shorter than ``length``.  Exact copies of a long enough text go entirely, every
    one of them.  Repeated rows count as copies.  Other columns pass through; columns of the three names are
    replaced.  ``length`` is at least LONG and at most twice that.
    """
    if not LONG <= length <= 2 * LONG:
        raise ValueError(f"length must be from {LONG} to {2 * LONG}")
    rest, back = set_apart(docs.drop("n_bytes", "removed", "kept"), "text")
    found = repeated_starts(docs.select("text"), length)
    both = _keyed(rest).join(found.df.hint("merge"), DOC, "left").withColumn("__bytes", filled(F.col("text")).cast("binary")).drop(*DOC)

    def run(batches):
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in pieces(batches):
            at = batch.schema.get_field_index
            sizes, removed, kept = [], [], []
            for text, runs in zip(batch.column(at("__bytes")).to_pylist(), batch.column(at("__runs")).to_pylist()):
                spans = _covered(runs, length)
                begins, ends = [0, *(b for _, b in spans)], [*(a for a, _ in spans), len(text)]
                sizes.append(len(text))
                removed.append([{"start": a, "end": b} for a, b in spans])
                kept.append(b"".join(text[a:b] for a, b in zip(begins, ends)))
            own = [i for i, n in enumerate(batch.schema.names) if n not in ("__bytes", "__runs")]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in own), pa.array(sizes, pa.int64()), pa.array(removed, span), pa.array(kept, pa.binary())], names=[*(batch.schema.names[i] for i in own), "n_bytes", "removed", "kept"])

    schema = both.drop("__bytes", "__runs").selectExpr("*", "CAST(0 AS BIGINT) AS n_bytes", "CAST(array() AS array<struct<start:bigint,end:bigint>>) AS removed", "CAST('' AS BINARY) AS kept").schema
    return back(both.mapInArrow(run, schema), "n_bytes", "removed", "kept")

"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the windows of benchmark items.  All patterns of one length m share
a shift table over blocks of two neighbouring words: a block that no pattern
holds lets the search jump m - 1 words, a block inside a pattern jumps to its
nearest end.  At shift zero the hash of the last two words selects the patterns
that end there, and a direct comparison confirms an occurrence.
"""

from __future__ import annotations

from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetloom.llm.store import Stored
from sheetloom.llm.text import pieces

WINDOW = 10
#: Words of patterns that one pass over the documents holds in memory; more patterns take more passes.
BLOCK_WORDS = 2_000_000

_WORD_BYTES = bytes(ord(chr(b).lower()) if chr(b).isalnum() and b < 128 else b if b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Runs of ASCII letters, digits and all non-ASCII characters, A-Z in lower case."""
    return text.encode().translate(_WORD_BYTES).split() if text else []


class WuManber:
    """Search tables of patterns that all have ``length`` words."""

    def __init__(self, length: int, patterns: dict[tuple[bytes, ...], list]):
        self.length = length
        self.block = min(2, length)
        self.longest = length - self.block + 1
        self.shift: dict = {}
        self.ending: dict = defaultdict(list)
        for words, items in patterns.items():
            for end in range(self.block, length + 1):
                key = self._key(words, end)
                self.shift[key] = min(self.shift.get(key, self.longest), length - end)
            self.ending[self._key(words, length)].append((words, items))

    def _key(self, words, end: int):
        return (words[end - 2], words[end - 1]) if self.block == 2 else words[end - 1]

    def find(self, words: list[bytes]):
        """(start, items) of every occurrence."""
        end, size, get, longest, length = self.length, len(words), self.shift.get, self.longest, self.length
        pairs = self.block == 2
        while end <= size:
            key = (words[end - 2], words[end - 1]) if pairs else words[end - 1]
            jump = get(key, longest)
            if jump:
                end += jump
                continue
            start = end - length
            for pattern, items in self.ending[key]:
                if tuple(words[start:end]) == pattern:
                    yield start, items
            end += 1


def patterns_of(item_id, text: str | None, window: int) -> list[tuple[tuple[bytes, ...], object]]:
    words = words_of(text)
    if not words:
        return []
    size = min(window, len(words))
    return [(tuple(words[i : i + size]), item_id) for i in range(len(words) - size + 1)]


def tables(items: list[tuple[object, str | None]], window: int) -> list[WuManber]:
    by_length: dict[int, dict] = defaultdict(dict)
    for item_id, text in items:
        for words, owner in patterns_of(item_id, text, window):
            owners = by_length[len(words)].setdefault(words, [])
            if owner is not None and owner not in owners:
                owners.append(owner)
    return [WuManber(length, found) for length, found in sorted(by_length.items())]


def _search(df: DataFrame, machines: list[WuManber], text: str) -> DataFrame:
    """Extend the spans and items of every row by what these tables find in its whole text."""
    machines_sent = df.sparkSession.sparkContext.broadcast(machines)  # at most BLOCK_WORDS words
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        for batch in pieces(batches):
            at = batch.schema.get_field_index
            counts, spans_out, items_out = [], [], []
            for value, spans, items in zip(batch.column(at(text)).to_pylist(), batch.column(at("hit_spans")).to_pylist(), batch.column(at("hit_items")).to_pylist()):
                words = words_of(value)
                found, owners = [(s["start"], s["end"]) for s in spans], set(items)
                for machine in machines_sent.value:
                    for start, ids in machine.find(words):
                        found.append((start, start + machine.length))
                        owners.update(ids)
                merged: list[list[int]] = []
                for start, end in sorted(found):
                    if merged and start <= merged[-1][1]:
                        merged[-1][1] = max(end, merged[-1][1])
                    else:
                        merged.append([start, end])
                counts.append(len(words))
                spans_out.append([{"start": a, "end": b} for a, b in merged])
                items_out.append(sorted(owners))
            made = {"n_words": pa.array(counts, pa.int64()), "hit_spans": pa.array(spans_out, span), "hit_items": pa.array(items_out, pa.list_(pa.string()))}
            yield pa.RecordBatch.from_arrays([made.get(n, batch.column(i)) for i, n in enumerate(batch.schema.names)], names=batch.schema.names)

    return df.mapInArrow(run, df.schema)


RESULT = {"n_words": "0L", "hit_spans": "CAST(array() AS array<struct<start:int,end:int>>)", "hit_items": "CAST(array() AS array<string>)"}


def blocks_of(benchmark: DataFrame, block_words: int):
    """Items in blocks of bounded size: a range of item hashes each, read one block at a time."""
    weighed = benchmark.select(
        F.col("item_id").cast("string").alias("item_id"), F.col("text"), (F.octet_length(F.coalesce("text", F.lit(""))) / 2 * WINDOW + 1).alias("weight")
    )
    total = weighed.agg(F.sum("weight")).first()[0] or 0
    n = max(1, int(total // block_words) + 1)
    for k in range(n):
        part = weighed.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).select("item_id", "text")
        yield n, [(r.item_id, r.text) for r in part.collect() ]


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS, text: str = "text") -> DataFrame:
    """Append n_words, hit_spans (merged word ranges, end exclusive) and hit_items (sorted ids) to every document.

    An item of at least ``window`` words gives all its windows, a shorter one is a
    single window, one without words gives none.  The windows of an item without an id
    are hit like others, but give no item.  A null text has no words.  Repeated
    items count under each of their ids.  Documents keep their columns; columns of
    those three names are replaced.  The benchmark is taken in blocks of
    ``block_words`` (upper estimate), each broadcast in turn: its size is bounded
    however large the benchmark is.  Documents are never shuffled.
    """
    df = docs.drop(*RESULT).selectExpr("*", *(f"{v} AS {k}" for k, v in RESULT.items()))
    df = df.select(*(F.col(f"`{f.name}`") for f in df.schema.fields))
    before = None
    for n, items in blocks_of(benchmark, block_words):
        df = _search(df, tables(items, window), text)
        if n > 1:
            kept = Stored(df, "decontaminate")
            df = kept.df
            if before is not None:
                before.drop()
            before = kept
    return df


def hit_words():
    """Words inside any occurrence, from the merged spans."""
    return F.aggregate("hit_spans", F.lit(0).cast("long"), lambda total, s: total + (s["end"] - s["start"]).cast("long"))

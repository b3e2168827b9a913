"""Byte-level BPE encoding and decoding.

Words come from the public pre-tokenisation pattern.  A short word holds an array
of part boundaries and an array of the ranks of adjacent parts; the smallest rank
is searched, its boundary deleted and the two neighbouring ranks refreshed, until
no adjacent parts merge.  A long word (no bound on its length) keeps the ranks in
a heap instead, which gives the same merges in n log n steps.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
import sys
import unicodedata
from array import array

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheetloom.llm.text import pieces

NEVER = 1 << 62
SHORT = 200
CACHE_WORDS = 250_000


def _class(kind: str) -> str:
    """Character class of the code points whose Unicode category starts with ``kind``, as ranges."""
    ranges: list[list[int]] = []
    for point in range(sys.maxunicode + 1):
        if unicodedata.category(chr(point))[0] == kind:
            if ranges and ranges[-1][1] == point - 1:
                ranges[-1][1] = point
            else:
                ranges.append([point, point])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" if b > a else f"\\U{a:08x}" for a, b in ranges)


# The pre-tokenisation pattern of the vocabulary, and White_Space of Unicode.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


@functools.cache
def word_pattern(ascii_only: bool) -> re.Pattern:
    letter, digit, space = ("A-Za-z", "0-9", r"\t-\r ") if ascii_only else (_class("L"), _class("N"), SPACE)
    return re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{letter}]+| ?[{digit}]+| ?[^{space}{letter}{digit}]+|[{space}]+(?![^{space}])|[{space}]+")


def _byte_letters() -> dict[str, int]:
    """The printable stand-in of every byte in the vocabulary file."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in shown}
    return letters | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}


class Vocabulary:
    """Merges, ids and special tokens of a vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        back = _byte_letters()
        names = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of: list[bytes] = [b""] * (max([*names.values(), *self.special.values()]) + 1)
        for name, token in names.items():
            self.bytes_of[token] = bytes(map(back.__getitem__, name)) if name not in self.special else name.encode()
        for name, token in self.special.items():
            self.bytes_of[token] = name.encode()
        self.byte_ids = [0] * 256
        for name, token in names.items():
            if len(name) == 1:
                self.byte_ids[back[name]] = token
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[names[left], names[right]] = (rank, names[left + right])
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.cache: dict[str, bytes] = {}

    def word_ids(self, word: bytes) -> list[int]:
        parts = [self.byte_ids[b] for b in word]
        return self._short(parts) if len(parts) <= SHORT else self._long(parts)

    def _rank(self, left: int, right: int) -> int:
        found = self.merges.get((left, right))
        return NEVER if found is None else found[0]

    def _short(self, parts: list[int]) -> list[int]:
        ranks = [self._rank(a, b) for a, b in zip(parts, parts[1:])]
        while ranks:
            least = min(ranks)
            if least == NEVER:
                break
            at = ranks.index(least)
            parts[at] = self.merges[parts[at], parts[at + 1]][1]
            del parts[at + 1], ranks[at]
            if at < len(ranks):
                ranks[at] = self._rank(parts[at], parts[at + 1])
            if at:
                ranks[at - 1] = self._rank(parts[at - 1], parts[at])
        return parts

    def _long(self, parts: list[int]) -> list[int]:
        size = len(parts)
        following, previous = list(range(1, size + 1)), list(range(-1, size - 1))
        heap = [(self._rank(parts[i], parts[i + 1]), i, parts[i], parts[i + 1]) for i in range(size - 1)]
        heapq.heapify(heap)
        while heap:
            rank, at, left, right = heapq.heappop(heap)
            if rank == NEVER:
                break
            after = following[at]
            if parts[at] != left or after >= size or parts[after] != right:
                continue  # one of the two parts has been merged since
            parts[at], parts[after] = self.merges[left, right][1], -1
            following[at] = following[after]
            if following[at] < size:
                previous[following[at]] = at
                heapq.heappush(heap, (self._rank(parts[at], parts[following[at]]), at, parts[at], parts[following[at]]))
            if previous[at] >= 0:
                before = previous[at]
                heapq.heappush(heap, (self._rank(parts[before], parts[at]), before, parts[before], parts[at]))
        return [p for p in parts if p >= 0]

    def _word(self, word: str) -> bytes:
        ids = array("I", self.word_ids(word.encode())).tobytes()
        if len(word) <= SHORT:
            if len(self.cache) >= CACHE_WORDS:
                self.cache.clear()
            self.cache[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Token ids as little-endian unsigned 32-bit integers."""
        out, get = [], self.cache.get
        for piece in self.split_special.split(text) if self.split_special else [text]:
            if piece in self.special:
                out.append(array("I", [self.special[piece]]).tobytes())
            elif piece:
                out += [get(word) or self._word(word) for word in word_pattern(piece.isascii()).findall(piece)]
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes_of.__getitem__, memoryview(ids).cast("I"))).decode("utf-8", "replace")


@functools.cache
def vocabulary(path: str) -> Vocabulary:
    """One vocabulary per worker process; ``path`` is a file that every worker has."""
    return Vocabulary(path)


def _mapped(df: DataFrame, source: str, target: str, kind: str, fn) -> DataFrame:
    """Append ``target`` = fn(column ``source``) batch by batch, all other columns pass through Arrow untouched."""
    arrow = {"binary": pa.binary(), "string": pa.string()}[kind]
    schema = T.StructType([f for f in df.schema.fields if f.name != target] + [T.StructField(target, T._parse_datatype_string(kind))])

    def run(batches):
        for batch in pieces(batches):
            made = pa.array(map(fn, batch.column(batch.schema.get_field_index(source)).to_pylist()), arrow)
            keep = [i for i, name in enumerate(batch.schema.names) if name != target]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), made], names=[*(batch.schema.names[i] for i in keep), target])

    return df.mapInArrow(run, schema)


def bpe_encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Append ``ids``: the whole text as packed little-endian unsigned 32-bit token ids.

    The strings of special tokens in a text become those tokens.  A null or empty
    text gives no ids (empty binary).  Rows keep their other columns; a column
    already named ``ids`` is replaced.
    """
    return _mapped(docs, text, ids, "binary", lambda value: vocabulary(path).encode(value or ""))


def bpe_decode(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Append ``decoded``: the text of packed ids; special tokens appear as their strings, null ids as an empty text."""
    return _mapped(df, ids, text, "string", lambda value: vocabulary(path).decode(value or b""))


def bpe_round(docs: DataFrame, path: str) -> DataFrame:
    """Append ``ids`` and ``decoded`` as bpe_encode and bpe_decode do, in one pass: a task needs one Python worker, not one for each."""
    added = T.StructType.fromDDL("ids binary, decoded string")
    schema = T.StructType([f for f in docs.schema.fields if f.name not in added.fieldNames()] + added.fields)

    def run(batches):
        words = vocabulary(path)
        for batch in pieces(batches):
            ids = [words.encode(value or "") for value in batch.column(batch.schema.get_field_index("text")).to_pylist()]
            keep = [i for i, name in enumerate(batch.schema.names) if name not in added.fieldNames()]
            made = [pa.array(ids, pa.binary()), pa.array(map(words.decode, ids), pa.string())]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), *made], names=[*(batch.schema.names[i] for i in keep), *added.fieldNames()])

    return docs.mapInArrow(run, schema)


def unpacked(ids: Column) -> Column:
    """Packed ids as an array of integers."""
    digits = F.hex(ids)
    return F.transform(
        F.sequence(F.lit(1), F.octet_length(ids).cast("int"), F.lit(4)),
        lambda at: F.conv(F.concat(*(F.substring(digits, at * 2 - 1 + 2 * k, F.lit(2)) for k in (3, 2, 1, 0))), 16, 10).cast("long"),
    )

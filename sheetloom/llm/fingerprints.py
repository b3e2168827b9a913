"""Document fingerprints from prefix polynomial hashes.

``Prefixes`` holds, for a sequence of code points, the arrays of the polynomial
hashes of all its prefixes (two bases, modulus 2^31 - 1).  The hash of any span is a
difference of two entries, so spans are compared without reading them, and the
longest common extension of two positions is found by binary search over lengths.

A fingerprint has three parts, all read off the prefix arrays:
- the hash of the whole text and its length;
- a ladder: hashes of the prefixes at fixed, geometrically growing lengths, on which
  a binary search finds how far two texts agree from their start;
- a sketch: the smallest hash in each of BUCKETS classes among all spans of SPAN code
  points, whose shared entries estimate the share of equal spans.
``likeness`` of two fingerprints is the larger of both answers.

Documents and their successors meet by ranges of doc_id: split documents come from
a bounded sample, every block is sorted and streamed, and the first document of a
block is sent to the block before it as well.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetloom.llm.text import filled, pieces

PRIME = (1 << 31) - 1
BASES = (1_000_003, 1_618_033_988)
SPAN = 12
BUCKETS = 64
EMPTY = 0xFFFF
#: Bytes of text that a block is planned for, blocks at most, and sampled documents per block (they reach the driver).
BLOCK_BYTES = 8 << 20
MOST_BLOCKS = 1 << 16
SAMPLES = 8
#: Code points hashed together.
BATCH_POINTS = 1 << 18
_RUN = 1 << 12
_BLOCK = 1 << 14


def _reduced(x: np.ndarray) -> np.ndarray:
    """x modulo 2^31 - 1 for x below 2^63."""
    p = np.uint64(PRIME)
    x = (x & p) + (x >> np.uint64(31))
    x = (x & p) + (x >> np.uint64(31))
    return x - p * (x >= p)


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo 2^31 - 1 for reduced a and b."""
    x = a * b
    x = (x & np.uint64(PRIME)) + (x >> np.uint64(31))
    return x - np.uint64(PRIME) * (x >= np.uint64(PRIME))


def _difference(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a + np.uint64(PRIME) * (a < b) - b


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    for i in range(1, n):
        out[i] = int(out[i - 1]) * base % PRIME
    return out


_POWERS = [_powers(b, _RUN + 1) for b in BASES]
_INVERSE = [_powers(pow(b, -1, PRIME), _RUN + 1) for b in BASES]


#: base^(k * _RUN), as far as spans have needed it.
_HIGH = [[1] for _ in BASES]


def _power(which: int, exponent: np.ndarray) -> np.ndarray:
    """base^exponent from two small tables."""
    high = _HIGH[which]
    while len(high) <= int(exponent.max(initial=0)) // _RUN:
        high.append(high[-1] * int(_POWERS[which][_RUN]) % PRIME)
    return _reduced(_POWERS[which][exponent % _RUN] * np.array(high, np.uint64)[exponent // _RUN])


def _folded(x: np.ndarray) -> np.ndarray:
    """x modulo 2^31 - 1, up to a few multiples that the next step tolerates."""
    return (x & np.uint64(PRIME)) + (x >> np.uint64(31))


def _prefix_array(points: np.ndarray, which: int) -> np.ndarray:
    """h[i] is the hash of the first i code points: h[i + 1] = h[i] * base + point + 1."""
    n = len(points)
    out = np.zeros(n + 1, np.uint64)
    powers, inverse = _POWERS[which][1:], _INVERSE[which][1:]
    carry = 0
    for at in range(0, n, _RUN):
        run = points[at : at + _RUN].astype(np.uint64) + np.uint64(1)
        # Inside a run: the sum of point_j * base^-(j + 1), plus what came before, times base^(i + 1).
        sums = np.cumsum(_folded(run * inverse[: len(run)])) + np.uint64(carry)
        out[at + 1 : at + 1 + len(run)] = h = _reduced(_folded(sums) * powers[: len(run)])
        carry = int(h[-1])
    return out


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


class Prefixes:
    """Prefix hashes of a code-point sequence; memory is 20 bytes per code point."""

    def __init__(self, points: np.ndarray):
        self.size = len(points)
        self.arrays = [_prefix_array(points, k) for k in range(len(BASES))]

    def span(self, start, end) -> np.ndarray:
        """62-bit hashes of the spans [start, end); arrays of the same length, or numbers."""
        start, end = np.asarray(start, np.int64), np.asarray(end, np.int64)
        parts = [_difference(h[end], _product(h[start], _power(k, end - start))) for k, h in enumerate(self.arrays)]
        return (parts[0] << np.uint64(31)) | parts[1]

    def equal(self, start: int, other: Prefixes, at: int, length: int) -> bool:
        """Whether ``length`` code points from ``start`` equal those of ``other`` from ``at``."""
        return bool(self.span(start, start + length) == other.span(at, at + length))

    def common(self, start: int, other: Prefixes, at: int) -> int:
        """Longest common extension of the two positions, by binary search."""
        low, high = 0, min(self.size - start, other.size - at)
        while low < high:
            middle = (low + high + 1) // 2
            if self.equal(start, other, at, middle):
                low = middle
            else:
                high = middle - 1
        return low


def _ladder(most: int) -> np.ndarray:
    out, step = list(range(1, 9)), 1
    while out[-1] <= most:
        out += [out[-1] + step * k for k in range(1, 9)]
        step *= 2
    return np.array(out, np.int64)


#: Lengths of the ladder: all up to eight, then eight per octave.
RUNGS = _ladder(1 << 31)


def rungs(most: int) -> np.ndarray:
    """Lengths of the ladder up to ``most``."""
    return RUNGS[: np.searchsorted(RUNGS, most, side="right")]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Prints:
    """Fingerprints of several texts, from one prefix array over all of them."""

    def __init__(self, texts: list[np.ndarray]):
        self.sizes = np.array([len(t) for t in texts], np.int64)
        starts = np.cumsum(self.sizes) - self.sizes
        self.starts = starts
        self.prefixes = Prefixes(np.concatenate([*texts, np.empty(0, np.uint32)]))
        self.whole = self.prefixes.span(starts, starts + self.sizes)
        self.sketch = self._sketches()
        self.ladder = self._ladders()

    def _ladders(self) -> list[np.ndarray]:
        """Hashes of the prefixes on the rungs."""
        every = rungs(int(self.sizes.max(initial=0)))
        counts = np.searchsorted(every, self.sizes, side="right")
        start = np.repeat(self.starts, counts)
        length = every[np.concatenate([np.arange(c) for c in counts] or [np.empty(0, np.int64)]).astype(np.int64)]
        hashes = _mixed(self.prefixes.span(start, start + length)) >> np.uint64(48) if len(start) else np.empty(0, np.uint64)
        return np.split(hashes.astype(np.uint16), np.cumsum(counts)[:-1])

    def _sketches(self) -> np.ndarray:
        """The smallest span hash of each class; a text shorter than a span is one span."""
        out = np.full(len(self.sizes) * BUCKETS, EMPTY, np.uint16)

        def put(owner, h):
            v = (h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(42)
            cell = owner * BUCKETS + (v >> np.uint64(16)).astype(np.int64)
            np.minimum.at(out, cell, np.minimum(v & np.uint64(0xFFFF), np.uint64(EMPTY - 1)).astype(np.uint16))

        h = self.prefixes.arrays[0]
        if self.prefixes.size >= SPAN:
            owner = np.repeat(np.arange(len(self.sizes)), self.sizes)
            for at in range(0, len(owner) - SPAN + 1, _BLOCK):  # blocks stay in the processor's cache
                stop = min(at + _BLOCK, len(owner) - SPAN + 1)
                inside = owner[at:stop] == owner[at + SPAN - 1 : stop + SPAN - 1]
                spans = _difference(h[at + SPAN : stop + SPAN], _product(h[at:stop], _POWERS[0][SPAN]))
                put(owner[at:stop][inside], spans[inside])
        short = np.flatnonzero((self.sizes > 0) & (self.sizes < SPAN))
        put(short, self.whole[short] >> np.uint64(31))
        return out.reshape(-1, BUCKETS)

    def same_start(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Code points on which texts one[k] and two[k] agree from their start: binary searches for longest common extensions."""
        low, high = np.zeros(len(one), np.int64), np.minimum(self.sizes[one], self.sizes[two])
        a, b = self.starts[one], self.starts[two]
        while (open_ := low < high).any():
            middle = (low + high + 1) // 2
            same = self.prefixes.span(a, a + middle) == self.prefixes.span(b, b + middle)
            low, high = np.where(open_ & same, middle, low), np.where(open_ & ~same, middle - 1, high)
        return low

    def text(self, i: int) -> str:
        """Hexadecimal: length, whole hash, sketch, ladder."""
        return f"{int(self.sizes[i]):08x}{int(self.whole[i]):016x}{self.sketch[i].astype('>u2').tobytes().hex()}{self.ladder[i].astype('>u2').tobytes().hex()}"

    def parts(self, i: int):
        return int(self.sizes[i]), int(self.whole[i]), self.sketch[i], self.ladder[i]


def _agreed(a: np.ndarray, b: np.ndarray) -> int:
    """Rungs on which two ladders agree from the start, by binary search."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[middle - 1] == b[middle - 1]:
            low = middle
        else:
            high = middle - 1
    return low


def _like(one, two) -> float:
    """Likeness of two fingerprints in parts: 1 if the texts are equal, else the larger of shared spans and shared start."""
    (n, whole, sketch, ladder), (m, other, sketch2, ladder2) = one, two
    if (n, whole) == (m, other):
        return 1.0
    used = ((sketch != EMPTY) | (sketch2 != EMPTY)).sum()
    spans = ((sketch == sketch2) & (sketch != EMPTY)).sum() / used if used else 0.0
    agreed = _agreed(ladder, ladder2)
    start = rungs(max(n, m))[agreed - 1] / max(n, m) if agreed else 0.0
    return float(max(spans, start))


def likeness(one: str, two: str) -> float:
    """Likeness of two fingerprints as text, 0 to 1."""

    def parts(text):
        values = np.frombuffer(bytes.fromhex(text[24:]), ">u2").astype(np.uint16)
        return int(text[:8], 16), int(text[8:24], 16), values[:BUCKETS], values[BUCKETS:]

    return _like(parts(one), parts(two))


def edited(text: str, following: str) -> str:
    """``text`` with its last third replaced by as many first code points of ``following`` (or all)."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, same_start_edited long, same_start_next long"


def _answers(rows: list[tuple], following: str) -> pa.RecordBatch:
    """Result rows of (doc_id, text, copies) in order; ``following`` is the text after the last one."""
    texts = [t for _, t, _ in rows]
    after = [*texts[1:], following]
    changed = [edited(t, f) for t, f in zip(texts, after)]
    made = Prints([code_points(t) for t in [*texts, following, *changed]])
    n = len(rows)
    columns: list[list] = [[] for _ in range(9)]
    own = np.arange(n)
    same_edited, same_next = made.same_start(own, own + n + 1).tolist(), made.same_start(own, own + 1).tolist()
    for i, (doc_id, text, copies) in enumerate(rows):
        j = n + 1 + i
        starts = (same_edited[i], same_next[i])
        row = (doc_id, len(text), hashlib.sha256(changed[i].encode()).hexdigest(), made.text(i), made.text(j), _like(made.parts(i), made.parts(j)), _like(made.parts(i), made.parts(i + 1)), *starts)
        for column, value in zip(columns, row):
            column += [value] * copies
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[f.split()[0] for f in RESULT.split(", ")])


def _streamed(batches):
    """Sorted rows (block, guest, doc_id, hash, copies, text) of whole blocks to result rows."""
    held: list[tuple] = []  # (doc_id, text, copies) of one block that wait for what follows
    last = None  # (block, doc_id, hash) of the last held row
    points = 0
    for batch in pieces(batches):
        for block, guest, doc_id, key, copies, text in zip(*(batch.column(i).to_pylist() for i in range(6))):
            if guest:
                if held:
                    yield _answers(held, text)
                held, last, points = [], None, 0
                continue
            if last == (block, doc_id, key):
                held[-1] = (*held[-1][:2], held[-1][2] + copies)
                continue
            if points > BATCH_POINTS:
                yield _answers(held, text)
                held, points = [], 0
            held.append((doc_id, text, copies))
            last = (block, doc_id, key)
            points += len(text)


def _splits(keys: DataFrame) -> list[tuple]:
    """First documents (doc_id, hash) of the blocks, in order: descending ids, null last, then ascending hash."""
    n, size = keys.agg(F.count("*"), F.sum("size")).first()
    if not n:
        return []
    blocks = int(min(MOST_BLOCKS, size // BLOCK_BYTES + 1))
    place = F.struct(F.col("doc_id").isNull().alias("none"), F.bitwise_not("doc_id").alias("less"), F.col("hash").alias("hash"))
    first = keys.agg(F.min(place).alias("p")).first().p
    # A uniform sample of distinct documents: the smallest hash of each of a fixed number of classes.
    drawn = F.xxhash64("doc_id", "hash", F.lit(1))
    sample = keys.groupBy(F.pmod(drawn, F.lit(blocks * SAMPLES)).alias("class")).agg(F.min(F.struct(drawn.alias("drawn"), place.alias("p")))["p"].alias("p"))
    start = (first.none, first.less or 0, first.hash)
    if blocks == 1:
        return [start]
    rows = sorted((r.p.none, r.p.less or 0, r.p.hash) for r in sample.collect())
    return sorted({start, *(rows[len(rows) * k // blocks] for k in range(1, blocks))})


def _dealt(splits: list[tuple]):
    """Rows to their blocks, copies inside a batch as one row; the first document of a block goes to the block before it too."""
    table = np.array([(s[0], s[1], s[2]) for s in splits], [("none", "?"), ("less", "i8"), ("hash", "i8")])
    guests = {tuple(s): (k - 1) % len(splits) for k, s in enumerate(splits)}

    def run(batches):
        for batch in batches:
            ids, keys, sizes = batch.column(0), np.asarray(batch.column(1)), batch.num_rows
            rows = np.zeros(sizes, table.dtype)
            rows["none"] = np.asarray(ids.is_null())
            rows["less"] = np.where(rows["none"], 0, ~np.asarray(ids.fill_null(0)))
            rows["hash"] = keys
            _, first, copies = np.unique(rows, return_index=True, return_counts=True)
            mine = rows[first]
            block = np.searchsorted(table, mine, side="right") - 1
            more = [(k, guests[tuple(r)]) for k, r in enumerate(mine.tolist()) if tuple(r) in guests]
            take = np.concatenate([first, first[[k for k, _ in more]]]).astype(np.int64) if more else first
            kept = batch.take(pa.array(take))
            out = np.concatenate([block, [b for _, b in more]]).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(out), pa.array(np.concatenate([np.zeros(len(first), bool), np.ones(len(more), bool)])), kept.column(0), kept.column(1),
                    pa.array(np.concatenate([copies, np.ones(len(more), np.int64)]).astype(np.int64)), kept.column(2),
                ],
                names=["block", "guest", "doc_id", "hash", "copies", "text"],
            )

    return run


def fingerprints(docs: DataFrame) -> DataFrame:
    """A row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next,
    same_start_edited and same_start_next (code points that text and edited or next text share from their start).

    The next document is that of the next smaller doc_id; the first follows the last.
    Documents of equal or null doc_id (null comes last) go by the hash of their text.
    Rows that repeat doc_id and text are one document and get the same answer.  A null
    text counts as empty; two empty texts are alike (1).  A single document follows
    itself.  Other columns are ignored, an empty table gives no rows.  A text and its
    two neighbours must fit a task's memory.
    """
    text = filled(F.col("text"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("hash"), text.alias("text"))
    splits = _splits(rows.select("doc_id", "hash", F.octet_length("text").alias("size")))
    if not splits:
        return docs.sparkSession.createDataFrame([], RESULT)
    dealt = rows.mapInArrow(_dealt(splits), "block long, guest boolean, doc_id long, hash long, copies long, text string")
    # Copies of the first document of a block arrive from several batches: one guest is enough, more change nothing.
    order = ["block", "guest", F.col("doc_id").desc_nulls_last(), "hash"]
    return dealt.repartition(len(splits), "block").sortWithinPartitions(*order).mapInArrow(_streamed, RESULT)

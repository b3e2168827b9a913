"""Spelling variants by dense prefix-suffix tiling.

Two words are near when one inserted, deleted or replaced code point makes one the
other; that is so exactly when their common prefix and common suffix together reach
the length of the longer one minus one.  Words are rows of two padded code-point
matrices, one flush left and one flush right; comparing rows gives both lengths.

Which blocks meet: a word of length L is cut into SEGMENTS segments.  The one edit
lies in one of them, so the two words agree before that segment and after it, and
share the key (L, segment, what is before, what is after) - as the shorter word
with L, as the longer one with L - 1.  The words of a key are dealt to blocks of
about TILE words; every pair of blocks is a tile of its own, so a common key is many
bounded tasks.  A pair counts in the one segment in which its common prefix ends,
hence once.  A tile gives one row per word that has near words: no pairs leave it.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetloom.llm.store import Stored
from sheetloom.llm.text import pieces

LEAST_LENGTH, LEAST_COUNT = 5, 3
#: Every word that this divides the checksum of loses a code point (planted slips of the query).
SLIP = 97
SEGMENTS = 4
TILE = 512
#: Distinct words that a task counts before it hands them on.
FLUSH = 200_000
#: Matrix cells of one dense comparison.
CELLS = 1 << 22

# Letters A-Z a-z and U+00C0 to U+00FF as Latin-1 bytes, A-Z in lower case, all else a space.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))


def runs(text: str | None) -> list[bytes]:
    """Maximal runs of letters, one Latin-1 byte per code point."""
    return text.encode("latin-1", "replace").translate(_LETTERS).split() if text else []


def slipped(run: bytes, start: int, every: int) -> bytes:
    """The run without one code point where ``every`` divides its checksum, which goes on from that of ``<doc_id>:``."""
    check = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
    if check % every:
        return run
    at = check % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, slip: int | None = SLIP) -> DataFrame:
    """(word, n) of all words of ``docs`` that are long and frequent enough."""

    def run(batches):
        def rows(counts):
            kept = {w: n for w, n in counts.items() if len(w) >= least_length}
            return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in kept], pa.string()), pa.array(list(kept.values()), pa.int64())], names=["word", "n"])

        total: Counter = Counter()
        for batch in pieces(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = Counter(runs(text))
                if slip:
                    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                    for word, n in found.items():
                        total[slipped(word, start, slip)] += n
                else:
                    total.update(found)
                if len(total) > FLUSH:
                    yield rows(total)
                    total.clear()
        yield rows(total)

    counted = docs.select("doc_id", "text").mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _keyed(words: DataFrame, segments: int) -> DataFrame:
    """Every word under all its keys: base (the shorter length), segment, longer (its role) and the key."""
    length = F.char_length("word")
    roles = words.withColumn("longer", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("base", length - F.col("longer"))
    cut = roles.withColumn("segment", F.explode(F.sequence(F.lit(0), F.lit(segments - 1))))
    lo = F.floor(F.col("base") * F.col("segment") / segments).cast("int")
    hi = F.floor(F.col("base") * (F.col("segment") + 1) / segments).cast("int")
    cut = cut.withColumns({"lo": lo, "hi": hi})
    before, after = F.expr("substring(word, 1, lo)"), F.expr("right(word, base - hi)")
    return cut.withColumn("key", F.xxhash64("base", "segment", before, after))


def tiles(words: DataFrame, segments: int = SEGMENTS, tile: int = TILE) -> Stored:
    """(base, key, one, two, block, segment, longer, word, n): the words of every tile (key, one, two)."""
    keyed = _keyed(words, segments).select("base", "key", "segment", "lo", "hi", "longer", "word", "n")
    sizes = Stored(keyed.groupBy("key").agg(F.count("*").alias("m"), F.min("longer").alias("shortest")).where("m > 1 AND shortest = 0").select("key", "m"), "keys")
    blocks = F.floor((F.col("m") - 1) / tile).cast("int") + 1
    members = keyed.join(sizes.df.hint("merge"), "key").withColumn("blocks", blocks)
    members = members.withColumn("block", F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int"))
    spread = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    found = Stored(spread.select("base", "key", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "block", "lo", "hi", "longer", "word", "n"), "tiles")
    sizes.drop()
    return found


def _matrices(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points flush left and flush right, padded with zero, and the lengths."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    width = int(sizes.max())
    flat = np.frombuffer(b"".join(words), np.uint8)
    row = np.repeat(np.arange(len(words)), sizes)
    column = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    left, right = np.zeros((len(words), width), np.uint8), np.zeros((len(words), width), np.uint8)
    left[row, column] = flat
    right[row, width - 1 - (sizes[row] - 1 - column)] = flat
    return left, right[:, ::-1].copy(), sizes


def _run_length(a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Equal leading columns of paired rows."""
    differs = a != b
    first = differs.argmax(1)
    return np.minimum(np.where(differs[np.arange(len(a)), first], first, a.shape[1]), most)


def near_pairs(words: list[bytes], tile: np.ndarray, block: np.ndarray, same: np.ndarray, longer: np.ndarray, lo: np.ndarray, hi: np.ndarray):
    """Index pairs of near words; rows lie tile after tile, ``same`` marks tiles of a block with itself.

    Row i is compared with row i + d of its tile for every d: each step is one dense
    comparison of all tiles at once.
    """
    left, right, sizes = _matrices(words)
    ends = np.append(np.flatnonzero(np.diff(tile)) + 1, len(tile))
    end = np.repeat(ends, np.diff(np.concatenate([[0], ends])))
    rows = np.arange(len(tile))
    ones, twos = [], []
    shift = 1
    while len(rows := rows[rows + shift < end[rows]]):
        i, j = rows, rows + shift
        # Both as the longer word is the business of another key; blocks of a mixed tile meet across only.
        fits = ((longer[i] & longer[j]) == 0) & (same[i] | (block[i] != block[j]))
        i, j = i[fits], j[fits]
        step = max(1, CELLS // left.shape[1])
        for at in range(0, len(i), step):
            a, b = i[at : at + step], j[at : at + step]
            short, long = np.minimum(sizes[a], sizes[b]), np.maximum(sizes[a], sizes[b])
            prefix = _run_length(left[a], left[b], short)
            suffix = _run_length(right[a], right[b], short)
            # The segment in which the prefix ends; the last one if the shorter word is a prefix of the longer.
            inside = (prefix >= lo[a]) & ((prefix < hi[a]) | ((hi[a] == short) & (prefix == short)))
            near = (prefix + suffix >= long - 1) & inside & ((prefix < short) | (long > short))
            ones.append(a[near])
            twos.append(b[near])
        shift += 1
    none = np.empty(0, np.int64)
    return np.concatenate([none, *ones]), np.concatenate([none, *twos])


#: Rows of tiles compared together.
STACK = 1 << 14


def _compare(batches):
    """One row per word with near words in a stack of tiles: their number and the best of them."""

    def rows(table: pa.Table) -> pa.RecordBatch:
        text = table["word"].to_pylist()
        at = lambda name: table[name].to_numpy()
        one, two = at("one"), at("two")
        key = at("key")
        change = np.concatenate([[True], (key[1:] != key[:-1]) | (one[1:] != one[:-1]) | (two[1:] != two[:-1])])
        a, b = near_pairs([w.encode("latin-1") for w in text], np.cumsum(change), at("block"), one == two, at("longer"), at("lo"), at("hi"))
        n = at("n")
        me, other = np.concatenate([a, b]), np.concatenate([b, a])
        best: dict[str, tuple[int, str]] = {}
        count: Counter = Counter()
        for i, j in zip(me.tolist(), other.tolist()):
            word, rank = text[i], (-int(n[j]), text[j])
            count[word] += 1
            if word not in best or rank < best[word]:
                best[word] = rank
        keep = list(best)
        return pa.RecordBatch.from_arrays(
            [pa.array(keep, pa.string()), pa.array([count[w] for w in keep], pa.int64()), pa.array([-best[w][0] for w in keep], pa.int64()), pa.array([best[w][1] for w in keep], pa.string())],
            names=["word", "n_near", "form_n", "form"],
        )

    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size < STACK:
            continue
        table = pa.Table.from_batches(held)
        tail = [table[name][size - 1].as_py() for name in ("key", "one", "two")]
        last = np.logical_and.reduce([table[name].to_numpy() == v for name, v in zip(("key", "one", "two"), tail)])
        done = int(np.argmax(last))  # the last tile may go on in the next batch
        if done:
            yield rows(table.slice(0, done))
        held = table.slice(done).combine_chunks().to_batches()
        size -= done
    if size:
        yield rows(pa.Table.from_batches(held))


def variants(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, slip: int | None = SLIP, tile: int = TILE) -> DataFrame:
    """(word, form, root, n, n_near, form_n), a row per frequent word of all texts.

    Near words differ by one inserted, deleted or replaced code point.  ``form`` is
    the near word of largest n (ties: smallest in code-point order) if it is at least
    twice as frequent, else null; ``root`` follows forms to their end.  Words are runs
    of Latin letters, A-Z in lower case.  ``slip`` removes a code point of the runs
    whose checksum with the doc_id it divides (None: of none); a null doc_id counts as
    an empty one.  Null and empty texts have no words, repeated rows count each, other
    columns are ignored, an empty table gives no rows.
    """
    words = Stored(word_counts(docs, least_length, least_count, slip), "words")
    found = tiles(words.df, tile=tile)
    dealt = found.df.repartition("key", "one", "two").sortWithinPartitions("base", "key", "one", "two")
    partial = dealt.mapInArrow(_compare, "word string, n_near long, form_n long, form string")
    best = F.min(F.struct((-F.col("form_n")).alias("less"), "form"))
    near = partial.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best"))
    every = words.df.join(near.hint("merge"), "word", "left").withColumn("form_n", -F.col("best.less"))
    rise = F.col("form_n") >= 2 * F.col("n")
    forms = Stored(
        every.select("word", F.when(rise, F.col("best.form")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(rise, F.col("form_n")).alias("form_n")),
        "forms",
    )
    found.drop()
    words.drop()
    # Counts at least double from form to form, so a few rounds of pointer doubling reach every end.
    linked = Stored(forms.df.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = linked.df.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = Stored(linked.df.join(ahead.hint("merge"), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        linked.drop()
        linked = moved
        if linked.df.where("moved").isEmpty():
            break
    return forms.df.join(linked.df.select("word", "root").hint("merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

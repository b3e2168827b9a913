"""Near duplicates by exact similarity of five-word shingles, by ball hashing and prefix filtering.

A text is the set of its five-word shingles; equal sets are one vertex.  Ball hashing
comes first: fingerprints of three-word shingles that differ in three bits or fewer are linked by
``simhash.links``, and the sets behind a link are a candidate pair.  At similarity 0.8
two fingerprints differ in about ten bits, too many for its radius, so a prefix filter
finds the pairs that are left.  With all shingles in one fixed order, two sets of similarity 0.8 or more share a shingle among
the first fifth (plus one) of each, whatever the order is.  The order puts shingles
that many documents hold last, so that a shared template or passage brings no
documents together unless it makes up four fifths of them.  Which shingles those are
is read off a part of the documents: the order decides the work, never the result.

Vertices that share a prefix shingle form its group.
- Small groups (at most SMALL members) give pairs.  A similar pair shares not one but
  at least a known number of prefix shingles, so pairs are counted first.
- In a large group all members are held against one centre, the one whose prefix
  reaches the shared shingle first.  Where that does not make the group one component, the
  members outside the largest component meet the others block by block in tiles,
  which compare prefixes densely and give only the pairs with enough in common.
  A pair is given once, by the first open group that holds both, and only if the parity
  bitmaps of the whole sets leave it possible (bits that differ stand for shingles that do).
All pairs that are left are checked on their whole sets, so no link is lost and
none is made below 0.8.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetloom.llm.bloom import Filter
from sheetloom.llm.components import components
from sheetloom.llm.simhash import keyed, links, majority
from sheetloom.llm.store import Stored, collect_shuffles
from sheetloom.llm.text import filled, pieces, set_apart

SHINGLE = 5
#: Words of a shingle of a fingerprint, as in ``simhash``: a changed word changes fewer of them.
PRINT_SHINGLE = 3
#: Similarity of a link, as a fraction.
LEAST = (4, 5)
#: Members of a group that gives pairs at once, and members of a block of a larger one.
SMALL, TILE = 8, 256
#: Shingles that a tile compares at a time.
CHUNK = 2048
#: One document in PART tells which shingles are frequent: those it shows in OFTEN documents.
PART, OFTEN = 4, 3
FILTER_BITS = 1 << 26
#: Words whose hash a Python worker keeps.
CACHE_WORDS = 1 << 16
SEED = 42


class _Hashes(dict):
    """Hash of a word; filled as words come."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word, SEED)
        return h


_HASHES = _Hashes()


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of all word shingles; a text of fewer words is one shingle, one without words none."""
    words = text.encode().lower().split() if text else []  # bytes: A-Z and ASCII space only
    if not words:
        return np.empty(0, np.uint64)
    one = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    size = min(size, len(words))
    h = one[: len(words) - size + 1]
    for k in range(1, size):
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + one[k : len(words) - size + 1 + k]
    return np.unique((h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9))


def prefix_size(n: int) -> int:
    """Shingles of a set of n of which a similar set holds at least one."""
    return n - -(-n * LEAST[0] // LEAST[1]) + 1 if n else 0


def prefix(hashes: np.ndarray, frequent: Filter) -> np.ndarray:
    """The first shingles of a set: infrequent ones first, by hash."""
    return hashes[np.argsort(frequent.has(hashes), kind="stable")[: prefix_size(len(hashes))]] if len(hashes) else hashes


def parity(hashes: np.ndarray) -> np.ndarray:
    """Bitmap (uint64) of the set, two bits or more for each hash: a bit is set where an odd number of hashes fall.

    Where two bitmaps of one size differ, the sets differ: the number of such bits is at
    most the number of hashes in one set only.
    """
    bits = 64
    while bits < 2 * len(hashes):
        bits *= 2
    odd = np.bincount((hashes >> np.uint64(32)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<u8")


def least_differing(one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Hashes in one of two sets only, at least, by their bitmaps; the larger bitmap is folded to the size of the other."""
    found = np.zeros(len(others), np.int64)
    sizes = np.array([len(x) for x in others], np.int64)
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        least = min(size, len(one))
        fold = lambda x: np.bitwise_xor.reduce(x.reshape(len(x), -1, least), axis=1)  # noqa: B023, E731
        found[at] = np.bitwise_count(fold(np.stack([others[k] for k in at])) ^ fold(one[None])).sum(1)
    return found


def _columns(docs: DataFrame, schema: str, columns) -> DataFrame:
    """mapInArrow over (__id, __key, text); ``columns`` makes the values of the further columns from one text."""
    made = docs.sparkSession.createDataFrame([], schema).schema

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        names = to_arrow_schema(made)
        for batch in pieces(batches):
            rows = [columns(t) for t in batch.column(2).to_pylist()]
            values = [pa.array([r[k] for r in rows], names.field(k + 2).type) for k in range(len(names) - 2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *values], names=names.names)

    return docs.select("__id", "__key", "text").mapInArrow(run, made)


def _set(text):
    return (shingles(text).view(np.int64),)


def _enough(shared, a, b):
    return shared * LEAST[1] >= (a + b - shared) * LEAST[0]


def _shared_at_least(a, b):
    """Shingles that similar sets of sizes a and b have in common at least."""
    return F.ceil((a + b) * F.lit(LEAST[0]) / F.lit(sum(LEAST)))


def frequent_shingles(texts: DataFrame) -> Filter:
    """Shingles that many documents hold, by the documents of a PART-th of all text hashes."""

    def run(batches):
        held, size = [], 0
        for batch in pieces(batches):
            for text in batch.column(0).to_pylist():
                held.append(shingles(text))
                size += len(held[-1])
                if size > 1 << 20:
                    yield _counted(held)
                    held, size = [], 0
        yield _counted(held)

    some = texts.where(F.pmod("__key", F.lit(PART)) == 0).select("text")
    counts = some.mapInArrow(run, "hash long, c long").groupBy("hash").agg(F.sum("c").alias("c")).where(F.col("c") >= OFTEN)
    found = Filter(FILTER_BITS)
    found.add(counts.select("hash"))
    return found


def _counted(sets: list[np.ndarray]) -> pa.RecordBatch:
    values, counts = np.unique(np.concatenate([*sets, np.empty(0, np.uint64)]), return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(counts.astype(np.int64))], names=["hash", "c"])


def vertices(texts: DataFrame) -> Stored:
    """(digest, __id, __key, n, print, prefix, parity) of every distinct set, with its first document."""
    sent = texts.sparkSession.sparkContext.broadcast(frequent_shingles(texts))  # FILTER_BITS

    def sketch(text):
        hashes = shingles(text)
        return xxhash.xxh64_intdigest(hashes.tobytes(), SEED) - (1 << 63), len(hashes), majority(shingles(text, PRINT_SHINGLE)) - (1 << 63), prefix(hashes, sent.value).view(np.int64), parity(hashes).tobytes()

    sketches = _columns(texts, "__id long, __key long, digest long, n int, print long, prefix array<long>, parity binary", sketch)
    least = sketches.groupBy("digest").agg(F.min(F.struct("__id", "__key", "n", "print", "prefix", "parity")).alias("least"))
    return Stored(least.select("digest", "least.*"), "vertices")


def _checked(pairs: DataFrame, vertices: DataFrame, texts: DataFrame) -> Stored:
    """The pairs (a, b) of vertices that are similar enough, from their whole sets."""
    wanted = Stored(pairs.distinct(), "pairs")
    ends = wanted.df.select(F.col("a").alias("digest")).union(wanted.df.select("b")).distinct()
    places = Stored(vertices.join(ends, "digest").select("digest", "__id", "__key"), "ends")
    # Repeated rows of a document are one text.
    found = texts.join(places.df.select("__id", "__key").hint("merge"), ["__id", "__key"], "left_semi").dropDuplicates(["__id", "__key"])
    sets = _columns(found, "__id long, __key long, hashes array<long>", _set).join(places.df.hint("merge"), ["__id", "__key"])
    held = Stored(sets.select("digest", "hashes"), "sets")
    one = held.df.select(F.col("digest").alias("b"), F.col("hashes").alias("of_b"))
    two = held.df.select(F.col("digest").alias("a"), F.col("hashes").alias("of_a"))
    both = wanted.df.join(one.hint("merge"), "b").join(two.hint("merge"), "a")
    shared = F.size(F.array_intersect("of_a", "of_b"))
    found = Stored(both.where(_enough(shared, F.size("of_a"), F.size("of_b"))).select("a", "b"), "links")
    for done in (wanted, places, held):
        done.drop()
    return found


def _fits(a, b):
    """Sets of too different sizes cannot be similar."""
    return _enough(F.least(a, b), a, b)


def near_pairs(vertices: DataFrame) -> Stored:
    """Pairs (a, b) of vertices by ball hashing of their fingerprints.

    Vertices of one fingerprint are held against the first of them, linked fingerprints
    by their first ones, so that no group gives all its pairs.
    """
    sets = vertices.select("print", "digest", "n")
    first = Stored(sets.groupBy("print").agg(F.min(F.struct("digest", "n")).alias("first")), "prints")
    # Flipping the sign bit of every fingerprint, as ``vertices`` does, keeps their distances.
    found = Stored(links(first.df.select(F.col("print").alias("fingerprint"))).distinct(), "near prints")
    of = lambda name: first.df.select(F.col("print").alias(name), F.col("first").alias(f"{name}_first"))
    same = sets.join(of("print").hint("merge"), "print").select(F.struct("digest", "n").alias("x"), F.col("print_first").alias("y"))
    near = found.df.join(of("a").hint("merge"), "a").join(of("b").hint("merge"), "b").select(F.col("a_first").alias("x"), F.col("b_first").alias("y"))
    both = same.union(near).where((F.col("x.digest") != F.col("y.digest")) & _fits(F.col("x.n"), F.col("y.n")))
    pairs = Stored(both.select(F.least("x.digest", "y.digest").alias("a"), F.greatest("x.digest", "y.digest").alias("b")), "near")
    first.drop()
    found.drop()
    collect_shuffles(vertices.sparkSession)
    return pairs


def _small_pairs(rows: DataFrame) -> DataFrame:
    """Pairs (a, b) of small groups that share enough prefix shingles.

    Of the prefixes of two similar sets at least ``least`` shingles are common; those
    in large groups are not counted here, so as many may be missing.
    """
    groups = rows.where(F.col("m") <= SMALL).groupBy("hash").agg(F.array_sort(F.collect_list(F.struct("digest", "n", "large"))).alias("members"))
    # At most SMALL members, so at most SMALL - 1 pairs for each.
    pairs = groups.select("members", F.explode(F.expr("sequence(1, size(members) - 1)")).alias("i")).select(
        F.get("members", F.col("i")).alias("y"), F.explode(F.slice("members", F.lit(1), F.col("i"))).alias("x")
    )
    pairs = pairs.where(_fits(F.col("x.n"), F.col("y.n"))).groupBy(F.col("x.digest").alias("a"), F.col("y.digest").alias("b"), "x.n", F.col("y.n").alias("n_b"), "x.large", F.col("y.large").alias("large_b"))
    counted = pairs.agg(F.count("*").alias("c"))
    shared = _shared_at_least(F.col("n"), F.col("n_b"))
    size = lambda n: n - F.ceil(n * LEAST[0] / LEAST[1]) + 1
    least = F.least(size(F.col("n")) - (F.col("n") - shared), size(F.col("n_b")) - (F.col("n_b") - shared))
    return counted.where(F.col("c") >= least - F.least("large", "large_b")).select("a", "b")


def _common(values: np.ndarray, owner: np.ndarray, probe: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Number of common values of each row in ``left`` and each in ``right``; ``owner`` tells the row of a value, ``probe`` the side of a row.

    Values of one side only are left out, the others are columns of two 0/1 matrices, whose product counts them, CHUNK columns at a time.
    """
    place = np.empty(len(probe), np.int64)
    place[left], place[right] = np.arange(len(left)), np.arange(len(right))
    distinct, column = np.unique(values, return_inverse=True)
    in_left = probe[owner]
    both = (np.bincount(column[in_left], minlength=len(distinct)) > 0) & (np.bincount(column[~in_left], minlength=len(distinct)) > 0)
    number = np.cumsum(both) - 1
    kept = both[column]
    column, row, in_left = number[column[kept]], place[owner[kept]], in_left[kept]
    order = np.argsort(column, kind="stable")
    column, row, in_left = column[order], row[order], in_left[order]
    shared = np.zeros((len(left), len(right)), np.float32)  # whole numbers below 2^24
    for at in range(0, int(both.sum()), CHUNK):
        lo, hi = np.searchsorted(column, [at, at + CHUNK])
        ones, twos = np.zeros((len(left), CHUNK), np.float32), np.zeros((len(right), CHUNK), np.float32)
        part = in_left[lo:hi]
        ones[row[lo:hi][part], column[lo:hi][part] - at] = 1
        twos[row[lo:hi][~part], column[lo:hi][~part] - at] = 1
        shared += ones @ twos.T
    return shared


def _tiles(open_: DataFrame, sketches: DataFrame) -> DataFrame:
    """Pairs (a, b) of large groups, of different components, with enough prefix shingles in common and bitmaps that are near enough.

    ``open_`` has (hash, digest, n, root, stray) of the members of groups with strays, ``sketches`` (digest, prefix, parity).
    Every block with strays meets every block of its group in a tile of its own.  A pair
    comes from the group of the smallest open hash that both have, and from one of its two tiles.
    """
    sizes = Stored(open_.groupBy("hash").agg((F.floor((F.count("*") - 1) / TILE) + 1).cast("int").alias("blocks"), (F.floor((F.count_if("stray") - 1) / TILE) + 1).cast("int").alias("stray_blocks")), "sizes")
    rows = open_.join(sizes.df.hint("merge"), "hash")
    block = F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int")
    stray_block = F.pmod(F.xxhash64("digest"), F.col("stray_blocks")).cast("int")
    columns = lambda one, two: ["hash", one.alias("one"), two.alias("two"), "digest", "n", "root", "stray"]
    probes = rows.where("stray").withColumn("at", stray_block).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).select(*columns(F.col("at"), F.col("other")), F.lit(True).alias("probe"))
    members = rows.withColumn("at", block).withColumn("other", F.explode(F.expr("sequence(0, stray_blocks - 1)"))).select(*columns(F.col("other"), F.col("at")), F.lit(False).alias("probe"))
    hashes = open_.groupBy("digest").agg(F.collect_set("hash").alias("hashes"))
    ends = Stored(sketches.join(hashes.hint("merge"), "digest"), "open sets")
    placed = Stored(probes.unionByName(members).join(ends.df.hint("merge"), "digest"), "tiles")
    sizes.drop()
    ends.drop()

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        hash_ = key[0].as_py()
        stray = table["stray"].to_numpy(zero_copy_only=False)
        bitmaps = [np.frombuffer(x, "<u8") for x in table["parity"].to_pylist()]
        probe = table["probe"].to_numpy(zero_copy_only=False)
        digest, n, root = (table[c].to_numpy() for c in ("digest", "n", "root"))
        lists = table["prefix"].combine_chunks()
        values, owner = lists.flatten().to_numpy(), np.repeat(np.arange(len(n)), np.asarray(lists.value_lengths()).astype(np.int64))
        left, right = np.flatnonzero(probe), np.flatnonzero(~probe)
        shared = _common(values, owner, probe, left, right)
        lists = table["hashes"].combine_chunks()
        values, owner = lists.flatten().to_numpy(), np.repeat(np.arange(len(n)), np.asarray(lists.value_lengths()).astype(np.int64))
        earlier = _common(values[values < hash_], owner[values < hash_], probe, left, right)
        out_a, out_b = [], []
        for i, common_prefix, met_before in zip(left, shared, earlier):
            a, b = n[i].astype(np.int64), n[right].astype(np.int64)
            common = -(-(a + b) * LEAST[0] // sum(LEAST))
            size = lambda x: x - -(-x * LEAST[0] // LEAST[1]) + 1
            least = np.maximum(np.minimum(size(a) - (a - common), size(b) - (b - common)), 1)
            fits = np.minimum(a, b) * LEAST[1] >= np.maximum(a, b) * LEAST[0]
            good = fits & (common_prefix >= least) & (root[i] != root[right]) & (met_before == 0) & (~stray[right] | (digest[i] < digest[right]))
            at = np.flatnonzero(good)
            # Of a + b shingles ``apart`` at least are in one set only, half of the others are common.
            apart = least_differing(bitmaps[i], [bitmaps[k] for k in right[at]])
            good[at] = (a + b[at] - apart) * sum(LEAST) >= (a + b[at]) * 2 * LEAST[0]
            out_a.append(np.minimum(digest[i], digest[right[good]]))
            out_b.append(np.maximum(digest[i], digest[right[good]]))
        none = np.empty(0, np.int64)
        return pa.table({"a": np.concatenate([none, *out_a]), "b": np.concatenate([none, *out_b])})

    return placed.df.groupBy("hash", "one", "two").applyInArrow(compare, "a long, b long")


def similar(docs: DataFrame) -> tuple[Stored, Stored]:
    """Vertices (digest, __id, __key of the first document with that set, n, print, prefix) and links (a, b) that connect them."""
    texts = keyed(docs.select("doc_id", "text")).select("__id", "__key", filled(F.col("text")).alias("text"))
    every = vertices(texts)
    near = near_pairs(every.df)
    rows = every.df.select("digest", "n", F.posexplode("prefix").alias("pos", "hash"))
    groups = Stored(rows.groupBy("hash").agg(F.count("*").alias("m"), F.min(F.struct(F.col("pos") / F.col("n"), "digest", "n")).alias("centre")).where("m > 1"), "groups")
    shared = Stored(rows.join(groups.df.hint("merge"), "hash").select("hash", "digest", "n", "m", F.col("centre.digest").alias("centre"), F.col("centre.n").alias("n_centre")), "shared")
    large = shared.df.groupBy("digest").agg(F.count_if(F.col("m") > SMALL).alias("large"))
    small = _small_pairs(shared.df.join(large.hint("merge"), "digest"))
    members = shared.df.where(F.col("m") > SMALL)
    stars = members.where((F.col("digest") != F.col("centre")) & _fits(F.col("n"), F.col("n_centre"))).select(F.least("centre", "digest").alias("a"), F.greatest("centre", "digest").alias("b"))
    first = _checked(small.union(stars).union(near.df), every.df, texts)
    labels = components(first.df)
    placed = Stored(members.join(labels.withColumnRenamed("vertex", "digest").hint("merge"), "digest", "left").select("hash", "digest", "n", F.coalesce("root", "digest").alias("root")), "placed")
    roots = placed.df.groupBy("hash", "root").agg(F.count("*").alias("size"))
    largest = Stored(roots.groupBy("hash").agg(F.max(F.struct("size", "root"))["root"].alias("largest"), F.count("*").alias("roots")).where("roots > 1").select("hash", "largest"), "largest")
    open_ = Stored(placed.df.join(largest.df.hint("merge"), "hash").select("hash", "digest", "n", "root", (F.col("root") != F.col("largest")).alias("stray")), "open")
    connecting = first
    if not open_.df.isEmpty():
        second = _checked(_tiles(open_.df, every.df.select("digest", "prefix", "parity")), every.df, texts)
        connecting = Stored(first.df.union(second.df), "links")
        first.drop()
        second.drop()
    for done in (near, groups, shared, placed, largest, open_):
        done.drop()
    return every, connecting


def without_similar(docs: DataFrame) -> DataFrame:
    """One document of each component of similar texts, the one with the smallest doc_id (null last), with all its columns.

    Rows that repeat doc_id and text are one document.  Texts without words are one set.
    Columns of any name stay as they are; an empty table gives no rows.
    """
    found, connecting = similar(docs)
    labels = components(connecting.df)
    rooted = found.df.join(labels.withColumnRenamed("vertex", "digest"), "digest", "left").select(F.coalesce("root", "digest").alias("root"), "__id", "__key")
    kept = Stored(rooted.groupBy("root").agg(F.min(F.struct("__id", "__key")).alias("first")).select("first.*"), "kept")
    found.drop()
    connecting.drop()
    apart, back = set_apart(docs, "doc_id", "text")
    rows = keyed(apart).join(kept.df.hint("merge"), ["__id", "__key"], "left_semi").dropDuplicates(["__id", "__key"])
    return back(rows)

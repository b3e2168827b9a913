"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints at three or fewer differing bits have a variant in common that
is one flip from one and at most two flips from the other.  Every fingerprint
emits all variants within half the radius (one flip); so that the odd radius
meets too, fingerprints of odd parity emit two flips as well: of two
fingerprints at distance three just one is odd, and of three differing bits two
lie in the same half, so two flips within a half are enough.  Equal variants meet
in one group.

A group around variant v with a member c at one flip or fewer links c to all the
others: each is at most two flips from v, so at most three from c - and every
link within the radius has a group in which it is implied that way.  Links are
checked on the fingerprints before they leave the group.  No group ever emits
pairs, however many near copies share it, and no link is lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheetloom.llm.components import components
from sheetloom.llm.store import Stored
from sheetloom.llm.text import filled, pieces, set_apart

BITS = 64
RADIUS = 3
SHINGLE = 3
SEED = 42
#: Variants of one group table; it bounds the memory of a task.
GROUP_VARIANTS = 1_000_000
BLOCK = 2_000

ONE = [0, *(1 << i for i in range(BITS))]
TWO = [(1 << i) | (1 << j) for half in (range(32), range(32, 64)) for i in half for j in half if i < j]
MASKS = np.array(ONE + TWO, np.uint64)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Bit-wise majority of the hashes of all word shingles; zero without words."""
    words = text.encode().lower().split() if text else []  # bytes: A-Z and ASCII space only
    if not words:
        return 0
    size = min(shingle, len(words))
    hashes = np.fromiter(
        (xxhash.xxh64_intdigest(b" ".join(words[i : i + size]), SEED) for i in range(len(words) - size + 1)), np.uint64, len(words) - size + 1
    )
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half the hashes."""
    ones = np.zeros(BITS, np.int64)
    for part in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[part : part + (1 << 16)].astype(">u8").view(np.uint8)).reshape(-1, BITS).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def with_fingerprint(docs: DataFrame, text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """Append fingerprint (long, the 64 bits as they are) from whole texts; a column of that name is replaced."""
    schema = T.StructType([f for f in docs.schema.fields if f.name not in ("fingerprint", text)] + [T.StructField("fingerprint", T.LongType())])

    def run(batches):
        for batch in pieces(batches):
            values = batch.column(batch.schema.get_field_index(text)).to_pylist()
            made = np.fromiter((fingerprint(v, shingle) for v in values), np.uint64, len(values)).view(np.int64)
            keep = [i for i, n in enumerate(batch.schema.names) if n not in ("fingerprint", text)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(made)], names=[*(batch.schema.names[i] for i in keep), "fingerprint"])

    return docs.mapInArrow(run, schema)


def _spread(values: np.ndarray, parts: int) -> np.ndarray:
    mixed = (values ^ (values >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(32)) % np.uint64(parts)).astype(np.uint32)


def _emit(parts: int):
    """Variants of a block of fingerprints, packed by target group: fingerprints, variants per fingerprint, mask numbers."""

    def run(batches):
        for batch in batches:
            every = np.asarray(batch.column(0)).view(np.uint64)
            for at in range(0, len(every), BLOCK):
                prints = every[at : at + BLOCK]
                odd = np.bitwise_count(prints) % 2 == 1
                owner = np.concatenate([np.repeat(np.flatnonzero(~odd), len(ONE)), np.repeat(np.flatnonzero(odd), len(MASKS))]).astype(np.uint32)
                mask = np.concatenate([np.tile(np.arange(len(ONE), dtype=np.uint16), (~odd).sum()), np.tile(np.arange(len(MASKS), dtype=np.uint16), odd.sum())])
                group = _spread(prints[owner] ^ MASKS[mask], parts)
                order = np.lexsort((owner, group))
                group, owner, mask = group[order], owner[order], mask[order]
                edges = np.flatnonzero(np.diff(group)) + 1
                rows = {"part": [], "prints": [], "counts": [], "masks": []}
                for lo, hi in zip([0, *edges], [*edges, len(group)]):
                    own, counts = np.unique(owner[lo:hi], return_counts=True)
                    rows["part"].append(int(group[lo]))
                    rows["prints"].append(prints[own].tobytes())
                    rows["counts"].append(counts.astype(np.uint16).tobytes())
                    rows["masks"].append(mask[lo:hi].tobytes())
                yield pa.RecordBatch.from_pydict(rows, pa.schema([("part", pa.int32()), ("prints", pa.binary()), ("counts", pa.binary()), ("masks", pa.binary())]))

    return run


def _meet(table: pa.Table) -> pa.Table:
    """Links of one group table: members of equal variants to the smallest member at one flip or fewer."""
    prints = np.concatenate([np.repeat(np.frombuffer(p, np.uint64), np.frombuffer(c, np.uint16)) for p, c in zip(table["prints"].to_pylist(), table["counts"].to_pylist())])
    masks = np.concatenate([np.frombuffer(m, np.uint16) for m in table["masks"].to_pylist()])
    variants = prints ^ MASKS[masks]
    order = np.argsort(variants)
    variants = variants[order]
    starts = np.flatnonzero(np.concatenate([[True], variants[1:] != variants[:-1]]))
    sizes = np.diff(np.append(starts, len(variants)))
    shared = np.repeat(sizes > 1, sizes)
    order = order[shared]
    sizes = sizes[sizes > 1]
    prints, near = prints[order], masks[order] < len(ONE)
    if not len(prints):
        return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    most = np.uint64(2**64 - 1)
    centre = np.minimum.reduceat(np.where(near, prints, most), starts)
    has = np.maximum.reduceat(near, starts)
    centre, has = np.repeat(centre, sizes), np.repeat(has, sizes)
    keep = has & (centre != prints) & (np.bitwise_count(centre ^ prints) <= RADIUS)
    pairs = np.unique(np.stack([centre[keep], prints[keep]], 1), axis=0)
    return pa.table({"a": pairs[:, 0].copy().view(np.int64), "b": pairs[:, 1].copy().view(np.int64)})


def links(prints: DataFrame) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints of column ``fingerprint`` at RADIUS or fewer bits."""
    expected = prints.count() * (len(ONE) + len(TWO) / 2)
    parts = max(1, int(expected // GROUP_VARIANTS) + 1)
    packed = prints.select("fingerprint").mapInArrow(_emit(parts), "part int, prints binary, counts binary, masks binary")
    return packed.groupBy("part").applyInArrow(_meet, "a long, b long")


#: Stands for a null doc_id: it comes after every other.
LAST = (1 << 63) - 1


def keyed(docs: DataFrame) -> DataFrame:
    """Append __id and __key, which name a document: its doc_id and the hash of its text."""
    return docs.withColumns({"__id": F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)), "__key": F.xxhash64(filled(F.col("text")))})


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """One row per document of (doc_id, text): doc_id, fingerprint (16 hex digits), component_id, kept, __id, __key.

    component_id is the smallest doc_id reachable over fingerprints at RADIUS or
    fewer bits; ``kept`` marks that one document of each component.  Null, empty and
    wordless texts have fingerprint zero and are linked like any other.  Rows that
    repeat doc_id and text are one document and get the same answer.  A null doc_id
    comes after every other and is a null component_id where there is nothing else.
    An empty table gives no rows; other columns are ignored.
    """
    wanted = keyed(docs.select("doc_id", "text")).select("__id", "__key", filled(F.col("text")).alias("text"))
    prints = Stored(with_fingerprint(wanted, "text", shingle), "prints")
    least = Stored(prints.df.groupBy("fingerprint").agg(F.min(F.struct("__id", "__key")).alias("least")), "distinct")
    found = Stored(links(least.df).distinct(), "links")
    labels = components(found.df)
    # A fingerprint without links is its own component.
    roots = Stored(least.df.join(labels, least.df["fingerprint"] == labels["vertex"], "left").select("fingerprint", "least", F.coalesce("root", "fingerprint").alias("root")), "roots")
    smallest = roots.df.groupBy("root").agg(F.min("least").alias("first"))
    by_print = Stored(roots.df.join(smallest, "root").select("fingerprint", "first"), "components")
    for done in (least, found, roots):
        done.drop()
    real = lambda c: F.when(c != LAST, c)
    return prints.df.join(by_print.df, "fingerprint").select(
        real(F.col("__id")).alias("doc_id"),
        F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"),
        real(F.col("first.__id")).alias("component_id"),
        ((F.col("first.__id") == F.col("__id")) & (F.col("first.__key") == F.col("__key"))).alias("kept"),
        "__id",
        "__key",
    )


def without_near_duplicates(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """One document of each component, with all its columns."""
    kept = Stored(near_duplicates(docs, shingle).where("kept").select("__id", "__key").distinct(), "kept")
    apart, back = set_apart(docs, "doc_id", "text")
    return back(keyed(apart).join(kept.df.hint("merge"), ["__id", "__key"], "left_semi").dropDuplicates(["__id", "__key"]))

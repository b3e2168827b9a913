"""Column helpers that several operators share."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SALTS = 64
#: Rows whose texts a Python worker holds as objects at a time.
PIECE_ROWS = 256


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. A text without multi-byte characters takes the byte-wise path of ``lower``."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def filled(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def held_out(doc_id: Column) -> Column:
    """Rows that no model learns from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def unit_hash(*cols: Column) -> Column:
    """A number in [0, 1) fixed by the given columns."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 30)) / F.lit(float(1 << 30))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def set_apart(docs: DataFrame, *needed: str) -> tuple[DataFrame, Callable[..., DataFrame]]:
    """``docs`` with all but the ``needed`` columns under names that no operator uses, and the way back to its own columns (and more)."""
    names = {c: f"__in{k}" for k, c in enumerate(docs.columns) if c not in needed}
    apart = docs.select(*(F.col(f"`{c}`").alias(names.get(c, c)) for c in docs.columns))
    return apart, lambda found, *more: found.select(*(F.col(names.get(c, f"`{c}`")).alias(c) for c in docs.columns), *more)


def pieces(batches):
    """Arrow batches in slices of a few rows, so that long texts do not pile up as Python objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, PIECE_ROWS):
            yield batch.slice(at, PIECE_ROWS)

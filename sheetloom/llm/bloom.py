"""A Bloom filter of a fixed size that tasks hold; it decides what is worth counting, never a result."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Filter:
    """``bits`` is a power of two from 64 to 2^32; two bits stand for a 64-bit hash."""

    def __init__(self, bits: int):
        self.bits, self.words, self.filled = bits, np.zeros(bits >> 6, np.uint64), False

    def copy(self) -> Filter:
        other = Filter(64)
        other.bits, other.words, other.filled = self.bits, self.words.copy(), self.filled
        return other

    def has(self, hashes: np.ndarray) -> np.ndarray:
        """Whether each hash (uint64) may have been added; those added always have."""
        out = np.ones(len(hashes), bool)
        for place in (hashes, hashes >> np.uint64(32)):
            place = place & np.uint64(self.bits - 1)
            out &= (self.words[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)
        return out

    def add(self, hashes: DataFrame) -> None:
        """Add a table's column ``hash`` (long); at most one row per 64-bit word reaches the driver."""
        h, most = F.col("hash"), F.lit(self.bits - 1)
        places = hashes.select(F.explode(F.array(h.bitwiseAND(most), F.shiftrightunsigned(h, 32).bitwiseAND(most))).alias("place"))
        bit = F.expr("shiftleft(1L, CAST(place & 63 AS INT))")
        made = places.groupBy(F.shiftright("place", 6).alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
        if made.num_rows:
            self.words[made["word"].to_numpy()] |= made["bits"].to_numpy().view(np.uint64)
            self.filled = True

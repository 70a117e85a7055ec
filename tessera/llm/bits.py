"""A table of bits that turns most rows away before anything is joined."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Over 1,000 bits for each value, within these powers of two (128 KB to 32 MB); a value has two.
LEAST_BITS, MOST_BITS = 20, 28


class Bits:
    """Two bits for each value of a column of 64-bit hashes; a call gives the places of the hashes that may be there.

    No value is missed.  At most ``1 << MOST_BITS`` bits are held, whatever the number of values: with
    very many of them more rows pass, and a join decides.
    """

    def __init__(self, rows: DataFrame, h: Column):
        self.size = 1 << min(max(rows.count().bit_length() + 10, LEAST_BITS), MOST_BITS)
        slots = rows.select(F.explode(F.array(h, F.shiftright(h, 32))).alias("h")).select(F.col("h").bitwiseAND(F.lit(self.size - 1)).alias("slot"))
        held = slots.groupBy(F.shiftright("slot", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(slot & 63 AS INT))")).alias("b")).toArrow()  # size / 64 rows at most
        table = np.zeros(self.size // 64, dtype=np.int64)
        table[held["w"].to_numpy()] = held["b"].to_numpy()
        self.table = table.view(np.uint8)

    def __call__(self, h: np.ndarray) -> np.ndarray:
        at = self._set(h)
        return at[self._set(h[at].view(np.int64) >> 32)]

    def _set(self, h: np.ndarray) -> np.ndarray:
        slot = h.view(np.int64) & (self.size - 1)
        return np.flatnonzero(self.table[slot >> 3] >> (slot & 7).astype(np.uint8) & 1)

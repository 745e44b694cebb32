"""A Bloom-style table of fixed size, broadcast to let a second scan skip what cannot matter.

Its size does not depend on the corpus. It may let rows through by chance, so
what follows must settle them exactly; it never holds a marked key back.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FILTER_BITS = 1 << 25  # 4 MB


def bit_table(keys: DataFrame, column: str) -> np.ndarray:
    """The table with the bit of every long in ``column`` set; at most ``FILTER_BITS / 64`` rows reach the driver."""
    word = F.expr(f"pmod({column}, {FILTER_BITS}L) div 64").alias("word")
    bits = F.bit_or(F.expr(f"shiftleft(1L, CAST(pmod({column}, {FILTER_BITS}L) % 64 AS INT))")).alias("bits")
    found = keys.groupBy(word).agg(bits).toPandas()
    table = np.zeros(FILTER_BITS // 64, np.uint64)
    table[found["word"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64).view(np.uint64)
    return table


def in_table(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Flags of the keys whose bit is set."""
    at = keys.view(np.int64) % FILTER_BITS
    return (table[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1

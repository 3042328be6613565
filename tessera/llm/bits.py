"""Sets of hashes as bits of a bounded number, to be sent to the tasks: a hash that is in the set is always found there."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: 16 bits for each hash, 16 MB at most: beyond 8 million hashes more bits are set by chance, and what is tested for is only thinned out less.
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 27


def bit_set(hashes: DataFrame, n: int, most: int = MOST_BITS) -> np.ndarray:
    """The set of the ``n`` longs of a table of one column, as bytes; two bits stand for each. Bits are put together by position in Spark."""
    size = LEAST_BITS
    while size < min(16 * n, most):
        size *= 2
    h = F.col(hashes.columns[0])
    two = F.array(h.bitwiseAND(F.lit(size - 1)), F.shiftrightunsigned(h, 32).bitwiseAND(F.lit(size - 1)))
    each = hashes.select(F.explode(two).alias("at"))
    slots = each.groupBy(F.shiftright("at", 5).alias("slot")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 31 as int))")).alias("bits")).toArrow()
    bits = np.zeros(size // 32, np.uint32)
    bits[slots["slot"].to_numpy()] = slots["bits"].to_numpy().astype(np.uint32)
    return bits.view(np.uint8)


def is_set(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether unsigned 64-bit hashes are in the set, or seem to be."""
    size = np.uint64(8 * len(bits) - 1)
    found = np.ones(len(hashes), bool)
    for at in ((hashes & size).astype(np.int64), ((hashes >> np.uint64(32)) & size).astype(np.int64)):
        found &= (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
    return found

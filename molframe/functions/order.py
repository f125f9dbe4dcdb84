"""The total order of floats: negative NaN, negative numbers, -0, +0, positive numbers, NaN.

Spark puts -0 and +0 together; the bits of a number, with those of negative numbers but the sign turned over, do not."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

LOW63 = (1 << 63) - 1


def total_order(c: Column) -> Column:
    """A long that sorts as the total order of the doubles of `c`; null stays null."""
    bits = F.reflect(F.lit("java.lang.Double"), F.lit("doubleToRawLongBits"), F.coalesce(c.cast("double"), F.lit(0.0))).cast("long")
    return F.when(c.isNotNull(), F.when(bits < 0, bits.bitwiseXOR(F.lit(LOW63))).otherwise(bits))


def total_order_np(x: np.ndarray) -> np.ndarray:
    """The same for an array."""
    bits = np.ascontiguousarray(x, dtype=np.float64).view(np.int64)
    return np.where(bits < 0, bits ^ LOW63, bits)

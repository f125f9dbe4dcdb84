"""The splitmix64 finaliser on LONG bit patterns.

ANSI mode refuses overflow, so products are made of 32-bit halves whose partial sums stay in range, and
sums wrap through a carry-free identity. Unsigned order of a LONG x is the signed order of x ^ MIN.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MASK32 = 0xFFFFFFFF
MIN = -(1 << 63)
#: Fixed values of the generator.
GAMMA, FIRST, SECOND = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def signed(v: int) -> int:
    """A 64-bit pattern as a signed number."""
    v &= (1 << 64) - 1
    return v - (1 << 64) if v >> 63 else v


def _halves(x: Column) -> tuple[Column, Column]:
    return F.shiftrightunsigned(x, 32), x.bitwiseAND(MASK32)


def _joined(high: Column, low: Column) -> Column:
    return F.shiftleft(high.bitwiseAND(MASK32), 32).bitwiseOR(low.bitwiseAND(MASK32))


def wrapping_add(x: Column, k: int) -> Column:
    hi, lo = _halves(x)
    low = lo + (k & MASK32)
    return _joined(hi + ((k >> 32) & MASK32) + F.shiftrightunsigned(low, 32), low)


def wrapping_mul(x: Column, k: int) -> Column:
    """x * k modulo 2**64, by 16-bit digits of k so that no partial product overflows."""
    hi, lo = _halves(x)
    out_hi, out_lo = F.lit(0).cast("long"), F.lit(0).cast("long")
    for i in range(4):
        d = (k >> (16 * i)) & 0xFFFF
        p = lo * d  # below 2**48
        q = hi * d
        if i < 2:
            s = F.shiftleft(p.bitwiseAND((1 << (32 - 16 * i)) - 1), 16 * i) if i else p.bitwiseAND(MASK32)
            carry_over = F.shiftrightunsigned(p, 32 - 16 * i)
            low = out_lo + s
            out_hi = (out_hi + carry_over + F.shiftleft(q.bitwiseAND(MASK32 >> (16 * i)), 16 * i) + F.shiftrightunsigned(low, 32)).bitwiseAND(MASK32)
            out_lo = low.bitwiseAND(MASK32)
        else:
            out_hi = (out_hi + F.shiftleft(p.bitwiseAND(MASK32 >> (16 * (i - 2))), 16 * (i - 2))).bitwiseAND(MASK32)
    return _joined(out_hi, out_lo)


def _bound(x: Column, f) -> Column:
    """f of x with x evaluated once: each step uses its input many times, and copies would grow as powers."""
    return F.transform(F.array(x), f)[0]


def splitmix64(x: Column) -> Column:
    x = _bound(wrapping_add(x, GAMMA), lambda v: v.bitwiseXOR(F.shiftrightunsigned(v, 30)))
    x = _bound(_bound(x, lambda v: wrapping_mul(v, FIRST)), lambda v: v.bitwiseXOR(F.shiftrightunsigned(v, 27)))
    return _bound(_bound(x, lambda v: wrapping_mul(v, SECOND)), lambda v: v.bitwiseXOR(F.shiftrightunsigned(v, 31)))


def unsigned_order(x: Column) -> Column:
    return x.bitwiseXOR(F.lit(MIN).cast("long"))


def splitmix64_int(v: int) -> int:
    """The same on Python numbers, unsigned."""
    m = (1 << 64) - 1
    v = (v + GAMMA) & m
    v = ((v ^ (v >> 30)) * FIRST) & m
    v = ((v ^ (v >> 27)) * SECOND) & m
    return v ^ (v >> 31)

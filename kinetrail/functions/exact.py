"""Decimal rounding of the exact binary value, as JVM expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Splits a double into halves of 26 bits, whose products are exact.
SPLIT = float(2**27 + 1)


def _halves(c: Column | float) -> tuple:
    t = c * SPLIT
    high = t - (t - c)
    return high, c - high


def rounded(c: Column, digits: int = 6) -> Column:
    """c to `digits` (1 to 9) decimals: the decimal nearest to the exact value of the double, ties to even, then its nearest double.

    F.round rounds the shortest decimal text half up instead: 2.675, which is less than its text says, becomes 2.68 there and 2.67 here.
    The fraction (exact, as a double less its nearest integer) times 10**digits is split into a rounded product and its error, both
    doubles, so that a midpoint is told from what lies beside it. Values so large that decimals of that size can't change them
    stay as they are, as do NaN, infinities, null and the sign of zero.
    """
    if not 1 <= digits <= 9:
        raise ValueError("digits must be 1 to 9")
    ten = float(10**digits)
    whole = F.rint(c)
    part = c - whole
    product, (ah, al), (bh, bl) = part * ten, _halves(part), _halves(ten)
    error = ((ah * bh - product) + ah * bl + al * bh) + al * bl
    n = F.rint(product)
    rest = product - n
    n = F.when((rest == 0.5) & (error > 0), n + 1).when((rest == -0.5) & (error < 0), n - 1).otherwise(n)
    total = whole * ten + n  # a whole number below 2**53
    out = F.when(total == 0, c * 0.0).otherwise(total / ten)
    return F.when(F.abs(c) < 2.0 ** (52 - math.floor(math.log2(ten))), out).otherwise(c)

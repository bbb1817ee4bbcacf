"""Exact sums and rounding of doubles, as integers in limbs.

A double below 2**46 is split, exactly, into its integer part and 96 bits of its
fraction, in limbs of 24 bits. Sums of limbs are sums of longs: exact, mergeable in any
order, so a total doesn't depend on how Spark partitions the rows. The total is rounded to
a double once. (A value below 2**-43 may have bits beyond the 96; these are cut off for
each value alike, so the order still doesn't matter.) Sums that hold a NaN, an infinity
or a larger value are plain sums.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a limb, limbs of the fraction, and the bound of values that are split.
BITS, FRACTION, BOUND = 24, 4, 2.0 ** 46
_BASE, _MASK, _TWO = 1 << BITS, (1 << BITS) - 1, 2.0 ** (2 * BITS)


def _split(v: Column) -> tuple[Column, Column, Column]:
    """Floor of a double in bounds, and its fraction as two integers of 48 bits. Every step is exact."""
    whole = F.floor(v)
    upper = (v - whole.cast("double")) * F.lit(_TWO)
    return whole, F.floor(upper), F.floor((upper - F.floor(upper)) * F.lit(_TWO))


def _limbs(v: Column) -> list[Column]:
    """Limbs of a double in bounds: its floor's, the uppermost with its sign, and its fraction's."""
    return [x for part in _split(v) for x in (F.shiftright(part, BITS), _low(part))]


def _low(x: Column) -> Column:
    return x.bitwiseAND(F.lit(_MASK).cast("long"))


def _dec(x: Column) -> Column:
    return x.cast("decimal(38,0)")


class ExactSum:
    """Aggregates of one column's exact sum, and the sum from them.

    ``s.total(df.groupBy(k).agg(*s.aggs()), "total")``; NULLs are skipped, and the sum of no
    value is NULL."""

    def __init__(self, value, name: str):
        self.of = F.col(value) if isinstance(value, str) else value
        self.name = name

    def _part(self, i) -> str:
        return f"_{self.name}_{i}"

    def aggs(self) -> list[Column]:
        regular = F.abs(self.of) < BOUND  # a NaN is not less
        limbs = _limbs(F.when(regular, self.of))
        return [*[F.sum(x).alias(self._part(i)) for i, x in enumerate(limbs)],
                F.count_if(self.of.isNotNull() & ~regular).alias(self._part("odd")),
                F.sum(F.when(~regular, self.of)).alias(self._part("plain"))]

    def total(self, sums: DataFrame, alias: str) -> DataFrame:
        """``sums`` with the total, rounded to the nearest double, in place of the limbs' sums."""
        c, n = self._part, 2 + FRACTION
        step = sums
        for i in range(n - 1, 0, -1):  # carries upwards; every limb but the uppermost ends within its bits
            step = step.withColumn(c(i - 1), F.col(c(i - 1)) + F.shiftright(c(i), BITS)).withColumn(c(i), _low(F.col(c(i))))
        below = (F.col(c(n - 1)).bitwiseOR(F.col(c(n - 2))) != 0).cast("int")
        whole = _dec(_dec(F.col(c(0))) * F.lit(Decimal(_BASE)) + F.col(c(1)))
        step = step.withColumn(c("whole"), whole).withColumn(
            c("a"), F.col(c(2)) * _BASE + F.col(c(3))).withColumn(c("b"), F.col(c(4)) * _BASE + F.col(c(5)))
        # a decimal of 38 digits holds all limbs of a small total; of a larger one the lower limbs
        # only tell whether there is something below, which decides a tie
        two = F.lit(Decimal(1 << (2 * BITS)))
        upper = _dec(F.col(c("whole")) * two + F.col(c("a")))
        small = _dec(upper * two + F.col(c("b"))).cast("double") / F.lit(_TWO * _TWO)
        middle = _dec(upper * 2 + below).cast("double") / F.lit(2 * _TWO)
        exact = (F.when(F.abs(c(0)) < 32, small).when(F.abs(c(0)) < 2 ** 50, middle)
                 .otherwise(F.col(c("whole")).cast("double")))
        step = step.withColumn(c("exact"), F.coalesce(exact, F.when(F.col(c("odd")) > 0, 0.0)))
        out = step.withColumn(alias, F.when(F.col(c("odd")) > 0, F.col(c("plain")) + F.col(c("exact"))).otherwise(F.col(c("exact"))))
        return out.drop(*[c(x) for x in (*range(n), "odd", "plain", "whole", "a", "b", "exact")])


def to_fixed2(value) -> Column:
    """A double to two decimals, by its binary value: of the two nearest hundredths the
    nearer one, the larger in size at an exact tie. 1.005, which is below 1.005 in binary,
    gives 1.0. Values from 2**46 on, which have few bits left, are rounded as decimal text."""
    v = F.col(value) if isinstance(value, str) else value
    size = F.abs(v)
    whole, upper, lower = _split(F.when(size < BOUND, size))
    bits = 2 * BITS
    scaled = upper * 100 + F.shiftright(lower * 100, bits)  # what leaves the 48 bits are the hundredths
    half = F.shiftright(scaled, bits - 1).bitwiseAND(F.lit(1).cast("long"))
    hundredths = whole * 100 + F.shiftright(scaled, bits) + half
    exact = F.when(v < 0, -hundredths).otherwise(hundredths).cast("double") / F.lit(100.0)
    return F.when(size < BOUND, exact).otherwise(F.round(v, 2))

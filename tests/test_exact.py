"""Exact sums of doubles and rounding by the binary value."""

import math
import random
from decimal import ROUND_HALF_UP, Decimal
from fractions import Fraction

import pytest

from conftest import readings_df, tags_df
from millrun.functions.exact import ExactSum, to_fixed2
from millrun.operators import stats as ST


def _sum(spark, values, parts):
    df = spark.createDataFrame([(i % 2, v) for i, v in enumerate(values)], "k int, v double").repartition(parts)
    s = ExactSum("v", "x")
    return {r.k: r.t for r in s.total(df.groupBy("k").agg(*s.aggs()), "t").collect()}


def _cases():
    rng = random.Random(1)
    yield [0.1] * 1001
    yield [rng.uniform(-1e3, 1e3) for _ in range(3000)]
    yield [rng.choice([1e13, -1e13, 1e-6, -1e-6, 3.3, 1e9]) * rng.random() for _ in range(3000)]
    yield [rng.choice([7e13, 6.9e13, 0.1]) for _ in range(3000)]       # totals beyond 2**53
    yield [2.0 ** 45, 2.0 ** -8, 2.0 ** 45, 2.0 ** -8] * 4             # ties and what decides them
    yield [2.0 ** 53 / 1024] * 2048 + [0.5, 2.0 ** -43, 0.5, 0.0] + [1.0, 1.0]
    yield [-0.0, 0.0, None, 2.0 ** -43, -(2.0 ** -43)]
    yield [-1e-9, -2.5, 1e-9, 2.5, -1e12, 1e12]


@pytest.mark.parametrize("case", range(8))
def test_sums_are_exact_in_any_partitions(spark, case):
    values = list(_cases())[case]
    got = [_sum(spark, values, n) for n in (1, 5)]
    assert got[0] == got[1]
    for k in (0, 1):
        own = [v for v in values[k::2] if v is not None]
        assert got[0][k] == (math.fsum(own) if own else None)


def test_odd_values(spark):
    assert math.isnan(_sum(spark, [1.0, 2.0, math.nan, 2.0], 2)[0])
    assert _sum(spark, [1.0, 0.0, math.inf, 0.0], 2) == {0: math.inf, 1: 0.0}
    assert _sum(spark, [1e300, 1.0, 1.0, 2.0], 2) == {0: 1e300, 1: 3.0}
    assert _sum(spark, [None, 1.0], 1) == {0: None, 1: 1.0}


def test_fixed2_by_the_binary_value(spark):
    rng = random.Random(2)
    values = [1.005, 1.015, 1.025, 0.125, 0.375, -0.125, -1.005, 2.5, 0.0, -0.0, 1.255, 8.345, 10.235, 0.994999, 0.995, 0.999,
              1e-9, -1e-9, 123456789.125, 70368744177663.99, 2.0 ** 46 - 0.0078125, 20.004, *[k / 8 + 0.0 for k in range(-9, 9)],
              *[round(rng.uniform(0, 100), 3) for _ in range(500)], *[rng.uniform(-1e6, 1e6) for _ in range(500)]]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for v, got in [(r.v, r.f) for r in df.select("v", to_fixed2("v").alias("f")).collect()]:
        assert got == float(Decimal(v).quantize(Decimal("0.01"), ROUND_HALF_UP)), v
    odd = spark.createDataFrame([(math.nan,), (math.inf,), (None,), (2.0 ** 60,)], "v double")
    a, b, c, d = [r[0] for r in odd.select(to_fixed2("v")).collect()]
    assert math.isnan(a) and b == math.inf and c is None and d == 2.0 ** 60


def test_statistics_do_not_depend_on_the_partitions(spark):
    rng = random.Random(3)
    pts = [(i, rng.choice([rng.uniform(0, 1e5), 0.1, 1e-7, None])) for i in range(4000)]
    df = readings_df(spark, pts)
    tags = tags_df(spark, n=1)
    own = [v for _, v in pts if v is not None]
    for n in (1, 7):
        r = df.repartition(n)
        kw = ("2026-01-01 00:00:00", "2026-02-01 00:00:00")
        total = math.fsum(own)
        assert ST.window_stats(r, tags, *kw).first().avgVal == total / len(own)
        assert ST.capacity(r, tags, *kw, divisor=6).first().cap == total / 6
        w = ST.weighing_stats(r, tags, *kw).first()
        assert (w.sumVal, w.avgVal) == (total, total / len(own) * 2)
    assert Fraction(total) != sum(map(Fraction, own))  # the double nearest to the exact sum

"""Weighing-cycle pivot semantics."""

import datetime as dt

from millrun import schemas
from millrun.operators import weighing as W
from millrun.sources import registry as R
from millrun.sources.local import local_table

T0 = dt.datetime(2024, 1, 1, 8, 0, 0)
NAMES = [n for n, _ in R.WEIGHING_TAGS] + ["[PLC_Crushing]OTHER"]


def _data(spark, rows):
    tags = local_table(spark, [("WL", i + 1, n) for i, n in enumerate(NAMES)], schemas.TAGS)
    r = local_table(spark, [("WL", tag, T0 + dt.timedelta(seconds=s), v, "G", seq)
                            for seq, (s, tag, v) in enumerate(rows)], schemas.READINGS)
    return r, tags


def _cycles(spark, rows):
    r, t = _data(spark, rows)
    return W.cycles(r, t, "2024-01-01 00:00:00", "2024-01-02 00:00:00")


def test_pivot_last_value_wins_and_unknown_tag_creates_cycle(spark):
    rows = [(0, 1, 7.0), (0, 3, 20.0), (0, 3, 21.5), (0, 4, 2.0),   # cycle 0: weight twice
            (5, 6, 9.0),                                            # only an unpivoted tag
            (9, 3, 0.0), (9, 1, 0.0)]                               # only zeros -> no cycle
    c = {r.DateAndTime: r for r in _cycles(spark, rows).collect()}
    assert set(c) == {T0, T0 + dt.timedelta(seconds=5)}
    assert c[T0].Weight == 21.5 and c[T0].id == 7.0 and c[T0].Silo == 2.0 and c[T0].Material is None
    other = c[T0 + dt.timedelta(seconds=5)]
    assert all(getattr(other, k) is None for k in W.PIVOT_COLUMNS)


def test_filters_treat_null_as_zero_in_ranges_only(spark):
    rows = [(0, 1, 7.0), (0, 3, 30.0), (5, 6, 9.0), (7, 4, 3.0)]
    c = _cycles(spark, rows)
    assert W.filter_cycles(c, max_weight=10).count() == 2        # NULL weights pass
    assert W.filter_cycles(c, min_weight=0).count() == 3
    assert W.filter_cycles(c, min_weight=1).count() == 1
    assert W.filter_cycles(c, silo=3).count() == 1               # equality never matches NULL
    assert W.filter_cycles(c, id_=7).count() == 1


def test_summary_and_format(spark):
    rows = [(0, 3, 10.0), (1, 3, 20.004), (2, 1, 5.0)]
    c = _cycles(spark, rows)
    s = W.summary(c).first()
    assert s.cycles == 3 and s.totalWeight == 30.0 and s.avgWeight == 10.0
    f = W.formatted(c).collect()
    assert [r.Weight for r in f] == [10.0, 20.0, 0.0]

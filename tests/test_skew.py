"""The chunked successor must equal the plain per-series window exactly."""

import random

from conftest import readings_df
from millrun.operators import gaps as G


def test_chunked_successor_matches_unchunked(spark):
    rnd = random.Random(7)
    pts, t = [], 0
    for _ in range(3000):                     # one hot tag over ~2 weeks, irregular
        t += rnd.choice([1, 5, 10, 10, 10, 30, 600, 7200, 40000])
        pts.append((t, rnd.choice([0.0, 5.0, 5.5, 50.0])))
    pts += [(p[0], p[1] + 1) for p in pts[::97]]          # duplicate timestamps
    hot = readings_df(spark, pts, tag=1)
    cold = readings_df(spark, [(0, 1.0), (3 * 86400, 1.0)], tag=2)
    df = hot.unionByName(cold)
    cols = ["plant", "TagIndex", "DateAndTime", "seq", "next_DateAndTime", "next_Val"]
    a = G.with_successor(df, chunk_ms=None).select(cols)
    for chunk in (G.MS_PER_DAY, 3_600_000, 60_000, "auto"):
        b = G.with_successor(df, chunk_ms=chunk, target_rows=50).select(cols)
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_auto_chunks_split_only_dense_series(spark):
    hot = readings_df(spark, [(i, 1.0) for i in range(2000)], tag=1)       # 2000 rows in a day
    cold = readings_df(spark, [(i * 600, 1.0) for i in range(100)], tag=2)  # 100 rows in a day
    w = {r.TagIndex: r._width for r in G.chunk_widths(hot.unionByName(cold), G.SERIES,
                                                         target_rows=500).collect()}
    assert w[2] == G.MS_PER_DAY and w[1] == G.MS_PER_DAY // 4


def test_fill_identical_under_chunking(spark):
    pts = [(i * 37 % 5000, float(i % 3)) for i in range(400)]
    df = readings_df(spark, pts)
    base = G.gap_fill(df, 10, 90, 0.2, chunk_ms=None).drop("next_DateAndTime", "next_Val")
    for chunk in (60_000, 1_000):
        other = G.gap_fill(df, 10, 90, 0.2, chunk_ms=chunk).drop("next_DateAndTime", "next_Val")
        assert base.exceptAll(other).count() == 0 and other.exceptAll(base).count() == 0


def test_window_partitions_are_chunks(spark, capsys):
    """The big window is keyed by (series, chunk), not by the series alone."""
    df = readings_df(spark, [(i, 1.0) for i in range(10)])
    G.with_successor(df).explain()
    plan = capsys.readouterr().out
    assert "hashpartitioning(plant#" in plan and "_chunk" in plan

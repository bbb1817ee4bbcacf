"""Gap-fill cases restated from the reference's unit tests (FIXTURES.md §2)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import BASE, readings_df
from millrun.operators import gaps as G
from millrun.sources import registry as R


def run(spark, pts, chunk_ms=G.MS_PER_DAY, **opt):
    o = G.FillOptions.resolve(opt.get("cadence"), opt.get("cap"), opt.get("tolerance"))
    f = G.gap_fill(readings_df(spark, pts), o.cadence_s, o.cap_s, o.tolerance, chunk_ms=chunk_ms)
    rows = f.orderBy("DateAndTime", "Filled").collect()
    flagged = [r for r in rows if r.gap_kind in (R.REASON_EXCEEDS_CAP, R.REASON_MISMATCH)]
    return rows, flagged


@pytest.mark.parametrize("chunk_ms", [G.MS_PER_DAY, None, 15_000])
def test_clean_cadence(spark, chunk_ms):
    rows, flagged = run(spark, [(0, 100), (10, 100)], chunk_ms)
    assert len(rows) == 2 and not flagged


@pytest.mark.parametrize("chunk_ms", [G.MS_PER_DAY, None, 15_000])
def test_bridge_20s(spark, chunk_ms):
    rows, flagged = run(spark, [(0, 100), (20, 100)], chunk_ms)
    assert len(rows) == 3 and not flagged
    assert rows[1].Filled and rows[1].DateAndTime == BASE + dt.timedelta(seconds=10)
    assert rows[1].Val == 100.0


def test_exceeds_cap(spark):
    rows, flagged = run(spark, [(0, 100), (200, 100)])
    assert len(rows) == 2 and len(flagged) == 1 and flagged[0].gap_kind == "exceeds cap"


def test_value_mismatch(spark):
    rows, flagged = run(spark, [(0, 100), (20, 0)])
    assert len(rows) == 2 and len(flagged) == 1
    assert flagged[0].gap_kind == "value mismatch across gap"


def test_synthetic_rows_keep_tag_fields(spark):
    f = G.gap_fill(readings_df(spark, [(0, 5), (30, 5)], tag=3, plant="Q"))
    rows = f.collect()
    assert len(rows) == 4
    assert {(r.plant, r.TagIndex, r.Status) for r in rows} == {("Q", 3, "G")}


def test_descending_input_comes_out_ascending(spark):
    rows, _ = run(spark, [(20, 1), (0, 1)])
    assert [r.DateAndTime for r in rows] == [BASE + dt.timedelta(seconds=s) for s in (0, 10, 20)]


def test_cadence_60(spark):
    rows, flagged = run(spark, [(0, 9), (60, 9)], cadence=60)
    assert len(rows) == 2 and not flagged


def test_cap_override(spark):
    rows, flagged = run(spark, [(0, 1), (20, 1)], cap=15)
    assert sum(r.Filled for r in rows) == 0 and len(flagged) == 1


def test_tolerance_zero_is_honoured(spark):
    _, flagged = run(spark, [(0, 100), (20, 100.0001)], tolerance=0)
    assert len(flagged) == 1


def test_bad_options_fall_back():
    o = G.FillOptions.resolve("x", -5, -1)
    assert (o.cadence_s, o.cap_s, o.tolerance) == (10.0, 90.0, 0.2)
    assert G.FillOptions.resolve(None, None, 0).tolerance == 0.0


def test_exactly_one_and_a_half_cadence_is_normal(spark):
    rows, flagged = run(spark, [(0, 1), (15, 1)])
    assert len(rows) == 2 and not flagged


def test_exactly_cap_is_bridged(spark):
    rows, flagged = run(spark, [(0, 1), (90, 1)])
    assert sum(r.Filled for r in rows) == 8 and not flagged


def test_uneven_gap(spark):
    rows, _ = run(spark, [(0, 1), (25, 1)])
    filled = [r.DateAndTime for r in rows if r.Filled]
    assert filled == [BASE + dt.timedelta(seconds=10), BASE + dt.timedelta(seconds=20)]


def test_gap_across_era_boundary_is_neither_filled_nor_flagged(spark):
    df = readings_df(spark, [(0, 1), (10, 1), (40, 1), (50, 1)])
    df = df.withColumn("era_id", F.when(F.col("DateAndTime") <= F.lit(BASE + dt.timedelta(seconds=10)), 0)
                       .otherwise(1))
    f = G.gap_fill(df, series=("plant", "TagIndex", "era_id")).collect()
    assert len(f) == 4
    assert not any(r.Filled for r in f)
    assert not any(r.gap_kind in (R.REASON_EXCEEDS_CAP, R.REASON_MISMATCH) for r in f)


def test_audit(spark):
    f = G.gap_fill(readings_df(spark, [(0, 100), (20, 100), (220, 100), (240, 0)]))
    a = G.fill_audit(f).collect()[0]
    assert (a.realReadings, a.filledReadings, a.totalReadings) == (4, 1, 5)
    assert a.flaggedGaps == 2 and a.flagged_s == 220.0

"""Invariants from the reference's live tests, on the driver tables."""

import datetime as dt

from conftest import SF_SMALL, readings_df, tags_df
from millrun.operators import runhours
from millrun.plans.queries import REGISTRY


def test_buckets_sum_to_total_and_hours(spark):
    rows = REGISTRY["run_hours"](spark, SF_SMALL).join(
        REGISTRY["tariff_hours"](spark, SF_SMALL).drop("tagName"), ["plant", "TagIndex"]).collect()
    assert rows
    for r in rows:
        assert abs(r.A + r.B + r.C + r.D - r.total) < 1e-9
        assert abs(r.total - r.hour) < 1e-9


def test_real_plus_filled_is_total_and_raw_le_filled(spark):
    a = REGISTRY["gap_fill_audit"](spark, SF_SMALL).collect()
    assert all(r.realReadings + r.filledReadings == r.totalReadings for r in a)
    g = REGISTRY["gap_correction_report"](spark, SF_SMALL).collect()
    assert g and all(r.raw_hour <= r.filled_hour for r in g)


def test_weekend_day_has_no_weekday_buckets(spark):
    sunday = dt.datetime(2026, 7, 5)
    pts = [(i * 10, 50.0) for i in range(8640)]
    df = readings_df(spark, pts, base=sunday)
    r = runhours.count_run_hours(df, tags_df(spark), threshold=0, tbf="2026-07-05 00:00:00",
                                 taf="2026-07-05 23:59:59").where("TagIndex = 0").first()
    assert r.A == 0 and r.B == 0 and abs(r.C + r.D - 24.0) < 1e-9 and r["count"] == 8640


def test_unknown_tag_gives_nulls_and_zero(spark):
    r = {x.TagIndex: x for x in REGISTRY["window_stats"](spark, SF_SMALL).collect()}
    assert r[7].tagName is None and r[7].avgVal is None and r[7].n == 0
    h = {x.TagIndex: x for x in REGISTRY["run_hours"](spark, SF_SMALL).collect()}
    assert h[7]["count"] == 0 and h[7].tagName is None and h[7].realReadings == 0
    e = {x.TagIndex: x for x in REGISTRY["run_hours_eras"](spark, SF_SMALL).collect()}
    assert e[7].realReadings is None        # era audit is absent for an empty tag


def test_fill_off_has_no_audit(spark):
    r = REGISTRY["run_hours_raw"](spark, SF_SMALL).collect()
    assert all(x.realReadings is None and x.filledReadings is None for x in r)


def test_forced_era_defaults_to_240_per_hour(spark):
    r = [x for x in REGISTRY["run_hours_forced_era"](spark, SF_SMALL).collect() if x["count"]]
    assert r and all(abs(x.hour - x["count"] / 240.0) < 1e-12 for x in r)

"""No query, job or report loses rows silently."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from millrun import schemas
from millrun.functions import time as TM
from millrun.functions.tariff import with_holiday
from millrun.operators import reports, runhours
from millrun.plans import params as P
from millrun.plans import routes
from millrun.plans.queries import REGISTRY
from millrun.sources import fixtures as FX
from millrun.sources import registry as R
from millrun.sources.local import local_table

from conftest import SF_SMALL, readings_df, tags_df

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("sf", [SF_SMALL, SF])
def test_windows_cover_all_rows(spark, sf):
    for readings, lo, hi in ((FX.weighing_readings(spark, sf), P.WL_TBF, P.WL_TAF),
                             (FX.readings(spark, sf), P.TBF, P.TAF), (FX.readings(spark, sf), P.ALL_TBF, P.ALL_TAF),
                             (FX.weighing_readings(spark, sf), P.ALL_TBF, P.ALL_TAF)):
        inside = F.col("DateAndTime").between(TM.ts_lit(TM.parse_local(lo)), TM.ts_lit(TM.parse_local(hi)))
        assert readings.where(inside).count() == readings.count() > 0


def test_long_listing_holds_every_weighing_reading(spark):
    # cycles give several tags each; bad-quality rows are filtered by rule, the window drops nothing
    good = FX.weighing_readings(spark, SF).where("Status is null or Status <> 'E'").count()
    assert REGISTRY["readings_long"](spark, SF).count() == good


def _rmm1(spark, plant="RMM1", n=240):
    start = R.RMM1_CADENCE_CHANGE + dt.timedelta(seconds=15)
    after = [(15 * k, 50.0) for k in range(n)]
    before = [(-10 * k - 60, 50.0) for k in range(1, n)]
    return readings_df(spark, sorted(before + after), plant=plant, base=start)


def test_by_plant_equals_one_plant_at_a_time(spark):
    window = dict(tbf="2026-07-09 00:00:00", taf="2026-07-10 00:00:00", threshold=10.0)
    readings, tags = _rmm1(spark), tags_df(spark, "RMM1", 1)
    for plant in ("BM2", "WL"):
        readings = readings.unionByName(_rmm1(spark, plant))
        tags = tags.unionByName(tags_df(spark, plant, 1))
    config = local_table(spark, list(R.PLANT_POLICY), schemas.PLANT_CONFIG)
    got = runhours.count_run_hours_by_plant(readings, tags, config, eras=routes.registry_eras(spark),
                                            holidays=R.holiday_dates(), **window)
    got = {r.plant: r for r in got.collect()}
    for plant in ("RMM1", "BM2", "WL"):
        want = routes.count(spark, readings, tags, plant, 0, window["tbf"], window["taf"], 10.0).first().asDict()
        for name, value in want.items():
            assert got[plant][name] == pytest.approx(value) if isinstance(value, float) else got[plant][name] == value, (plant, name)


def test_unknown_plant_fails(spark):
    config = local_table(spark, list(R.PLANT_POLICY), schemas.PLANT_CONFIG)
    with pytest.raises(Exception, match="no configuration for plant NEW"):
        runhours.count_run_hours_by_plant(_rmm1(spark, "NEW"), tags_df(spark, "NEW", 1), config, threshold=1.0,
                                          tbf="2026-07-09 00:00:00", taf="2026-07-10 00:00:00").collect()


def test_uptime_with_a_missing_value(spark):
    r = readings_df(spark, [(0, 20.0), (10, None), (60, 20.0), (70, 20.0)])
    row = reports.uptime(r, tags_df(spark), "2026-01-01 00:00:00", "2026-01-01 01:00:00").first()
    assert row.span_s == 70 and row.running_s == 70 and row.filled_s == 60


def test_holiday_rule_as_a_column(spark):
    df = spark.createDataFrame([(dt.datetime(2026, 1, d), d) for d in (2, 3, 4)], "DateAndTime timestamp_ntz, n int")
    got = with_holiday(df, F.col("n") == 2).collect()
    assert [r.is_holiday for r in sorted(got, key=lambda r: r.n)] == [True, False, False]


def test_tariff_clock_can_be_shifted(spark):
    r = readings_df(spark, [(k * 10, 50.0) for k in range(360)], plant="BM2", base=dt.datetime(2026, 1, 6, 8, 0, 0))
    run = lambda **kw: runhours.count_run_hours(
        r, tags_df(spark, "BM2", 1), threshold=1.0, tbf="2026-01-06 00:00:00", taf="2026-01-06 23:59:59", **kw).first()
    assert (run().A, run().B) == (0.0, 1.0)
    assert (run(tz_offset_minutes=120).A, run(tz_offset_minutes=120).B) == (1.0, 0.0)


@pytest.mark.parametrize("text", ["2026-07-10 08:00:00.", "2026-07-10 08:00.5", "2026-07-10 08:00:00.1234", "2026-7-10  08:00",
                                  "2026-07-10  8:00", "2026-07-10 08:00:60", "2026-07-10x08:00", "٢026-07-10 08:00", ""])
def test_local_time_is_strict(text):
    with pytest.raises(ValueError):
        TM.parse_local(text)

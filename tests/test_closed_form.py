"""Fill counts in closed form against the synthetic rows, and configuration inside the row."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL, tags_df
from millrun import schemas
from millrun.functions.tariff import bucket_of, holiday_flag, points_by_bucket
from millrun.operators import gaps as G
from millrun.operators import joins as J
from millrun.operators import runhours as RH
from millrun.plans.queries import REGISTRY
from millrun.sources.local import local_table

HOLIDAYS = [dt.date(2026, 1, 1), dt.date(2026, 1, 7), dt.date(2026, 1, 8)]


def _readings(spark, seed, n=400, longest_s=4 * 86_400, grain_us=1000):
    """Gaps from milliseconds to days, values that mostly agree."""
    rng = random.Random(seed)
    rows, t = [], {0: dt.datetime(2025, 12, 30), 1: dt.datetime(2025, 12, 31, 8, 59, 59), 2: dt.datetime(1969, 12, 30)}
    for i in range(n):
        tag = rng.randrange(3)
        rows.append(("P", tag, t[tag], rng.choice([1.0, 1.0, 1.01, 5.0]), "G", i))
        gap = rng.choice([10, 15, 21, 600, 3600, rng.random() * longest_s, rng.random() * 100])
        t[tag] += dt.timedelta(microseconds=int(gap * 1e6) // grain_us * grain_us)
    return local_table(spark, rows, schemas.READINGS)


@pytest.mark.parametrize("seed,cadence,cap,offset,grain", [
    (1, 10, 90, 0, 1000), (2, 600, 7200, 0, 1000), (3, 10, 5 * 86_400, 0, 1000), (4, 1 / 3, 5000, 0, 1000),
    (5, 86_400, 40 * 86_400, 0, 1000), (6, 33.333, 86_400 * 3, -420, 1000), (7, 0.0007, 25, 0, 1000), (8, 61, 86_400, 90, 1)])
def test_counts_equal_the_rows(spark, seed, cadence, cap, offset, grain):
    """Per bucket, over all gap lengths, cadences that are no whole milliseconds, caps of days,
    shifted clocks and microsecond times."""
    n = 40 if cadence < 1 else 400
    df = _readings(spark, seed, n, longest_s=60 * 86_400 if cadence > 80_000 else 4 * 86_400, grain_us=grain)
    kw = dict(threshold=0.5, tbf="1960-01-01 00:00:00", taf="2029-01-01 00:00:00", cadence_s=cadence, cap_s=cap, tolerance=0.2,
              points_per_hour=6.0, tz_offset_minutes=offset)
    tags = tags_df(spark)
    closed = RH.count_run_hours(df, tags, holidays=HOLIDAYS, **kw)
    # a Column over the row is a rule that only rows can answer
    rows = RH.count_run_hours(df, tags, holidays=holiday_flag("_clock", HOLIDAYS), **kw)
    a, b = ([tuple(r) for r in x.orderBy("plant", "TagIndex").collect()] for x in (closed, rows))
    assert a == b and sum(r[closed.columns.index("filledReadings")] for r in a) > 0


def test_other_clock_and_calendars(spark):
    """A clock column that synthetic rows copy; the calendar as list, table and function of a date."""
    df = _readings(spark, 11).withColumn("shown", F.timestamp_add("HOUR", F.lit(5), F.col("DateAndTime")))
    kw = dict(threshold=2, op="<", tbf="1960-01-01 00:00:00", taf="2029-01-01 00:00:00", cadence_s=60, cap_s=86_400)
    tags = tags_df(spark)

    def run(holidays, **more):
        return [tuple(r) for r in RH.count_run_hours(df, tags, holidays=holidays, **kw, **more).orderBy("TagIndex").collect()]

    want = run(HOLIDAYS)
    table = local_table(spark, [(d,) for d in HOLIDAYS], schemas.HOLIDAYS)
    assert run(table) == want == run(holiday_flag("_clock", HOLIDAYS))
    assert run(lambda d: holiday_flag(d, HOLIDAYS)) == want
    assert run(HOLIDAYS, time_field="shown") == run(holiday_flag("_clock", HOLIDAYS), time_field="shown") != want


def test_large_calendar_is_joined(spark, monkeypatch):
    from millrun.functions import tariff
    df = _readings(spark, 12)
    table = local_table(spark, [(d,) for d in HOLIDAYS], schemas.HOLIDAYS)
    kw = dict(threshold=0, tbf="1960-01-01 00:00:00", taf="2029-01-01 00:00:00", cadence_s=60, cap_s=86_400, holidays=table)
    want = [tuple(r) for r in RH.count_run_hours(df, tags_df(spark), **kw).orderBy("TagIndex").collect()]
    monkeypatch.setattr(tariff, "INLINE_DATES", 2)
    assert [tuple(r) for r in RH.count_run_hours(df, tags_df(spark), **kw).orderBy("TagIndex").collect()] == want


def test_points_at_the_edges(spark):
    """Points on the very milliseconds where buckets begin and end."""
    rows = []
    for day in (dt.datetime(2026, 1, 5), dt.datetime(2026, 1, 7), dt.datetime(2026, 1, 10)):
        for clock in ("05:59:59", "06:00:00", "08:59:59", "09:00:00", "17:59:59", "18:00:00", "21:59:59", "22:00:00", "23:59:58"):
            for ms in (0, 999):
                t = dt.datetime.combine(day.date(), dt.time.fromisoformat(clock)) + dt.timedelta(milliseconds=ms)
                rows += [(t, float(cad), n) for cad in (1, 1000, 86_400_000) for n in (0, 1, 3)]
    df = spark.createDataFrame(rows, "t timestamp_ntz, cad double, n int").withColumn("id", F.monotonically_increasing_id())
    rule = lambda d: holiday_flag(d, HOLIDAYS)
    got = {r.id: tuple(r.p) if r.p else (0, 0, 0, 0) for r in df.select(
        "id", points_by_bucket(F.col("t"), F.col("cad"), F.col("n"), rule).alias("p")).collect()}
    points = df.where("n > 0").select("id", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("k"), "t", "cad")
    points = points.withColumn("at", F.timestamp_add("MILLISECOND", (F.col("k") * F.col("cad")).cast("long"), F.col("t")))
    want = {i: [0, 0, 0, 0] for i in got}
    for r in points.select("id", bucket_of("at", rule(F.to_date("at"))).alias("b")).collect():
        want[r.id]["ABCD".index(r.b)] += 1
    assert got == {i: tuple(w) for i, w in want.items()}


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["run_hours", "tariff_hours", "tariff_hours_raw", "tariff_hours_calendar", "run_hours_eras",
                                  "run_hours_by_plant", "run_hours_by_plant_eras", "run_hours_forced_era",
                                  "gap_correction_report", "gap_fill_audit"])
def test_count_routes_make_no_rows_and_loop_over_none(spark, name):
    plan = _plan(REGISTRY[name](spark, SF_SMALL))
    assert "Generate" not in plan and "explode" not in plan
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_fill_options_plan(spark):
    assert "NestedLoop" not in _plan(REGISTRY["fill_options"](spark, SF_SMALL))


ERAS = [("P", 0, None, dt.datetime(2026, 1, 2), 10.0, 360.0), ("P", 1, dt.datetime(2026, 1, 2), dt.datetime(2026, 1, 3), 60.0, 60.0),
        ("P", 2, dt.datetime(2026, 1, 4), None, 30.0, 120.0), ("Q", 7, dt.datetime(2026, 1, 1), dt.datetime(2026, 1, 5), 5.0, 720.0)]


@pytest.mark.parametrize("inline", [200, 1])
def test_eras_are_searched_within_the_row(spark, monkeypatch, inline):
    """Edges (from exclusive, to inclusive), a hole between eras, plants without eras; inline and joined."""
    monkeypatch.setattr(J, "INLINE_ROWS", inline)
    times = [dt.datetime(2025, 12, 31), *[dt.datetime(2026, 1, d) + dt.timedelta(milliseconds=m) for d in range(1, 6) for m in (-1, 0, 1)]]
    df = spark.createDataFrame([(p, t) for p in ("P", "Q", "R", None) for t in times], "plant string, DateAndTime timestamp_ntz")
    eras = local_table(spark, ERAS, schemas.ERAS)
    got = {(r.plant, r.DateAndTime): (r.era_id, r.era_cadence_s, r.era_pph) for r in J.assign_era(df, eras).collect()}
    for (plant, t), found in got.items():
        want = [(e, c, p) for q, e, a, b, c, p in ERAS if q == plant and (a is None or t > a) and (b is None or t <= b)]
        assert [found] == (want or [(None, None, None)])
    assert len(got) == df.count()


@pytest.mark.parametrize("inline", [200, 0])
def test_overlapping_eras_are_an_error(spark, monkeypatch, inline):
    monkeypatch.setattr(J, "INLINE_ROWS", inline)
    rows = [ERAS[0], ("P", 1, dt.datetime(2026, 1, 1), None, 60.0, 60.0)]
    df = spark.createDataFrame([("P", dt.datetime(2026, 1, 1))], "plant string, DateAndTime timestamp_ntz")
    with pytest.raises(Exception, match="overlap"):
        J.assign_era(df, local_table(spark, rows, schemas.ERAS)).collect()


@pytest.mark.parametrize("inline", [200, 1])
def test_attach(spark, monkeypatch, inline):
    monkeypatch.setattr(J, "INLINE_ROWS", inline)
    dim = spark.createDataFrame([("a", 1, ["x"], None), ("b", 1, ["x", "y"], True), ("c", None, None, False)],
                                "k string, n int, l array<string>, f boolean")
    df = spark.createDataFrame([("a",), ("b",), ("c",), ("d",), (None,)], "k string")
    got = {r.k: (r.n, r.l, r.f) for r in J.attach(df, dim, "k").collect()}
    assert got == {"a": (1, ["x"], None), "b": (1, ["x", "y"], True), "c": (None, None, False), "d": (None, None, None), None: (None, None, None)}


def test_never_filled_plants_pass_no_window(spark):
    """Only readings of filled plants are shuffled by the successor's keys."""
    df = _readings(spark, 20).unionByName(_readings(spark, 21).withColumn("plant", F.lit("Q")))
    cfg = local_table(spark, [("P", ["E"], 10.0, 6.0, True, True), ("Q", ["E"], 10.0, 6.0, False, False)], schemas.PLANT_CONFIG)
    tags = tags_df(spark).unionByName(tags_df(spark, "Q"))
    kw = dict(tbf="1960-01-01 00:00:00", taf="2029-01-01 00:00:00", cap_s=3600)
    x, _ = RH._classified_by_plant(df, tags, cfg, tolerance=None, chunk_ms=G.CHUNK_MS, eras=None, **kw)
    plan = x._jdf.queryExecution().optimizedPlan().toString()
    assert "NOT (plant" in plan or "plant#" in plan
    got = {(r.plant, r.TagIndex): r for r in RH.count_run_hours_by_plant(df, tags, cfg, threshold=0, **kw).collect()}
    one = {r.TagIndex: r for r in RH.count_run_hours(df.where("plant = 'Q'"), tags_df(spark, "Q"), threshold=0, fill=False,
                                                     points_per_hour=6.0, tbf=kw["tbf"], taf=kw["taf"]).collect()}
    assert all(got["Q", i]["count"] == r["count"] and got["Q", i].hour == r.hour for i, r in one.items())
    assert got["Q", 0].realReadings is None and got["P", 0].filledReadings > 0

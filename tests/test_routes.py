"""Route facade: each plant's policy applied from the registry."""

import datetime as dt

import pytest

from millrun import schemas
from millrun.plans import routes
from millrun.sources import registry as R
from millrun.sources.local import local_table

DAY = "2026-07-06"           # a Monday
TBF, TAF = f"{DAY} 00:00:00", f"{DAY} 23:59:59"


def _readings(spark, plant, pts, base=dt.datetime(2026, 7, 6, 10, 0, 0), tag=0):
    rows = [(plant, tag, base + dt.timedelta(seconds=o), float(v), st, i)
            for i, (o, v, st) in enumerate(pts)]
    return local_table(spark, rows, schemas.READINGS)


def _tags(spark, plant, n=2):
    return local_table(spark, [(plant, i, f"{plant}_T{i}") for i in range(n)], schemas.TAGS)


def _one(df, tag=0):
    return [r for r in df.collect() if r.TagIndex == tag][0]


def test_count_fills_by_default_and_can_be_turned_off(spark):
    r = _readings(spark, "BM2", [(0, 100, "G"), (20, 100, "G")])
    t = _tags(spark, "BM2")
    on = _one(routes.count(spark, r, t, "BM2", 0, TBF, TAF, 50))
    assert on["count"] == 3 and on.filledReadings == 1 and abs(on.hour - 3 / 360) < 1e-15
    off = _one(routes.count(spark, r, t, "BM2", 0, TBF, TAF, 50, fillGaps=False))
    assert off["count"] == 2 and off.filledReadings is None


def test_counter_plant_drops_three_codes_and_never_fills(spark):
    r = _readings(spark, "Hour_OFIL", [(0, 100, "G"), (20, 100, "U"), (40, 100, "S"), (60, 100, "G")])
    t = _tags(spark, "Hour_OFIL")
    x = _one(routes.count(spark, r, t, "Hour_OFIL", 0, TBF, TAF, 50, pointsPerHour=60))
    assert x["count"] == 2 and x.realReadings is None and abs(x.hour - 2 / 60) < 1e-15


def test_rmm1_splits_eras_unless_forced(spark):
    change = R.RMM1_CADENCE_CHANGE
    pts = [(-20, 5, "G"), (-10, 5, "G"), (0, 5, "G"), (15, 5, "G"), (30, 5, "G")]
    r = _readings(spark, "RMM1", pts, base=change)
    t = _tags(spark, "RMM1")
    tbf, taf = "2026-07-09 00:00:00", "2026-07-09 23:59:59"
    x = _one(routes.count(spark, r, t, "RMM1", 0, tbf, taf, 0))
    assert x["count"] == 5 and abs(x.hour - (3 / 360 + 2 / 240)) < 1e-12
    assert x.filledReadings == 0 and x.flaggedGaps == 0
    forced = _one(routes.count(spark, r, t, "RMM1", 0, tbf, taf, 0, pointsPerHour=240))
    assert abs(forced.hour - 5 / 240) < 1e-12


def test_weighing_count_is_count_and_hour_only(spark):
    r = _readings(spark, "WL", [(0, 10, "G"), (3600, 20, "G")])
    t = _tags(spark, "WL")
    x = routes.count(spark, r, t, "WL", 0, TBF, TAF, 15)
    assert x.columns == ["plant", "TagIndex", "tagName", "date_before", "date_after", "count", "hour"]
    assert _one(x)["count"] == 1


def test_window_fill_only_where_allowed(spark):
    pts = [(0, 100, "G"), (20, 100, "G")]
    bm2 = routes.window(_readings(spark, "BM2", pts), _tags(spark, "BM2"), "BM2", 0, TBF, TAF,
                        fillGaps=True)
    assert bm2.count() == 3
    wl = routes.window(_readings(spark, "WL", pts), _tags(spark, "WL"), "WL", 0, TBF, TAF, fillGaps=True)
    assert wl.count() == 2 and "Filled" not in wl.columns


def test_all_tags_in_one_plan_and_unknown_plant(spark):
    r = _readings(spark, "BM2", [(0, 100, "G"), (10, 100, "G")]).unionByName(
        _readings(spark, "BM2", [(0, 1, "G")], tag=1))
    out = routes.count(spark, r, _tags(spark, "BM2"), "BM2", None, TBF, TAF, 50)
    assert sorted((x.TagIndex, x["count"]) for x in out.collect()) == [(0, 2), (1, 0)]
    with pytest.raises(ValueError):
        routes.policy("NOPE")


def test_catalog_nested_one_row_per_plant(spark):
    from millrun.sources import fixtures as FX
    tags = FX.tags(spark)
    rows = {r.plant: r for r in routes.catalog(tags, FX.plants(spark)).collect()}
    assert rows["WL"].description == "Wheel Loader Weight"
    assert [t.TagIndex for t in rows["WL"].tags] == list(range(1, 8))
    assert rows["BM2"].tags is None          # listed plant without tags in this table
    assert [r.TagName for r in routes.tag_list(tags, "EVT").collect()][:2] == ["TAG_0", "TAG_1"]


def test_listing_and_statistics_routes(spark):
    pts = [(0, 10, "G"), (10, 20, "E"), (20, 30, "G"), (30, 40, "G")]
    r = _readings(spark, "CT7_con", pts)
    t = _tags(spark, "CT7_con")
    a = _one(routes.avg(spark, r, t, "CT7_con", 0, TBF, TAF))
    assert (a.minVal, a.maxVal, a.n) == (10.0, 40.0, 3) and abs(a.avgVal - 80 / 3) < 1e-12
    c = _one(routes.cal_cap(spark, r, t, "CT7_con", 0, TBF, TAF))
    assert c.cap == 80 / 6
    missing = routes.avg(spark, r, t, "CT7_con", 9, TBF, TAF).first()
    assert missing.tagName is None and missing.avgVal is None and missing.n == 0
    assert routes.latest(r, t, "CT7_con", 0).first().Val == 40.0
    assert routes.all_newest(r, t, "CT7_con").count() == 3
    asc = [x.Val for x in routes.window(r, t, "CT7_con", 0, TBF, TAF, ascending=True).collect()]
    assert asc == [10.0, 30.0, 40.0]


def test_weighing_routes(spark):
    names = [n for n, _ in R.WEIGHING_TAGS]
    t = local_table(spark, [("WL", i + 1, n) for i, n in enumerate(names)], schemas.TAGS)
    r = _readings(spark, "WL", [(0, 7, "G"), (0, 25, "G"), (5, 8, "G"), (5, 0, "G")])
    r = r.withColumn("TagIndex", (r.seq % 2 * 2 + 1).cast("int"))   # tags 1 (id) and 3 (Weight)
    cycles, summary = routes.pivot_filter(r, t, TBF, TAF, minWeight="0")
    assert cycles.count() == 2 and summary.first().cycles == 2
    d = routes.datacal(spark, r, t, 3, TBF, TAF).first()
    assert d["count"] == 1 and d.avgVal == 25.0                   # zero weight kept in avg
    assert routes.long_form(r, t, "WL", TBF, TAF).count() == 4
    with pytest.raises(ValueError):
        routes.pivot_filter(r, t, TBF, TAF, colour=1)

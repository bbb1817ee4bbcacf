"""Storage round trips: partitioned historian/alarm datasets, JSON readings, jobs."""

import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from millrun.operators import alarms as A
from millrun.plans import params as P
from millrun.plans.jobs import gap_report_job
from millrun.plans.queries import REGISTRY
from millrun.sources import fixtures as FX
from millrun.sources import historian as H


def _same(a, b):
    b = b.select(*a.columns)
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_readings_round_trip_with_pruning(spark, capsys):
    d = tempfile.mkdtemp(prefix="millrun-test-")
    src = FX.readings(spark, SF_SMALL)
    H.write_readings(src, f"{d}/readings")
    back = H.read_readings(spark, f"{d}/readings", plants=["EVT"], tbf=P.TBF, taf=P.TAF)
    back.explain()
    plan = capsys.readouterr().out
    assert "PartitionFilters: [isnotnull(plant" in plan and "event_date" in plan
    want = src.where(F.col("DateAndTime").between(F.lit(P.TBF).cast("timestamp_ntz"),
                                                  F.lit(P.TAF).cast("timestamp_ntz")))
    assert _same(back.drop("event_date"), want)


def test_alarm_log_round_trip_and_date_pruning(spark, capsys):
    d = tempfile.mkdtemp(prefix="millrun-test-")
    ev = FX.alarm_events(spark, SF_SMALL)
    H.write_alarm_events(ev, f"{d}/alarms")
    back = H.read_alarm_events(spark, f"{d}/alarms")
    a = A.noisy(back, as_of=P.AS_OF, hours=48, top=50)
    b = A.noisy(ev, as_of=P.AS_OF, hours=48, top=50)
    assert _same(a, b) and a.count() > 0
    a.explain()
    plan = capsys.readouterr().out
    assert "GreaterThanOrEqual(TicksTimeStamp," in plan          # ticks bound pushed to Parquet
    assert "PartitionFilters: [isnotnull(event_date" in plan     # day directories pruned


def test_newest_events_of_a_stored_log(spark):
    d = tempfile.mkdtemp(prefix="millrun-test-")
    ev = FX.alarm_events(spark, SF_SMALL)
    H.write_alarm_events(ev, f"{d}/alarms")
    back = H.read_alarm_events(spark, f"{d}/alarms")
    for kw in (dict(limit=7), dict(limit=5000), dict(limit=40, exclude_faults=False, source=P.SOURCE)):
        a, b = A.recent(back, as_of=P.AS_OF, **kw), A.recent(ev, as_of=P.AS_OF, **kw)
        assert _same(a, b) and a.count() > 0
    assert _same(A.source_history(back, P.SOURCE, as_of=P.AS_OF, hours=720, limit=3),
                 A.source_history(ev, P.SOURCE, as_of=P.AS_OF, hours=720, limit=3))


def test_json_readings(spark):
    d = tempfile.mkdtemp(prefix="millrun-test-")
    with open(os.path.join(d, "r.json"), "w") as f:
        json.dump([{"DateAndTime": "2026-07-06T10:00:00.000Z", "Val": 5},
                   {"DateAndTime": "2026-07-06 10:00:20", "Val": 5.0}], f)
    r = H.read_readings_json(spark, d, "BM2", 0, array=True).orderBy("DateAndTime").collect()
    assert [x.DateAndTime.second for x in r] == [0, 20] and r[0].Val == 5.0


def test_json_lines_keep_every_row(spark):
    d = tempfile.mkdtemp(prefix="millrun-test-")
    with open(os.path.join(d, "r.json"), "w") as f:
        for k in range(5):
            f.write(json.dumps({"DateAndTime": f"2026-07-06T10:00:0{k}.1239Z", "Val": k}) + "\n")
    r = H.read_readings_json(spark, d, "BM2", 0)
    assert [x.Val for x in r.orderBy("DateAndTime").collect()] == [0, 1, 2, 3, 4]
    assert {x.seq for x in r.collect()} == {x.seq for x in r.repartition(3).collect()}
    with open(os.path.join(d, "s.json"), "w") as f:
        f.write("{not json\n")
    with pytest.raises(Exception):
        H.read_readings_json(spark, d, "BM2", 0).collect()


def test_gap_report_job_matches_queries(spark):
    d = tempfile.mkdtemp(prefix="millrun-test-")
    readings = FX.readings(spark, SF_SMALL)
    tags = FX.tags(spark).where(F.col("plant") == "EVT")
    paths = gap_report_job(spark, readings, tags, d, tbf=P.TBF, taf=P.TAF, cadence_s=P.CADENCE_S,
                           cap_s=P.CAP_S, tolerance=P.TOLERANCE)
    audit = spark.read.parquet(paths["fill_audit"])
    assert _same(audit, REGISTRY["gap_fill_audit"](spark, SF_SMALL))
    flagged = spark.read.parquet(paths["flagged_gaps"])
    assert _same(flagged, REGISTRY["flagged_gaps"](spark, SF_SMALL))


def test_daily_report_job_end_to_end(spark):
    from millrun.plans.jobs import main
    d = tempfile.mkdtemp(prefix="millrun-test-")
    H.write_readings(FX.readings(spark, SF_SMALL), f"{d}/readings")
    FX.tags(spark).write.parquet(f"{d}/tags")
    FX.plant_config(spark).write.parquet(f"{d}/config")
    rc = main(["--readings", f"{d}/readings", "--tags", f"{d}/tags", "--out", f"{d}/out",
               "--tbf", P.TBF, "--taf", P.TAF, "--threshold", str(P.THRESHOLD), "--profile", "local",
               "--cap", str(P.CAP_S), "--tolerance", str(P.TOLERANCE), "--plant-config", f"{d}/config"])
    assert rc == 0
    hours = spark.read.parquet(f"{d}/out/run_hours")
    cols = ["plant", "TagIndex", "count", "hour", "realReadings", "filledReadings", "flaggedGaps"]
    want = REGISTRY["run_hours_by_plant"](spark, SF_SMALL).where("plant = 'EVT' AND TagIndex < 7")
    assert _same(want.select(*cols), hours.where("plant = 'EVT'").select(*cols))
    audit = spark.read.parquet(f"{d}/out/fill_audit")
    assert _same(audit, REGISTRY["gap_fill_audit"](spark, SF_SMALL))

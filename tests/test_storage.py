"""Bucketed readings, counted writes, the grain of stored times, plans of reports."""

import datetime as dt
import json
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL, tags_df
from millrun import schemas
from millrun.operators import gaps as G
from millrun.operators import runhours as RH
from millrun.operators import weighing as W
from millrun.operators.joins import known_only
from millrun.plans import routes
from millrun.plans.queries import REGISTRY
from millrun.sources import historian as H
from millrun.sources import registry as R
from millrun.sources.local import local_table

SPAN = dict(tbf="2026-01-01 00:00:00", taf="2027-01-01 00:00:00")


def _dir():
    return tempfile.mkdtemp(prefix="millrun-test-")


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def _hot(spark, n=3000):
    """One tag with most of the readings, over many chunks."""
    rng = random.Random(4)
    rows, t = [], [dt.datetime(2026, 1, 1)] * 4
    for i in range(n):
        tag = 0 if rng.random() < 0.8 else rng.randrange(1, 4)
        t[tag] += dt.timedelta(seconds=rng.choice([10, 10, 10, 20, 60, 400]))
        rows.append(("P", tag, t[tag], rng.choice([1.0, 1.0, 5.0]), rng.choice(["G"] * 9 + ["E"]), i))
    return local_table(spark, rows, schemas.READINGS)


@pytest.fixture
def bucketed(spark):
    df = _hot(spark)
    spark.sql("DROP TABLE IF EXISTS bucketed_readings")
    H.write_bucketed(df, "bucketed_readings", 6, path=_dir())
    yield df, H.read_bucketed(spark, "bucketed_readings")
    spark.sql("DROP TABLE IF EXISTS bucketed_readings")


def _exchanges_below_first_window(df):
    """Shuffles under the lowest window of the plan (a broadcast of a dimension isn't one)."""
    lines = df._jdf.queryExecution().sparkPlan().toString().splitlines()
    plan = df._jdf.queryExecution().executedPlan().toString().splitlines()
    assert any("Window" in x for x in lines)
    last = max(i for i, x in enumerate(plan) if "Window [" in x or "Window (" in x)
    return [x for x in plan[last:] if "Exchange hashpartitioning" in x or "Exchange rangepartitioning" in x]


def test_flagged_gaps_of_bucketed_readings_need_no_shuffle(spark, bucketed):
    df, table = bucketed
    tags = tags_df(spark)

    def classified(r, chunk):
        cols = [*G.SERIES, *G.ORDER, "Val", *(["_chunk"] if chunk == "stored" else [])]
        r = known_only(RH.select_window(r, SPAN["tbf"], SPAN["taf"]), tags).select(*cols)
        return G.gap_classified(r, 10, 90, 0.2, chunk_ms=chunk)

    stored = classified(table, "stored")
    assert _exchanges_below_first_window(stored) == []
    assert _exchanges_below_first_window(classified(df, G.CHUNK_MS)) != []
    assert _rows(G.flagged_gaps(stored)) == _rows(G.flagged_gaps(classified(df, None)))
    assert _rows(G.fill_audit(stored)) == _rows(G.fill_audit(classified(df, G.CHUNK_MS)))
    # the hot tag's chunks are spread over the buckets
    hot = table.where("TagIndex = 0")
    per_bucket = [r["count"] for r in hot.groupBy(F.pmod(F.hash("plant", "TagIndex", "_chunk"), F.lit(6))).count().collect()]
    assert len(per_bucket) == 6 and max(per_bucket) < 0.4 * sum(per_bucket)


def test_count_is_taken_in_the_run_that_writes(spark):
    """Every input row passes once, and the count is that of the rows."""
    seen = spark.sparkContext.accumulator(0)
    d = _dir()

    def passing(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = _hot(spark).mapInArrow(passing, schemas.READINGS).where("Val > 1").select("TagIndex", "Val")
    n = H.write_counted(df, f"{d}/out")
    assert seen.value == 3000 and n == spark.read.json(f"{d}/out").count() > 0
    assert H.write_counted(df.where("Val > 99"), f"{d}/none") == 0


def test_times_are_stored_in_milliseconds(spark):
    """Two rows of one weighing cycle, 0.4 ms apart, are one cycle."""
    t = dt.datetime(2026, 1, 1, 8, 0, 0, 12_300)
    names = [n for n, _ in R.WEIGHING_TAGS]
    tags = local_table(spark, [("WL", i + 1, n) for i, n in enumerate(names)], schemas.TAGS)
    rows = [("WL", 1, t, 7.0, "G", 0), ("WL", 3, t + dt.timedelta(microseconds=400), 21.5, "G", 1),
            ("WL", 3, dt.datetime(2026, 1, 2, 0, 0, 0, 900), 1.0, "G", 2)]
    df = local_table(spark, rows, schemas.READINGS)
    d = _dir()
    H.write_readings(df, d)
    # a dataset that was stored finer is cut when it is read, up to the window's last millisecond
    raw = _dir()
    df.withColumn("event_date", F.to_date("DateAndTime")).write.mode("overwrite").partitionBy("plant", "event_date").parquet(raw)
    for path in (d, raw):
        back = H.read_readings(spark, path, tbf="2026-01-01 00:00:00", taf="2026-01-02 00:00:00")
        c = W.cycles(back, tags, "2026-01-01 00:00:00", "2026-01-02 00:00:00").orderBy("DateAndTime").collect()
        assert [(x.DateAndTime, x.id, x.Weight) for x in c] == [(t.replace(microsecond=12_000), 7.0, 21.5), (dt.datetime(2026, 1, 2), None, 1.0)]


def test_summary_echoes_the_given_filters(spark):
    tags = local_table(spark, [("WL", i + 1, n) for i, (n, _) in enumerate(R.WEIGHING_TAGS)], schemas.TAGS)
    df = local_table(spark, [("WL", 3, dt.datetime(2026, 1, 1), 1.005, "G", 0)], schemas.READINGS)
    rows, summary = routes.pivot_filter(df, tags, "2026-01-01 00:00:00", "2026-01-02 00:00:00", maxWeight=10)
    assert json.loads(summary.first().filters) == {"maxWeight": 10}
    assert summary.first().totalWeight == 1.0 and rows.first().Weight == 1.0


def test_completeness_scans_once(spark):
    plan = REGISTRY["logging_completeness"](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1


def test_filled_readings_are_sorted_within_plant_and_day(spark):
    df = REGISTRY["gap_filled_readings"](spark, SF_SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan
    for part in df.rdd.glom().collect():
        keys = [(r.plant, r.DateAndTime.date(), r.TagIndex, r.DateAndTime, r.Filled) for r in part]
        assert keys == sorted(keys)

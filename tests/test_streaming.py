"""Streaming jobs fed by file sources must agree with the batch operators."""

import tempfile
import uuid

from pyspark.sql import functions as F

from conftest import SF_SMALL
from millrun import schemas
from millrun.operators import alarms as A
from millrun.operators import gaps as G
from millrun.operators.joins import known_only
from millrun.operators.runhours import select_window
from millrun.plans import params as P
from millrun.sources import fixtures as FX
from millrun.streaming.alarms import daily_counts_stream, heartbeat_stream
from millrun.streaming.gaps import gap_events_stream, with_timestamps
from millrun.streaming.run import start

CUTS = ["2024-01-11 00:00:00", "2024-01-21 00:00:00"]


def _write_in_time_order(df, ts, path):
    """Three appends, oldest first, one file each (processed in that order)."""
    lo = [None] + CUTS
    hi = CUTS + [None]
    for a, b in zip(lo, hi):
        part = df
        if a:
            part = part.where(F.col(ts) >= F.lit(a).cast("timestamp_ntz"))
        if b:
            part = part.where(F.col(ts) < F.lit(b).cast("timestamp_ntz"))
        part.coalesce(1).write.mode("append").parquet(path)


def _run(spark, df, mode):
    name = "q_" + uuid.uuid4().hex[:8]
    q = start(df, name, mode=mode, fmt="memory")
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return spark.table(name)


def _same(a, b):
    b = b.select(*a.columns)
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_daily_counts_stream_matches_batch(spark):
    d = tempfile.mkdtemp(prefix="millrun-stream-")
    ev = FX.alarm_events(spark, SF_SMALL)
    _write_in_time_order(ev, "EventTimeStamp", d)
    src = spark.readStream.schema(schemas.ALARM_EVENTS).option("maxFilesPerTrigger", 1).parquet(d)
    got = _run(spark, daily_counts_stream(src, watermark="3 days"), "complete")
    want = A.daily(ev, as_of=P.AS_OF, days=P.MAX_DAYS)
    assert _same(want, got)


def test_heartbeat_stream(spark):
    d = tempfile.mkdtemp(prefix="millrun-stream-")
    ev = FX.alarm_events(spark, SF_SMALL)
    _write_in_time_order(ev, "EventTimeStamp", d)
    src = spark.readStream.schema(schemas.ALARM_EVENTS).option("maxFilesPerTrigger", 1).parquet(d)
    got = _run(spark, heartbeat_stream(src), "complete").first()
    want = A.heartbeat(ev, as_of=P.AS_OF).first()
    assert (got.newest_event, got.total_rows) == (want.newest_event, want.total_rows)


def test_gap_events_stream_matches_batch(spark):
    d = tempfile.mkdtemp(prefix="millrun-stream-")
    tags = FX.tags(spark).where(F.col("plant") == "EVT")
    r = known_only(select_window(FX.readings(spark, SF_SMALL), P.TBF, P.TAF, P.BAD), tags)
    _write_in_time_order(r, "DateAndTime", d)
    src = spark.readStream.schema(r.schema).option("maxFilesPerTrigger", 1).parquet(d)
    got = _run(spark, with_timestamps(gap_events_stream(src, P.CADENCE_S, P.CAP_S, P.TOLERANCE)),
               "append")
    c = G.classify_gaps(G.with_successor(r), P.CADENCE_S, P.CAP_S, P.TOLERANCE)
    want = c.where(F.col("gap_kind").isin("bridged", "exceeds cap", "value mismatch across gap")).select(
        "plant", "TagIndex", F.col("DateAndTime").alias("from_ts"),
        F.col("next_DateAndTime").alias("to_ts"), (F.col("gap_ms") / 1000.0).alias("gap_s"),
        F.col("gap_kind").alias("kind"), "n_fill")
    assert got.count() > 0
    assert _same(want, got.where(F.col("kind") != "late readings dropped").drop("late_dropped"))


def test_gap_stream_counts_late_readings(spark):
    import datetime as dt
    from conftest import readings_df
    d = tempfile.mkdtemp(prefix="millrun-stream-")
    base = dt.datetime(2026, 1, 1)
    readings_df(spark, [(100, 1.0), (110, 1.0)], base=base).coalesce(1).write.mode("append").parquet(d)
    readings_df(spark, [(50, 1.0), (60, 1.0), (300, 1.0)], base=base).coalesce(1) \
        .write.mode("append").parquet(d)
    src = spark.readStream.schema(schemas.READINGS).option("maxFilesPerTrigger", 1).parquet(d)
    got = _run(spark, gap_events_stream(src, 10, 90, 0.2), "append").collect()
    late = [r for r in got if r.kind == "late readings dropped"]
    assert [r.late_dropped for r in late] == [2]
    assert [(r.from_ms is not None, r.kind) for r in got if r.kind != "late readings dropped"] == \
        [(True, "exceeds cap")]


def test_gap_stream_on_rocksdb_state_store(spark):
    import datetime as dt
    from conftest import readings_df
    from millrun.session import CLUSTER_CONF
    key = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(key)
    spark.conf.set(key, CLUSTER_CONF[key])
    try:
        d = tempfile.mkdtemp(prefix="millrun-stream-")
        base = dt.datetime(2026, 1, 1)
        readings_df(spark, [(0, 1.0), (10, 1.0)], base=base).coalesce(1).write.mode("append").parquet(d)
        readings_df(spark, [(40, 1.0), (500, 1.0)], base=base).coalesce(1).write.mode("append").parquet(d)
        src = spark.readStream.schema(schemas.READINGS).option("maxFilesPerTrigger", 1).parquet(d)
        got = sorted((r.kind, r.n_fill) for r in _run(spark, gap_events_stream(src, 10, 90, 0.2),
                                                       "append").collect())
        assert got == [("bridged", 2), ("exceeds cap", 0)]
    finally:
        spark.conf.set(key, old)

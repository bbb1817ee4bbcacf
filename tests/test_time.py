"""Ticks anchors, local->UTC bounds and minute boundaries (FIXTURES.md §2)."""

import datetime as dt

import pytest

from millrun.functions import time as TM


def test_ticks_anchors_python():
    assert TM.file_ticks_py(dt.datetime(1601, 1, 1)) == 0
    assert TM.file_ticks_py(dt.datetime(1970, 1, 1)) == 116444736000000000
    t = dt.datetime(2026, 7, 19, 9, 31, 37, 20000)
    assert TM.file_ticks_py(t) == 134289270970200000
    assert TM.file_ticks_py(t + dt.timedelta(milliseconds=1)) - TM.file_ticks_py(t) == 10000
    lo, hi = TM.ticks_range(t, t)
    assert hi - lo == 9999
    assert TM.ticks_range(None, None) == (None, None)


def test_ticks_anchors_spark(spark):
    rows = [(dt.datetime(1970, 1, 1),), (dt.datetime(2026, 7, 19, 9, 31, 37, 20000),)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz")
    got = [r.t for r in df.select(TM.file_ticks("ts").alias("t")).collect()]
    assert got == [116444736000000000, 134289270970200000]


def test_local_to_utc():
    assert TM.local_to_utc("2026-07-10 08:00") == dt.datetime(2026, 7, 10, 1, 0)
    assert TM.local_to_utc("2026-07-10 00:30:00") == dt.datetime(2026, 7, 9, 17, 30)
    assert TM.local_to_utc("2026-07-10T00:30:00.5") == dt.datetime(2026, 7, 9, 17, 30, 0, 500000)


@pytest.mark.parametrize("bad", ["2026-02-30 00:00", "2026-13-01 00:00", "2026-07-10 24:00",
                                 "2026-07-10", "yesterday"])
def test_local_rejects(bad):
    with pytest.raises(ValueError):
        TM.parse_local(bad)


def test_minutes_between_counts_boundaries(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, 0, 0, 59), dt.datetime(2024, 1, 1, 0, 1, 1))],
                               "a timestamp_ntz, b timestamp_ntz")
    assert df.select(TM.minutes_between("a", "b").alias("m")).first().m == 1


def test_trunc_ms_is_zone_independent(spark):
    ts = dt.datetime(2024, 3, 10, 2, 30, 7, 179575)       # inside a US DST gap
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        df = spark.createDataFrame([(ts,)], "ts timestamp_ntz")
        got = df.select(TM.trunc_ms("ts").alias("t")).first().t
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert got == dt.datetime(2024, 3, 10, 2, 30, 7, 179000)


def test_iso_text(spark):
    df = spark.createDataFrame([("2026-07-10T08:00:00+07:00",), ("2026-07-10 08:00:00",),
                                ("2026-07-10T01:00:00Z",)], "s string")
    got = [r.t for r in df.select(TM.iso_text_to_ntz("s").alias("t")).collect()]
    assert got == [dt.datetime(2026, 7, 10, 1), dt.datetime(2026, 7, 10, 8), dt.datetime(2026, 7, 10, 1)]


def test_epoch_millis_and_offset(spark):
    df = spark.createDataFrame([(1783260000123,)], "ms long")
    r = df.select(TM.epoch_millis_to_ntz("ms").alias("t"),
                  TM.with_offset_minutes(TM.epoch_millis_to_ntz("ms"), 420).alias("local")).first()
    assert r.t == dt.datetime(2026, 7, 5, 14, 0, 0, 123000)
    assert r.local == dt.datetime(2026, 7, 5, 21, 0, 0, 123000)

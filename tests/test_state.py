"""Newest-first walk, kept state and rollups over stored data."""

import datetime as dt
import os
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL, tags_df
from millrun import schemas
from millrun.operators import alarms as A
from millrun.operators import newest as N
from millrun.operators import readings as RD
from millrun.operators import rollup as RU
from millrun.plans import params as P
from millrun.sources import fixtures as FX
from millrun.sources import historian as H
from millrun.sources.local import local_table


def _dir():
    return tempfile.mkdtemp(prefix="millrun-test-")


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def _same(a, b):
    a, b = _rows(a.select(*sorted(a.columns))), _rows(b.select(*sorted(b.columns)))
    assert a == b


def _log(spark, path, days=30):
    """The fixture log stored by day."""
    ev = FX.alarm_events(spark, SF_SMALL)
    H.write_alarm_events(ev, path)
    return ev, H.read_alarm_events(spark, path)


def _spoil(path, before):
    """Make the files of all days before a day unreadable; returns how many days that were."""
    n = 0
    for name in os.listdir(path):
        if name.startswith("event_date=") and name.split("=")[1] < before.isoformat():
            n += 1
            for f in os.listdir(f"{path}/{name}"):
                if f.endswith(".parquet"):
                    with open(f"{path}/{name}/{f}", "wb") as out:
                        out.write(b"not a parquet file")
                    crc = f"{path}/{name}/.{f}.crc"
                    if os.path.exists(crc):
                        os.remove(crc)
    return n


CASES = [dict(limit=20), dict(limit=150), dict(limit=60, exclude_faults=False, source=P.SOURCE),
         dict(limit=9, condition="TRIP", group=P.GROUP), dict(limit=3, exclude_faults=False, from_local="2024-01-05 00:00:00",
                                                              to_local="2024-01-20 00:00:00")]


@pytest.mark.parametrize("kw", CASES)
def test_only_the_newest_days_that_hold_the_rows_are_opened(spark, kw):
    """Older days can't even be read: they are spoilt, all but those the walk may open."""
    d = _dir()
    ev, back = _log(spark, d)
    want = _rows(A.recent(ev, as_of=P.AS_OF, **kw))
    lo, hi = A.time_window(P.AS_OF, None, kw.get("from_local"), kw.get("to_local"))
    e = A.in_ticks(back, lo, hi)
    e = e.where(A.not_fault_noise()) if kw.get("exclude_faults", True) else e
    e = A._opt_eq(A._opt_eq(e, "SourceName", kw.get("source")), "GroupPath", kw.get("group"))
    e = e.where(A.condition_family(kw["condition"])) if kw.get("condition") else e
    per_day = sorted(((r["event_date"], r["count"]) for r in e.groupBy("event_date").count().collect()), reverse=True)
    held, first = 0, None
    for day, n in per_day:
        held, first = held + n, day
        if held >= kw["limit"]:
            break
    newest = min(dt.date(2024, 1, 30), hi.date() if hi else dt.date.max)
    if per_day[0][0] == newest:  # no day without a row is walked: nothing more may be opened
        spoilt = _spoil(d, first)
        assert spoilt > 5 or kw["limit"] > 100 or kw.get("source")
    assert _rows(A.recent(H.read_alarm_events(spark, d), as_of=P.AS_OF, **kw)) == want


def test_days_opened_are_counted(spark, monkeypatch):
    """An unfiltered walk opens just the days that hold the rows, the densest day telling how many."""
    d = _dir()
    start = dt.datetime(2024, 3, 1, 12)
    for n, day in enumerate(range(20)):
        rows = [(str(1000 * day + i), start + dt.timedelta(days=day, seconds=i)) for i in range(10)]
        df = spark.createDataFrame(rows, "EventID string, EventTimeStamp timestamp_ntz").withColumn("event_date", F.to_date("EventTimeStamp"))
        df.write.mode("append").partitionBy("event_date").parquet(d)
    stored = spark.read.parquet(d)
    assert N.stored_days(stored) == {(): [dt.date(2024, 3, 20) - dt.timedelta(days=k) for k in range(20)]}
    for want in (1, 10, 11, 35, 95, 200, 1000):
        days = min(20, -(-want // 10))
        assert N.first_days(stored, want) == {(): dt.date(2024, 3, 20) - dt.timedelta(days=days - 1)}
    rare = stored.where(F.col("EventID") == "4003")
    assert N.newest_days(rare, 1).collect()[0].EventID == "4003"
    assert N.first_days(stored.where("EventID = 'x'"), 1) == {(): dt.date(2024, 3, 1)}
    _spoil(d, dt.date(2024, 3, 17))  # four days are left: enough for 40 rows
    assert N.first_days(spark.read.schema(stored.schema).parquet(d), 40) == {(): dt.date(2024, 3, 17)}
    plain = FX.alarm_events(spark, SF_SMALL)
    assert N.newest_days(plain, 5) is plain


def test_newest_readings_of_stored_plants(spark):
    """Each plant has its own days; an old plant's newest day is found behind a busy one's."""
    rng = random.Random(3)
    rows = []
    for plant, first, days in (("P", 0, 40), ("Q", -300, 20), ("R 1/x", 30, 2)):
        for day in range(days):
            for k in range(rng.randrange(1, 9)):
                t = dt.datetime(2024, 5, 1) + dt.timedelta(days=first + day, minutes=7 * k)
                rows.append((plant, k % 3, t, float(k), rng.choice(["G", "G", "E"]), k))
    df = local_table(spark, rows, schemas.READINGS)
    tags = tags_df(spark, "P").unionByName(tags_df(spark, "Q")).unionByName(tags_df(spark, "R 1/x"))
    d = _dir()
    H.write_readings(df, d)
    for n in (1, 12, 500):
        _same(RD.newest(H.read_readings(spark, d), tags, n), RD.newest(df, tags, n))


def test_latest_state_equals_recomputation(spark):
    """Any batches of days, a failed run and a repeated run give the full computation."""
    log_dir, state_dir = _dir(), f"{_dir()}/state"
    ev, log = _log(spark, log_dir)
    for day in (3, 4, 11, 20):
        H.advance_state(log, state_dir, dt.date(2024, 1, day), A.active_state)
    # a run that fails while it merges leaves no state behind
    broken = lambda s, new: A.active_state(s, new).withColumn(
        "Severity", F.raise_error(F.lit("lost")).cast("int"))
    with pytest.raises(Exception, match="lost"):
        H.advance_state(log, state_dir, dt.date(2024, 1, 28), broken)
    assert H._partition_days(spark, state_dir, "reached")[-1] == dt.date(2024, 1, 20)
    for day in (28, 28, 31):
        state = H.advance_state(log, state_dir, dt.date(2024, 1, day), A.active_state)
    assert H.read_state(spark, state_dir).count() == state.count()
    for kw in (dict(hours=720), dict(hours=720, acked=True), dict(hours=90, condition="TRIP"),
               dict(hours=720, group=P.GROUP), dict(hours=1)):
        _same(A.active_from_state(state, as_of=P.AS_OF, **kw), A.active(ev, as_of=P.AS_OF, **kw))


def test_state_reads_new_days_only(spark):
    log_dir, state_dir = _dir(), f"{_dir()}/state"
    ev, log = _log(spark, log_dir)
    H.advance_state(log, state_dir, dt.date(2024, 1, 20), A.active_state)
    _spoil(log_dir, dt.date(2024, 1, 21))
    state = H.advance_state(H.read_alarm_events(spark, log_dir), state_dir, dt.date(2024, 1, 31), A.active_state)
    _same(A.active_from_state(state, as_of=P.AS_OF, hours=720), A.active(ev, as_of=P.AS_OF, hours=720))


def test_latest_with_ties_nulls_and_moving_groups(spark):
    """Equal ticks go by event id; null keys are keys; an alarm whose group changes."""
    ev = FX.alarm_events(spark, SF_SMALL)
    odd = ev.limit(40).withColumns({
        "TicksTimeStamp": F.lit(133500000000000000) + (F.col("EventID").cast("long") % 3),
        "SourceName": F.when(F.col("EventID").cast("long") % 4 == 0, F.lit(None).cast("string")).otherwise(F.lit("S")),
        "GroupPath": F.when(F.col("EventID").cast("long") % 2 == 0, "G1.x").otherwise(F.lit(None).cast("string")),
        "Active": F.lit(True), "Message": F.lit(None).cast("string")})
    as_of = dt.datetime(2024, 1, 20)
    want = {}
    for r in sorted(odd.collect(), key=lambda r: (r.TicksTimeStamp, r.EventID)):
        want[(r.SourceName, r.ConditionName)] = (r.Severity, r.Priority, r.GroupPath)
    got = A.active(odd, as_of=as_of, hours=720).collect()
    assert {(r.SourceName, r.ConditionName): (r.Severity, r.Priority, r.GroupPath) for r in got} == want
    half = F.col("EventID").cast("long") % 5 < 2
    state = A.active_state(A.active_state(None, odd.where(half)), odd.where(~half))
    for group in (None, "G1.x"):
        _same(A.active_from_state(state, as_of=as_of, hours=720, group=group), A.active(odd, as_of=as_of, hours=720, group=group))


def test_latest_readings_state(spark):
    df = FX.readings(spark, SF_SMALL)
    tags = FX.tags(spark)
    d, state_dir = _dir(), f"{_dir()}/state"
    H.write_readings(df, d)
    log = H.read_readings(spark, d)
    for day in (5, 6, 31):
        state = H.advance_state(log, state_dir, dt.date(2024, 1, day), RD.latest_state)
    _same(RD.latest_from_state(state, tags), RD.latest_per_tag(df, tags))


@pytest.mark.parametrize("rolled", [dt.date(2023, 12, 1), dt.date(2024, 1, 1), dt.date(2024, 1, 17), dt.date(2024, 3, 1)])
def test_rollup_equals_raw_for_any_window(spark, rolled):
    ev = FX.alarm_events(spark, SF_SMALL)
    roll = RU.daily_rollup(ev.where(F.to_date("EventTimeStamp") <= F.lit(rolled))).persist()
    rng = random.Random(rolled.day)
    for _ in range(3):
        as_of = dt.datetime(2024, 1, 31) - dt.timedelta(milliseconds=rng.randrange(20 * 86_400_000))
        hours, days = rng.choice([1, 23, 100, 333, 720]), rng.choice([1, 7, 90])
        _same(RU.noisy(roll, ev, as_of=as_of, rolled_to=rolled, hours=hours, top=50), A.noisy(ev, as_of=as_of, hours=hours, top=50))
        _same(RU.faults(roll, ev, as_of=as_of, rolled_to=rolled, hours=hours, top=50), A.faults(ev, as_of=as_of, hours=hours, top=50))
        _same(RU.groups(roll, ev, as_of=as_of, rolled_to=rolled, hours=hours), A.groups(ev, as_of=as_of, hours=hours))
        _same(RU.daily(roll, ev, as_of=as_of, rolled_to=rolled, days=days), A.daily(ev, as_of=as_of, days=days))
    _same(RU.groups(roll, ev, rolled_to=rolled), A.groups(ev))
    _same(RU.noisy(roll, ev, as_of=dt.datetime(2024, 1, 31), rolled_to=rolled, hours=720, top=9, group=P.GROUP),
          A.noisy(ev, as_of=dt.datetime(2024, 1, 31), hours=720, top=9, group=P.GROUP))
    roll.unpersist()


def test_stored_rollup_is_repeatable(spark):
    """Advanced in steps, one of them twice; a whole-day window opens no raw day before the last rolled one."""
    log_dir, roll_dir = _dir(), f"{_dir()}/rollup"
    ev, log = _log(spark, log_dir)
    for day in (4, 15, 15, 25):
        reached = H.advance_rollup(log, roll_dir, dt.date(2024, 1, day))
    _spoil(log_dir, dt.date(2024, 1, 26))
    roll, log = H.read_rollup(spark, roll_dir), H.read_alarm_events(spark, log_dir)
    kw = dict(as_of=P.AS_OF, hours=720, top=50)
    _same(RU.noisy(roll, log, rolled_to=reached, **kw), A.noisy(ev, **kw))
    _same(RU.daily(roll, log, as_of=P.AS_OF, rolled_to=reached, days=90), A.daily(ev, as_of=P.AS_OF, days=90))


def test_alarm_job(spark):
    """The command advances state and rollup day by day; a log without events has neither."""
    from millrun.plans import jobs
    log_dir, out = _dir(), _dir()
    ev, log = _log(spark, log_dir)
    for day in ("2023-12-30", "2024-01-10", "2024-01-30"):
        assert jobs.main(["alarms", "--log", log_dir, "--state", f"{out}/state", "--rollup", f"{out}/rollup", "--through", day,
                          "--profile", "local"]) == 0
    state, roll = H.read_state(spark, f"{out}/state"), H.read_rollup(spark, f"{out}/rollup")
    _same(A.active_from_state(state, as_of=P.AS_OF, hours=720), A.active(ev, as_of=P.AS_OF, hours=720))
    _same(RU.groups(roll, log, rolled_to=dt.date(2024, 1, 30)), A.groups(ev))


def test_state_of_an_empty_log(spark):
    state_dir = f"{_dir()}/state"
    empty = FX.alarm_events(spark, SF_SMALL).withColumn("event_date", F.to_date("EventTimeStamp")).limit(0)
    state = H.advance_state(empty, state_dir, dt.date(2024, 1, 1), A.active_state)
    assert state.count() == 0 and A.active_from_state(state, as_of=P.AS_OF, hours=720).count() == 0

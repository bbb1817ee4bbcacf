"""Active-alarm and ranking semantics on a hand-made log."""

import datetime as dt

from millrun import schemas
from millrun.functions.time import file_ticks_py
from millrun.operators import alarms as A
from millrun.sources.local import local_table

AS_OF = dt.datetime(2026, 7, 19, 12, 0, 0)


def _log(spark, events):
    rows = []
    for i, (mins_ago, src, cond, msg, active, acked, group, sev) in enumerate(events):
        t = AS_OF - dt.timedelta(minutes=mins_ago)
        rows.append((f"e{i:03d}", t, file_ticks_py(t), src, None, cond, cond, msg, group, sev, 1,
                     1.0, None, active, acked))
    return local_table(spark, rows, schemas.ALARM_EVENTS)


def test_latest_event_decides_and_fault_rows_do_not_clear(spark):
    log = _log(spark, [
        (30, "S1", "TRIP", "Event", True, False, "G.a", 5),
        (20, "S1", "TRIP", "Alarm fault: quality is bad", False, False, "G.a", 5),  # ignored
        (50, "S2", "HI", "Event", True, False, "G.a", 3),
        (10, "S2", "HI", "Event", False, True, "G.a", 3),           # cleared
        (40, "S3", "TRIP_L", None, True, True, "G.b", 9),            # NULL message kept
        (9000, "S4", "LO", "Event", True, False, "G.b", 1),          # older than look-back
    ])
    got = A.active(log, as_of=AS_OF, hours=48).collect()
    assert [(r.SourceName, r.ConditionName) for r in got] == [("S3", "TRIP_L"), ("S1", "TRIP")]
    assert got[0].EventTimeStamp == AS_OF - dt.timedelta(minutes=40) + dt.timedelta(hours=7)
    unacked = A.active(log, as_of=AS_OF, hours=48, acked=False).collect()
    assert [r.SourceName for r in unacked] == ["S1"]
    trip = A.active(log, as_of=AS_OF, hours=720, condition="TRIP").collect()
    assert {r.SourceName for r in trip} == {"S1", "S3"}


def test_daily_counts_null_message_as_real(spark):
    log = _log(spark, [(60, "S1", "TRIP", None, True, False, "G", 1),
                       (61, "S1", "TRIP", "Alarm fault: x", True, False, "G", 1),
                       (62, "S1", "TRIP", "Event", True, False, "G", 1)])
    r = A.daily(log, as_of=AS_OF, days=1).collect()
    assert len(r) == 1 and (r[0].real_events, r[0].fault_events, r[0].total_events) == (2, 1, 3)


def test_heartbeat(spark):
    log = _log(spark, [(125, "S1", "TRIP", "Event", True, False, "G", 1)])
    h = A.heartbeat(log, as_of=AS_OF).first()
    assert h.minutes_since_last == 125 and h.logging_ok is False and h.total_rows == 1
    empty = A.heartbeat(log.limit(0), as_of=AS_OF).first()
    assert empty.newest_event is None and empty.logging_ok is False and empty.total_rows == 0


def test_groups_keep_null_group(spark):
    log = _log(spark, [(1, "S1", "TRIP", "Event", True, False, None, 1),
                       (2, "S1", "TRIP", "Event", True, False, "Mill.Alarm_A", 1)])
    g = {r.GroupPath: r for r in A.groups(log).collect()}
    assert set(g) == {None, "Mill.Alarm_A"} and g["Mill.Alarm_A"].plant_area == "Mill"

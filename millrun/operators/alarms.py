"""Alarm/event-log queries.

The log is append-only snapshots in UTC. Time windows are evaluated in UTC on
``TicksTimeStamp``; timestamps in outputs are shifted to plant time (+7 h).
"Now" is an explicit ``as_of`` (UTC) so runs are repeatable. When the input has
an ``event_date`` (UTC) partition column, matching date bounds are added so the
scan prunes partitions.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrun.functions.predicates import (condition_family, is_fault_prefix, is_quality_fault,
                                          not_fault_noise)
from millrun.functions.time import (file_ticks_py, local_date, local_to_utc, minutes_between,
                                   shift_hours, ts_lit)
from millrun.operators.latest import advanced, latest_rows
from millrun.operators.newest import newest_days
from millrun.sources import registry as R

RECENT_COLUMNS = ("SourceName", "ConditionName", "SubConditionName", "Severity", "Priority",
                  "Message", "InputValue", "LimitValue", "Active", "Acked")
SOURCE_COLUMNS = ("ConditionName", "SubConditionName", "Severity", "Message", "InputValue",
                  "LimitValue", "Active", "Acked")


# What identifies an alarm, what makes an event the latest, and what is shown of it.
ACTIVE_KEYS = ("SourceName", "ConditionName")
ACTIVE_ORDER = ("TicksTimeStamp", "EventID")
ACTIVE_PAYLOAD = ("EventTimeStamp", "SubConditionName", "Severity", "Priority", "Message",
                  "InputValue", "LimitValue", "Active", "Acked", "GroupPath")
STATE_KEYS = (*ACTIVE_KEYS, "GroupPath")
STATE_PAYLOAD = tuple(c for c in ACTIVE_PAYLOAD if c not in STATE_KEYS)


def check_range(name: str, value, rng: tuple[int, int]) -> None:
    """Out-of-range arguments are rejected, never clamped."""
    if value is None:
        return
    lo, hi = rng
    if not isinstance(value, int) or isinstance(value, bool) or not lo <= value <= hi:
        raise ValueError(f"{name} must be {lo}-{hi}")


def time_window(as_of: dt.datetime, hours: int | None = None, from_local: str | None = None,
                to_local: str | None = None, hours_default: int | None = None,
                tz_hours: int = R.PLANT_TZ_OFFSET_HOURS):
    """``hours`` xor a plant-local ``from``/``to``; either bound alone is
    open; ``from`` after ``to`` is rejected. Returns UTC ``(from, to)``."""
    check_range("hours", hours, R.HOURS_RANGE)
    f = local_to_utc(from_local, tz_hours) if from_local else None
    t = local_to_utc(to_local, tz_hours) if to_local else None
    if (f or t) and hours is not None:
        raise ValueError("use either hours or from/to, not both")
    if f and t and f > t:
        raise ValueError("from must not be after to")
    if f or t:
        return f, t
    h = hours if hours is not None else hours_default
    return (as_of - dt.timedelta(hours=h) if h is not None else None), None


def in_ticks(events: DataFrame, from_utc: dt.datetime | None, to_utc: dt.datetime | None) -> DataFrame:
    """inclusive ticks range on ms-aligned bounds (upper + 9999); an
    open side adds no predicate."""
    c = F.col("TicksTimeStamp")
    if from_utc is not None:
        events = events.where(c >= F.lit(file_ticks_py(from_utc)))
    if to_utc is not None:
        events = events.where(c <= F.lit(file_ticks_py(to_utc) + R.TICKS_UPPER_PAD))
    if "event_date" in events.columns:
        if from_utc is not None:
            events = events.where(F.col("event_date") >= F.lit(from_utc.date()))
        if to_utc is not None:
            events = events.where(F.col("event_date") <= F.lit(to_utc.date()))
    return events


def _opt_eq(events: DataFrame, col: str, value) -> DataFrame:
    """an optional exact filter; absent -> no predicate."""
    return events if value is None else events.where(F.col(col) == F.lit(value))


def shifted(col: str = "EventTimeStamp", alias: str | None = None, tz_hours=R.PLANT_TZ_OFFSET_HOURS) -> Column:
    return shift_hours(col, tz_hours).alias(alias or col)


def _newest_first() -> list[Column]:
    return [F.col("TicksTimeStamp").desc(), F.col("EventID").desc()]


def _day(bound: dt.datetime | None) -> dt.date | None:
    return None if bound is None else bound.date()


def recent(events: DataFrame, *, as_of: dt.datetime, limit: int = R.RECENT_LIMIT,
           exclude_faults: bool = True, source: str | None = None, condition: str | None = None,
           group: str | None = None, hours: int | None = None, from_local: str | None = None,
           to_local: str | None = None, tz_hours: int = R.PLANT_TZ_OFFSET_HOURS) -> DataFrame:
    """Newest ``limit`` events with optional filters (planned as a
    ``TakeOrderedAndProject``: per-task top-N, then a merge of N rows each). Of a
    log stored by day only the newest days that hold them are opened."""
    check_range("limit", limit, R.LIMIT_RANGE)
    lo, hi = time_window(as_of, hours, from_local, to_local, None, tz_hours)
    e = in_ticks(events, lo, hi)
    if exclude_faults:
        e = e.where(not_fault_noise())
    e = _opt_eq(e, "SourceName", source)
    if condition is not None:
        e = e.where(condition_family(condition))
    e = _opt_eq(e, "GroupPath", group)
    return (newest_days(e, limit, since=_day(lo), until=_day(hi)).orderBy(*_newest_first()).limit(limit)
             .select(shifted(tz_hours=tz_hours), *RECENT_COLUMNS))


def source_history(events: DataFrame, source: str, *, as_of: dt.datetime,
                   limit: int = R.SOURCE_LIMIT, hours: int | None = None,
                   from_local: str | None = None, to_local: str | None = None,
                   condition: str | None = None, tz_hours: int = R.PLANT_TZ_OFFSET_HOURS) -> DataFrame:
    """T4/F16: newest events of one source (look-back 168 h unless from/to)."""
    if not isinstance(source, str) or not 1 <= len(source) <= 255:
        raise ValueError("sourceName must be 1-255 characters")
    check_range("limit", limit, R.LIMIT_RANGE)
    lo, hi = time_window(as_of, hours, from_local, to_local, R.SOURCE_HOURS, tz_hours)
    e = in_ticks(events, lo, hi).where(F.col("SourceName") == F.lit(source))
    if condition is not None:
        e = e.where(condition_family(condition))
    return (newest_days(e, limit, since=_day(lo), until=_day(hi)).orderBy(*_newest_first()).limit(limit)
             .select(shifted(tz_hours=tz_hours), *SOURCE_COLUMNS))


def active(events: DataFrame, *, as_of: dt.datetime, hours: int = R.ACTIVE_HOURS,
           condition: str | None = None, group: str | None = None, acked: bool | None = None,
           tz_hours: int = R.PLANT_TZ_OFFSET_HOURS) -> DataFrame:
    """Alarms standing now = the latest event per (source,
    condition) inside the look-back has ``Active``. Fault noise, condition and
    group are filtered before picking the latest, ``acked`` after.

    The latest event is a hash aggregate of the newest ticks per key, combined
    map-side, and a fetch of the winners' payload (``latest.latest_rows``), so a
    source with a third of the log is not one window partition and no split is
    sorted with its messages.
    """
    check_range("hours", hours, R.HOURS_RANGE)
    e = in_ticks(events, as_of - dt.timedelta(hours=hours), None).where(not_fault_noise())
    if condition is not None:
        e = e.where(condition_family(condition))
    e = _opt_eq(e, "GroupPath", group)
    return _standing(latest_rows(e, ACTIVE_KEYS, ACTIVE_ORDER, ACTIVE_PAYLOAD), acked, tz_hours)


def _standing(latest: DataFrame, acked: bool | None, tz_hours: int) -> DataFrame:
    x = latest.where(F.col("Active"))
    if acked is not None:
        x = x.where(F.col("Acked") == F.lit(bool(acked)))
    return (x.select(shifted(tz_hours=tz_hours), "SourceName", "ConditionName", "SubConditionName",
                     "Severity", "Priority", "Message", "InputValue", "LimitValue", "Active",
                     "Acked", "GroupPath")
             .orderBy(F.col("Severity").desc(), F.col("EventTimeStamp").desc()))


def active_state(state: DataFrame | None, new_events: DataFrame) -> DataFrame:
    """W1 as kept state: the latest event that isn't fault noise per (source, condition,
    group), after ``new_events``. The group is part of the key, because it is filtered
    before the latest event is picked."""
    return advanced(state, new_events.where(not_fault_noise()), STATE_KEYS, ACTIVE_ORDER, STATE_PAYLOAD)


def active_from_state(state: DataFrame, *, as_of: dt.datetime, hours: int = R.ACTIVE_HOURS,
                      condition: str | None = None, group: str | None = None, acked: bool | None = None,
                      tz_hours: int = R.PLANT_TZ_OFFSET_HOURS) -> DataFrame:
    """``active`` from the state of the whole log: a latest event older than the look-back
    means that its key has none inside it."""
    check_range("hours", hours, R.HOURS_RANGE)
    e = state.where(F.col("TicksTimeStamp") >= F.lit(file_ticks_py(as_of - dt.timedelta(hours=hours))))
    if condition is not None:
        e = e.where(condition_family(condition))
    e = _opt_eq(e, "GroupPath", group)
    return _standing(latest_rows(e, ACTIVE_KEYS, ACTIVE_ORDER, ACTIVE_PAYLOAD), acked, tz_hours)


def daily(events: DataFrame, *, as_of: dt.datetime, days: int = R.DAILY_DAYS,
          tz_hours: int = R.PLANT_TZ_OFFSET_HOURS) -> DataFrame:
    """Events per plant-local day since local midnight ``days`` days before
    today (so ``days`` + today), split real vs fault (NULL message = real).
    Quiet days are absent."""
    check_range("days", days, R.DAYS_RANGE)
    local_today = (as_of + dt.timedelta(hours=tz_hours)).date()
    start_utc = dt.datetime.combine(local_today - dt.timedelta(days=days), dt.time()) \
        - dt.timedelta(hours=tz_hours)
    e = in_ticks(events, start_utc, None)
    fault = F.coalesce(is_fault_prefix(), F.lit(False))
    return (e.groupBy(local_date("EventTimeStamp", tz_hours).alias("event_date"))
             .agg(F.count_if(~fault).alias("real_events"), F.count_if(fault).alias("fault_events"),
                  F.count(F.lit(1)).alias("total_events"))
             .orderBy("event_date"))


def noisy(events: DataFrame, *, as_of: dt.datetime, hours: int = R.NOISY_HOURS,
          top: int = R.NOISY_TOP, group: str | None = None,
          tz_hours: int = R.PLANT_TZ_OFFSET_HOURS) -> DataFrame:
    """A10/T5: chattering (source, condition) pairs, faults included; ties at
    the cut are broken by key order."""
    check_range("hours", hours, R.HOURS_RANGE)
    check_range("top", top, R.TOP_RANGE)
    e = _opt_eq(in_ticks(events, as_of - dt.timedelta(hours=hours), None), "GroupPath", group)
    g = e.groupBy("SourceName", "ConditionName").agg(
        F.count(F.lit(1)).alias("event_count"),
        F.min("EventTimeStamp").alias("_first"), F.max("EventTimeStamp").alias("_last"))
    return (g.orderBy(F.col("event_count").desc(), "SourceName", "ConditionName").limit(top)
             .select("SourceName", "ConditionName", "event_count",
                     shifted("_first", "first_event", tz_hours), shifted("_last", "last_event", tz_hours)))


def groups(events: DataFrame, *, as_of: dt.datetime | None = None, hours: int | None = None,
           tz_hours: int = R.PLANT_TZ_OFFSET_HOURS) -> DataFrame:
    """Every GroupPath (NULL is a group) with its event count and last
    event; ``plant_area`` is the text before the first dot."""
    check_range("hours", hours, R.HOURS_RANGE)
    e = events if hours is None else in_ticks(events, as_of - dt.timedelta(hours=hours), None)
    g = e.groupBy("GroupPath").agg(F.count(F.lit(1)).alias("event_count"),
                                   F.max("EventTimeStamp").alias("_last"))
    return (g.select("GroupPath", F.substring_index("GroupPath", ".", 1).alias("plant_area"),
                     "event_count", shifted("_last", "last_event", tz_hours))
             .orderBy(F.col("event_count").desc(), "GroupPath"))


def faults(events: DataFrame, *, as_of: dt.datetime, hours: int = R.FAULTS_HOURS,
           top: int = R.FAULTS_TOP, tz_hours: int = R.PLANT_TZ_OFFSET_HOURS) -> DataFrame:
    """Quality-fault counts per source (message *contains* the text)."""
    check_range("hours", hours, R.HOURS_RANGE)
    check_range("top", top, R.TOP_RANGE)
    e = in_ticks(events, as_of - dt.timedelta(hours=hours), None).where(is_quality_fault())
    g = e.groupBy("SourceName").agg(F.count(F.lit(1)).alias("fault_count"),
                                    F.min("EventTimeStamp").alias("_first"),
                                    F.max("EventTimeStamp").alias("_last"))
    return (g.orderBy(F.col("fault_count").desc(), "SourceName").limit(top)
             .select("SourceName", "fault_count", shifted("_first", "first_fault", tz_hours),
                     shifted("_last", "last_fault", tz_hours)))


def heartbeat(events: DataFrame, *, as_of: dt.datetime,
              tz_hours: int = R.PLANT_TZ_OFFSET_HOURS) -> DataFrame:
    """Newest event, minutes since it (minute boundaries crossed up to
    ``as_of``), total rows, and ``logging_ok`` = minutes < 120 (NULL -> false).
    One global aggregate; partial per task."""
    agg = events.agg(F.max_by("EventTimeStamp", "TicksTimeStamp").alias("_newest"),
                     F.count(F.lit(1)).alias("total_rows"))
    mins = minutes_between(F.col("_newest"), ts_lit(as_of))
    return agg.select(shifted("_newest", "newest_event", tz_hours),
                      mins.alias("minutes_since_last"), "total_rows",
                      F.coalesce(mins < R.HEARTBEAT_OK_MINUTES, F.lit(False)).alias("logging_ok"))

"""Alarm statistics from stored daily partial aggregates.

A rollup row holds, per UTC day, plant-local day, source, condition and group, the
counts and the first and last times of its events. All of it merges by sum, min and
max, so a window is answered from the rollup rows of its whole days, joined with
aggregates of the raw events of the day in which the window starts and of the days
after the rollup's last. Results equal those from the raw log for any window.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrun.functions.predicates import is_fault_prefix, is_quality_fault
from millrun.functions.time import file_ticks_py, local_date
from millrun.operators.alarms import check_range, in_ticks, shifted
from millrun.sources import registry as R

KEYS = ("event_date", "local_date", "SourceName", "ConditionName", "GroupPath")


def daily_rollup(events: DataFrame, tz_hours: int = R.PLANT_TZ_OFFSET_HOURS) -> DataFrame:
    """Partial aggregates of the log by ``KEYS``; one hash aggregate, combined map-side."""
    fault, quality = F.coalesce(is_fault_prefix(), F.lit(False)), F.coalesce(is_quality_fault(), F.lit(False))
    return events.groupBy(
        F.to_date("EventTimeStamp").alias("event_date"), local_date("EventTimeStamp", tz_hours).alias("local_date"),
        "SourceName", "ConditionName", "GroupPath").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(fault).alias("n_fault"), F.count_if(quality).alias("n_quality"),
        F.min("EventTimeStamp").alias("first"), F.max("EventTimeStamp").alias("last"),
        F.min(F.when(quality, F.col("EventTimeStamp"))).alias("quality_first"),
        F.max(F.when(quality, F.col("EventTimeStamp"))).alias("quality_last"))


def window(rollup: DataFrame, events: DataFrame, from_utc: dt.datetime | None, rolled_to: dt.date,
           tz_hours: int = R.PLANT_TZ_OFFSET_HOURS) -> DataFrame:
    """Rollup rows of all events since ``from_utc`` (None: of all time).

    ``rollup`` holds every day up to ``rolled_to``; later days, and the day in which the
    window starts, come from ``events``."""
    after = dt.datetime.combine(rolled_to + dt.timedelta(days=1), dt.time())
    whole = rollup.where(F.col("event_date") <= F.lit(rolled_to))
    if from_utc is None or from_utc >= after:
        raw = in_ticks(events, max(from_utc or after, after), None)
        return daily_rollup(raw, tz_hours) if from_utc else whole.unionByName(daily_rollup(raw, tz_hours))
    raw = daily_rollup(in_ticks(events, after, None), tz_hours)
    day = from_utc.date()
    if from_utc.time() != dt.time():
        edge = in_ticks(events, from_utc, None)
        midnight = dt.datetime.combine(day + dt.timedelta(days=1), dt.time())
        edge = edge.where(F.col("TicksTimeStamp") < F.lit(file_ticks_py(midnight)))
        if "event_date" in edge.columns:
            edge = edge.where(F.col("event_date") == F.lit(day))
        raw = raw.unionByName(daily_rollup(edge, tz_hours))
        day += dt.timedelta(days=1)
    return whole.where(F.col("event_date") >= F.lit(day)).unionByName(raw)


def _since(as_of: dt.datetime, hours: int | None) -> dt.datetime | None:
    check_range("hours", hours, R.HOURS_RANGE)
    return None if hours is None else as_of - dt.timedelta(hours=hours)


def daily(rollup: DataFrame, events: DataFrame, *, as_of: dt.datetime, rolled_to: dt.date, days: int = R.DAILY_DAYS,
          tz_hours: int = R.PLANT_TZ_OFFSET_HOURS) -> DataFrame:
    """A9 as ``alarms.daily``: local days are whole in the rollup, so no edge is read."""
    check_range("days", days, R.DAYS_RANGE)
    first = (as_of + dt.timedelta(hours=tz_hours)).date() - dt.timedelta(days=days)
    start_utc = dt.datetime.combine(first, dt.time()) - dt.timedelta(hours=tz_hours)
    x = window(rollup, events, dt.datetime.combine(start_utc.date(), dt.time()), rolled_to, tz_hours)
    return (x.where(F.col("local_date") >= F.lit(first)).groupBy(F.col("local_date").alias("event_date"))
             .agg((F.sum("n") - F.sum("n_fault")).alias("real_events"), F.sum("n_fault").alias("fault_events"),
                  F.sum("n").alias("total_events")).orderBy("event_date"))


def noisy(rollup: DataFrame, events: DataFrame, *, as_of: dt.datetime, rolled_to: dt.date, hours: int = R.NOISY_HOURS,
          top: int = R.NOISY_TOP, group: str | None = None, tz_hours: int = R.PLANT_TZ_OFFSET_HOURS) -> DataFrame:
    """A10/T5 as ``alarms.noisy``."""
    check_range("top", top, R.TOP_RANGE)
    x = window(rollup, events, _since(as_of, hours), rolled_to, tz_hours)
    if group is not None:
        x = x.where(F.col("GroupPath") == F.lit(group))
    g = x.groupBy("SourceName", "ConditionName").agg(
        F.sum("n").alias("event_count"), F.min("first").alias("_first"), F.max("last").alias("_last"))
    return (g.orderBy(F.col("event_count").desc(), "SourceName", "ConditionName").limit(top)
             .select("SourceName", "ConditionName", "event_count",
                     shifted("_first", "first_event", tz_hours), shifted("_last", "last_event", tz_hours)))


def groups(rollup: DataFrame, events: DataFrame, *, rolled_to: dt.date, as_of: dt.datetime | None = None,
           hours: int | None = None, tz_hours: int = R.PLANT_TZ_OFFSET_HOURS) -> DataFrame:
    """A11/X11 as ``alarms.groups``."""
    x = window(rollup, events, _since(as_of, hours), rolled_to, tz_hours)
    g = x.groupBy("GroupPath").agg(F.sum("n").alias("event_count"), F.max("last").alias("_last"))
    return (g.select("GroupPath", F.substring_index("GroupPath", ".", 1).alias("plant_area"), "event_count",
                     shifted("_last", "last_event", tz_hours))
             .orderBy(F.col("event_count").desc(), "GroupPath"))


def faults(rollup: DataFrame, events: DataFrame, *, as_of: dt.datetime, rolled_to: dt.date, hours: int = R.FAULTS_HOURS,
           top: int = R.FAULTS_TOP, tz_hours: int = R.PLANT_TZ_OFFSET_HOURS) -> DataFrame:
    """A12/F8 as ``alarms.faults``."""
    check_range("top", top, R.TOP_RANGE)
    x = window(rollup, events, _since(as_of, hours), rolled_to, tz_hours).where(F.col("n_quality") > 0)
    g = x.groupBy("SourceName").agg(F.sum("n_quality").alias("fault_count"), F.min("quality_first").alias("_first"),
                                    F.max("quality_last").alias("_last"))
    return (g.orderBy(F.col("fault_count").desc(), "SourceName").limit(top)
             .select("SourceName", "fault_count", shifted("_first", "first_fault", tz_hours),
                     shifted("_last", "last_fault", tz_hours)))

"""Structured Streaming forms of the alarm dashboards.

Dashboards poll the batch queries every 30-60 s; these are the push forms.
Event time must be a zoned TIMESTAMP for watermarks, so the NTZ instant is
converted exactly through epoch microseconds (no session-zone dependence).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrun.functions.predicates import is_fault_prefix
from millrun.functions.time import EPOCH, micros_since_epoch, shift_hours
from millrun.sources import registry as R


def as_instant(ntz) -> Column:
    """NTZ wall clock (read as UTC) -> TIMESTAMP instant, zone-independent."""
    return F.timestamp_micros(micros_since_epoch(ntz))


def as_wall_clock(ts) -> Column:
    """TIMESTAMP instant -> NTZ UTC wall clock, zone-independent."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.timestamp_add("MICROSECOND", F.unix_micros(c), F.expr(EPOCH))


def daily_counts_stream(events: DataFrame, watermark: str = "2 hours",
                        tz_hours: int = R.PLANT_TZ_OFFSET_HOURS) -> DataFrame:
    """A9 as a stream: events per plant-local day, real vs fault vs total.

    Days are tumbling 1-day windows on plant time. With output mode
    ``update`` a dashboard sees each day's counts change per trigger; with
    ``append`` a day is emitted once the watermark passes its end. Events later
    than the watermark are dropped (Spark counts them in the query progress).
    """
    x = events.select(as_instant(shift_hours("EventTimeStamp", tz_hours)).alias("_local"), "Message")
    fault = F.coalesce(is_fault_prefix(), F.lit(False))
    g = (x.withWatermark("_local", watermark)
          .groupBy(F.window("_local", "1 day").alias("_w"))
          .agg(F.count_if(~fault).alias("real_events"), F.count_if(fault).alias("fault_events"),
               F.count(F.lit(1)).alias("total_events")))
    return g.select(F.to_date(as_wall_clock(F.col("_w.start"))).alias("event_date"),
                    "real_events", "fault_events", "total_events")


def heartbeat_stream(events: DataFrame, tz_hours: int = R.PLANT_TZ_OFFSET_HOURS) -> DataFrame:
    """A13 as a stream (output mode ``complete``/``update``): newest event in
    plant time and total rows so far; minutes-since is taken by the reader."""
    agg = events.agg(F.max_by("EventTimeStamp", "TicksTimeStamp").alias("_newest"),
                     F.count(F.lit(1)).alias("total_rows"))
    return agg.select(shift_hours("_newest", tz_hours).alias("newest_event"), "total_rows")

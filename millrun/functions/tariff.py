"""Tariff buckets on the plant-local clock."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrun.functions.time import MS_PER_DAY, US_PER_MS, _c, micros_since_epoch, seconds_of_day
from millrun.sources import registry as R

BUCKETS = ("A", "B", "C", "D")
#: Dates of a calendar table that are written into the plan; a larger one is joined.
INLINE_DATES = 20_000
_US_PER_S, _US_PER_DAY = 1_000_000, MS_PER_DAY * US_PER_MS


def weekend(ts) -> Column:
    """Saturday or Sunday of the row's own wall-clock date."""
    return F.dayofweek(_c(ts)).isin(1, 7)


def holiday_flag(ts, holidays: Sequence[dt.date] | None) -> Column:
    """X3 with a literal calendar: listed date or weekend. The list is a small,
    bounded parameter, so it stays an in-expression inside codegen."""
    c = _c(ts)
    listed = F.to_date(c).isin(list(holidays)) if holidays else F.lit(False)
    return listed | weekend(c)


def bucket_of(ts, is_holiday: Column) -> Column:
    """Holiday -> C in [06:00:00, 18:00:00] else D; other days -> A in
    [09:00:00, 22:00:00] else B. Both ends inclusive; milliseconds ignored."""
    sod = seconds_of_day(ts)
    return (F.when(is_holiday,
                   F.when(sod.between(R.HOLIDAY_DAY_START_S, R.HOLIDAY_DAY_END_S), "C").otherwise("D"))
            .otherwise(F.when(sod.between(R.WORKDAY_PEAK_START_S, R.WORKDAY_PEAK_END_S), "A")
                       .otherwise("B")))


def with_holiday(df: DataFrame, holidays, ts: str = "DateAndTime", out: str = "is_holiday",
                 max_calendar_rows: int = 100_000) -> DataFrame:
    """Attach the holiday flag. ``holidays`` is a list of dates (in-expression), a
    DataFrame with a DATE column ``d`` (J5: checked broadcast join), or a boolean
    Column over the row that decides alone, in place of list and weekend rule, or a
    function from a date Column to such a Column."""
    if callable(holidays) and not isinstance(holidays, Column):
        holidays = holidays(F.to_date(F.col(ts)))
    if isinstance(holidays, Column):
        return df.withColumn(out, F.coalesce(holidays, F.lit(False)))
    if holidays is None or isinstance(holidays, (list, tuple)):
        return df.withColumn(out, holiday_flag(ts, holidays))
    from millrun.operators.joins import checked_broadcast
    cal = holidays.select(F.col("d").alias("_hd")).distinct()
    cal = checked_broadcast(cal, max_calendar_rows)
    joined = df.join(cal, F.to_date(F.col(ts)) == F.col("_hd"), "left")
    return joined.withColumn(out, F.col("_hd").isNotNull() | weekend(ts)).drop("_hd")


def day_rule(holidays) -> Callable[[Column], Column] | None:
    """The holiday rule as a function of a date Column, or None where it can't be one: a
    Column over the row may look at more than the date, a calendar table may be too large."""
    if isinstance(holidays, DataFrame):
        dates = holidays.select("d").distinct().limit(INLINE_DATES + 1).collect()
        if len(dates) > INLINE_DATES:
            return None
        holidays = [r["d"] for r in dates if r["d"] is not None]
    if isinstance(holidays, Column):
        return None
    if callable(holidays):
        return lambda d: F.coalesce(holidays(d), F.lit(False))
    return lambda d: holiday_flag(d, holidays)


def points_by_bucket(clock: Column, cadence_ms: Column, n: Column, rule: Callable[[Column], Column]) -> Column:
    """How many of the points ``clock + k * cadence``, k from 1 to ``n``, fall into each bucket.

    Counted in closed form: on each day between the first and the last point, the points
    up to a bucket's edges are whole steps. No point is made. A struct of ``BUCKETS``;
    NULL where ``n`` is 0."""
    start = micros_since_epoch(clock)

    def offset(k: Column) -> Column:  # of point k in ms, as its row would be
        return (k * cadence_ms).cast("long")

    def until(at: Column) -> Column:
        """Points at most at ``at`` (in microseconds)."""
        room = F.floor((at - start) / F.lit(US_PER_MS))
        k = F.floor((room + 1) / cadence_ms)
        k = F.when(offset(k + 1) <= room, k + 1).when(offset(k) <= room, k).otherwise(k - 1)
        return F.when(room < 0, F.lit(0).cast("long")).otherwise(F.least(n.cast("long"), k))

    def merge(sums: Column, day: Column) -> Column:
        midnight = F.unix_date(day) * F.lit(_US_PER_DAY)
        holiday = rule(day)

        def edge(free: int, work: int) -> Column:
            return midnight + F.when(holiday, F.lit(free * _US_PER_S)).otherwise(F.lit(work * _US_PER_S))

        whole = until(midnight + F.lit(_US_PER_DAY - 1)) - until(midnight - 1)
        # both ends of a bucket are inclusive at the grain of seconds
        inner = (until(edge(R.HOLIDAY_DAY_END_S + 1, R.WORKDAY_PEAK_END_S + 1) - 1)
                 - until(edge(R.HOLIDAY_DAY_START_S, R.WORKDAY_PEAK_START_S) - 1))
        zero = F.lit(0).cast("long")
        return F.struct(
            (sums["A"] + F.when(holiday, zero).otherwise(inner)).alias("A"),
            (sums["B"] + F.when(holiday, zero).otherwise(whole - inner)).alias("B"),
            (sums["C"] + F.when(holiday, inner).otherwise(zero)).alias("C"),
            (sums["D"] + F.when(holiday, whole - inner).otherwise(zero)).alias("D"))

    last = F.timestamp_add("MILLISECOND", offset(n), clock)
    none = F.struct(*[F.lit(0).cast("long").alias(b) for b in BUCKETS])
    return F.when(n > 0, F.aggregate(F.sequence(F.to_date(clock), F.to_date(last)), none, merge))

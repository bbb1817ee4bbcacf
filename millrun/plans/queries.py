"""The registered queries: ``name -> f(spark, sf_dir) -> DataFrame``.

Each builds its inputs from the driver's tables (``millrun.sources.fixtures``)
and runs one operator family with the parameters of ``millrun.plans.params``.
Sums of floating values are exact (``functions.exact``), so nothing is rounded for
the comparison with the DuckDB oracle in ``millrun.plans.oracle``.
"""

from __future__ import annotations

import functools
import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrun.operators import runhours
from millrun.operators.joins import size_check_scope
from millrun.plans import params as P
from millrun.sources import fixtures as FX
from millrun.sources.local import local_table

REQUEST_SCHEMA = T.StructType([T.StructField("plant", T.StringType()),
                               T.StructField("TagIndex", T.IntegerType())])

Query = Callable[[SparkSession, str], DataFrame]
CALENDAR_SCHEMA = T.StructType([T.StructField("d", T.DateType())])

REGISTRY: dict[str, Query] = {}


def register(name: str):
    """Register a query; its plan is built inside one size-check scope."""
    def deco(fn: Query) -> Query:
        @functools.wraps(fn)
        def build(spark: SparkSession, sf_dir: str) -> DataFrame:
            with size_check_scope():
                return fn(spark, sf_dir)
        REGISTRY[name] = build
        return build
    return deco


def _window():
    from millrun.functions.time import parse_local
    return parse_local(P.TBF), parse_local(P.TAF)


def _readings(spark, sf_dir, window=()):
    return FX.readings(spark, sf_dir, window=_window() if window == () else window)


def _evt_tags(spark):
    return FX.tags(spark).where(F.col("plant") == FX.READINGS_PLANT)


def _request(spark):
    """Every known fixture tag plus the unknown tag 7 (J3 path)."""
    unknown = local_table(spark, [(FX.READINGS_PLANT, P.UNKNOWN_TAG)], REQUEST_SCHEMA)
    return _evt_tags(spark).select("plant", "TagIndex").unionByName(unknown)


def _run_hours(spark, sf_dir, **kw) -> DataFrame:
    args = dict(threshold=P.THRESHOLD, tbf=P.TBF, taf=P.TAF, bad=P.BAD,
                cadence_s=P.CADENCE_S, cap_s=P.CAP_S, tolerance=P.TOLERANCE,
                points_per_hour=P.POINTS_PER_HOUR, holidays=FX.holidays())
    args.update(kw)
    return runhours.count_run_hours(_readings(spark, sf_dir), _evt_tags(spark),
                                    request=_request(spark), **args)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gap-filled run-hours, tariff buckets and fill audit per tag, one plan."""
    with size_check_scope():
        return _run_hours(spark, sf_dir)


@register("run_hours")
def run_hours(spark, sf_dir):
    """A5 + A8: gap-filled run-hours with the fill audit (count routes' default)."""
    return _run_hours(spark, sf_dir).select(
        "plant", "TagIndex", "tagName", "date_before", "date_after", "count", "hour",
        "realReadings", "filledReadings", "flaggedGaps", "flagged_s")


@register("tariff_hours")
def tariff_hours(spark, sf_dir):
    """Run-hours split into tariff buckets A-D under the holiday calendar."""
    return _run_hours(spark, sf_dir).select("plant", "TagIndex", "tagName", "A", "B", "C", "D", "total")


# ----------------------------------------------------------------- helpers

def _wl(spark, sf_dir):
    return FX.weighing_readings(spark, sf_dir), FX.weighing_tags(spark)


def _alarms(spark, sf_dir, hours=None):
    """The alarm log; a look-back also bounds the time column of the scan."""
    return FX.alarm_events(spark, sf_dir, P.AS_OF - dt.timedelta(hours=hours) if hours else None)


# ------------------------------------------------------- catalogue, listings

@register("tag_catalog")
def tag_catalog(spark, sf_dir):
    """Every plant's tags with the plant description."""
    from millrun.operators.readings import tag_catalog as op
    return op(FX.tags_from_data(spark, sf_dir), FX.plants(spark))


@register("readings_window")
def readings_window(spark, sf_dir):
    """Good readings of known tags in a window, newest first."""
    from millrun.operators.readings import window_readings
    return window_readings(_readings(spark, sf_dir), _evt_tags(spark), P.TBF, P.TAF,
                           bad=P.BAD, newest_first=True)


@register("readings_window_asc")
def readings_window_asc(spark, sf_dir):
    """R2: the weighing plant's readings in its window, oldest first."""
    from millrun.operators.readings import window_readings
    r, t = _wl(spark, sf_dir)
    return window_readings(r, t, P.WL_TBF, P.WL_TAF, bad=P.BAD, newest_first=False)


@register("readings_long")
def readings_long(spark, sf_dir):
    """All tags of the weighing plant in long form, oldest first."""
    from millrun.operators.readings import long_form
    r, t = _wl(spark, sf_dir)
    return long_form(r, t, P.WL_TBF, P.WL_TAF, bad=P.BAD)


@register("readings_newest")
def readings_newest(spark, sf_dir):
    """Newest 1000 good readings of the plant."""
    from millrun.operators.readings import newest
    return newest(FX.readings(spark, sf_dir), _evt_tags(spark), bad=P.BAD)


@register("readings_latest_per_tag")
def readings_latest_per_tag(spark, sf_dir):
    """Latest good reading of every known tag."""
    from millrun.operators.readings import latest_per_tag
    return latest_per_tag(FX.readings(spark, sf_dir), _evt_tags(spark), bad=P.BAD)


@register("counter_window")
def counter_window(spark, sf_dir):
    """F1 with the counter plant's three bad codes (E, U, S), newest first."""
    from millrun.operators.readings import window_readings
    return window_readings(_readings(spark, sf_dir), _evt_tags(spark), P.TBF, P.TAF,
                           bad=P.COUNTER_BAD, newest_first=True)


# ---------------------------------------------------------------- statistics

@register("window_stats")
def window_stats(spark, sf_dir):
    """A1 + J3: min/max/avg/n per requested tag (unknown tag -> NULLs)."""
    from millrun.operators.stats import window_stats as op
    return op(_readings(spark, sf_dir), _evt_tags(spark), P.TBF, P.TAF, bad=P.BAD, request=_request(spark))


@register("capacity_total")
def capacity_total(spark, sf_dir):
    """A2: min, max and SUM(Val)/6 per requested tag."""
    from millrun.operators.stats import capacity
    return capacity(_readings(spark, sf_dir), _evt_tags(spark), P.TBF, P.TAF, bad=P.BAD,
                    request=_request(spark))


@register("weighing_stats")
def weighing_stats(spark, sf_dir):
    """A3: weighing max/min/sum, doubled mean (0 when empty), non-zero count."""
    from millrun.operators.stats import weighing_stats as op
    r, t = _wl(spark, sf_dir)
    return op(r, t, P.WL_TBF, P.WL_TAF, bad=P.BAD)


# ------------------------------------------------------------------ gap fill

def _classified(spark, sf_dir):
    from millrun.operators import gaps as G
    from millrun.operators.joins import known_only
    from millrun.operators.runhours import select_window
    r = known_only(select_window(_readings(spark, sf_dir), P.TBF, P.TAF, P.BAD), _evt_tags(spark))
    return G.gap_classified(r.select(*G.SERIES, *G.ORDER, "Val"), P.CADENCE_S, P.CAP_S, P.TOLERANCE)


def _filled(spark, sf_dir):
    from millrun.operators.gaps import fill_rows
    return fill_rows(_classified(spark, sf_dir))


@register("flagged_gaps")
def flagged_gaps(spark, sf_dir):
    """Gaps that were neither normal nor bridged, with the reason."""
    from millrun.operators.gaps import flagged_gaps as op
    return op(_classified(spark, sf_dir))


@register("gap_filled_readings")
def gap_filled_readings(spark, sf_dir):
    """Chronological readings with hold-last synthetic rows marked Filled."""
    from millrun.operators.gaps import chronological
    from millrun.operators.joins import with_tag_names
    f = with_tag_names(_filled(spark, sf_dir), _evt_tags(spark))
    return chronological(f.select("plant", "TagIndex", "TagName", "DateAndTime", "Val", "Filled"))


@register("gap_fill_audit")
def gap_fill_audit(spark, sf_dir):
    """Real, filled and total rows, flagged gaps and their seconds per tag."""
    from millrun.operators.gaps import fill_audit
    return fill_audit(_classified(spark, sf_dir))


# ------------------------------------------------------------ counts, hours

@register("threshold_counts")
def threshold_counts(spark, sf_dir):
    """Counts for all eight comparison operators."""
    return runhours.threshold_counts(_readings(spark, sf_dir), _evt_tags(spark), P.THRESHOLD,
                                     P.TBF, P.TAF, bad=P.BAD, request=_request(spark))


@register("run_hours_raw")
def run_hours_raw(spark, sf_dir):
    """A5 with fill off (the legacy raw count): audit columns NULL."""
    return _run_hours(spark, sf_dir, fill=False).select(
        "plant", "TagIndex", "tagName", "count", "hour", "realReadings", "filledReadings")


@register("tariff_hours_raw")
def tariff_hours_raw(spark, sf_dir):
    """A6 with raw counts instead of hours."""
    return _run_hours(spark, sf_dir, return_hours=False).select(
        "plant", "TagIndex", "tagName", "count", "A", "B", "C", "D", "total")


@register("run_hours_eras")
def run_hours_eras(spark, sf_dir):
    """A7 + J6: each cadence era filled and divided on its own, then summed."""
    df = _run_hours(spark, sf_dir, cadence_s=None, points_per_hour=None, eras=FX.eras(spark))
    return df.select(
        "plant", "TagIndex", "tagName", "count", "hour", "A", "B", "C", "D", "total",
        "realReadings", "filledReadings", "flaggedGaps", "flagged_s")


@register("run_hours_by_plant")
def run_hours_by_plant(spark, sf_dir):
    """A5/A6/A8 for two plants in one plan, each under its own configured
    policy: the event plant is filled at 600 s with 6 samples/h, the weighing
    plant (event data) is never filled and uses 360 samples/h."""
    from millrun.functions.time import parse_local
    span = (parse_local(P.ALL_TBF), parse_local(P.ALL_TAF))
    readings = _readings(spark, sf_dir, window=span).unionByName(FX.weighing_readings(spark, sf_dir))
    tags = FX.tags(spark)
    unknown = local_table(spark, [(FX.READINGS_PLANT, P.UNKNOWN_TAG)], REQUEST_SCHEMA)
    request = tags.select("plant", "TagIndex").unionByName(unknown)
    return runhours.count_run_hours_by_plant(
        readings, tags, FX.plant_config(spark), threshold=P.THRESHOLD, tbf=P.ALL_TBF,
        taf=P.ALL_TAF, cap_s=P.CAP_S, tolerance=P.TOLERANCE, holidays=FX.holidays(),
        request=request).drop("date_before", "date_after", "fillOptions")


@register("run_hours_by_plant_eras")
def run_hours_by_plant_eras(spark, sf_dir):
    """A7 in the all-plant plan: the same result as the one-plant era split."""
    from millrun.operators.runhours import count_run_hours_by_plant
    df = count_run_hours_by_plant(
        _readings(spark, sf_dir), _evt_tags(spark), FX.plant_config(spark), threshold=P.THRESHOLD,
        tbf=P.TBF, taf=P.TAF, cap_s=P.CAP_S, tolerance=P.TOLERANCE, holidays=FX.holidays(),
        request=_request(spark), eras=FX.eras(spark))
    return df.select(
        "plant", "TagIndex", "tagName", "count", "hour", "A", "B", "C", "D", "total",
        "realReadings", "filledReadings", "flaggedGaps", "flagged_s")


@register("fill_options")
def fill_options(spark, sf_dir):
    """The options each era of each tag was filled with."""
    df = _run_hours(spark, sf_dir, cadence_s=None, points_per_hour=None, eras=FX.eras(spark))
    return df.select("plant", "TagIndex", F.explode("fillOptions").alias("o")).select("plant", "TagIndex", "o.*")


@register("tariff_hours_calendar")
def tariff_hours_calendar(spark, sf_dir):
    """Tariff buckets with the calendar given as a DataFrame."""
    calendar = local_table(spark, [(d,) for d in FX.holidays()], CALENDAR_SCHEMA)
    return _run_hours(spark, sf_dir, holidays=calendar).select(
        "plant", "TagIndex", "tagName", "A", "B", "C", "D", "total")


@register("run_hours_forced_era")
def run_hours_forced_era(spark, sf_dir):
    """Q12: a caller-given cadence forces one era (divisor defaults to 240)."""
    df = _run_hours(spark, sf_dir, cadence_s=P.CADENCE_S, points_per_hour=None, eras=FX.eras(spark))
    return df.select("plant", "TagIndex", "tagName", "count", "hour", "total",
                     "realReadings", "filledReadings", "flaggedGaps")


@register("counter_run_hours")
def counter_run_hours(spark, sf_dir):
    """Counter plant: three bad codes, never filled, 60 samples per hour."""
    return _run_hours(spark, sf_dir, bad=P.COUNTER_BAD, fill=False, threshold=P.COUNTER_THRESHOLD,
                      points_per_hour=P.COUNTER_POINTS_PER_HOUR).select(
        "plant", "TagIndex", "tagName", "count", "hour", "A", "B", "C", "D", "total")


@register("gap_correction_report")
def gap_correction_report(spark, sf_dir):
    """Raw vs gap-filled hours with the fill audit per tag."""
    return runhours.raw_vs_filled(_readings(spark, sf_dir), _evt_tags(spark), threshold=P.THRESHOLD,
                                  tbf=P.TBF, taf=P.TAF, bad=P.BAD, cadence_s=P.CADENCE_S,
                                  cap_s=P.CAP_S, tolerance=P.TOLERANCE,
                                  points_per_hour=P.POINTS_PER_HOUR)


# ------------------------------------------------------------------ reports

@register("uptime_accounting")
def uptime_accounting(spark, sf_dir):
    """running/stopped/filled/unmeasured seconds and uptime %."""
    from millrun.operators.reports import uptime
    return uptime(_readings(spark, sf_dir), _evt_tags(spark), P.TBF, P.TAF,
                  threshold=P.UPTIME_THRESHOLD, cadence_s=P.CADENCE_S, cap_s=P.CAP_S, bad=P.BAD)


@register("uptime_gaps")
def uptime_gaps(spark, sf_dir):
    """A16 flagged intervals with state before/after."""
    from millrun.operators.reports import uptime_gaps as op
    return op(_readings(spark, sf_dir), _evt_tags(spark), P.TBF, P.TAF,
              threshold=P.UPTIME_THRESHOLD, cadence_s=P.CADENCE_S, cap_s=P.CAP_S, bad=P.BAD)


@register("logging_completeness")
def logging_completeness(spark, sf_dir):
    """Samples per tag-day against 86400/cadence."""
    from millrun.operators.reports import completeness
    return completeness(_readings(spark, sf_dir), _evt_tags(spark), P.TBF, P.TAF,
                        cadence_s=P.CADENCE_S, bad=P.BAD)


# ----------------------------------------------------------------- weighing

def _cycles(spark, sf_dir):
    from millrun.operators.weighing import cycles
    r, t = _wl(spark, sf_dir)
    return cycles(r, t, P.WL_TBF, P.WL_TAF, bad=P.BAD)


def _filters():
    return dict(min_weight=P.MIN_WEIGHT, max_weight=P.MAX_WEIGHT, min_id=P.MIN_ID, max_id=P.MAX_ID)


@register("weighing_pivot")
def weighing_pivot(spark, sf_dir):
    """A14 + P5: one row per weighing cycle."""
    from millrun.operators.weighing import formatted
    return formatted(_cycles(spark, sf_dir))


@register("weighing_pivot_filtered")
def weighing_pivot_filtered(spark, sf_dir):
    """weight and id range filters after the pivot (NULL compares as 0)."""
    from millrun.operators.weighing import filter_cycles, formatted
    return formatted(filter_cycles(_cycles(spark, sf_dir), **_filters()))


@register("weighing_pivot_silo")
def weighing_pivot_silo(spark, sf_dir):
    """F12 equality filter: one silo (NULL never matches)."""
    from millrun.operators.weighing import filter_cycles, formatted
    return formatted(filter_cycles(_cycles(spark, sf_dir), silo=P.SILO))


@register("weighing_summary")
def weighing_summary(spark, sf_dir):
    """Cycles, total and average weight of the filtered cycles."""
    from millrun.operators.weighing import filter_cycles, summary
    return summary(filter_cycles(_cycles(spark, sf_dir), **_filters()))


@register("weighing_summary_echo")
def weighing_summary_echo(spark, sf_dir):
    """The route's summary with the filters it was asked for."""
    from millrun.plans.routes import pivot_filter
    r, t = _wl(spark, sf_dir)
    return pivot_filter(r, t, P.WL_TBF, P.WL_TAF, **P.WL_FILTERS)[1]


# -------------------------------------------------------------------- alarms

@register("weighing_pivot_material")
def weighing_pivot_material(spark, sf_dir):
    """F12 equality filter: one material."""
    from millrun.operators.weighing import filter_cycles, formatted
    return formatted(filter_cycles(_cycles(spark, sf_dir), material=P.MATERIAL))


@register("weighing_pivot_loader")
def weighing_pivot_loader(spark, sf_dir):
    """F12 equality filter: one wheel loader."""
    from millrun.operators.weighing import filter_cycles, formatted
    return formatted(filter_cycles(_cycles(spark, sf_dir), wlno=P.LOADER))


@register("weighing_pivot_id")
def weighing_pivot_id(spark, sf_dir):
    """F12 equality filter: one id."""
    from millrun.operators.weighing import filter_cycles, formatted
    return formatted(filter_cycles(_cycles(spark, sf_dir), id_=P.CYCLE_ID))


@register("alarm_recent")
def alarm_recent(spark, sf_dir):
    """Newest events, fault noise excluded (limit is the feature)."""
    from millrun.operators.alarms import recent
    return recent(_alarms(spark, sf_dir), as_of=P.AS_OF, limit=5000)


@register("alarm_recent_filtered")
def alarm_recent_filtered(spark, sf_dir):
    """T3 with condition family, group and a plant-local from/to window."""
    from millrun.operators.alarms import recent
    return recent(_alarms(spark, sf_dir), as_of=P.AS_OF, limit=5000, exclude_faults=False,
                  condition=P.CONDITION, group=P.GROUP, from_local=P.FROM_LOCAL, to_local=P.TO_LOCAL)


@register("alarm_source_history")
def alarm_source_history(spark, sf_dir):
    """T4: one source's history over the longest look-back."""
    from millrun.operators.alarms import source_history
    return source_history(_alarms(spark, sf_dir, P.MAX_HOURS), P.SOURCE, as_of=P.AS_OF, limit=5000,
                          hours=P.MAX_HOURS)


@register("alarm_source_window")
def alarm_source_window(spark, sf_dir):
    """T4 with a from/to window and an exact-family condition."""
    from millrun.operators.alarms import source_history
    return source_history(_alarms(spark, sf_dir), P.SOURCE, as_of=P.AS_OF, limit=5000,
                          from_local=P.FROM_LOCAL, to_local=P.TO_LOCAL, condition="TRIP_L")


@register("alarm_active")
def alarm_active(spark, sf_dir):
    """Alarms standing at as_of (latest event per source+condition active)."""
    from millrun.operators.alarms import active
    return active(_alarms(spark, sf_dir, P.MAX_HOURS), as_of=P.AS_OF, hours=P.MAX_HOURS)


@register("alarm_active_unacked")
def alarm_active_unacked(spark, sf_dir):
    """W1 + F13 + F10: unacknowledged standing TRIP-family alarms."""
    from millrun.operators.alarms import active
    return active(_alarms(spark, sf_dir, P.MAX_HOURS), as_of=P.AS_OF, hours=P.MAX_HOURS,
                  condition=P.CONDITION, acked=False)


@register("alarm_daily")
def alarm_daily(spark, sf_dir):
    """Events per plant-local day, real vs fault."""
    from millrun.operators.alarms import daily
    return daily(_alarms(spark, sf_dir), as_of=P.AS_OF, days=P.MAX_DAYS)


@register("alarm_noisy")
def alarm_noisy(spark, sf_dir):
    """A10: top chattering source+condition pairs."""
    from millrun.operators.alarms import noisy
    return noisy(_alarms(spark, sf_dir, P.MAX_HOURS), as_of=P.AS_OF, hours=P.MAX_HOURS, top=50)


@register("alarm_noisy_group")
def alarm_noisy_group(spark, sf_dir):
    """A10 restricted to one group."""
    from millrun.operators.alarms import noisy
    return noisy(_alarms(spark, sf_dir, P.MAX_HOURS), as_of=P.AS_OF, hours=P.MAX_HOURS, top=50, group=P.GROUP)


@register("alarm_groups")
def alarm_groups(spark, sf_dir):
    """Every group with its event count and last event (all time)."""
    from millrun.operators.alarms import groups
    return groups(_alarms(spark, sf_dir))


@register("alarm_groups_window")
def alarm_groups_window(spark, sf_dir):
    """A11 with a look-back."""
    from millrun.operators.alarms import groups
    return groups(_alarms(spark, sf_dir, P.MAX_HOURS), as_of=P.AS_OF, hours=P.MAX_HOURS)


@register("alarm_recent_source")
def alarm_recent_source(spark, sf_dir):
    """Newest events of one source, fault noise excluded."""
    from millrun.operators.alarms import recent
    return recent(_alarms(spark, sf_dir, P.MAX_HOURS), as_of=P.AS_OF, limit=5000, source=P.SOURCE, hours=P.MAX_HOURS)


@register("alarm_active_acked")
def alarm_active_acked(spark, sf_dir):
    """W1 + F13: acknowledged standing alarms."""
    from millrun.operators.alarms import active
    return active(_alarms(spark, sf_dir, P.MAX_HOURS), as_of=P.AS_OF, hours=P.MAX_HOURS, acked=True)


@register("alarm_faults")
def alarm_faults(spark, sf_dir):
    """Quality-fault ranking per source."""
    from millrun.operators.alarms import faults
    return faults(_alarms(spark, sf_dir, P.MAX_HOURS), as_of=P.AS_OF, hours=P.MAX_HOURS, top=50)


@register("alarm_heartbeat")
def alarm_heartbeat(spark, sf_dir):
    """Newest event, minutes since, total rows, logging_ok."""
    from millrun.operators.alarms import heartbeat
    return heartbeat(_alarms(spark, sf_dir), as_of=P.AS_OF)


# --------------------------------------------------- kept state and rollups

def _until(events, day):
    """The log up to a UTC day, as a batch job would read it."""
    return events.where(F.to_date("EventTimeStamp") <= F.lit(day))


@register("alarm_active_state")
def alarm_active_state(spark, sf_dir):
    """W1 from kept state that was advanced over the log in three batches of days."""
    from millrun.operators.alarms import active_from_state, active_state
    log, state, last = _alarms(spark, sf_dir), None, None
    for day in (*P.BATCH_DAYS, None):
        new = log if day is None else _until(log, day)
        new = new if last is None else new.where(F.to_date("EventTimeStamp") > F.lit(last))
        state, last = active_state(state, new), day
    return active_from_state(state, as_of=P.AS_OF, hours=P.MAX_HOURS, acked=False)


@register("readings_latest_state")
def readings_latest_state(spark, sf_dir):
    """T2 from kept state that was advanced over the readings in two batches."""
    from millrun.operators.readings import latest_from_state, latest_state
    r, day = FX.readings(spark, sf_dir), F.to_date("DateAndTime")
    state = latest_state(None, r.where(day <= F.lit(P.BATCH_DAYS[0])), bad=P.BAD)
    state = latest_state(state, r.where(day > F.lit(P.BATCH_DAYS[0])), bad=P.BAD)
    return latest_from_state(state, _evt_tags(spark))


def _rollup(spark, sf_dir):
    from millrun.operators.rollup import daily_rollup
    log = _alarms(spark, sf_dir)
    return daily_rollup(_until(log, P.ROLLED_TO)), log


@register("alarm_daily_rollup")
def alarm_daily_rollup(spark, sf_dir):
    """A9 from daily partial aggregates; days after the rollup come from the log."""
    from millrun.operators.rollup import daily
    return daily(*_rollup(spark, sf_dir), as_of=P.AS_OF, rolled_to=P.ROLLED_TO, days=P.MAX_DAYS)


@register("alarm_noisy_rollup")
def alarm_noisy_rollup(spark, sf_dir):
    """A10 over a window that starts and ends inside a day."""
    from millrun.operators.rollup import noisy
    return noisy(*_rollup(spark, sf_dir), as_of=P.EDGE_AS_OF, rolled_to=P.ROLLED_TO, hours=P.EDGE_HOURS, top=50)


@register("alarm_groups_rollup")
def alarm_groups_rollup(spark, sf_dir):
    """A11 of all time."""
    from millrun.operators.rollup import groups
    return groups(*_rollup(spark, sf_dir), rolled_to=P.ROLLED_TO)


@register("alarm_faults_rollup")
def alarm_faults_rollup(spark, sf_dir):
    """A12 over a window that starts and ends inside a day."""
    from millrun.operators.rollup import faults
    return faults(*_rollup(spark, sf_dir), as_of=P.EDGE_AS_OF, rolled_to=P.ROLLED_TO, hours=P.EDGE_HOURS, top=50)


# ------------------------------------------------- text times, shifted clock

@register("run_hours_text")
def run_hours_text(spark, sf_dir):
    """S7 + X4 + the calendar hook: readings whose times come as ISO text, some zoned and
    some plain; tariff buckets on a clock 90 minutes ahead, under a calendar that is a
    rule on that clock (odd days of the month are holidays)."""
    from millrun.sources.historian import text_readings
    ev = FX.readings(spark, sf_dir)
    text = F.date_format("DateAndTime", "yyyy-MM-dd'T'HH:mm:ss.SSS")
    text = F.when(F.col("seq") % 3 == 0, F.concat(text, F.lit("Z"))).when(F.col("seq") % 3 == 1, F.concat(
        F.date_format(F.timestamp_add("HOUR", F.lit(2), F.col("DateAndTime")), "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("+02:00"))
    ).otherwise(F.replace(text, F.lit("T"), F.lit(" ")))
    given = text_readings(ev.withColumn("DateAndTime", text))
    return runhours.count_run_hours(
        given, _evt_tags(spark), threshold=P.THRESHOLD, tbf=P.TBF, taf=P.TAF, bad=P.BAD, cadence_s=P.CADENCE_S,
        cap_s=P.CAP_S, tolerance=P.TOLERANCE, points_per_hour=P.POINTS_PER_HOUR, tz_offset_minutes=P.CLOCK_OFFSET_MINUTES,
        holidays=F.dayofmonth("_clock") % 2 == 1, request=_request(spark)).select(
        "plant", "TagIndex", "tagName", "count", "hour", "A", "B", "C", "D", "total", "realReadings", "filledReadings")

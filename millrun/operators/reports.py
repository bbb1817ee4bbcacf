"""Uptime accounting and logging completeness.

A17 (raw vs gap-filled run-hours per tag) lives in ``runhours.raw_vs_filled``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrun.functions.predicates import good_status, in_window
from millrun.functions.time import diff_millis
from millrun.operators.gaps import CHUNK_MS, ORDER, SERIES, with_successor
from millrun.operators.joins import known_only
from millrun.sources import registry as R


def _pairs(readings, tags, tbf, taf, bad, chunk_ms):
    # A reading without a value says nothing about the machine's state: it is dropped
    # before pairing, so the interval between its neighbours is judged by its length.
    r = known_only(readings.where(in_window(tbf, taf) & good_status(bad) & F.col("Val").isNotNull()), tags)
    s = with_successor(r.select(*SERIES, *ORDER, "Val"), chunk_ms=chunk_ms).where(F.col("next_DateAndTime").isNotNull())
    return s.withColumn("dt_ms", diff_millis("DateAndTime", "next_DateAndTime"))


def _classified(readings, tags, tbf, taf, threshold, cadence_s, cap_s, bad, chunk_ms):
    s = _pairs(readings, tags, tbf, taf, bad, chunk_ms)
    sa = F.col("Val") >= F.lit(float(threshold))
    sb = F.col("next_Val") >= F.lit(float(threshold))
    normal = F.col("dt_ms") <= F.lit(cadence_s * 1000.0 * R.GAP_NORMAL_FACTOR)
    bridge = ~normal & (F.col("dt_ms") <= F.lit(cap_s * 1000.0)) & (sa == sb)
    return s.withColumns({"state_before": sa, "state_after": sb, "_normal": normal,
                          "_bridge": bridge, "_unmeasured": ~normal & ~bridge})


def uptime(readings: DataFrame, tags: DataFrame, tbf, taf, threshold: float = R.UPTIME_THRESHOLD,
           cadence_s: float = R.GAP_CADENCE_S, cap_s: float = R.GAP_CAP_S,
           bad: Sequence[str] = ("E",), chunk_ms: int | str | None = CHUNK_MS) -> DataFrame:
    """Per tag, seconds running / stopped / filled / unmeasured over the
    intervals between consecutive readings, and uptime % of measured time.

    Running means ``Val >= threshold`` at the interval start. An interval up to
    1.5 x cadence is measured; a longer one up to ``cap`` whose two ends are in
    the same state is filled (and measured); anything else is unmeasured and
    flagged. Durations are summed as integer milliseconds (exact), then shown
    in seconds. Tags with fewer than two readings have no row.
    """
    x = _classified(readings, tags, tbf, taf, threshold, cadence_s, cap_s, bad, chunk_ms)
    meas = F.col("_normal") | F.col("_bridge")
    ms = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("dt_ms"))), F.lit(0))
    agg = x.groupBy(*SERIES).agg(
        ms(meas & F.col("state_before")).alias("_run"),
        ms(meas & ~F.col("state_before")).alias("_stop"),
        ms(F.col("_bridge")).alias("_fill"),
        ms(F.col("_unmeasured")).alias("_unm"),
        F.count_if(F.col("_unmeasured")).alias("flagged_gaps"))
    run, stop = F.col("_run") / 1000.0, F.col("_stop") / 1000.0
    measured = run + stop
    return agg.select(
        *SERIES,
        ((F.col("_run") + F.col("_stop") + F.col("_unm")) / 1000.0).alias("span_s"),
        run.alias("running_s"), stop.alias("stopped_s"),
        (F.col("_fill") / 1000.0).alias("filled_s"), (F.col("_unm") / 1000.0).alias("unmeasured_s"),
        F.when(measured > 0, run / measured * 100.0).otherwise(F.lit(0.0)).alias("uptime_pct"),
        "flagged_gaps")


def uptime_gaps(readings: DataFrame, tags: DataFrame, tbf, taf, threshold: float = R.UPTIME_THRESHOLD,
                cadence_s: float = R.GAP_CADENCE_S, cap_s: float = R.GAP_CAP_S,
                bad: Sequence[str] = ("E",), chunk_ms: int | str | None = CHUNK_MS) -> DataFrame:
    """A16 flagged intervals with the machine state on both sides."""
    x = _classified(readings, tags, tbf, taf, threshold, cadence_s, cap_s, bad, chunk_ms)
    reason = F.when(F.col("dt_ms") > F.lit(cap_s * 1000.0), F.lit(R.REASON_EXCEEDS_CAP)) \
              .otherwise(F.lit(R.REASON_STATE_MISMATCH))
    return x.where(F.col("_unmeasured")).select(
        *SERIES, F.col("DateAndTime").alias("from_ts"), F.col("next_DateAndTime").alias("to_ts"),
        (F.col("dt_ms") / 1000.0).alias("gap_s"), "state_before", "state_after", reason.alias("reason"))


def completeness(readings: DataFrame, tags: DataFrame, tbf, taf, cadence_s: float = R.GAP_CADENCE_S,
                 bad: Sequence[str] = ("E",)) -> DataFrame:
    """Per tag and plant-local day, samples logged vs expected
    (86400 / cadence). Days between a tag's first and last logged day that have
    no sample at all are reported with 0."""
    r = known_only(readings.where(in_window(tbf, taf) & good_status(bad)), tags)
    per_day = r.groupBy(*SERIES, F.to_date("DateAndTime").alias("day")).agg(
        F.count(F.lit(1)).alias("samples"))
    # a logged day also stands for the empty days up to the next one, so the readings are scanned once
    following = F.lead("day").over(Window.partitionBy(*SERIES).orderBy("day"))
    until = F.coalesce(F.date_sub(following, 1), F.col("day"))
    days = per_day.withColumn("_until", until).select(*SERIES, F.col("day").alias("_logged"), "samples",
                                                      F.explode(F.sequence("day", "_until")).alias("day"))
    out = days.withColumn("samples", F.when(F.col("day") == F.col("_logged"), F.col("samples")).otherwise(0))
    expected = F.lit(86400.0 / float(cadence_s))
    samples = F.col("samples")
    return out.select(*SERIES, "day", expected.alias("expected"), samples.alias("samples"),
                      (expected - samples).alias("missing"),
                      (samples / expected * 100.0).alias("completeness_pct"))

"""Batch jobs that write several outputs from one expensive intermediate.

The gap-filled readings feed several outputs; they are written once, as Parquet
beside the outputs or as a reliable checkpoint, so each output re-reads them
instead of re-running scan, shuffle and window, and a lost executor only costs a
re-read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from millrun.operators import gaps as G
from millrun.operators.joins import known_only
from millrun.operators.runhours import select_window
from millrun.sources.historian import materialize, write_result


def gap_report_job(spark: SparkSession, readings: DataFrame, tags: DataFrame, out_dir: str, *,
                   tbf, taf, cadence_s=None, cap_s=None, tolerance=None,
                   bad: Sequence[str] = ("E",), fmt: str = "parquet") -> dict[str, str]:
    """Write filled readings (R4), flagged gaps (W2) and the fill audit
    for every tag of ``readings`` in ``[tbf, taf]``. Returns output paths."""
    opts = G.FillOptions.resolve(cadence_s, cap_s, tolerance)
    r = known_only(select_window(readings, tbf, taf, bad), tags)
    filled = materialize(G.gap_fill(r.select(*G.SERIES, *G.ORDER, "Val"), opts.cadence_s, opts.cap_s, opts.tolerance))
    outs = {
        "filled_readings": filled.select("plant", "TagIndex", "DateAndTime", "Val", "Filled"),
        "flagged_gaps": G.flagged_gaps(filled),
        "fill_audit": G.fill_audit(filled),
    }
    paths = {}
    for name, df in outs.items():
        paths[name] = f"{out_dir}/{name}"
        write_result(df, paths[name], fmt)
    return paths


def daily_report_job(spark: SparkSession, readings_path: str, tags_path: str, out_dir: str, *,
                     tbf, taf, threshold: float, cap_s=None, tolerance=None,
                     plant_config: DataFrame | None = None, fmt: str = "parquet") -> dict[str, str]:
    """The production batch: read the stored historian for ``[tbf, taf]``
    (partition-pruned), fill every plant under its own policy and cadence eras
    once, write that as Parquet by plant and day (``filled_rows``), and from its
    columns write filled readings, flagged gaps, the fill audit and run-hours
    with tariff buckets."""
    from pyspark.sql import functions as F

    from millrun import schemas
    from millrun.operators.runhours import fill_by_plant, run_hours_from_filled
    from millrun.plans.routes import registry_eras
    from millrun.sources import registry as R
    from millrun.sources.historian import read_readings, stored
    from millrun.sources.local import local_table
    cfg = (plant_config if plant_config is not None else
           local_table(spark, list(R.PLANT_POLICY), schemas.PLANT_CONFIG))
    readings = read_readings(spark, readings_path, tbf=tbf, taf=taf).drop("event_date")
    tags = spark.read.parquet(tags_path)
    filled, cfg_b = fill_by_plant(readings, tags, cfg, tbf=tbf, taf=taf, cap_s=cap_s,
                                  tolerance=tolerance, eras=registry_eras(spark))
    filled = stored(filled.withColumn("event_date", F.to_date("DateAndTime")).hint("rebalance", "plant", "event_date"),
                    f"{out_dir}/filled_rows", ("plant", "event_date"))
    fills = filled.where(F.col("_fill"))
    outs = {
        "filled_readings": fills.select("plant", "TagIndex", "DateAndTime", "Val", "Filled"),
        "flagged_gaps": G.flagged_gaps(fills),
        "fill_audit": G.fill_audit(fills),
        "run_hours": run_hours_from_filled(filled, tags, cfg_b, threshold=threshold, tbf=tbf,
                                           taf=taf, holidays=R.holiday_dates()),
    }
    paths = {}
    for name, df in outs.items():
        paths[name] = f"{out_dir}/{name}"
        write_result(df, paths[name], fmt)
    return paths


def alarm_state_job(spark: SparkSession, log_path: str, state_path: str, rollup_path: str, through) -> None:
    """The daily batch of the alarm log: standing alarms as kept state and the daily partial
    aggregates, advanced to the end of day ``through``. Reads new days only; a failed or
    repeated run changes nothing of the days before."""
    from millrun.operators.alarms import active_state
    from millrun.sources.historian import advance_rollup, advance_state, read_alarm_events
    log = read_alarm_events(spark, log_path)
    advance_state(log, state_path, through, active_state)
    advance_rollup(log, rollup_path, through)


def _alarms_main(argv) -> int:
    import argparse
    import datetime as dt

    from millrun.session import get_session
    ap = argparse.ArgumentParser(description="daily alarm state and rollup")
    for a in ("--log", "--state", "--rollup", "--through"):
        ap.add_argument(a, required=True)
    ap.add_argument("--profile", default="cluster")
    args = ap.parse_args(argv)
    alarm_state_job(get_session(profile=args.profile), args.log, args.state, args.rollup, dt.date.fromisoformat(args.through))
    return 0


def main(argv=None) -> int:
    """``python -m millrun.plans.jobs --readings P --tags P --out P
    --tbf '2026-07-06 00:00:00' --taf '2026-07-06 23:59:59' --threshold 0``, or
    ``python -m millrun.plans.jobs alarms --log P --state P --rollup P --through 2026-07-06``"""
    import argparse
    import sys

    from millrun.session import get_session
    argv = sys.argv[1:] if argv is None else list(argv)
    if argv[:1] == ["alarms"]:
        return _alarms_main(argv[1:])
    ap = argparse.ArgumentParser(description="daily gap-fill and run-hours report")
    for a in ("--readings", "--tags", "--out", "--tbf", "--taf"):
        ap.add_argument(a, required=True)
    ap.add_argument("--plant-config", default=None, help="Parquet of plant policies (default: the registry's)")
    ap.add_argument("--threshold", type=float, required=True)
    ap.add_argument("--cap", type=float, default=None)
    ap.add_argument("--tolerance", type=float, default=None)
    ap.add_argument("--format", default="parquet")
    ap.add_argument("--profile", default="cluster")
    args = ap.parse_args(argv)
    spark = get_session(profile=args.profile)
    config = spark.read.parquet(args.plant_config) if args.plant_config else None
    paths = daily_report_job(spark, args.readings, args.tags, args.out, tbf=args.tbf, taf=args.taf,
                             plant_config=config, threshold=args.threshold, cap_s=args.cap, tolerance=args.tolerance,
                             fmt=args.format)
    for name, path in paths.items():
        print(f"{name}\t{path}")
    return 0


if __name__ == "__main__":
    import sys
    sys.exit(main())

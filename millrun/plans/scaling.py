"""Scaling check: flagship run-hours on k copies of the driver's readings.

The copies are made by Spark from the given table (``explode(sequence(0,
k-1))``), each shifted 30 days later with its own ``seq`` range, so every
tag's series is k months long and the work grows k-fold. Prints one line per
k with rows in, seconds (warm, best of 2) and rows per second. Run:
``python -m millrun.plans.scaling /root/testdata/sf0.1 1 4 16 64``.
"""

from __future__ import annotations

import datetime as dt
import sys
import time

from pyspark.sql import functions as F

SHIFT_DAYS = 30


def replicated_readings(spark, sf_dir: str, k: int):
    from millrun.sources import fixtures as FX
    r = FX.readings(spark, sf_dir)
    copy = F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("_copy")
    x = r.select("*", copy)
    return x.select(
        "plant", "TagIndex",
        F.timestamp_add("DAY", F.col("_copy") * SHIFT_DAYS, F.col("DateAndTime")).alias("DateAndTime"),
        "Val", "Status", (F.col("seq") + F.col("_copy").cast("long") * F.lit(10 ** 9)).alias("seq"))


def run(spark, sf_dir: str, k: int) -> tuple[int, float]:
    from millrun.operators import runhours
    from millrun.operators.joins import size_check_scope
    from millrun.plans import params as P
    from millrun.sources import fixtures as FX
    readings = replicated_readings(spark, sf_dir, k)
    tags = FX.tags(spark).where(F.col("plant") == FX.READINGS_PLANT)
    taf = (dt.datetime(2024, 1, 31) + dt.timedelta(days=SHIFT_DAYS * k)).isoformat(sep=" ")
    n = readings.count()
    best = None
    for _ in range(2):
        t0 = time.perf_counter()
        with size_check_scope():
            df = runhours.count_run_hours(
                readings, tags, threshold=P.THRESHOLD, tbf=P.TBF, taf=taf, bad=P.BAD,
                cadence_s=P.CADENCE_S, cap_s=P.CAP_S, tolerance=P.TOLERANCE,
                points_per_hour=P.POINTS_PER_HOUR, holidays=FX.holidays())
        df.write.format("noop").mode("overwrite").save()
        t = time.perf_counter() - t0
        best = t if best is None else min(best, t)
    return n, best


def main(argv) -> int:
    from millrun.session import get_session
    sf_dir = argv[0] if argv else "/root/testdata/sf0.1"
    ks = [int(a) for a in argv[1:]] or [1, 4, 16]
    spark = get_session("local[8]", 16)
    run(spark, "/root/testdata/sf0.001", 1)          # warm-up
    print("copies  rows_in     seconds  rows_per_s")
    for k in ks:
        n, t = run(spark, sf_dir, k)
        print(f"{k:6d}  {n:10d}  {t:8.2f}  {n / t:10.0f}", flush=True)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))

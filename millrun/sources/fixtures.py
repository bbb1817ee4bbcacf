"""Views over the driver's test tables, shaped like the historian inputs.

``events`` becomes both a readings table (plant 'EVT', 8 tags, every status
path) and an alarm-event log; ``lineitem`` x ``orders`` becomes weighing-cycle
event data (plant 'WL'). Definitions follow FIXTURES.md section 3 and are
mirrored in DuckDB SQL by ``millrun.plans.oracle``.
"""

from __future__ import annotations

import datetime as dt
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrun import schemas
from millrun.functions.time import file_ticks, trunc_ms, ts_lit
from millrun.sources import registry as R
from millrun.sources.local import local_table

READINGS_PLANT = "EVT"
WEIGHING_PLANT = "WL"
N_TAGS = 8           # TagIndex = user_id % 8
N_KNOWN_TAGS = 7     # tags 0..6 are named; 7 is the unknown tag
N_SOURCES = 40
N_AREAS = 4
# Rows of ``lineitem`` and ``orders`` that one task of the weighing join gets on average. Its
# hash aggregates and sorts hold them all, so this bounds the memory of a task.
WEIGHING_TASK_ROWS = 250_000

# Test values of the fixtures (FIXTURES.md section 3).
# Two extra weighing tags that are not part of the pivot (lines 6 and 7).
WEIGHING_OTHER_TAGS = ["[PLC_Crushing]BRS_INT[09]", "[PLC_Crushing]BRS_REAL[27]"]
# Fixture calendar, eras and clock (FIXTURES.md section 3).
FIXTURE_HOLIDAYS = ["2024-01-01", "2024-01-15", "2024-01-25"]
FIXTURE_ERA_CHANGE = dt.datetime(2024, 1, 16, 0, 0, 0)
FIXTURE_ERAS = [(0, 600.0, 6.0), (1, 900.0, 4.0)]
FIXTURE_AS_OF = dt.datetime(2024, 1, 31, 0, 0, 0)
# Policy of the fixture plant: bad 'E', cadence 600 s, 6 samples/h, fills.
FIXTURE_PLANT_POLICY = (READINGS_PLANT, ["E"], 600.0, 6.0, True, True)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def readings(spark: SparkSession, sf_dir: str, window: tuple | None = None) -> DataFrame:
    """Readings ``(plant, TagIndex, DateAndTime, Val, Status, seq)``.

    With ``window=(lo, hi)`` (datetimes) the bound is also put on the raw
    ``ts`` column so the Parquet scan prunes row groups: truncation to ms is
    monotone, so ``trunc_ms(ts) <= hi`` iff ``ts < hi + 1 ms``.
    """
    ev = _table(spark, sf_dir, "events")
    if window is not None:
        lo, hi = window
        ev = ev.where((F.col("ts") >= ts_lit(lo))
                      & (F.col("ts") < ts_lit(hi + dt.timedelta(milliseconds=1))))
    code = F.col("event_id") % 50
    status = (F.when(code == 0, "E").when(code == 1, "U").when(code == 2, "S")
              .when(code == 3, F.lit(None).cast("string")).otherwise("G"))
    return ev.select(
        F.lit(READINGS_PLANT).alias("plant"),
        (F.col("user_id") % N_TAGS).cast("int").alias("TagIndex"),
        trunc_ms("ts").alias("DateAndTime"),
        F.col("value").alias("Val"),
        status.alias("Status"),
        F.col("event_id").alias("seq"),
    )


def tags(spark: SparkSession) -> DataFrame:
    """S2 dimension: ``EVT`` tags 0..6 named ``TAG_i`` plus the weighing tags."""
    rows = [(READINGS_PLANT, i, f"TAG_{i}") for i in range(N_KNOWN_TAGS)]
    return local_table(spark, rows, schemas.TAGS).unionByName(weighing_tags(spark))


def tags_from_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S2 dimension derived from the tables themselves: the tag indexes that
    occur in ``events`` (0..6 named, 7 left unknown) and the line numbers of
    ``lineitem`` that carry a weighing tag name."""
    evt = (_table(spark, sf_dir, "events")
           .select((F.col("user_id") % N_TAGS).cast("int").alias("TagIndex")).distinct()
           .where(F.col("TagIndex") < N_KNOWN_TAGS)
           .select(F.lit(READINGS_PLANT).alias("plant"), "TagIndex",
                   F.concat(F.lit("TAG_"), F.col("TagIndex").cast("string")).alias("TagName")))
    lines = (_table(spark, sf_dir, "lineitem")
             .select(F.col("l_linenumber").cast("int").alias("TagIndex")).distinct())
    wl = lines.join(F.broadcast(weighing_tags(spark)), "TagIndex")
    return evt.unionByName(wl.select("plant", "TagIndex", "TagName"))


def weighing_tags(spark: SparkSession) -> DataFrame:
    names = [t for t, _ in R.WEIGHING_TAGS] + WEIGHING_OTHER_TAGS
    rows = [(WEIGHING_PLANT, i + 1, n) for i, n in enumerate(names)]
    return local_table(spark, rows, schemas.TAGS)


def plants(spark: SparkSession) -> DataFrame:
    rows = list(R.PLANT_DESCRIPTIONS) + [(READINGS_PLANT, "Synthetic event plant")]
    return local_table(spark, rows, schemas.PLANTS)


def weighing_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighing event data: one cycle per order at ``o_orderdate + o_orderkey s``;
    line numbers are tags; quantities of 5 or less are logged as 0.

    ``lineitem`` is hash-partitioned by order key once: that partitioning
    satisfies both the (order, line) aggregate and the join with ``orders``, so
    the largest table is shuffled a single time. The number of partitions follows
    the rows (counted from the Parquet footers): without one, adaptive execution
    merges partitions down to about the number of cores, and a task grows with the input.
    Both tables grow, so neither is broadcast, whatever its estimated size.
    """
    li = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    o = _table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    parts = max(2, math.ceil((li.count() + o.count()) / WEIGHING_TASK_ROWS))  # one is not by key, and shuffled again
    li = (li.repartition(parts, "l_orderkey")
          .groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("q")))
    j = li.join(o.hint("merge"), li["l_orderkey"] == o["o_orderkey"])
    val = F.when(F.col("q") <= 5, F.lit(0.0)).otherwise(F.col("q"))
    return j.select(
        F.lit(WEIGHING_PLANT).alias("plant"),
        F.col("l_linenumber").cast("int").alias("TagIndex"),
        F.timestamp_add("SECOND", F.col("o_orderkey"), F.col("o_orderdate")).alias("DateAndTime"),
        val.alias("Val"),
        F.lit("G").alias("Status"),
        F.col("o_orderkey").alias("seq"),
    )


def alarm_events(spark: SparkSession, sf_dir: str, since: dt.datetime | None = None) -> DataFrame:
    """S3: alarm log rows in the event-table schema (UTC instants); ``since`` is a
    bound on the stored time column, which the scan can use."""
    ev = _table(spark, sf_dir, "events")
    if since is not None:
        ev = ev.where(F.col("ts") >= ts_lit(since))
    eid, uid = F.col("event_id"), F.col("user_id")
    cond = (F.when(F.col("event_type") == "error", "TRIP")
            .when(F.col("event_type") == "signup", "TRIP_L")
            .when(F.col("event_type") == "purchase", "HI")
            .when(F.col("event_type") == "click", "LO").otherwise("EVENT"))
    msg = (F.when(eid % 10 == 0, "Alarm fault: quality is bad")
           .when(eid % 10 == 1, F.lit(None).cast("string"))
           .when(eid % 10 == 2, "Input quality is bad")
           .otherwise(F.concat(F.lit("Event "), F.col("event_type"))))
    return ev.select(
        eid.cast("string").alias("EventID"),
        trunc_ms("ts").alias("EventTimeStamp"),
        file_ticks("ts").alias("TicksTimeStamp"),
        F.concat(F.lit("SRC_"), (uid % N_SOURCES).cast("string")).alias("SourceName"),
        F.lit(None).cast("string").alias("SourcePath"),
        cond.alias("ConditionName"),
        cond.alias("SubConditionName"),
        msg.alias("Message"),
        F.concat(F.lit("Area "), (uid % N_AREAS).cast("string"), F.lit(".Alarm_Main")).alias("GroupPath"),
        F.floor("value").cast("int").alias("Severity"),
        (eid % 5).cast("int").alias("Priority"),
        F.col("value").alias("InputValue"),
        F.when(eid % 4 == 0, F.lit(None).cast("double")).otherwise(F.lit(100.0)).alias("LimitValue"),
        (eid % 3 != 0).alias("Active"),
        (eid % 2 == 0).alias("Acked"),
    )


def plant_config(spark: SparkSession) -> DataFrame:
    """Per-plant policy as data: the registry's plants plus the fixture plant."""
    return local_table(spark, list(R.PLANT_POLICY) + [FIXTURE_PLANT_POLICY], schemas.PLANT_CONFIG)


def holidays() -> list[dt.date]:
    """Calendar for the fixture data: the listed years plus the fixture dates."""
    return R.holiday_dates(FIXTURE_HOLIDAYS)


def eras(spark: SparkSession) -> DataFrame:
    """Two cadence eras of the fixture plant, split at ``FIXTURE_ERA_CHANGE``."""
    (e0, c0, p0), (e1, c1, p1) = FIXTURE_ERAS
    rows = [(READINGS_PLANT, e0, None, FIXTURE_ERA_CHANGE, c0, p0),
            (READINGS_PLANT, e1, FIXTURE_ERA_CHANGE, None, c1, p1)]
    return local_table(spark, rows, schemas.ERAS)

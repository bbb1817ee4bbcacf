"""Historian and alarm-log storage: readers and writers at cluster scale.

Layout. Readings live in one Parquet dataset for all plants, partitioned by
``plant`` and plant-local ``event_date``; within a file, rows are clustered by
``(TagIndex, DateAndTime)`` so min/max statistics prune row groups for a tag or
time filter. The alarm log is partitioned by its UTC ``event_date``. A reader
given a window adds ``event_date`` bounds next to the time bounds, so Spark
prunes whole directories before it opens a file.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrun import schemas
from millrun.functions.time import iso_text_to_ntz, parse_local, trunc_ms, ts_lit
from millrun.operators.gaps import CHUNK_MS, chunk_of

READINGS_PARTITIONS = ("plant", "event_date")
ALARM_PARTITIONS = ("event_date",)
BUCKETS = ("plant", "TagIndex", "_chunk")


def _with_date(schema: T.StructType) -> T.StructType:
    return T.StructType(list(schema.fields) + [T.StructField("event_date", T.DateType())])


def _date_bounds(tbf, taf):
    lo = parse_local(tbf) if isinstance(tbf, str) else tbf
    hi = parse_local(taf) if isinstance(taf, str) else taf
    return lo, hi


# -------------------------------------------------------------------- readings

def write_readings(readings: DataFrame, path: str, mode: str = "append") -> None:
    """Store readings partitioned by plant and day, clustered by tag and time.

    The ``rebalance`` hint groups rows by (plant, day) so few files are written
    per directory, and lets AQE split a hot plant-day over several tasks
    instead of writing it from one. ``sortWithinPartitions`` clusters by
    (tag, time) for row-group pruning. Times are stored at the grain of milliseconds.
    """
    out = readings.withColumn("DateAndTime", trunc_ms("DateAndTime")).withColumn("event_date", F.to_date("DateAndTime"))
    out = out.hint("rebalance", "plant", "event_date") \
             .sortWithinPartitions("plant", "event_date", "TagIndex", "DateAndTime")
    out.write.mode(mode).partitionBy(*READINGS_PARTITIONS).parquet(path)


def read_readings(spark: SparkSession, path: str, plants: Sequence[str] | None = None,
                  tbf=None, taf=None) -> DataFrame:
    """Readings of the given plants (all if None), optionally bounded to a
    window; partition pruning on ``plant`` and ``event_date``, Parquet filter
    pushdown on ``DateAndTime``. The schema is declared, never inferred. Times that
    were stored finer are cut to milliseconds."""
    df = spark.read.schema(_with_date(schemas.READINGS)).parquet(path)
    if plants:
        df = df.where(F.col("plant").isin(list(plants)))
    if tbf is not None and taf is not None:
        lo, hi = _date_bounds(tbf, taf)
        df = df.where(F.col("event_date").between(F.lit(lo.date()), F.lit(hi.date())))
        # on the stored column, so that it reaches the scan: cut(t) <= hi where t < hi + 1 ms
        df = df.where((F.col("DateAndTime") >= ts_lit(lo)) & (F.col("DateAndTime") < ts_lit(hi + dt.timedelta(milliseconds=1))))
    return df.withColumn("DateAndTime", trunc_ms("DateAndTime"))


def write_bucketed(readings: DataFrame, table: str, buckets: int, path: str | None = None,
                   chunk_ms: int = CHUNK_MS, mode: str = "overwrite") -> None:
    """Store readings as a table in buckets of (plant, tag, time chunk), sorted by time.

    A successor window over such a table starts without a shuffle, a hot tag being spread
    over the buckets by its chunks. ``buckets`` is the number of tasks that read it; each
    bucket is written by one task, from one shuffle at load time."""
    out = (readings.withColumn("DateAndTime", trunc_ms("DateAndTime")).withColumn("_chunk", chunk_of("DateAndTime", chunk_ms))
           .repartition(buckets, *BUCKETS))
    writer = out.write.mode(mode).format("parquet").bucketBy(buckets, *BUCKETS).sortBy(*BUCKETS, "DateAndTime", "seq")
    (writer.option("path", path) if path else writer).saveAsTable(table)


def read_bucketed(spark: SparkSession, table: str) -> DataFrame:
    """Readings of a bucketed table with their ``_chunk``; pass ``chunk_ms="stored"`` to the operators."""
    return spark.table(table)


def read_readings_json(spark: SparkSession, path: str, plant: str, tag_index: int,
                       status: str = "G", array: bool = False) -> DataFrame:
    """Readings supplied as JSON objects ``{DateAndTime: ISO8601, Val}`` into
    the readings schema: one object per line (files are split among tasks), or
    with ``array`` one array per file. A malformed record fails the read. Zoned
    text is taken as its UTC wall clock, naive text as is; truncated to ms.
    Equal timestamps are ordered by a hash of the record, which no retry changes."""
    raw = (spark.read.schema(schemas.READINGS_JSON).option("mode", "FAILFAST")
           .option("multiLine", str(array).lower()).json(path))
    return text_readings(raw.select(
        F.lit(plant).alias("plant"), F.lit(int(tag_index)).alias("TagIndex"), "DateAndTime",
        F.col("Val").cast("double").alias("Val"), F.lit(status).alias("Status"),
        F.xxhash64("DateAndTime", "Val").alias("seq")))


def text_readings(readings: DataFrame) -> DataFrame:
    """Readings whose ``DateAndTime`` is ISO text, at the grain of milliseconds."""
    return readings.withColumn("DateAndTime", trunc_ms(iso_text_to_ntz("DateAndTime")))


def read_readings_jdbc(spark: SparkSession, url: str, fact_table: str, plant: str,
                       lower: dt.datetime, upper: dt.datetime, num_partitions: int = 64,
                       properties: dict | None = None) -> DataFrame:
    """S1 alternative: read one historian fact table over JDBC in parallel
    slices of ``DateAndTime``. The bounds only shape the slices, so the window is
    also a filter on the raw column, which the source can push down. Not
    exercised by the tests: it needs a database server."""
    reader = (spark.read.format("jdbc").option("url", url).option("dbtable", fact_table)
              .option("partitionColumn", "DateAndTime")
              .option("lowerBound", lower.isoformat(sep=" "))
              .option("upperBound", upper.isoformat(sep=" "))
              .option("numPartitions", str(num_partitions)))
    for k, v in (properties or {}).items():
        reader = reader.option(k, v)
    df = reader.load().where(F.col("DateAndTime").between(F.lit(lower), F.lit(upper)))
    return df.select(F.lit(plant).alias("plant"), F.col("TagIndex").cast("int"),
                     trunc_ms(F.col("DateAndTime").cast("timestamp_ntz")).alias("DateAndTime"),
                     F.col("Val").cast("double"), F.col("Status").cast("string"),
                     F.xxhash64("DateAndTime", "TagIndex", "Val", "Status").alias("seq"))


# ------------------------------------------------------------------ alarm log

def write_alarm_events(events: DataFrame, path: str, mode: str = "append") -> None:
    """Store the alarm log partitioned by UTC day, sorted by ticks."""
    out = events.withColumn("event_date", F.to_date("EventTimeStamp"))
    out.hint("rebalance", "event_date").sortWithinPartitions("event_date", "TicksTimeStamp") \
       .write.mode(mode).partitionBy(*ALARM_PARTITIONS).parquet(path)


def read_alarm_events(spark: SparkSession, path: str) -> DataFrame:
    """S3: the alarm log with its declared schema plus ``event_date``; the
    alarm operators add ``event_date`` bounds to every ticks bound."""
    return spark.read.schema(_with_date(schemas.ALARM_EVENTS)).parquet(path)


# ---------------------------------------------------------- kept state, rollups

def _partition_days(spark: SparkSession, path: str, name: str) -> list[dt.date]:
    """The days of a dataset's partitions, in order; none if it doesn't exist yet."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(where):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(where)]
    return sorted(dt.date.fromisoformat(n.split("=", 1)[1]) for n in names if n.startswith(name + "="))


def _write_days(df: DataFrame, path: str, day: str) -> None:
    """Replace the partitions that ``df`` has. They appear when the job commits, so a
    failed run leaves nothing and a repeated run replaces its own."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path))


def advance_state(log: DataFrame, path: str, through: dt.date, merge, day: str = "event_date") -> DataFrame:
    """Advance the state kept at ``path`` to the end of day ``through`` and return it.

    ``merge(state or None, new rows)`` gives the new state (``alarms.active_state``,
    ``readings.latest_state``). Only days after the day reached so far are read. Each
    state is a partition named by the day it reaches: running a day again gives the same
    partition, from the state before it, whatever a failed run left."""
    spark = log.sparkSession
    before = [d for d in _partition_days(spark, path, "reached") if d < through]
    new = log.where(F.col(day) <= F.lit(through))
    state = None
    if before:
        new = new.where(F.col(day) > F.lit(before[-1]))
        state = spark.read.parquet(f"{path}/reached={before[-1].isoformat()}")
    merged = merge(state, new.drop(day))
    _write_days(merged.withColumn("reached", F.lit(through)), path, "reached")
    # no row ever logged: no partition, and the next run starts from the first day again
    return read_state(spark, path, through) if through in _partition_days(spark, path, "reached") else merged.limit(0)


def read_state(spark: SparkSession, path: str, reached: dt.date | None = None) -> DataFrame:
    """The state that reaches a day, by default the newest."""
    reached = reached or _partition_days(spark, path, "reached")[-1]
    return spark.read.parquet(f"{path}/reached={reached.isoformat()}")


def advance_rollup(log: DataFrame, path: str, through: dt.date) -> dt.date:
    """Roll up the stored log's days that the rollup at ``path`` lacks, up to ``through``;
    returns ``through``, the day that ``operators.rollup`` may read it to."""
    from millrun.operators.rollup import daily_rollup
    done = [d for d in _partition_days(log.sparkSession, path, "event_date") if d <= through]
    new = log.where(F.col("event_date") <= F.lit(through))
    if done:
        # the newest rolled day again: a failed run may have stopped before the days after it
        new = new.where(F.col("event_date") >= F.lit(done[-1]))
    rolled = daily_rollup(new)
    _write_days(rolled.repartition("event_date"), path, "event_date")
    return through


def read_rollup(spark: SparkSession, path: str) -> DataFrame:
    """The stored rollup rows of all days."""
    return spark.read.parquet(path)


# ----------------------------------------------------------------------- sinks

def write_result(df: DataFrame, path: str, fmt: str = "json", mode: str = "overwrite") -> None:
    """A result row set as files (JSON lines by default, or Parquet)."""
    df.write.mode(mode).format(fmt).save(path)


def write_counted(df: DataFrame, path: str, fmt: str = "json", mode: str = "overwrite") -> int:
    """S6 ``{count, rows}``: write the rows and return how many there were, counted as they
    pass, in the one run of the plan that writes them."""
    seen = Observation("written")
    df.observe(seen, F.count(F.lit(1)).alias("count")).write.mode(mode).format(fmt).save(path)
    return seen.get["count"]


def stored(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Cut lineage by writing ``df`` once as Parquet and reading it back, so that
    every output of a job reads only its own columns of it."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage before a result feeds several outputs: a reliable checkpoint
    in the cluster's shared ``spark.checkpoint.dir`` (never a local one), so a
    lost executor costs a re-read, not a recomputation of the whole plan."""
    from millrun.session import checkpoint_dir
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)

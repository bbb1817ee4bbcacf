"""Fixed schemas of the inputs and outputs (never inferred)."""

from pyspark.sql import types as T

READINGS = T.StructType([
    T.StructField("plant", T.StringType(), False),
    T.StructField("TagIndex", T.IntegerType(), True),
    T.StructField("DateAndTime", T.TimestampNTZType(), True),
    T.StructField("Val", T.DoubleType(), True),
    T.StructField("Status", T.StringType(), True),
    T.StructField("seq", T.LongType(), True),
])

TAGS = T.StructType([
    T.StructField("plant", T.StringType(), False),
    T.StructField("TagIndex", T.IntegerType(), False),
    T.StructField("TagName", T.StringType(), True),
])

PLANTS = T.StructType([
    T.StructField("plant", T.StringType(), False),
    T.StructField("description", T.StringType(), True),
])

PLANT_CONFIG = T.StructType([
    T.StructField("plant", T.StringType(), False),
    T.StructField("bad_status", T.ArrayType(T.StringType()), False),
    T.StructField("cadence_s", T.DoubleType(), True),
    T.StructField("points_per_hour", T.DoubleType(), False),
    T.StructField("fill_window", T.BooleanType(), False),
    T.StructField("fill_count", T.BooleanType(), False),
])

# One row per logging-cadence era of a plant. ``from_ts`` is exclusive, ``to_ts``
# inclusive (the boundary row belongs to the earlier era); NULL = open.
ERAS = T.StructType([
    T.StructField("plant", T.StringType(), False),
    T.StructField("era_id", T.IntegerType(), False),
    T.StructField("from_ts", T.TimestampNTZType(), True),
    T.StructField("to_ts", T.TimestampNTZType(), True),
    T.StructField("cadence_s", T.DoubleType(), False),
    T.StructField("points_per_hour", T.DoubleType(), False),
])

HOLIDAYS = T.StructType([T.StructField("d", T.DateType(), False)])

ALARM_EVENTS = T.StructType([
    T.StructField("EventID", T.StringType(), True),
    T.StructField("EventTimeStamp", T.TimestampNTZType(), True),   # UTC, ms
    T.StructField("TicksTimeStamp", T.LongType(), True),           # 100 ns since 1601 UTC
    T.StructField("SourceName", T.StringType(), True),
    T.StructField("SourcePath", T.StringType(), True),
    T.StructField("ConditionName", T.StringType(), True),
    T.StructField("SubConditionName", T.StringType(), True),
    T.StructField("Message", T.StringType(), True),
    T.StructField("GroupPath", T.StringType(), True),
    T.StructField("Severity", T.IntegerType(), True),
    T.StructField("Priority", T.IntegerType(), True),
    T.StructField("InputValue", T.DoubleType(), True),
    T.StructField("LimitValue", T.DoubleType(), True),
    T.StructField("Active", T.BooleanType(), True),
    T.StructField("Acked", T.BooleanType(), True),
])

# Readings supplied as JSON documents ``[{DateAndTime: ISO8601, Val}]``.
READINGS_JSON = T.StructType([
    T.StructField("DateAndTime", T.StringType(), True),
    T.StructField("Val", T.DoubleType(), True),
])

"""Tariff bucket edges (FIXTURES.md §2) and the holiday calendar."""

import datetime as dt

import pytest

from millrun.functions.tariff import bucket_of, holiday_flag, with_holiday
from millrun.sources import registry as R
from millrun.sources.local import local_table
from millrun import schemas

WEEKDAY = dt.date(2026, 1, 7)     # Wednesday
SATURDAY = dt.date(2026, 1, 10)

EDGES = [
    ("05:59:59", "B", "D"), ("06:00:00", "B", "C"), ("08:59:59", "B", "C"),
    ("09:00:00", "A", "C"), ("18:00:00.999", "A", "C"), ("18:00:01", "A", "D"),
    ("22:00:00.999", "A", "D"), ("22:00:01", "B", "D"),
]


def _ts(day, clock):
    t = dt.time.fromisoformat(clock)
    return dt.datetime.combine(day, t)


@pytest.mark.parametrize("clock,weekday,weekend", EDGES)
def test_bucket_edges(spark, clock, weekday, weekend):
    rows = [(_ts(WEEKDAY, clock),), (_ts(SATURDAY, clock),)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz")
    got = [r.b for r in df.select(bucket_of("ts", holiday_flag("ts", [])).alias("b")).collect()]
    assert got == [weekday, weekend]


def test_listed_holiday_on_a_weekday(spark):
    day = dt.date(2026, 7, 28)    # Tuesday, listed
    df = spark.createDataFrame([(_ts(day, "10:00:00"),)], "ts timestamp_ntz")
    flag = df.select(holiday_flag("ts", R.holiday_dates()).alias("h")).first().h
    assert flag is True


def test_holiday_is_judged_by_the_rows_own_date(spark):
    # Monday 02:00 after a Sunday is an ordinary night hour (B).
    ts = dt.datetime(2026, 1, 12, 2, 0, 0)
    df = spark.createDataFrame([(ts,)], "ts timestamp_ntz")
    assert df.select(bucket_of("ts", holiday_flag("ts", [])).alias("b")).first().b == "B"


def test_calendar_dataframe_join_matches_literal_list(spark):
    days = [_ts(dt.date(2026, 7, d), "12:00:00") for d in range(20, 31)]
    df = spark.createDataFrame([(t,) for t in days], "DateAndTime timestamp_ntz")
    cal = local_table(spark, [(d,) for d in R.holiday_dates()], schemas.HOLIDAYS)
    a = with_holiday(df, R.holiday_dates()).orderBy("DateAndTime").collect()
    b = with_holiday(df, cal).orderBy("DateAndTime").collect()
    assert [r.is_holiday for r in a] == [r.is_holiday for r in b]

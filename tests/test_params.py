"""Alarm argument rules: ranges, window resolution, condition family."""

import datetime as dt

import pytest

from millrun.functions.predicates import compare, condition_family
from millrun.operators.alarms import check_range, time_window

AS_OF = dt.datetime(2026, 7, 19, 12, 0, 0)


def test_ranges_reject_never_clamp():
    check_range("limit", 5000, (1, 5000))
    for v in (0, 5001, 9999, -1):
        with pytest.raises(ValueError):
            check_range("limit", v, (1, 5000))
    with pytest.raises(ValueError):
        check_range("days", -1, (1, 90))


def test_time_window_rules():
    assert time_window(AS_OF) == (None, None)
    assert time_window(AS_OF, hours_default=168)[0] == AS_OF - dt.timedelta(hours=168)
    assert time_window(AS_OF, hours=2) == (AS_OF - dt.timedelta(hours=2), None)
    f, t = time_window(AS_OF, from_local="2026-07-10 08:00")
    assert f == dt.datetime(2026, 7, 10, 1) and t is None
    with pytest.raises(ValueError):
        time_window(AS_OF, hours=2, from_local="2026-07-10 08:00")
    with pytest.raises(ValueError):
        time_window(AS_OF, from_local="2026-07-11 08:00", to_local="2026-07-10 08:00")
    with pytest.raises(ValueError):
        time_window(AS_OF, hours=721)


def test_condition_family(spark):
    names = ["TRIP", "TRIP_L", "TRIPLE", "TRIP_L_X", "HI", "%", "[x]", "a%b"]
    df = spark.createDataFrame([(n,) for n in names], "ConditionName string")

    def match(c):
        return sorted(r.ConditionName for r in df.where(condition_family(c)).collect())
    assert match("TRIP") == ["TRIP", "TRIP_L", "TRIP_L_X"]
    assert match("TRIP_L") == ["TRIP_L", "TRIP_L_X"]
    assert match("%") == ["%"]
    assert match("[x]") == ["[x]"]


def test_compare_operators(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (None,)], "Val double")

    def n(op):
        return df.where(compare("Val", op, 2)).count()
    assert [n(o) for o in (">", "<", ">=", "<=", "==", "===", "!=", "!==")] == [1, 1, 2, 2, 1, 1, 2, 2]
    with pytest.raises(ValueError):
        compare("Val", "<>", 1)

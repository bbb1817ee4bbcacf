"""The weighing join's tasks hold a bounded number of rows, however large the tables are."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from millrun.plans.queries import REGISTRY
from millrun.sources import fixtures as FX

N_ORDERS, TASK_ROWS = 1500, 500
DAY = dt.datetime(2024, 1, 2)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Orders of four lines, the first line twice; some keys and quantities are null, some orders missing or there twice."""
    d = tmp_path_factory.mktemp("weighing")
    lines = [(k, n, float((k * n) % 50)) for k in range(N_ORDERS) for n in (1, 2, 3, 4)]
    lines += [(k, 1, 60.0) for k in range(N_ORDERS)] + [(None, 1, 7.0), (0, 5, None), (N_ORDERS, 1, 9.0)]
    orders = [(k, DAY + dt.timedelta(days=k % 7)) for k in [*range(N_ORDERS), 3]] + [(None, DAY), (-1, DAY)]
    events = [(i, DAY + dt.timedelta(minutes=i), i % 8, float(i % 40)) for i in range(100)]
    for name, rows, schema in (("lineitem", lines, "l_orderkey long, l_linenumber int, l_quantity double"),
                               ("orders", orders, "o_orderkey long, o_orderdate timestamp_ntz"),
                               ("events", events, "event_id long, ts timestamp_ntz, user_id long, value double")):
        spark.createDataFrame(rows, schema).write.parquet(f"{d}/{name}.parquet")
    return str(d), lines, orders


def test_no_task_gets_many_rows_and_none_is_lost(spark, tables, monkeypatch):
    d, lines, orders = tables
    monkeypatch.setattr(FX, "WEIGHING_TASK_ROWS", TASK_ROWS, raising=False)
    got = FX.weighing_readings(spark, d).withColumn("task", F.spark_partition_id()).collect()
    per_task = {}
    for r in got:
        per_task[r.task] = per_task.get(r.task, 0) + 1
    assert max(per_task.values()) <= 2 * TASK_ROWS
    most = {}
    for k, n, q in lines:
        if k is not None:
            most[k, n] = max((x for x in (most.get((k, n)), q) if x is not None), default=None)
    want = [(n, date + dt.timedelta(seconds=k), None if q is None else 0.0 if q <= 5 else q, k)
            for (k, n), q in most.items() for o, date in orders if o == k]
    key = lambda r: (r[0], r[1], r[3])
    assert sorted([(r.TagIndex, r.DateAndTime, r.Val, r.seq) for r in got], key=key) == sorted(want, key=key)


@pytest.mark.parametrize("name", ["weighing_stats", "readings_long", "readings_window_asc", "run_hours_by_plant"])
def test_partitions_follow_the_rows(spark, tables, monkeypatch, name):
    d, lines, orders = tables
    monkeypatch.setattr(FX, "WEIGHING_TASK_ROWS", TASK_ROWS, raising=False)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")  # of tables that look small
    try:
        plan = REGISTRY[name](spark, d)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    parts = -(-(len(lines) + len(orders)) // TASK_ROWS)
    by_order = [line for line in plan.splitlines() if "hashpartitioning(" in line and "_orderkey#" in line]
    assert len(by_order) == 2 and all(f", {parts})" in line for line in by_order), plan
    join = next(line for line in plan.splitlines() if "Join [l_orderkey#" in line)
    assert "SortMergeJoin" in join


def test_few_rows_are_shuffled_once(spark, tables):
    d, _, _ = tables
    plan = FX.weighing_readings(spark, d)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 2, plan


def test_empty_tables(spark, tmp_path):
    for name, schema in (("lineitem", "l_orderkey long, l_linenumber int, l_quantity double"),
                         ("orders", "o_orderkey long, o_orderdate timestamp_ntz")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert FX.weighing_readings(spark, str(tmp_path)).count() == 0

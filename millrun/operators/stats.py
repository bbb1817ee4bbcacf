"""Window statistics (A1-A3, J3, A19). Sums are exact (``functions.exact``), so results
don't depend on the partitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrun.functions.exact import ExactSum
from millrun.functions.predicates import good_status, in_window
from millrun.operators.joins import for_requested, known_only
from millrun.sources import registry as R


def _windowed(readings, tags, tbf, taf, bad):
    return known_only(readings.where(in_window(tbf, taf) & good_status(bad)), tags)


def _echo(tbf, taf):
    return [F.lit(str(tbf)).alias("date_before"), F.lit(str(taf)).alias("date_after")]


def window_stats(readings: DataFrame, tags: DataFrame, tbf, taf, bad: Sequence[str] = ("E",),
                 request: DataFrame | None = None) -> DataFrame:
    """A1: min, max, avg and count per requested tag; all NULL (count 0) when
    the window is empty or the tag unknown."""
    total = ExactSum("Val", "sum")
    agg = _windowed(readings, tags, tbf, taf, bad).groupBy("plant", "TagIndex").agg(
        F.min("Val").alias("minVal"), F.max("Val").alias("maxVal"),
        *total.aggs(), F.count("Val").alias("_values"), F.count(F.lit(1)).alias("n"))
    agg = total.total(agg, "_sum").withColumn("avgVal", F.when(F.col("_values") > 0, F.col("_sum") / F.col("_values")))
    out = for_requested(request if request is not None else tags, agg, tags)
    ok = F.coalesce(F.col("n"), F.lit(0)) > 0
    return out.select("plant", "TagIndex", F.when(ok, F.col("_known_name")).alias("tagName"),
                      *_echo(tbf, taf),
                      F.col("maxVal"), F.col("minVal"), F.col("avgVal"),
                      F.coalesce(F.col("n"), F.lit(0)).alias("n"))


def capacity(readings: DataFrame, tags: DataFrame, tbf, taf, bad: Sequence[str] = ("E",),
             divisor: float = R.CAPACITY_DIVISOR, request: DataFrame | None = None) -> DataFrame:
    """A2: min, max and ``SUM(Val) / divisor`` per requested tag."""
    total = ExactSum("Val", "sum")
    agg = _windowed(readings, tags, tbf, taf, bad).groupBy("plant", "TagIndex").agg(
        F.min("Val").alias("minVal"), F.max("Val").alias("maxVal"),
        *total.aggs(), F.count(F.lit(1)).alias("n"))
    agg = total.total(agg, "_sum")
    out = for_requested(request if request is not None else tags, agg, tags)
    ok = F.coalesce(F.col("n"), F.lit(0)) > 0
    return out.select("plant", "TagIndex", F.when(ok, F.col("_known_name")).alias("tagName"),
                      *_echo(tbf, taf), "maxVal", "minVal",
                      (F.col("_sum") / F.lit(float(divisor))).alias("cap"))


def weighing_stats(readings: DataFrame, tags: DataFrame, tbf, taf, bad: Sequence[str] = ("E",),
                   request: DataFrame | None = None) -> DataFrame:
    """A3: max, min, sum, twice the mean, and the count of non-zero values.
    On an empty window max/min/sum are NULL, the doubled mean is 0 (Q5) and the
    count 0."""
    total = ExactSum("Val", "sum")
    agg = _windowed(readings, tags, tbf, taf, bad).groupBy("plant", "TagIndex").agg(
        F.max("Val").alias("maxVal"), F.min("Val").alias("minVal"), *total.aggs(), F.count("Val").alias("_values"),
        F.count_if(F.col("Val") != 0).alias("_nz"), F.count(F.lit(1)).alias("n"))
    agg = total.total(agg, "sumVal").withColumn(
        "_avg2", F.when(F.col("_values") > 0, F.col("sumVal") / F.col("_values") * 2))
    out = for_requested(request if request is not None else tags, agg, tags)
    ok = F.coalesce(F.col("n"), F.lit(0)) > 0
    return out.select("plant", "TagIndex", F.when(ok, F.col("_known_name")).alias("tagName"),
                      *_echo(tbf, taf), "maxVal", "minVal", "sumVal",
                      F.coalesce(F.col("_avg2"), F.lit(0.0)).alias("avgVal"),
                      F.coalesce(F.col("_nz"), F.lit(0)).alias("count"))

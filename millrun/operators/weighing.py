"""Weighing-cycle pivot with filters and summary.

Readings that share a millisecond timestamp form one weighing cycle. The five
named PLC tags become columns; other tags still create the cycle but add no
column. Exact zeros are dropped first, so a timestamp with only zeros yields no
cycle. When one tag has several rows in a cycle, the last one (by ``seq``) wins.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrun.functions.exact import ExactSum, to_fixed2
from millrun.functions.predicates import good_status, in_window
from millrun.operators.joins import with_tag_names
from millrun.sources import registry as R

PIVOT_COLUMNS = tuple(c for _, c in R.WEIGHING_TAGS)


def cycles(readings: DataFrame, tags: DataFrame, tbf, taf, bad: Sequence[str] = ("E",)) -> DataFrame:
    """One row per (plant, DateAndTime) with ``id, WL_No, Weight, Silo,
    Material``. A grouped aggregate, combined map-side: no pivot shuffle of
    whole cycles, no collect."""
    r = with_tag_names(readings.where(in_window(tbf, taf) & good_status(bad)), tags)
    r = r.where(F.col("Val").isNull() | (F.col("Val") != 0))            # F15
    picks = [F.max_by(F.col("Val"), F.when(F.col("TagName") == name, F.col("seq"))).alias(col)
             for name, col in R.WEIGHING_TAGS]
    return r.groupBy("plant", "DateAndTime").agg(*picks)


def filter_cycles(c: DataFrame, silo: int | None = None, material: int | None = None,
                  wlno: int | None = None, id_: int | None = None,
                  min_weight: float | None = None, max_weight: float | None = None,
                  min_id: int | None = None, max_id: int | None = None) -> DataFrame:
    """F12, applied after the pivot. ``None`` disables a filter. Equality
    filters never match NULL; range filters compare NULL as 0 (so a NULL weight
    passes ``max_weight`` and passes ``min_weight`` when the bound is <= 0)."""
    conds: list[Column] = []
    for col, v in (("Silo", silo), ("Material", material), ("WL_No", wlno), ("id", id_)):
        if v is not None:
            conds.append(F.col(col) == F.lit(int(v)))
    z = lambda col: F.coalesce(F.col(col), F.lit(0.0))
    if min_weight is not None:
        conds.append(z("Weight") >= F.lit(float(min_weight)))
    if max_weight is not None:
        conds.append(z("Weight") <= F.lit(float(max_weight)))
    if min_id is not None:
        conds.append(z("id") >= F.lit(int(min_id)))
    if max_id is not None:
        conds.append(z("id") <= F.lit(int(max_id)))
    for cond in conds:
        c = c.where(cond)
    return c


def formatted(c: DataFrame) -> DataFrame:
    """P5: weight to 2 decimals by its binary value (Q7), NULL weight as 0; chronological."""
    return c.select("plant", "DateAndTime", "id", "WL_No",
                    F.coalesce(to_fixed2("Weight"), F.lit(0.0)).alias("Weight"),
                    "Silo", "Material").orderBy("plant", "DateAndTime")


def summary(c: DataFrame, filters: Mapping[str, object] | None = None) -> DataFrame:
    """A15 per plant: cycles, total weight (NULL as 0) and the average over all
    cycles, both to 2 decimals; 0 when there are no cycles. The total is exact.
    P4: ``filters``, as they were asked for, are echoed as a JSON text."""
    total = ExactSum(F.coalesce(F.col("Weight"), F.lit(0.0)), "total")
    agg = c.groupBy("plant").agg(F.count(F.lit(1)).alias("cycles"), *total.aggs())
    agg = total.total(agg, "_total")
    out = agg.select("plant", "cycles", F.coalesce(to_fixed2("_total"), F.lit(0.0)).alias("totalWeight"),
                     F.when(F.col("cycles") > 0, to_fixed2(F.col("_total") / F.col("cycles")))
                     .otherwise(F.lit(0.0)).alias("avgWeight"))
    return out if filters is None else out.withColumn("filters", F.lit(json.dumps(dict(filters))))

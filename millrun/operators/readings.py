"""Readings selection and listings.

All plants and tags in one plan; pass a filtered ``readings``/``tags`` for a
single plant or tag.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrun.functions.predicates import good_status, in_window
from millrun.operators.joins import checked_broadcast, fits, known_only, with_tag_names
from millrun.operators.latest import advanced, latest_rows
from millrun.operators.newest import newest_days
from millrun.sources import registry as R

PROJECTION = ("plant", "DateAndTime", "Val", "TagIndex", "TagName")


def tag_list(tags: DataFrame, plant: str) -> DataFrame:
    """``[{TagName, TagIndex}]`` of one plant."""
    return tags.where(F.col("plant") == plant).select("TagName", "TagIndex")


def tag_catalog(tags: DataFrame, plants: DataFrame) -> DataFrame:
    """Every plant's description with its tags, one row per tag."""
    return tags.join(checked_broadcast(plants), "plant", "inner") \
               .select("plant", "description", "TagIndex", "TagName")


def tag_catalog_nested(tags: DataFrame, plants: DataFrame) -> DataFrame:
    """S4 in the nested shape: one row per plant, tags as ``ARRAY<STRUCT>``.
    The arrays are one plant's tag dimension, a bounded list."""
    per_plant = tags.groupBy("plant").agg(
        F.sort_array(F.collect_list(F.struct("TagIndex", "TagName"))).alias("tags"))
    return plants.join(per_plant, "plant", "left")


def window_readings(readings: DataFrame, tags: DataFrame, tbf, taf,
                    bad: Sequence[str] = ("E",), newest_first: bool = True) -> DataFrame:
    """Good readings of known tags in ``[tbf, taf]`` with their names,
    ordered per tag by time (newest first for R1, oldest first for R2)."""
    r = readings.where(in_window(tbf, taf) & good_status(bad))
    r = with_tag_names(r, tags)
    t = F.col("DateAndTime").desc() if newest_first else F.col("DateAndTime").asc()
    s = F.col("seq").desc() if newest_first else F.col("seq").asc()
    return r.select(*PROJECTION, "seq").orderBy("plant", "TagIndex", t, s).drop("seq")


def long_form(readings: DataFrame, tags: DataFrame, tbf, taf, bad: Sequence[str] = ("E",)) -> DataFrame:
    """All tags of a plant in the window as ``(DateAndTime, TagName, Val)``,
    oldest first."""
    r = with_tag_names(readings.where(in_window(tbf, taf) & good_status(bad)), tags)
    return r.select("plant", "DateAndTime", "TagName", "Val", "seq") \
            .orderBy("plant", "DateAndTime", "seq").drop("seq")


def newest(readings: DataFrame, tags: DataFrame, n: int = R.NEWEST_READINGS,
           bad: Sequence[str] = ("E",)) -> DataFrame:
    """The newest ``n`` good readings of each plant (known tags only).

    Of readings stored by plant and day only each plant's newest days that hold them
    are opened. ``row_number() <= n`` per plant is planned as a partial
    ``WindowGroupLimit`` before the shuffle, so each task ships at most ``n`` rows
    per plant.
    """
    r = newest_days(with_tag_names(readings.where(good_status(bad)), tags), n, by=("plant",))
    w = Window.partitionBy("plant").orderBy(F.col("DateAndTime").desc(), F.col("seq").desc())
    return (r.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n)
             .select(*PROJECTION).orderBy("plant", F.col("DateAndTime").desc()))


TAG_KEYS, TAG_ORDER = ("plant", "TagIndex"), ("DateAndTime", "seq")


def latest_per_tag(readings: DataFrame, tags: DataFrame, bad: Sequence[str] = ("E",)) -> DataFrame:
    """The latest good reading of every known tag.

    A hash aggregate of the newest time per tag, combined map-side, then a fetch of the
    readings at that time (``latest.latest_rows``); a tag with a third of all rows costs
    one partial row per task, not one giant window partition.
    """
    few = fits(tags.select("plant", "TagIndex", "TagName"))
    r = known_only(readings.where(good_status(bad)), tags)  # so no more keys than tags
    return _named(latest_rows(r, TAG_KEYS, TAG_ORDER, ("Val",), few_keys=few), tags)


def latest_state(state: DataFrame | None, new_readings: DataFrame, bad: Sequence[str] = ("E",)) -> DataFrame:
    """T2 as kept state: the latest good reading of every (plant, tag) after ``new_readings``."""
    return advanced(state, new_readings.where(good_status(bad)), TAG_KEYS, TAG_ORDER, ("Val",))


def latest_from_state(state: DataFrame, tags: DataFrame) -> DataFrame:
    """``latest_per_tag`` from the state of all readings."""
    return _named(state, tags)


def _named(last: DataFrame, tags: DataFrame) -> DataFrame:
    return with_tag_names(last, tags).select("plant", "DateAndTime", "Val", "TagIndex", "TagName")

"""The historian service's route families as typed functions.

One function per route family (not per plant): the plant's policy comes from
the registry as data, so ``count("RMM1", ...)`` splits cadence eras, ``count(
"Hour_OFIL", ...)`` drops three status codes and never fills, ``count("WL",
...)`` is event data, and so on. Parameters keep the service's names. A
``tag_index`` of None means every tag of the plant, in one plan.

Inputs are the all-plant ``readings`` and ``tags`` DataFrames (see
``millrun.sources.historian.read_readings``).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrun import schemas
from millrun.operators import gaps as G
from millrun.operators import readings as RD
from millrun.operators import runhours as RH
from millrun.operators import stats as ST
from millrun.operators import weighing as WG
from millrun.operators.joins import with_tag_names
from millrun.sources import registry as R
from millrun.sources.local import local_table

_POLICY = {p[0]: p for p in R.PLANT_POLICY}
ERA_PLANT = "RMM1"
WEIGHING_PLANT = "WL"


def policy(plant: str):
    """(bad codes, cadence, points per hour, fill on window routes, fill on counts)."""
    try:
        _, bad, cadence, pph, fill_window, fill_count = _POLICY[plant]
    except KeyError:
        raise ValueError(f"unknown plant {plant!r}") from None
    return tuple(bad), cadence, pph, fill_window, fill_count


def registry_eras(spark: SparkSession) -> DataFrame:
    """The registry's cadence eras (RMM1) as a small table."""
    (e0, c0, p0), (e1, c1, p1) = R.RMM1_ERAS
    change = R.RMM1_CADENCE_CHANGE
    rows = [(ERA_PLANT, e0, None, change, c0, p0), (ERA_PLANT, e1, change, None, c1, p1)]
    return local_table(spark, rows, schemas.ERAS)


def _plant(df: DataFrame, plant: str, tag_index: int | None = None) -> DataFrame:
    df = df.where(F.col("plant") == plant)
    return df if tag_index is None else df.where(F.col("TagIndex") == int(tag_index))


def _request(spark: SparkSession, tags: DataFrame, plant: str, tag_index: int | None) -> DataFrame:
    if tag_index is None:
        return _plant(tags, plant).select("plant", "TagIndex")
    return local_table(spark, [(plant, int(tag_index))], _REQUEST)


_REQUEST = T.StructType([T.StructField("plant", T.StringType()),
                         T.StructField("TagIndex", T.IntegerType())])


# ---------------------------------------------------------------- listings

def tag_list(tags: DataFrame, plant: str) -> DataFrame:
    """``GET /{plant}``."""
    return RD.tag_list(tags, plant)


def catalog(tags: DataFrame, plants: DataFrame) -> DataFrame:
    """``GET /``: every plant with its tags (nested, one row per plant)."""
    return RD.tag_catalog_nested(tags, plants)


def all_newest(readings: DataFrame, tags: DataFrame, plant: str) -> DataFrame:
    """``GET /{plant}/all``: newest 1000 good readings."""
    bad, *_ = policy(plant)
    return RD.newest(_plant(readings, plant), _plant(tags, plant), bad=bad)


def latest(readings: DataFrame, tags: DataFrame, plant: str, tag_index: int | None = None) -> DataFrame:
    """``GET /{plant}/{tag}``: latest good reading of the tag(s)."""
    bad, *_ = policy(plant)
    return RD.latest_per_tag(_plant(readings, plant, tag_index), _plant(tags, plant), bad=bad)


def window(readings: DataFrame, tags: DataFrame, plant: str, tag_index: int | None, tbf, taf, *,
           fillGaps: bool = False, cadence=None, cap=None, tolerance=None,
           ascending: bool = False, total_order: bool = False) -> DataFrame:
    """``GET /{plant}/{tag}/{tbf}/{taf}`` (and WL ``/ins``, ``/asc``): good
    readings newest first; with ``fillGaps`` (plants that allow it) the result
    is chronological with ``Filled`` and gap columns (R4), within each plant and day
    unless ``total_order`` is asked for. RMM1 fills at 15 s unless a cadence is given."""
    bad, default_cadence, _, fill_window, _ = policy(plant)
    r = _plant(readings, plant, tag_index)
    t = _plant(tags, plant)
    if not (fillGaps and fill_window):
        return RD.window_readings(r, t, tbf, taf, bad=bad, newest_first=not ascending)
    opts = G.FillOptions.resolve(cadence, cap, tolerance, default_cadence or R.GAP_CADENCE_S)
    sel = RH.select_window(r, tbf, taf, bad)
    named = with_tag_names(sel, t).select(*G.SERIES, *G.ORDER, "Val", "TagName")
    filled = G.gap_fill(named, opts.cadence_s, opts.cap_s, opts.tolerance)
    return G.chronological(filled.select("plant", "DateAndTime", "Val", "TagIndex", "TagName", "Filled", "gap_kind",
                                         "gap_ms"), total_order)


def long_form(readings: DataFrame, tags: DataFrame, plant: str, tbf, taf) -> DataFrame:
    """``GET /WL/pivotData/{tbf}/{taf}``."""
    bad, *_ = policy(plant)
    return RD.long_form(_plant(readings, plant), _plant(tags, plant), tbf, taf, bad=bad)


def avg(spark: SparkSession, readings: DataFrame, tags: DataFrame, plant: str,
        tag_index: int | None, tbf, taf) -> DataFrame:
    """``GET /{plant}/{tag}/{tbf}/{taf}/avg``."""
    bad, *_ = policy(plant)
    return ST.window_stats(_plant(readings, plant), _plant(tags, plant), tbf, taf, bad=bad,
                           request=_request(spark, tags, plant, tag_index))


def cal_cap(spark: SparkSession, readings: DataFrame, tags: DataFrame, plant: str,
            tag_index: int | None, tbf, taf) -> DataFrame:
    """``GET /CT7_con/{tag}/{tbf}/{taf}/calCap``."""
    bad, *_ = policy(plant)
    return ST.capacity(_plant(readings, plant), _plant(tags, plant), tbf, taf, bad=bad,
                       request=_request(spark, tags, plant, tag_index))


def datacal(spark: SparkSession, readings: DataFrame, tags: DataFrame, tag_index: int | None,
            tbf, taf) -> DataFrame:
    """``GET /WL/{tag}/{tbf}/{taf}/datacal``."""
    bad, *_ = policy(WEIGHING_PLANT)
    return ST.weighing_stats(_plant(readings, WEIGHING_PLANT), _plant(tags, WEIGHING_PLANT), tbf, taf,
                             bad=bad, request=_request(spark, tags, WEIGHING_PLANT, tag_index))


def count(spark: SparkSession, readings: DataFrame, tags: DataFrame, plant: str,
          tag_index: int | None, tbf, taf, threshold: float, *, pointsPerHour=None,
          fillGaps: bool | None = None, cadence=None, cap=None, tolerance=None,
          holidays=None) -> DataFrame:
    """``GET /count{plant}?tagIndex&tbf&taf&threshold``: run-hours with tariff
    buckets and (where the plant fills) the gap-fill audit. Fill is on by
    default on count routes, except for plants that never fill (WL, Hour_OFIL,
    LC_CSH). RMM1 splits its cadence eras unless ``pointsPerHour`` or
    ``cadence`` is given. WL returns count and hour only."""
    if threshold is None:
        raise ValueError("threshold is required and must be a number")
    bad, _, default_pph, _, fill_count = policy(plant)
    fill = fill_count and fillGaps is not False
    holidays = R.holiday_dates() if holidays is None else holidays
    r, t = _plant(readings, plant), _plant(tags, plant)
    req = _request(spark, tags, plant, tag_index)
    given_pph = pointsPerHour if pointsPerHour and float(pointsPerHour) > 0 else None
    if plant == WEIGHING_PLANT:
        out = RH.count_run_hours(r, t, threshold=threshold, tbf=tbf, taf=taf, bad=bad, fill=False,
                                 points_per_hour=given_pph or default_pph, holidays=holidays,
                                 request=req)
        return out.select("plant", "TagIndex", "tagName", "date_before", "date_after", "count", "hour")
    eras = registry_eras(spark) if plant == ERA_PLANT else None
    if eras is None:
        given_pph = given_pph or default_pph
    return RH.count_run_hours(r, t, threshold=threshold, tbf=tbf, taf=taf, bad=bad, fill=fill,
                              cadence_s=cadence, cap_s=cap, tolerance=tolerance,
                              points_per_hour=given_pph, holidays=holidays, eras=eras, request=req)


def pivot_filter(readings: DataFrame, tags: DataFrame, tbf, taf, **filters):
    """``GET /WL/pivotDataFilter/{tbf}/{taf}?silo&material&wlno&id&minWeight&
    maxWeight&minId&maxId``: returns ``(cycles, summary)`` DataFrames; the summary
    echoes the given filters (P4)."""
    names = {"silo": "silo", "material": "material", "wlno": "wlno", "id": "id_",
             "minWeight": "min_weight", "maxWeight": "max_weight", "minId": "min_id", "maxId": "max_id"}
    unknown = set(filters) - set(names)
    if unknown:
        raise ValueError(f"unknown filters: {sorted(unknown)}")
    bad, *_ = policy(WEIGHING_PLANT)
    c = WG.cycles(_plant(readings, WEIGHING_PLANT), _plant(tags, WEIGHING_PLANT), tbf, taf, bad=bad)
    c = WG.filter_cycles(c, **{names[k]: v for k, v in filters.items()})
    return WG.formatted(c), WG.summary(c, filters)


def as_of_now() -> dt.datetime:
    """The service's "now" for the alarm routes, as a naive UTC instant."""
    return dt.datetime.now(dt.timezone.utc).replace(tzinfo=None, microsecond=0)

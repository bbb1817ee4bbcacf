"""Run-hours, threshold counts and tariff buckets.

One plan for all plants and tags: filter -> (era) -> gaps -> points per bucket ->
aggregate per (series, divisor) -> sum per tag -> one row per requested tag.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrun.functions.predicates import OPERATORS, compare, good_status, in_window
from millrun.functions.tariff import BUCKETS, bucket_of, day_rule, points_by_bucket, with_holiday
from millrun.functions.time import with_offset_minutes
from millrun.operators import gaps as G
from millrun.operators.joins import assign_era, attach, for_requested, known_only
from millrun.sources import registry as R


def select_window(readings: DataFrame, tbf, taf, bad: Sequence[str] = ("E",)) -> DataFrame:
    """F1 + F2: good-quality readings inside the closed window."""
    return readings.where(in_window(tbf, taf) & good_status(bad))


def threshold_counts(readings: DataFrame, tags: DataFrame, threshold: float, tbf, taf,
                     bad: Sequence[str] = ("E",), request: DataFrame | None = None) -> DataFrame:
    """Per tag, the count of readings satisfying each of the eight
    comparison operators against ``threshold``; 0 when empty or unknown."""
    r = known_only(select_window(readings, tbf, taf, bad), tags)
    names = {">": "n_gt", "<": "n_lt", ">=": "n_ge", "<=": "n_le",
             "==": "n_eq", "===": "n_seq", "!=": "n_ne", "!==": "n_sne"}
    per_tag = r.groupBy("plant", "TagIndex").agg(
        *[F.count_if(compare("Val", op, threshold)).alias(names[op]) for op in OPERATORS])
    out = for_requested(request if request is not None else tags, per_tag, tags)
    return out.select("plant", "TagIndex", F.col("_known_name").alias("tagName"),
                      *[F.coalesce(F.col(names[op]), F.lit(0)).alias(names[op]) for op in OPERATORS])


def count_run_hours(readings: DataFrame, tags: DataFrame, *, threshold: float, tbf, taf,
                    op: str = ">", bad: Sequence[str] = ("E",), fill: bool = True,
                    cadence_s=None, cap_s=None, tolerance=None,
                    points_per_hour: float | None = None, holidays=None,
                    eras: DataFrame | None = None, request: DataFrame | None = None,
                    return_hours: bool = True, chunk_ms: int | str | None = G.CHUNK_MS,
                    time_field: str = "DateAndTime", tz_offset_minutes: int = 0) -> DataFrame:
    """A5/A6/A7 (+A8 audit): run-hours of every requested tag in ``[tbf, taf]``.

    ``count`` = readings (after fill) with ``Val <op> threshold``; ``hour`` =
    count / points-per-hour; ``A``..``D``, ``total`` = the same split by tariff
    bucket (hours, or raw counts when ``return_hours`` is False). With ``eras``
    each era is filled at its own cadence and divided by its own divisor, and a
    gap across an era change is neither filled nor flagged. Audit columns are
    NULL when fill is off, and also when an era-split tag had no rows. The tariff
    clock is ``time_field`` moved by ``tz_offset_minutes``.
    """
    given_pph = points_per_hour is not None and float(points_per_hour) > 0
    era_mode = eras is not None
    if era_mode and (cadence_s is not None or given_pph):
        # Q12: a caller-given cadence or divisor forces one era over the window.
        eras = None
        opts = G.FillOptions.resolve(cadence_s, cap_s, tolerance, R.FORCED_ERA_CADENCE_S)
        pph = float(points_per_hour) if given_pph else R.FORCED_ERA_POINTS_PER_HOUR
    else:
        opts = G.FillOptions.resolve(cadence_s, cap_s, tolerance)
        pph = float(points_per_hour) if given_pph else R.DEFAULT_POINTS_PER_HOUR
    r = known_only(select_window(readings, tbf, taf, bad), tags)

    if eras is not None:
        r = assign_era(r, eras)
        series = ["plant", "TagIndex", "era_id"]
        cad = F.coalesce(F.col("era_cadence_s"), F.lit(opts.cadence_s))
        r = r.withColumn("_pph", F.coalesce(F.col("era_pph"), F.lit(pph)))
    else:
        series = ["plant", "TagIndex"]
        cad = F.lit(opts.cadence_s)
        r = r.withColumn("_pph", F.lit(pph))
    clock = [time_field] if time_field not in ("Val", *G.ORDER) else []
    r = r.withColumn("_cad", cad).select(*series, *G.ORDER, "Val", *clock, "_pph", "_cad")

    if fill:
        x = G.gap_classified(r, F.col("_cad"), opts.cap_s, opts.tolerance, series=series, chunk_ms=chunk_ms)
    else:
        x = _unfilled(r)
    if not fill:
        audit_on = F.lit(False)
    elif era_mode:
        audit_on = F.coalesce(F.col("_rows"), F.lit(0)) > 0
    else:
        audit_on = F.lit(True)
    per_tag = _per_tag(_weighted(x, op, threshold, holidays, time_field, tz_offset_minutes), series, return_hours)
    out = for_requested(request if request is not None else tags, per_tag, tags)
    return _shape(out, tbf, taf, return_hours, audit_on, opts)


def count_run_hours_by_plant(readings: DataFrame, tags: DataFrame, plant_config: DataFrame, *,
                             threshold: float, tbf, taf, op: str = ">", cap_s=None,
                             tolerance=None, holidays=None, request: DataFrame | None = None,
                             return_hours: bool = True,
                             chunk_ms: int | str | None = G.CHUNK_MS,
                             eras: DataFrame | None = None) -> DataFrame:
    """A5/A6/A7 + A8 for many plants in one plan, each under its own policy.

    ``plant_config`` (schema ``schemas.PLANT_CONFIG``) gives per plant the bad
    status codes (F1), the logging cadence, the samples per hour and whether
    count routes fill gaps. It is joined once (size-checked broadcast), so the
    per-plant rules are ordinary per-row columns: no loop over plants. Plants
    without a cadence fall back to the default cadence; plants that never fill
    are neither filled nor flagged and have NULL audit columns. Readings of a
    plant missing from the configuration raise an error. Plants named in ``eras``
    are filled and divided per era.
    """
    x, cfg = _classified_by_plant(readings, tags, plant_config, tbf=tbf, taf=taf, cap_s=cap_s,
                                  tolerance=tolerance, chunk_ms=chunk_ms, eras=eras)
    return run_hours_from_filled(x, tags, cfg, threshold=threshold, tbf=tbf, taf=taf, op=op,
                                 holidays=holidays, request=request, return_hours=return_hours,
                                 cap_s=cap_s, tolerance=tolerance)


def fill_by_plant(readings: DataFrame, tags: DataFrame, plant_config: DataFrame, *, tbf, taf,
                  cap_s=None, tolerance=None, chunk_ms: int | str | None = G.CHUNK_MS,
                  eras: DataFrame | None = None):
    """Per-plant F1 + gap fill: returns the filled rows (with ``_pph``, ``_fill``
    and ``era_id`` columns) and the configuration. Plants that never
    fill pass through unfilled and unflagged. Within ``eras`` a plant has each
    era's own cadence and divisor, and no gap is filled across a change. A
    reading of a plant without a configuration raises an error."""
    x, cfg = _classified_by_plant(readings, tags, plant_config, tbf=tbf, taf=taf, cap_s=cap_s,
                                  tolerance=tolerance, chunk_ms=chunk_ms, eras=eras)
    return G.fill_rows(x), cfg


def _classified_by_plant(readings, tags, plant_config, *, tbf, taf, cap_s, tolerance, chunk_ms, eras):
    """``fill_by_plant`` before the synthetic rows are made. Readings of plants that never
    fill go past the successor windows."""
    from millrun.functions.predicates import good_status_by_config
    opts = G.FillOptions.resolve(None, cap_s, tolerance)
    cfg = plant_config.select(
        "plant", F.col("bad_status").alias("_bad"),
        F.coalesce(F.col("cadence_s"), F.lit(opts.cadence_s)).alias("_cad"),
        F.col("points_per_hour").alias("_pph"), F.col("fill_count").alias("_fill"))
    if eras is not None:
        cfg = attach(cfg, eras.select("plant").distinct().withColumn("_eras", F.lit(True)), "plant")
    else:
        cfg = cfg.withColumn("_eras", F.lit(None).cast("boolean"))
    r = attach(readings.where(in_window(tbf, taf)), cfg.drop("_eras"), "plant")
    unknown = F.raise_error(F.concat(F.lit("no configuration for plant "), F.coalesce("plant", F.lit("NULL"))))
    r = r.where(F.when(F.col("_fill").isNull(), unknown.cast("boolean")).otherwise(good_status_by_config("_bad")))
    r = assign_era(known_only(r, tags), eras).withColumns({
        "_cad": F.coalesce("era_cadence_s", "_cad"), "_pph": F.coalesce("era_pph", "_pph")})
    series = ["plant", "TagIndex", "era_id"]
    r = r.select(*series, *G.ORDER, "Val", "_cad", "_pph", "_fill")
    x = G.gap_classified(r.where("_fill"), F.col("_cad"), opts.cap_s, opts.tolerance, series=series, chunk_ms=chunk_ms)
    rest = r.where("NOT _fill")
    return x.unionByName(_unfilled(rest).select(
        "*", *[F.lit(None).cast(x.schema[c].dataType).alias(c) for c in ("next_DateAndTime", "next_Val")])), cfg


def run_hours_from_filled(x: DataFrame, tags: DataFrame, cfg: DataFrame, *, threshold: float,
                          tbf, taf, op: str = ">", holidays=None, request: DataFrame | None = None,
                          return_hours: bool = True, cap_s=None, tolerance=None) -> DataFrame:
    """A5/A6 + A8 summary of rows produced by ``fill_by_plant`` (``cap_s`` and
    ``tolerance`` as given there, for the audit), or of classified rows."""
    per_tag = _per_tag(_weighted(x, op, threshold, holidays), ["plant", "TagIndex", "era_id"], return_hours)
    out = for_requested(request if request is not None else tags, per_tag, tags)
    out = attach(out, cfg.select("plant", "_fill", "_eras"), "plant")
    # as for one plant: the audit of an era-split tag without rows is absent
    seen = ~F.coalesce("_eras", F.lit(False)) | (F.coalesce("_rows", F.lit(0)) > 0)
    return _shape(out, tbf, taf, return_hours, F.coalesce("_fill", F.lit(False)) & seen,
                  G.FillOptions.resolve(None, cap_s, tolerance))


def _unfilled(r: DataFrame) -> DataFrame:
    """Classified rows of a series that isn't filled."""
    return r.withColumns({"gap_kind": F.lit(None).cast("string"), "gap_ms": F.lit(None).cast("long"),
                          "n_fill": F.lit(0), "_cad_ms": F.lit(0.0)})


def _weighted(x: DataFrame, op: str, threshold, holidays, time_field: str = "DateAndTime",
              tz_offset_minutes: int = 0) -> DataFrame:
    """X1-X4 + F11: per row ``_hit`` and ``_points``, how many points of each bucket it stands
    for. The tariff clock is ``time_field`` moved by ``tz_offset_minutes``.

    A filled row (real or synthetic) is one point. A classified row is itself and the
    synthetic rows owed after it, which hold its value, so they are counted in closed
    form; where the holiday rule looks at more than a date they are made after all."""
    rule = day_rule(holidays)
    if "n_fill" in x.columns and rule is None:
        x = G.fill_rows(x)
    clock = with_offset_minutes(time_field, tz_offset_minutes) if tz_offset_minutes else F.col(time_field)
    x = x.withColumn("_clock", clock)
    x = with_holiday(x, holidays, ts="_clock") if rule is None else x.withColumn("is_holiday", rule(F.to_date("_clock")))
    x = x.withColumns({"_hit": compare("Val", op, threshold), "_bucket": bucket_of("_clock", F.col("is_holiday"))})
    if "n_fill" not in x.columns:
        return x.withColumn("_points", F.struct(*[(F.col("_bucket") == b).cast("long").alias(b) for b in BUCKETS]))
    n = F.col("n_fill")
    if time_field == "DateAndTime":
        owed = points_by_bucket(F.col("_clock"), F.col("_cad_ms"), n, rule)
    else:  # synthetic rows keep the other clock of the row before them
        owed = F.struct(*[F.when(F.col("_bucket") == b, n).otherwise(0).cast("long").alias(b) for b in BUCKETS])
    x = x.withColumn("_owed", owed)
    return x.withColumn("_points", F.struct(*[
        ((F.col("_bucket") == b).cast("long") + F.coalesce(F.col("_owed")[b], F.lit(0))).alias(b) for b in BUCKETS]))


def _per_tag(x: DataFrame, series: list[str], return_hours: bool) -> DataFrame:
    """Level 1 per series and divisor (one era), level 2 per tag. Partial
    aggregation keeps each shuffle at one row per task and key, whatever the
    skew; per-era hours are divided by their own divisor before summing."""
    era = F.col("era_id") if "era_id" in series else F.lit(None)
    hits = [F.coalesce(F.sum(F.when(F.col("_hit"), F.col("_points")[b])), F.lit(0)) for b in BUCKETS]
    per_era = x.groupBy(*series, "_pph", "_cad").agg(
        sum(hits[1:], hits[0]).alias("_n"), *[h.alias(f"_n{b}") for h, b in zip(hits, BUCKETS)],
        *G.audit_aggs("Filled" in x.columns))
    div = F.col("_pph") if return_hours else F.lit(1.0)
    return per_era.groupBy("plant", "TagIndex").agg(
        F.sum("_n").alias("count"),
        F.sum(F.col("_n") / F.col("_pph")).alias("hour"),
        *[F.sum(F.col(f"_n{b}") / div).alias(b) for b in BUCKETS],
        F.sum(F.col("_n") / div).alias("total"),
        F.sum("realReadings").alias("realReadings"),
        F.sum("filledReadings").alias("filledReadings"),
        F.sum("flaggedGaps").alias("flaggedGaps"),
        F.sum("flagged_s").alias("flagged_s"),
        F.sum("totalReadings").alias("_rows"),
        # one entry per era of the tag
        F.array_distinct(F.sort_array(F.collect_list(
            F.struct(era.cast("int").alias("era_id"), F.col("_cad").alias("cadence_s"))))).alias("_options"),
    )


def _shape(out: DataFrame, tbf, taf, return_hours: bool, audit_on: Column,
           opts: G.FillOptions) -> DataFrame:
    """One row per requested tag: zeros for empty or unknown tags, tag name only
    when the tag had rows, audit columns only where ``audit_on``; among these
    ``fillOptions``, the cadence, cap and tolerance used (per era)."""
    has_rows = F.coalesce(F.col("_rows"), F.lit(0)) > 0
    zero_d = F.lit(0.0)
    cols: list[Column] = [
        "plant", "TagIndex",
        F.when(has_rows, F.col("_known_name")).alias("tagName"),
        F.lit(str(tbf)).alias("date_before"), F.lit(str(taf)).alias("date_after"),
        F.coalesce(F.col("count"), F.lit(0)).alias("count"),
        F.coalesce(F.col("hour"), zero_d).alias("hour"),
    ]
    for b in (*BUCKETS, "total"):
        v = F.coalesce(F.col(b), zero_d)
        cols.append((v if return_hours else v.cast("long")).alias(b))
    for a in ("realReadings", "filledReadings", "flaggedGaps", "flagged_s"):
        zero = F.lit(0.0) if a == "flagged_s" else F.lit(0).cast("long")
        cols.append(F.when(audit_on, F.coalesce(F.col(a), zero)).alias(a))
    used = F.transform("_options", lambda o: F.struct(
        o["era_id"], o["cadence_s"], F.lit(float(opts.cap_s)).alias("cap_s"),
        F.lit(float(opts.tolerance)).alias("tolerance")))
    return out.select(*cols, F.when(audit_on, used).alias("fillOptions"))


def raw_vs_filled(readings: DataFrame, tags: DataFrame, *, threshold: float, tbf, taf,
                  op: str = ">", bad: Sequence[str] = ("E",), cadence_s=None, cap_s=None,
                  tolerance=None, points_per_hour: float | None = None,
                  chunk_ms: int | str | None = G.CHUNK_MS) -> DataFrame:
    """Per tag, raw and gap-filled run-hours side by side with the fill
    audit, from one pass (synthetic rows hold the value of the row before them)."""
    opts = G.FillOptions.resolve(cadence_s, cap_s, tolerance)
    pph = float(points_per_hour) if points_per_hour else R.DEFAULT_POINTS_PER_HOUR
    r = known_only(select_window(readings, tbf, taf, bad), tags)
    x = G.gap_classified(r.select(*G.SERIES, *G.ORDER, "Val"), opts.cadence_s, opts.cap_s, opts.tolerance,
                         chunk_ms=chunk_ms)
    hit = compare("Val", op, threshold)
    owed = F.coalesce(F.sum(F.when(hit, F.col("n_fill").cast("long"))), F.lit(0))
    agg = x.groupBy("plant", "TagIndex").agg(
        (F.count_if(hit) / F.lit(pph)).alias("raw_hour"),
        ((F.count_if(hit) + owed) / F.lit(pph)).alias("filled_hour"),
        *G.audit_aggs(filled=False))
    return agg.select("plant", "TagIndex", "raw_hour", "filled_hour", "realReadings",
                      "filledReadings", "flaggedGaps", "flagged_s")

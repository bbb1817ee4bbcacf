"""Dimension joins (J1-J3, J6) and the size-checked broadcast they share."""

from __future__ import annotations

import contextlib
import contextvars
import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrun.functions.time import ts_lit

# Rows of a configuration that are written into the plan's expressions; more are joined.
INLINE_ROWS = 200

# Dimension sides above this many rows are joined by shuffle instead.
MAX_BROADCAST_ROWS = 1_000_000

_SIZE_MEMO: contextvars.ContextVar[dict | None] = contextvars.ContextVar("size_memo", default=None)


@contextlib.contextmanager
def size_check_scope():
    """Within one plan build, a dimension used by several joins is counted once
    (keyed by its plan's semantic hash)."""
    token = _SIZE_MEMO.set({})
    try:
        yield
    finally:
        _SIZE_MEMO.reset(token)


def fits(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> bool:
    """True if ``df`` provably has at most ``max_rows`` rows (counted once per
    plan build, see ``size_check_scope``)."""
    memo = _SIZE_MEMO.get()
    key = (df.semanticHash(), max_rows) if memo is not None else None
    if key is not None and key in memo:
        return memo[key] <= max_rows
    n = df.limit(max_rows + 1).count()
    if key is not None:
        memo[key] = n
    return n <= max_rows


def checked_broadcast(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Broadcast ``df`` only if it provably holds at most ``max_rows`` rows.

    The bound is checked with a ``limit(max_rows + 1).count()`` on the small
    side. Larger sides are returned unhinted, so Catalyst plans a shuffle join
    (with AQE skew-join splitting) instead of shipping them to every executor.
    """
    return F.broadcast(df) if fits(df, max_rows) else df


def with_tag_names(readings: DataFrame, tags: DataFrame, how: str = "inner",
                   max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Readings joined to their tag names on (plant, TagIndex). Inner:
    readings of an unknown tag vanish, as with the historian's inner join."""
    dim = checked_broadcast(tags.select("plant", "TagIndex", "TagName"), max_rows)
    return readings.join(dim, ["plant", "TagIndex"], how)


def known_only(readings: DataFrame, tags: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Left-semi join: keep readings of known tags without widening the rows."""
    dim = checked_broadcast(tags.select("plant", "TagIndex"), max_rows)
    return readings.join(dim, ["plant", "TagIndex"], "left_semi")


def for_requested(request: DataFrame, per_tag: DataFrame, tags: DataFrame,
                  max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """One output row per requested (plant, TagIndex). ``per_tag`` holds the
    aggregates of known tags; unknown or empty tags get NULLs (callers coalesce
    counts to 0) and a NULL TagName.

    ``per_tag`` is grouped by (plant, TagIndex) over readings already
    semi-joined to ``tags``, so it has at most as many rows as the tag
    dimension: when that dimension passes the size check, so does ``per_tag``,
    and both joins are broadcasts."""
    names = tags.select("plant", "TagIndex", F.col("TagName").alias("_known_name"))
    req = request.select("plant", "TagIndex").distinct()
    small = fits(names, max_rows)
    req = req.join(F.broadcast(names) if small else names, ["plant", "TagIndex"], "left")
    return req.join(F.broadcast(per_tag) if small else per_tag, ["plant", "TagIndex"], "left")


def attach(df: DataFrame, dim: DataFrame, key: str, max_rows: int = 100_000) -> DataFrame:
    """``df`` with the other columns of ``dim`` for its ``key`` (unique there), NULL where it has none.

    A dimension of at most ``INLINE_ROWS`` rows, such as a plant configuration, becomes part of
    the row's expressions: per column one CASE with a branch per different value. Nothing
    is joined, so a constant key can't turn the join into a nested loop. Larger ones are joined
    by a size-checked broadcast."""
    rows = dim.limit(INLINE_ROWS + 1).collect()
    if len(rows) > INLINE_ROWS:
        return df.join(checked_broadcast(dim, max_rows), key, "left")
    if len({r[key] for r in rows}) < len(rows):
        raise ValueError(f"{key} must be unique")
    out = {}
    for field in dim.schema.fields:
        if field.name != key:
            keys: dict = {}
            for r in rows:
                value = r[field.name]
                keys.setdefault(tuple(value) if isinstance(value, list) else value, []).append(r[key])
            case = F.lit(None).cast(field.dataType)
            for value, of in keys.items():
                if value is not None:
                    lit = F.array(*map(F.lit, value)) if isinstance(value, tuple) else F.lit(value)
                    case = F.when(F.col(key).isin(of), lit.cast(field.dataType)).otherwise(case)
            out[field.name] = case
    return df.withColumns(out)


def assign_era(readings: DataFrame, eras: DataFrame | None, ts: str = "DateAndTime",
               max_rows: int = 100_000) -> DataFrame:
    """Attach ``era_id``, ``era_cadence_s`` and ``era_pph`` from the plant's
    cadence eras. ``from_ts`` is exclusive and ``to_ts`` inclusive, so the row
    exactly at a change belongs to the earlier era. Plants without eras get
    NULLs (callers fall back to the plant defaults).

    Each plant's eras are an array sorted by time that is searched within the row. It
    comes with the plant configuration: inline for at most ``INLINE_ROWS`` eras, else by
    an equality join on the plant. Overlapping eras of a plant are an error."""
    if eras is None:
        return (readings.withColumn("era_id", F.lit(None).cast("int"))
                .withColumn("era_cadence_s", F.lit(None).cast("double"))
                .withColumn("era_pph", F.lit(None).cast("double")))
    t = F.col(ts)
    out = ("era_id", "era_cadence_s", "era_pph")
    rows = eras.limit(INLINE_ROWS + 1).collect()
    if len(rows) <= INLINE_ROWS:
        first, last = dt.datetime.min, dt.datetime.max
        rows = sorted(rows, key=lambda r: (r["plant"], r["from_ts"] or first))
        for a, b in zip(rows, rows[1:]):
            if a["plant"] == b["plant"] and (b["from_ts"] or first) < (a["to_ts"] or last):
                raise ValueError(f"eras of plant {a['plant']} overlap")
        if not rows:
            return assign_era(readings, None)
        place = F.lit(None).cast("int")
        for i, r in enumerate(rows, 1):
            inside = F.col("plant") == F.lit(r["plant"])
            if r["from_ts"] is not None:
                inside = inside & (t > ts_lit(r["from_ts"]))
            if r["to_ts"] is not None:
                inside = inside & (t <= ts_lit(r["to_ts"]))
            place = F.when(inside, F.lit(i)).otherwise(place)
        values = {c: F.get(F.array(*[F.lit(r[of]).cast(kind) for r in rows]), F.col("_era") - 1)
                  for c, of, kind in zip(out, ("era_id", "cadence_s", "points_per_hour"), ("int", "double", "double"))}
        return readings.withColumn("_era", place).withColumns(values).drop("_era")
    per_plant = eras.groupBy("plant").agg(F.sort_array(F.collect_list(
        F.struct("from_ts", "to_ts", "era_id", "cadence_s", "points_per_hour"))).alias("_eras_of"))
    for_all = F.forall(F.sequence(F.lit(1), F.size("_eras_of") - 1), lambda i: (F.size("_eras_of") == 1) | F.coalesce(
        F.col("_eras_of")[i]["from_ts"] >= F.col("_eras_of")[i - 1]["to_ts"], F.lit(False)))
    per_plant = per_plant.withColumn("_eras_of", F.when((F.size("_eras_of") == 1) | for_all, F.col("_eras_of")).otherwise(
        F.raise_error(F.concat(F.lit("eras overlap, plant "), "plant")).cast(per_plant.schema["_eras_of"].dataType)))
    found = F.filter("_eras_of", lambda e: (e["from_ts"].isNull() | (t > e["from_ts"])) & (e["to_ts"].isNull() | (t <= e["to_ts"])))
    joined = readings.join(checked_broadcast(per_plant, max_rows), "plant", "left").withColumn("_era", F.get(found, 0))
    return joined.withColumns({c: F.col("_era")[of] for c, of in zip(out, ("era_id", "cadence_s", "points_per_hour"))}) \
                 .drop("_era", "_eras_of")

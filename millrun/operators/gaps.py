"""Bounded, bracket-checked gap fill.

A reading's successor is the next reading of the same series (plant, tag and,
when eras are used, era) in time order. Gaps at most 1.5 x cadence are normal.
Longer gaps are bridged with hold-last synthetic rows at ``a + k * cadence``
(strictly before ``b``) only when they are at most ``cap`` long AND the two
bracketing values agree within ``tolerance``; otherwise they are flagged
(``exceeds cap`` when longer than the cap, else ``value mismatch across gap``).
A gap at the edge of the window has no successor and is neither filled nor
flagged.

Scale: the successor is found with ``lead`` over windows partitioned by
(series, time chunk), not by series alone, so one hot tag holding a third of all
rows is still spread over many tasks. Only the first and last row of each chunk
go through a second window over the series, which gives every last row its
successor. The readings are scanned and shuffled once; both windows read that
one exchange.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrun.functions.predicates import values_agree
from millrun.functions.time import MS_PER_DAY, add_millis, diff_millis, millis_since_epoch
from millrun.sources import registry as R

SERIES = ("plant", "TagIndex")
ORDER = ("DateAndTime", "seq")

NORMAL = "normal"
BRIDGED = "bridged"


def _p(x) -> Column:
    """A parameter that is either a constant or a per-row Column."""
    if isinstance(x, Column):
        return x
    if isinstance(x, str):
        return F.col(x)
    return F.lit(float(x))


@dataclass(frozen=True)
class FillOptions:
    """Resolved gap-fill options: positive cadence and cap, tolerance >= 0;
    anything else falls back to the default (0 tolerance is honoured)."""
    cadence_s: float = R.GAP_CADENCE_S
    cap_s: float = R.GAP_CAP_S
    tolerance: float = R.GAP_TOLERANCE

    @classmethod
    def resolve(cls, cadence=None, cap=None, tolerance=None, default_cadence=R.GAP_CADENCE_S):
        def pos(v, d):
            try:
                v = float(v)
            except (TypeError, ValueError):
                return d
            return v if v > 0 else d

        try:
            tol = float(tolerance) if tolerance is not None else None
        except (TypeError, ValueError):
            tol = None
        return cls(pos(cadence, default_cadence), pos(cap, R.GAP_CAP_S),
                   tol if tol is not None and tol >= 0 else R.GAP_TOLERANCE)


#: Chunk width: 360 readings of a series at the default cadence. Two rows a chunk go
#: through the second window, so that window's share of a series is bounded by its span.
CHUNK_MS = int(360 * R.GAP_CADENCE_S * 1000)
#: ``chunk_ms="auto"``: no chunk of a series holds more than about this many rows.
AUTO_CHUNK_ROWS = 4_000_000


def chunk_of(ts: str, width) -> Column:
    """The number of the time chunk that a reading is in."""
    return F.floor(millis_since_epoch(ts) / (width if isinstance(width, Column) else F.lit(width))).cast("long")


def chunk_widths(df: DataFrame, series: Sequence[str], ts: str = "DateAndTime",
                 target_rows: int = AUTO_CHUNK_ROWS) -> DataFrame:
    """Per series, a chunk width in ms: one day divided by the smallest power of
    two that keeps the series' busiest day under ``target_rows`` per chunk (1 ms
    at least, the grain of the timestamps). One hash aggregate over (series,
    day) -- a partial row per task and key -- then one row per series."""
    day = F.floor(millis_since_epoch(ts) / F.lit(MS_PER_DAY))
    per_day = df.groupBy(*series, day.alias("_day")).agg(F.count(F.lit(1)).alias("_n"))
    level = F.greatest(F.ceil(F.log2(F.col("_peak") / F.lit(float(target_rows)))), F.lit(0)).cast("int")
    width = (F.lit(MS_PER_DAY) / F.pow(F.lit(2), level)).cast("long")
    return (per_day.groupBy(*series).agg(F.max("_n").alias("_peak"))
            .select(*series, F.greatest(width, F.lit(1)).alias("_width")))


def with_successor(df: DataFrame, series: Sequence[str] = SERIES, order: Sequence[str] = ORDER,
                   carry: Sequence[str] = ("DateAndTime", "Val"),
                   chunk_ms: int | str | None = CHUNK_MS,
                   target_rows: int = AUTO_CHUNK_ROWS) -> DataFrame:
    """Add ``next_<c>`` for each ``c`` in ``carry`` from the next row of the
    same series in ``order``; rows that tie in ``order`` follow by their other
    columns. ``chunk_ms`` is a fixed chunk width, ``"auto"`` for a per-series
    width sized from the data (dense hot series get narrow chunks; this counts
    the readings first), ``"stored"`` for the chunks of readings stored in buckets
    (``historian.read_bucketed``: the first window then needs no shuffle), or None
    for one window per series. Hand over only the
    columns that are needed: all of them break ties, so none is pruned."""
    series, order = list(series), list(order)
    full = order + [c for c in carry if c not in order]
    full += [c for c in df.columns if c not in full + series]
    per_series = Window.partitionBy(*series).orderBy(*full)
    if chunk_ms is None:
        return df.select("*", *[F.lead(c).over(per_series).alias(f"next_{c}") for c in carry])

    ts = order[0]
    width = F.lit(CHUNK_MS if chunk_ms == "stored" else chunk_ms)
    if chunk_ms == "auto":
        from millrun.operators.joins import checked_broadcast
        df = df.join(checked_broadcast(chunk_widths(df, series, ts, target_rows)), series, "left")
        width = F.coalesce(F.col("_width"), F.lit(MS_PER_DAY))
    if chunk_ms == "stored":
        chunked = df
        full.remove("_chunk")
    else:
        chunked = df.withColumn("_chunk", chunk_of(ts, width)).drop("_width")
    # The order is total but for rows that are equal throughout, so both uses of
    # this window agree on which row is a chunk's last.
    w = Window.partitionBy(*series, "_chunk").orderBy(*full)
    there = F.lit(True)
    rows = chunked.select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in carry],
                          F.lag(there).over(w).isNull().alias("_is_first"),
                          F.lead(there).over(w).isNull().alias("_is_last"))
    edges = rows.where(F.col("_is_first") | F.col("_is_last"))
    stitched = edges.withColumns({f"next_{c}": F.lead(c).over(per_series) for c in carry})
    out = rows.where(~F.col("_is_last")).unionByName(stitched.where("_is_last"))
    return out.drop("_chunk", "_is_first", "_is_last")


def classify_gaps(df: DataFrame, cadence_s=R.GAP_CADENCE_S, cap_s=R.GAP_CAP_S,
                  tolerance=R.GAP_TOLERANCE, enabled: Column | None = None) -> DataFrame:
    """W2 on rows that carry ``next_DateAndTime``/``next_Val``. Adds ``gap_ms``,
    ``gap_kind`` (NULL for the last row, 'normal', 'bridged', or the flag
    reason) and ``n_fill`` (synthetic rows owed after this row). Rows where
    ``enabled`` is false (plants that are never filled) get a NULL kind: they
    are neither filled nor flagged."""
    cad_ms = _p(cadence_s) * 1000.0
    cap_ms = _p(cap_s) * 1000.0
    gap = diff_millis("DateAndTime", "next_DateAndTime")
    agree = values_agree("Val", "next_Val", _p(tolerance))
    off = F.col("next_DateAndTime").isNull()
    if enabled is not None:
        off = off | ~F.coalesce(enabled, F.lit(False))
    kind = (F.when(off, F.lit(None).cast("string"))
            .when(gap <= cad_ms * R.GAP_NORMAL_FACTOR, F.lit(NORMAL))
            .when((gap <= cap_ms) & F.coalesce(agree, F.lit(False)), F.lit(BRIDGED))
            .when(gap > cap_ms, F.lit(R.REASON_EXCEEDS_CAP))
            .otherwise(F.lit(R.REASON_MISMATCH)))
    out = df.withColumns({"gap_ms": gap, "gap_kind": kind})
    n = F.when(F.col("gap_kind") == BRIDGED,
               (F.ceil(F.col("gap_ms") / cad_ms) - 1).cast("int")).otherwise(F.lit(0))
    return out.withColumns({"n_fill": n, "_cad_ms": cad_ms})


def is_flagged(kind: str = "gap_kind") -> Column:
    return F.col(kind).isin(R.REASON_EXCEEDS_CAP, R.REASON_MISMATCH)


def fill_rows(classified: DataFrame) -> DataFrame:
    """Each row plus ``n_fill`` hold-last copies at ``a + k * cadence``,
    ``Filled`` true on the copies. Gap columns stay on the real row only."""
    k = F.explode(F.sequence(F.lit(0), F.col("n_fill"))).alias("_k")
    x = classified.select("*", k)
    synthetic = F.col("_k") > 0
    shifted = add_millis("DateAndTime", F.col("_k") * F.col("_cad_ms"))
    x = x.withColumns({
        "DateAndTime": F.when(synthetic, shifted).otherwise(F.col("DateAndTime")),
        "Filled": synthetic,
        "gap_kind": F.when(synthetic, F.lit(None).cast("string")).otherwise(F.col("gap_kind")),
        "gap_ms": F.when(synthetic, F.lit(None).cast("long")).otherwise(F.col("gap_ms")),
    })
    return x.drop("_k", "_cad_ms", "n_fill")


def gap_fill(readings: DataFrame, cadence_s=R.GAP_CADENCE_S, cap_s=R.GAP_CAP_S,
             tolerance=R.GAP_TOLERANCE, series: Sequence[str] = SERIES,
             chunk_ms: int | str | None = CHUNK_MS, enabled: Column | None = None) -> DataFrame:
    """Readings (already filtered to a window) plus synthetic rows.
    Output keeps every input column and adds ``Filled``, ``gap_kind``,
    ``gap_ms``, ``next_DateAndTime``, ``next_Val``. Cadence, cap and tolerance
    may be per-row Columns (per-plant policy); ``enabled`` switches the fill
    off per row."""
    return fill_rows(gap_classified(readings, cadence_s, cap_s, tolerance, series, chunk_ms, enabled))


def gap_classified(readings: DataFrame, cadence_s=R.GAP_CADENCE_S, cap_s=R.GAP_CAP_S,
                   tolerance=R.GAP_TOLERANCE, series: Sequence[str] = SERIES,
                   chunk_ms: int | str | None = CHUNK_MS, enabled: Column | None = None) -> DataFrame:
    """The rows of ``gap_fill`` without the synthetic ones, which are only owed: each row
    carries ``n_fill`` and ``_cad_ms``. What counts them needs no more."""
    s = with_successor(readings, series=series, chunk_ms=chunk_ms)
    return classify_gaps(s, cadence_s, cap_s, tolerance, enabled)


def chronological(filled: DataFrame, total_order: bool = False) -> DataFrame:
    """R4 order: by tag, time and ``Filled`` within each plant and day, which needs no range
    partitioning; with ``total_order`` over the whole result."""
    order = ["TagIndex", "DateAndTime", "Filled"]
    if total_order:
        return filled.orderBy("plant", *order)
    day = F.to_date("DateAndTime")
    return filled.repartition("plant", day).sortWithinPartitions("plant", day, *order)


def flagged_gaps(filled_or_classified: DataFrame, series: Sequence[str] = SERIES) -> DataFrame:
    """W2 output: one row per flagged gap ``(series, from_ts, to_ts, gap_s, reason)``."""
    g = filled_or_classified.where(is_flagged())
    return g.select(*series, F.col("DateAndTime").alias("from_ts"),
                    F.col("next_DateAndTime").alias("to_ts"),
                    (F.col("gap_ms") / 1000.0).alias("gap_s"),
                    F.col("gap_kind").alias("reason"))


def audit_aggs(filled: bool = True) -> list[Column]:
    """A8 aggregates over filled rows, or over classified ones (``filled`` False), whose
    synthetic rows are only owed."""
    flagged = is_flagged()
    real = F.count_if(~F.col("Filled")) if filled else F.count(F.lit(1))
    synthetic = F.count_if(F.col("Filled")) if filled else F.coalesce(F.sum(F.col("n_fill").cast("long")), F.lit(0))
    return [
        real.alias("realReadings"),
        synthetic.alias("filledReadings"),
        (F.count(F.lit(1)) if filled else real + synthetic).alias("totalReadings"),
        F.count_if(flagged).alias("flaggedGaps"),
        (F.coalesce(F.sum(F.when(flagged, F.col("gap_ms"))), F.lit(0)) / 1000.0).alias("flagged_s"),
    ]


def fill_audit(rows: DataFrame, series: Sequence[str] = SERIES) -> DataFrame:
    """Per series real, filled and total rows, flagged gap count and seconds, from
    filled or classified rows."""
    return rows.groupBy(*series).agg(*audit_aggs("Filled" in rows.columns))

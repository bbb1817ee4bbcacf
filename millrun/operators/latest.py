"""The latest row per key, in full and as kept state.

In full: a hash aggregate of the newest time per key over narrow columns, then the
rows at that time fetch their payload; only those few are compared by the tie-breaker.
No split is sorted with its payload.

As state: a table of the latest row per key and the day that it reaches. Advancing it
reads the new days only: the latest of old state and new days is the latest of all, so
a state advanced over any days in any steps equals the full computation.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrun.operators.joins import MAX_BROADCAST_ROWS, fits


def latest_rows(rows: DataFrame, keys: Sequence[str], order: Sequence[str], payload: Sequence[str],
                few_keys: bool | None = None) -> DataFrame:
    """Per key the row that is last by ``order`` (its first column a number or time, never
    null in the result), with ``payload``. Null keys are keys.

    ``few_keys`` tells whether the newest times fit a broadcast; if None they are counted."""
    newest, keys = order[0], list(keys)
    rows = rows.where(F.col(newest).isNotNull())
    top = rows.groupBy(*keys).agg(F.max(newest).alias("_top")).select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_top")
    if few_keys is None:
        few_keys = fits(top, MAX_BROADCAST_ROWS)
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)],
                  F.col(newest) == F.col("_top"))
    winners = rows.join(F.broadcast(top) if few_keys else top, same).select(*keys, *order, *payload)
    return _last(winners, keys, order, payload)


def _last(rows: DataFrame, keys: Sequence[str], order: Sequence[str], payload: Sequence[str]) -> DataFrame:
    """The last row per key among few."""
    cols = [*order, *[c for c in payload if c not in order]]
    x = rows.groupBy(*keys).agg(F.max(F.struct(*cols)).alias("_l"))
    return x.select(*keys, *[F.col("_l")[c].alias(c) for c in cols])


def advanced(state: DataFrame | None, new_rows: DataFrame, keys: Sequence[str], order: Sequence[str],
             payload: Sequence[str]) -> DataFrame:
    """The state after ``new_rows``: the old state (or None) merged with their latest rows."""
    new = latest_rows(new_rows, keys, order, payload)
    if state is None:
        return new
    return _last(state.select(*new.columns).unionByName(new), keys, order, payload)

"""Newest-first walk over the stored days of a partitioned dataset.

A top-N over a log that is partitioned by day must not open the whole log. The days
are known from the file listing alone; the walk counts the wanted rows of the newest
day, then of as many more days as the densest day so far says are needed, and stops
as soon as N rows are held. Where a filter has found nothing yet the range doubles,
so a rare filter takes a logarithmic number of steps. Only the counted columns of the
opened days are read; the caller's top-N then reads these days.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from functools import reduce
from operator import or_
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAY = "event_date"
_NO_DAY = "__HIVE_DEFAULT_PARTITION__"


def stored_days(df: DataFrame, by: Sequence[str] = ()) -> dict[tuple, list[dt.date]]:
    """The days of each partition group, newest first, from the file listing (nothing is opened)."""
    out: dict[tuple, set] = {}
    for path in df.inputFiles():
        # the listing gives URIs of directory names in which values are escaped already
        parts = dict(unquote(p).split("=", 1) for p in path.split("/")[:-1] if "=" in p)
        if DAY in parts and parts[DAY] != _NO_DAY and all(c in parts for c in by):
            out.setdefault(tuple(unquote(parts[c]) for c in by), set()).add(dt.date.fromisoformat(parts[DAY]))
    return {g: sorted(days, reverse=True) for g, days in out.items()}


def _group(by: Sequence[str], group: tuple) -> Column:
    return reduce(lambda a, c: a & (F.col(c[0]) == F.lit(c[1])), zip(by, group), F.lit(True))


def first_days(df: DataFrame, n: int, by: Sequence[str] = (), since: dt.date | None = None,
               until: dt.date | None = None) -> dict[tuple, dt.date]:
    """Per group, the newest day from which on ``df`` surely holds ``n`` rows (or all it has).

    ``df`` is the filtered dataset; days outside ``since``..``until`` hold none of its rows."""
    days = {g: [d for d in ds if (since is None or d >= since) and (until is None or d <= until)]
            for g, ds in stored_days(df, by).items()}
    first: dict[tuple, dt.date] = {}
    walk = {g: (0, 1, 0, 0) for g, ds in days.items() if ds}  # next day, days to open, rows held, most rows of a day
    while walk:
        opened = {g: days[g][i:i + step] for g, (i, step, _, _) in walk.items()}
        ranges = [_group(by, g) & F.col(DAY).between(F.lit(ds[-1]), F.lit(ds[0])) for g, ds in opened.items()]
        counts: dict[tuple, int] = {}
        for r in df.where(reduce(or_, ranges)).groupBy(*by, DAY).count().collect():  # a row per opened day
            counts[(tuple(str(r[c]) for c in by), r[DAY])] = r["count"]
        for g, ds in opened.items():
            i, step, held, peak = walk.pop(g)
            for d in ds:
                held += counts.get((g, d), 0)
                peak = max(peak, counts.get((g, d), 0))
                if held >= n:
                    break
            first[g] = d
            if held < n and i + len(ds) < len(days[g]):
                walk[g] = (i + len(ds), max(1, (n - held) // peak) if peak else 2 * step, held, peak)
    return first


def newest_days(df: DataFrame, n: int, by: Sequence[str] = (), since: dt.date | None = None,
                until: dt.date | None = None) -> DataFrame:
    """``df`` cut to the newest days that hold its newest ``n`` rows of each group.

    A dataset that isn't stored by day is returned as it is. Rows without a day are kept."""
    if DAY not in df.columns or any(c not in df.columns for c in by):
        return df
    first = first_days(df, n, by, since, until)
    if not first:
        return df
    wanted = reduce(or_, [_group(by, g) & (F.col(DAY) >= F.lit(d)) for g, d in first.items()])
    return df.where(F.col(DAY).isNull() | wanted)

"""Streaming gap detection (W2 + W3 counts) with per-tag state.

State per (plant, TagIndex) is the last accepted reading. Each micro-batch's
new readings of a tag are sorted by (time, seq), prefixed with that last
reading, and each consecutive pair is classified exactly as in the batch
operator. Gaps that are not normal are emitted as they close: bridged ones
with the number of synthetic rows they owe, flagged ones with their reason.
A reading older than the tag's last accepted reading arrives too late to be
paired and is dropped; the drop is counted in the state and reported as a
``late readings dropped`` row carrying the number dropped in that batch.

Per-key work is bounded by the micro-batch size (``maxFilesPerTrigger`` /
``maxBytesPerTrigger`` on the source), so a hot tag costs one larger group
per trigger, never its whole history. The pairing is vectorised with numpy.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from millrun.functions.time import millis_since_epoch, micros_since_epoch
from millrun.sources import registry as R

OUTPUT = T.StructType([
    T.StructField("plant", T.StringType()),
    T.StructField("TagIndex", T.IntegerType()),
    T.StructField("from_ms", T.LongType()),
    T.StructField("to_ms", T.LongType()),
    T.StructField("gap_s", T.DoubleType()),
    T.StructField("kind", T.StringType()),
    T.StructField("n_fill", T.IntegerType()),
    T.StructField("late_dropped", T.IntegerType()),
])
LATE = "late readings dropped"
STATE = T.StructType([
    T.StructField("last_ms", T.LongType()),
    T.StructField("last_us", T.LongType()),
    T.StructField("last_seq", T.LongType()),
    T.StructField("last_val", T.DoubleType()),
    T.StructField("late", T.LongType()),
])


def _classifier(cadence_s: float, cap_s: float, tolerance: float):
    import numpy as np
    import pandas as pd

    cad_ms, cap_ms = cadence_s * 1000.0, cap_s * 1000.0

    def fn(key, pdfs: Iterator, state):
        plant, tag = key
        batch = pd.concat(list(pdfs), ignore_index=True)
        batch = batch.sort_values(["_us", "seq"], kind="mergesort")
        late = dropped = 0
        if state.exists:
            last_ms, last_us, last_seq, last_val, late = state.get
            newer = (batch["_us"] > last_us) | ((batch["_us"] == last_us) & (batch["seq"] > last_seq))
            dropped = int((~newer).sum())
            late += dropped
            batch = batch[newer]
            ms = np.concatenate([[last_ms], batch["_ms"].to_numpy(dtype="int64")])
            us = np.concatenate([[last_us], batch["_us"].to_numpy(dtype="int64")])
            seq = np.concatenate([[last_seq], batch["seq"].to_numpy(dtype="int64")])
            val = np.concatenate([[last_val], batch["Val"].to_numpy(dtype="float64")])
        else:
            ms = batch["_ms"].to_numpy(dtype="int64")
            us = batch["_us"].to_numpy(dtype="int64")
            seq = batch["seq"].to_numpy(dtype="int64")
            val = batch["Val"].to_numpy(dtype="float64")
        if dropped:
            yield pd.DataFrame({"plant": [plant], "TagIndex": [int(tag)], "from_ms": [None],
                                "to_ms": [None], "gap_s": [None], "kind": [LATE], "n_fill": [0],
                                "late_dropped": [dropped]})
        if len(ms) == 0:
            return
        state.update((int(ms[-1]), int(us[-1]), int(seq[-1]), float(val[-1]), int(late)))
        if len(ms) < 2:
            return
        a, b = val[:-1], val[1:]
        gap = (ms[1:] - ms[:-1]).astype("float64")
        scale = np.maximum(np.maximum(np.abs(a), np.abs(b)), R.GAP_SCALE_FLOOR)
        agree = np.abs(a - b) / scale <= tolerance
        normal = gap <= cad_ms * R.GAP_NORMAL_FACTOR
        bridged = ~normal & (gap <= cap_ms) & agree
        flagged = ~normal & ~bridged
        keep = bridged | flagged
        if not keep.any():
            return
        kind = np.where(bridged, "bridged",
                        np.where(gap > cap_ms, R.REASON_EXCEEDS_CAP, R.REASON_MISMATCH))
        n_fill = np.where(bridged, np.ceil(gap / cad_ms) - 1, 0).astype("int32")
        yield pd.DataFrame({
            "plant": plant, "TagIndex": int(tag),
            "from_ms": ms[:-1][keep], "to_ms": ms[1:][keep], "gap_s": gap[keep] / 1000.0,
            "kind": kind[keep], "n_fill": n_fill[keep], "late_dropped": 0,
        })

    return fn


def gap_events_stream(readings: DataFrame, cadence_s: float = R.GAP_CADENCE_S,
                      cap_s: float = R.GAP_CAP_S, tolerance: float = R.GAP_TOLERANCE) -> DataFrame:
    """Bridged and flagged gaps of a readings stream (output mode ``append``).
    ``readings`` should already be filtered (good status, known tags)."""
    if not (cadence_s > 0 and cap_s > 0 and tolerance >= 0 and math.isfinite(tolerance)):
        raise ValueError("cadence and cap must be positive, tolerance >= 0")
    x = readings.select("plant", "TagIndex", "seq", "Val",
                        millis_since_epoch("DateAndTime").alias("_ms"),
                        micros_since_epoch("DateAndTime").alias("_us"))
    return (x.groupBy("plant", "TagIndex")
             .applyInPandasWithState(_classifier(cadence_s, cap_s, tolerance), OUTPUT, STATE,
                                     "append", GroupStateTimeout.NoTimeout))


def with_timestamps(gap_events: DataFrame) -> DataFrame:
    """Epoch-ms bounds of gap events back to NTZ timestamps."""
    from millrun.functions.time import EPOCH
    return gap_events.select(
        "plant", "TagIndex",
        F.timestamp_add("MILLISECOND", F.col("from_ms"), F.expr(EPOCH)).alias("from_ts"),
        F.timestamp_add("MILLISECOND", F.col("to_ms"), F.expr(EPOCH)).alias("to_ts"),
        "gap_s", "kind", "n_fill", "late_dropped")

"""Documents in packs: a row for some megabytes of texts, so that tasks work on arrays of bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrun.llm.common import utf8

#: Stands for a null id: larger than any other.
LAST = np.iinfo(np.int64).max


def packed(docs: DataFrame, size_bytes: int = 4 << 20, most: int = 20_000) -> DataFrame:
    """``pack, rest, ids, sizes, body, n_bytes``: documents in arrival order, bodies compressed.

    ``rest`` holds the other columns, ``ids`` and ``sizes`` 64-bit integers (``LAST`` for a null id);
    a longer document is a pack of its own, and a pack has at most ``most`` documents."""
    rest = [c for c in docs.columns if c != "text"]
    struct = F.struct(*[F.col(f"`{c}`") for c in rest])
    rows = docs.select(struct.alias("rest"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("id"),
                       utf8(F.col("text")).alias("body"))

    def run(batches):
        ctx = TaskContext.get()
        pack = (ctx.partitionId() if ctx else 0) << 32
        held, size = [], 0

        def flush():
            rows = pa.Table.from_batches([h[0] for h in held]).combine_chunks()
            bodies = rows.column(2).to_pylist()
            sizes = np.fromiter(map(len, bodies), np.int64, len(bodies))
            rest = rows.column(0).chunk(0)
            return pa.RecordBatch.from_arrays(
                [pa.array([pack]), pa.ListArray.from_arrays(pa.array([0, len(bodies)], pa.int32()), rest),
                 pa.array([rows.column(1).to_numpy().astype("<i8").tobytes()]), pa.array([sizes.astype("<i8").tobytes()]),
                 pa.array([zstandard.compress(b"".join(bodies), 3)]), pa.array([int(sizes.sum())], pa.int64())],
                ["pack", "rest", "ids", "sizes", "body", "n_bytes"])

        for batch in batches:
            lens = batch.column(2).cast(pa.large_binary())
            ends = np.frombuffer(lens.buffers()[1], "<i8")[lens.offset:lens.offset + len(lens) + 1]
            a = 0
            while a < batch.num_rows:
                room = size_bytes - size
                b = int(np.searchsorted(ends, ends[a] + room, side="right")) - 1
                b = min(max(b, a + (not held)), batch.num_rows, a + most - sum(h[0].num_rows for h in held))
                if b > a:
                    held.append((batch.slice(a, b - a),))
                    size += int(ends[b] - ends[a])
                    a = b
                if a < batch.num_rows or size >= size_bytes:
                    yield flush()
                    pack, held, size = pack + 1, [], 0
        if held:
            yield flush()

    kind = rows.schema["rest"].dataType.simpleString()
    return rows.mapInArrow(run, f"pack long, rest array<{kind}>, ids binary, sizes binary, body binary, n_bytes long")


def pack_rows(batch):
    """The rows of a batch of packs without ``rest``, one at a time."""
    names = [n for n in batch.schema.names if n != "rest"]
    for k in range(batch.num_rows):
        yield {n: batch.column(n)[k].as_py() for n in names}

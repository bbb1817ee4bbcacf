"""Best-fit packing (operator 7): large-item matching, then best fit of small items.

Items above one third of the capacity can share a sequence with at most one
other such item, so they are matched greedily: the largest with the largest
that still fits. Smaller items, largest first, go to the fullest sequence with
room. Items are dealt at random into buckets of about ``BUCKET_TOKENS`` tokens
(thousands of sequences each) that are packed in parallel; a bucket loses at
most part of one sequence against packing all at once, and no group grows with
the input.

Defined cases: null or empty texts are one token (the closing id 0); a null
``doc_id`` is an ordinary row; repeated rows are packed each; very long texts
are cut into pieces of the capacity, the first piece being the remainder; extra
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrun.llm.common import by_doc, ship, written
from millrun.llm.tokens import encoder

#: One packing group: about so many tokens, and so many pieces at most on average.
BUCKET_TOKENS, BUCKET_PIECES = 8_000_000, 200_000


def pieces_of(total: int, capacity: int) -> list[tuple[int, int]]:
    """``(start, length)`` of a document's pieces; the first takes the remainder."""
    first = total % capacity or min(total, capacity)
    starts = [0, *range(first, total, capacity)]
    return [(a, b - a) for a, b in zip(starts, [*starts[1:], total])]


def tokenized(docs: DataFrame, capacity: int = 2048, path: str | None = None) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``: every piece of every document."""
    ship(docs.sparkSession)

    def run(batches):
        enc = encoder(path)
        for batch in batches:
            for part in by_doc(batch):
                own, piece, start, length, crc = [], [], [], [], []
                for k, text in enumerate(part.column(1).to_pylist()):
                    ids = enc.encode(text or "") + b"\0\0\0\0"
                    for j, (a, n) in enumerate(pieces_of(len(ids) // 4, capacity)):
                        own.append(k)
                        piece.append(j)
                        start.append(a)
                        length.append(n)
                        crc.append(zlib.crc32(ids[4 * a:4 * (a + n)]))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(own, pa.int64())), pa.array(piece, pa.int32()),
                     pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    ["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def place(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each item; lengths are 1 to ``capacity``."""
    seq, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    by_length: list[list[int]] = [[] for _ in range(capacity + 1)]
    large = 0  # bit n: a large item of length n is unmatched
    order = np.argsort(-lengths, kind="stable").tolist()
    size = lengths.tolist()
    split = len(order)
    for r, i in enumerate(order):
        n = size[i]
        if 3 * n <= capacity:
            split = r
            break
        by_length[n].append(i)
        large |= 1 << n
    gaps: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_gaps = 0  # bit g: some sequence has g tokens of room
    made = 0

    def take() -> int:
        nonlocal large
        n = large.bit_length() - 1
        i = by_length[n].pop()
        if not by_length[n]:
            large ^= 1 << n
        return i

    while large:
        i = take()
        seq[i], offset[i], room = made, 0, capacity - size[i]
        fits = large & ((1 << (room + 1)) - 1)
        if fits:
            n = fits.bit_length() - 1
            j = by_length[n].pop()
            if not by_length[n]:
                large ^= 1 << n
            seq[j], offset[j], room = made, size[i], room - n
        if room:
            gaps[room].append(made)
            open_gaps |= 1 << room
        made += 1
    for i in order[split:]:
        n = size[i]
        fits = open_gaps >> n
        if fits:
            g = n + (fits & -fits).bit_length() - 1
            s = gaps[g].pop()
            if not gaps[g]:
                open_gaps ^= 1 << g
        else:
            g, s, made = capacity, made, made + 1
        seq[i], offset[i] = s, capacity - g
        if g > n:
            gaps[g - n].append(s)
            open_gaps |= 1 << (g - n)
    return seq, offset


def packed(docs: DataFrame, capacity: int = 2048, path: str | None = None) -> DataFrame:
    """Every piece with its ``sequence_id`` and ``offset``; see ``tokenized``."""
    pieces = written(tokenized(docs, capacity, path), "pieces")
    total = pieces.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("t"), F.count(F.lit(1)).alias("n")).first()
    buckets = max(1, -(-total["t"] // BUCKET_TOKENS), -(-total["n"] // BUCKET_PIECES))

    def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        seq, offset = place(group.column("length").to_numpy(), capacity)
        first = key[0].as_py() << 32
        return group.drop_columns(["bucket"]).append_column("sequence_id", pa.array(seq + first)).append_column(
            "offset", pa.array(offset))

    salt = F.xxhash64("doc_id", "piece", F.monotonically_increasing_id())
    dealt = pieces.withColumn("bucket", F.pmod(salt, F.lit(buckets)))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema)
    return dealt.groupBy("bucket").applyInArrow(run, f"{schema}, sequence_id long, offset long")

"""SimHash near-duplicates (operator 3): multi-index hashing over distinct fingerprints.

A fingerprint is cut into ``max_bits // 2 + 1`` segments (two at least), so two fingerprints
within ``max_bits`` agree up to ``max_bits // segments`` bits in some segment.
Each fingerprint is filed under its exact segments (the tables) and probes the
small Hamming ball around each segment. Only the side with the smaller segment
value probes, which halves the probes and loses nothing. Every match is
verified on all 64 bits.

A bucket gives only a spanning set of its verified links, not all its pairs:
components need no more. Exact copies share one fingerprint and are collapsed
before. Buckets with over ``HOT_BUCKET`` table rows, or probes from crowded
neighbours, are dealt out as cells of two table blocks and of a table and a probe
block (probes needn't meet), so no task holds an unbounded bucket and no link is
lost. A bucket's probes are counted from its neighbours' table rows.

Defined cases: null and empty texts have fingerprint 0, linked like any other;
a null ``doc_id`` row is kept and never is a component's smallest id (a
component of null ids only has a null id); repeated rows stay repeated; extra
columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrun.llm.common import by_doc, free_names, parts, ship, utf8, written
from millrun.llm.components import components
from millrun.operators.joins import checked_broadcast

#: Table rows or probes of one bucket that one task compares; larger buckets are dealt out in blocks.
HOT_BUCKET = 4096
#: Hash values turned into bit rows at once.
_STEP = 1 << 16


def fingerprint(data: bytes, shingle: int = 4) -> int:
    """Unsigned 64-bit SimHash of a UTF-8 text (ASCII lower case, ASCII white space)."""
    words = data.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, 42)
    length = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    end = np.cumsum(length + 1) - 1
    spans = zip((end - length).tolist(), end[shingle - 1:].tolist())
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], 42) for a, b in spans], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), _STEP):
        rows = hashes[i:i + _STEP].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(rows, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(ones * 2 > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """``doc_id, text_hash, fp`` (a signed long), one row per document row."""
    ship(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for part in by_doc(batch):
                fp = np.array([fingerprint(t, shingle) for t in part.column(2).to_pylist()], dtype=np.uint64)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(fp.view(np.int64))],
                                                 ["doc_id", "text_hash", "fp"])

    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), utf8(F.col("text")).alias("body")).mapInArrow(
        run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_hash long, fp long")


def segments(max_bits: int) -> tuple[list[tuple[int, int]], int]:
    """``[(shift, width)]`` of the segments, and the radius of the balls."""
    m = max(2, max_bits // 2 + 1)
    cuts = [64 * i // m for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])], max_bits // m


def _masks(width: int, radius: int) -> list[int]:
    return [sum(1 << b for b in c) for r in range(1, radius + 1) for c in combinations(range(width), r)]


def _filed(distinct: DataFrame, max_bits: int) -> DataFrame:
    """``key, fp, probe``: table rows (own segments) and probe rows (balls around them)."""
    cut, radius = segments(max_bits)

    def run(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            u = fp.view(np.uint64)
            for s, (shift, width) in enumerate(cut):
                seg = (u >> np.uint64(shift)) & np.uint64((1 << width) - 1)
                tag = np.uint64(s << 56)
                yield _rows(tag | seg, fp, False)
                for mask in _masks(width, radius):
                    key = seg ^ np.uint64(mask)
                    up = key > seg
                    if up.any():
                        yield _rows(tag | key[up], fp[up], True)

    return distinct.mapInArrow(run, "key long, fp long, probe boolean")


def _rows(key, fp, probe: bool):
    return pa.RecordBatch.from_arrays(
        [pa.array(key.view(np.int64)), pa.array(fp), pa.array(np.full(len(fp), probe))], ["key", "fp", "probe"])


def _span(fp: np.ndarray, probe: np.ndarray, max_bits: int):
    """Verified links that span the components of one bucket: breadth first from
    each unvisited table row (probes left over have no link), so a dense bucket
    costs about one pass over its rows."""
    rest = np.argsort(probe, kind="stable")
    found = []
    while len(rest) and not probe[rest[0]]:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            u = queue.pop()
            near = np.bitwise_count(fp[rest] ^ fp[u]) <= max_bits
            if probe[u]:
                near &= ~probe[rest]
            if near.any():
                hit = rest[near]
                found.append((np.full(len(hit), u), hit))
                queue.extend(hit.tolist())
                rest = rest[~near]
    return found


def _links(filed: DataFrame, max_bits: int) -> DataFrame:
    """Spanning verified links of every bucket; the input is sorted by bucket within partitions."""

    def solve(key, fp, probe):
        """All buckets of the arrays (whole buckets only)."""
        starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1)])
        sizes = np.diff(np.r_[starts, len(key)])
        a, b = [], []
        two = starts[sizes == 2]
        ok = ~(probe[two] & probe[two + 1]) & (np.bitwise_count(fp[two] ^ fp[two + 1]) <= max_bits)
        a.append(fp[two[ok]])
        b.append(fp[two[ok] + 1])
        for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
            p = probe[s:s + n]
            if not p.all():
                f = fp[s:s + n]
                for u, v in _span(f, p, max_bits):
                    a.append(f[u])
                    b.append(f[v])
        x, y = np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])

    def run(batches):
        held = None
        for batch in batches:
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
            key = np.stack(cols[:3], axis=1)
            now = [key, cols[3].astype(np.int64).view(np.uint64), cols[4].astype(bool)]
            if held is not None:
                now = [np.concatenate(x) for x in zip(held, now)]
            same = (now[0] == now[0][-1]).all(axis=1)
            cut = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
            if cut:
                yield solve(*[x[:cut] for x in now])
            held = [x[cut:] for x in now]
        if held is not None and len(held[0]):
            yield solve(*held)

    return filed.mapInArrow(run, "a long, b long").filter("a <> b")


def _hot_buckets(distinct: DataFrame, max_bits: int) -> DataFrame:
    """``key, blocks, probe_blocks`` of the buckets to deal out.

    A fingerprint probes the larger neighbours of its own segments, so a bucket's
    probes are its smaller neighbours' table rows. Neighbours that share evenly in
    ``HOT_BUCKET`` or less are left out; together they send no more than that."""
    cut, radius = segments(max_bits)
    masks = [_masks(w, radius) for _, w in cut]
    own = F.array(*[F.shiftrightunsigned(F.col("fp"), s).bitwiseAND(F.lit((1 << w) - 1)).bitwiseOR(F.lit(i << 56))
                    for i, (s, w) in enumerate(cut)])
    few = HOT_BUCKET // max(1, *map(len, masks))
    full = written(distinct.select(F.explode(own).alias("key")).groupBy("key").count()
                   .filter(F.col("count") > few), "full_buckets")
    near = F.element_at(F.array(*[F.array(*[F.lit(m).cast("long") for m in ms]) for ms in masks]),
                        (F.shiftright("key", 56) + 1).cast("int"))
    probes = (full.select("key", "count", F.explode(near).alias("mask"))
              .select(F.col("key").alias("of"), F.col("key").bitwiseXOR(F.col("mask")).alias("key"), "count")
              .filter("key > of").select("key", F.lit(0).alias("rows"), F.col("count").alias("probes")))
    block = F.lit(HOT_BUCKET / 2)
    return (full.select("key", F.col("count").alias("rows"), F.lit(0).alias("probes")).union(probes)
            .groupBy("key").agg(F.sum("rows").alias("rows"), F.sum("probes").alias("probes"))
            .filter((F.col("rows") > HOT_BUCKET) | (F.col("probes") > HOT_BUCKET))
            .select("key", F.greatest(F.lit(1), F.ceil(F.col("rows") / block)).cast("int").alias("blocks"),
                    F.greatest(F.lit(1), F.ceil(F.col("probes") / block)).cast("int").alias("probe_blocks")))


def _dealt(distinct: DataFrame, max_bits: int) -> DataFrame:
    """``key, i, j, fp, probe``: the rows of every bucket, hot ones by cells: table blocks
    ``i <= j < blocks``, or table block ``i`` and probe block ``j - blocks``."""
    hot = written(_hot_buckets(distinct, max_bits), "hot_buckets")
    block = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    probe_block = F.pmod(F.xxhash64("fp"), F.col("probe_blocks")).cast("int") + F.col("blocks")
    tables = F.sequence(F.lit(0), F.col("blocks") - 1)
    others = F.sequence(F.lit(0), F.col("blocks") + F.col("probe_blocks") - 1)
    cells = (F.when(F.col("blocks").isNull(), F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"))))
             .when(F.col("probe"), F.transform(tables, lambda i: F.struct(i.alias("i"), probe_block.alias("j"))))
             .otherwise(F.transform(others, lambda j: F.struct(F.least(block, j).alias("i"),
                                                               F.greatest(block, j).alias("j")))))
    return (_filed(distinct, max_bits).join(checked_broadcast(hot, 100_000), "key", "left")
            .select("key", "fp", "probe", F.explode(cells).alias("cell"))
            .select("key", F.col("cell.i").alias("i"), F.col("cell.j").alias("j"), "fp", "probe"))


def links(distinct: DataFrame, max_bits: int = 4) -> DataFrame:
    """``a, b``: links (``a < b``) whose components are those of all pairs within ``max_bits``."""
    if not 0 <= max_bits <= 16:
        raise ValueError("max_bits must be 0 to 16")
    spark = distinct.sparkSession
    ship(spark)
    dealt = (_dealt(distinct, max_bits).repartition(parts(spark), "key", "i", "j")
             .sortWithinPartitions("key", "i", "j"))
    return _links(dealt, max_bits).distinct()


def _grouped(docs: DataFrame, shingle: int, max_bits: int) -> DataFrame:
    """``doc_id, text_hash, fp, root, component_id``, one row per document row; ``root``,
    the component's smallest linked fingerprint, is its own even where ids repeat."""
    base = written(fingerprints(docs, shingle), "fingerprints")
    firsts = written(base.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct_fp")
    linked = components(links(firsts.select("fp"), max_bits))
    # Only fingerprints that have links need their component's smallest id.
    roots = (linked.join(firsts.withColumnRenamed("fp", "node"), "node")
             .groupBy("root").agg(F.min("first_id").alias("root_id")))
    moved = linked.join(roots, "root").select(F.col("node").alias("fp"), "root", "root_id")
    ids = (firsts.join(moved, "fp", "left")
           .select("fp", F.coalesce("root", "fp").alias("root"), F.coalesce("root_id", "first_id").alias("component_id")))
    # Both sides are plain tables, so that adaptive execution can split a hot fingerprint's rows.
    return base.join(written(ids, "fp_components"), "fp").select("doc_id", "text_hash", "fp", "root", "component_id")


def near_duplicates(docs: DataFrame, shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """``doc_id, text_hash, fp, component_id``, one row per document row."""
    return _grouped(docs, shingle, max_bits).select("doc_id", "text_hash", "fp", "component_id")


def representatives(docs: DataFrame, shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """One document (all its columns) of each component: that with the smallest id.

    A row is found again by its id and a hash of its text; of repeated rows one
    stays, and of rows that differ in other columns only that with the smallest hash of
    all columns. An id on rows of several components stands for each of them; on linked
    rows with different texts, that with the smallest hash stays. Components that
    hold only null ids keep one row per fingerprint."""
    groups = _grouped(docs, shingle, max_bits)
    alone = F.when(F.col("component_id").isNull(), F.col("fp"))
    keys = free_names(docs, "id", "none", "hash")
    first = free_names(docs, "first")[0]
    kept = (groups.filter("component_id is null or doc_id = component_id")
            .groupBy("root", alone.alias("alone"))
            .agg(F.min(F.struct("doc_id", "text_hash")).alias("k"))
            .select(*[c.alias(k) for k, c in zip(keys, (F.coalesce("k.doc_id", F.lit(0)), F.col("k.doc_id").isNull(),
                                                        F.col("k.text_hash")))]))
    rows = docs.withColumns(dict(zip(keys, (F.coalesce("doc_id", F.lit(0)), F.col("doc_id").isNull(), F.xxhash64("text")))))
    order = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return (rows.join(kept, keys, "left_semi").withColumn(first, place).filter(F.col(first) == 1)
            .select(*[F.col(f"`{c}`") for c in docs.columns]))

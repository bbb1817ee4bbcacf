"""Exact top-k search (operator 5): three-phase uniform threshold over score lists.

A vector's dimensions are cut into ``lists`` blocks; the partial inner products
of a query in one block are that block's score list over all candidates.

1. Every candidate block gathers the head of each of its lists and sums up the
   entries it has seen. The k-th best of those sums over all blocks is a lower
   bound of the query's k-th best score: the safe cutoff.
2. The cutoffs go back to all blocks. If every partial score of a candidate is
   below ``cutoff / lists``, its score is below the cutoff; only entries at or
   above that uniform threshold are collected.
3. The remaining scores of the collected candidates are resolved exactly, and
   each block sends its at most k best entries at or above the cutoff.

Queries and candidates meet in packed blocks by an equi-join on a group number
(each query block goes to every group; there are no more groups than candidate
blocks, and no more than make the copies as large as the candidates or keep all
cores busy), so work is even, no candidate is dropped, and neither side is broadcast,
whatever Spark takes it to measure before the copies are made. A task sends its k best
sums of phase 1 for a query once, whatever the number of its blocks.
The lists are not kept between the phases, since they are larger than the vectors:
phase 2 computes the partial scores again, and full scores only of what it collects.

Defined cases: vectors that are null, empty, or hold a null or non-finite
component take no part, nor do rows with a null id; rows with the query's own id
are not its candidates; repeated rows are candidates each; of an id's rows with
different vectors, that with the smallest vector (compared component by
component, a prefix first) is the query; a query only meets vectors of its own length; scores outside 64 bits are held at the 64-bit limits;
extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrun.llm.common import parts, ship, written

#: Rows of one packed block of candidates and of queries; queries scored at once.
CANDIDATES, QUERIES, SCORED = 4096, 2048, 256


def _packed(vectors: DataFrame, rows: int, cutoff: bool = False) -> DataFrame:
    """``dim, block, ids, body[, cutoffs]``: whole numbers of up to ``rows`` vectors of one length."""
    scale = 1024.0

    def run(batches):
        held: dict[int, list] = {}  # by length, pieces of ids, vectors and cutoffs

        def block(dim, cols):
            ids, body = cols[0].astype("<i8"), np.floor(cols[1] * scale)
            cols = [[dim], [int(np.bitwise_xor.reduce(ids) ^ len(ids))], [ids.tobytes()], [_bytes(body)], *[[c.astype("<i8").tobytes()] for c in cols[2:]]]
            return pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()), *[pa.array(c, pa.binary()) for c in cols[2:]]],
                ["dim", "block", "ids", "body", "cutoffs"][:len(cols)])

        for batch in batches:
            size = batch.column(1).value_lengths().to_numpy()
            for dim in np.unique(size).tolist():
                own = np.flatnonzero(size == dim)
                vectors = batch.column(1).take(pa.array(own)).flatten().to_numpy().reshape(-1, dim)
                cols = [batch.column(0).to_numpy()[own], vectors, *[c.to_numpy()[own] for c in batch.columns[2:]]]
                pieces = held.setdefault(dim, [])
                pieces.append(cols)
                if sum(len(x[0]) for x in pieces) >= rows:
                    cols = [np.concatenate(x) for x in zip(*pieces)]
                    whole = len(cols[0]) - len(cols[0]) % rows
                    for a in range(0, whole, rows):
                        yield block(dim, [c[a:a + rows] for c in cols])
                    held[dim] = [[c[whole:].copy() for c in cols]]
        for dim, pieces in held.items():
            cols = [np.concatenate(x) for x in zip(*pieces)]
            if len(cols[0]):
                yield block(dim, cols)

    extra = ", cutoffs binary" if cutoff else ""
    return vectors.mapInArrow(run, "dim int, block long, ids binary, body binary" + extra)


def _met(queries: DataFrame, candidates: DataFrame, groups: int) -> DataFrame:
    """Every query block beside every candidate block of the same length."""
    q = queries.select(F.col("dim").alias("qdim"), F.col("ids").alias("qids"), F.col("body").alias("qbody"),
                       *[c for c in ("cutoffs",) if c in queries.columns],
                       F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("qgroup"))
    c = candidates.withColumn("group", F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int"))
    return c.join(q.hint("merge"), (F.col("dim") == F.col("qdim")) & (F.col("group") == F.col("qgroup"))).drop("qgroup", "qdim")


#: Whole numbers up to here are exact as 32-bit and 64-bit floats.
_EXACT4, _EXACT8 = 2 ** 24, 2 ** 53


def _bytes(body: np.ndarray) -> bytes:
    """Whole numbers, as 32-bit floats where these hold them."""
    return body.astype("<f4" if np.abs(body).max(initial=0) <= _EXACT4 else "<f8").tobytes()


def _norm(m: np.ndarray) -> float:
    """The largest length of a row, or more."""
    with np.errstate(over="ignore"):
        return float(np.sqrt(np.einsum("ij,ij->i", m, m, dtype=np.float64).max(initial=0))) * (1 + 1e-9)


def _lists(q: np.ndarray, c: np.ndarray, lists: int, norms: float) -> list[np.ndarray]:
    """Exact partial scores per block of dimensions (whole numbers).

    ``norms``: the product of the longest rows' lengths, which no sum of products' magnitudes exceeds."""
    cuts = np.linspace(0, q.shape[1], min(lists, q.shape[1]) + 1).astype(int)
    if norms < _EXACT4 and q.dtype == c.dtype == np.float32:
        return [q[:, a:b] @ c[:, a:b].T for a, b in zip(cuts, cuts[1:])]
    q, c = q.astype(np.float64), c.astype(np.float64)
    if norms < _EXACT8:  # floats hold all sums exactly
        return [q[:, a:b] @ c[:, a:b].T for a, b in zip(cuts, cuts[1:])]
    big = [np.array([[int(x) for x in r] for r in m], dtype=object) for m in (q, c)]
    return [big[0][:, a:b] @ big[1][:, a:b].T for a, b in zip(cuts, cuts[1:])]


def _long(x: int) -> int:
    return max(-2 ** 63, min(2 ** 63 - 1, int(x)))


def _longs(x: np.ndarray) -> np.ndarray:
    if x.dtype == object:
        return np.array([_long(v) for v in x.ravel().tolist()], np.int64).reshape(x.shape)
    return x.astype(np.int64)


def _arrays(row):
    dim = row["dim"]
    ids, qids = (np.frombuffer(row[k], dtype="<i8") for k in ("ids", "qids"))
    c, q = (np.frombuffer(row[k], dtype=f"<f{len(row[k]) // (len(n) * dim)}").reshape(-1, dim) for k, n in (("body", ids), ("qbody", qids)))
    return ids, c, qids, q


def _rows(batches):
    """Candidate and query blocks that meet, one pair at a time, the queries some at a time: ``(row, part of queries, ids, c, qids, q, norms)``."""
    for batch in batches:
        for k in range(batch.num_rows):
            row = {n: batch.column(n)[k].as_py() for n in batch.schema.names}
            ids, c, qids, q = _arrays(row)
            longest = _norm(c)
            for a in range(0, len(qids), SCORED):
                at = slice(a, a + SCORED)
                yield row, at, ids, c, qids[at], q[at], longest * _norm(q[at])


def _heads(met: DataFrame, k: int, lists: int) -> DataFrame:
    """Phase 1: ``query_id, score`` of candidates seen at the head of some list, the k best of a task's blocks."""
    none = np.iinfo(np.int64).min

    def run(batches):
        best: dict = {}  # by queries: their ids, their k best sums so far, how many there are
        for row, at, ids, c, qids, q, norms in _rows(batches):
            partial = _lists(q, c, lists, norms)
            n = min(k + 1, len(ids))  # one more: the query's own row may be among them
            seen = np.zeros((len(qids), len(ids)), bool)
            for p in partial:  # the head of each list, and what equals its last entry
                seen |= (p >= np.partition(p, len(ids) - n, axis=1)[:, len(ids) - n, None]).astype(bool)
            i, j = np.nonzero(seen)
            fit = ids[j] != qids[i]
            i, j = i[fit], j[fit]
            sums = sum((p[i, j] for p in partial[1:]), partial[0][i, j])
            use = _best(i, sums, ids[j], k)
            i, sums = i[use], _longs(sums[use])
            score = np.full((len(qids), k), none)
            score[i, np.arange(len(i)) - np.searchsorted(i, i)] = sums
            key = row["dim"], at.start, row["qids"]
            _, before, count = best.get(key, (0, np.empty((len(qids), 0), np.int64), 0))
            score = np.sort(np.concatenate([before, score], axis=1), axis=1)[:, ::-1][:, :k]
            best[key] = qids.copy(), score.copy(), np.minimum(count + np.bincount(i, minlength=len(qids)), k)
        for qids, score, count in best.values():
            use = np.arange(score.shape[1]) < count[:, None]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qids, use.sum(axis=1))), pa.array(score[use])], ["query_id", "score"])

    return met.mapInArrow(run, "query_id long, score long")


def _best(query: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of each query's k best entries."""
    if score.dtype == object:
        by = np.array(sorted(range(len(ids)), key=lambda i: (query[i], -score[i], ids[i])), np.int64)
    else:
        by = np.lexsort((ids, -score, query))
    own = query[by]
    return by[np.arange(len(by)) - np.searchsorted(own, own) < k]


def _resolved(met: DataFrame, k: int, lists: int) -> DataFrame:
    """Phases 2 and 3: ``query_id, vec_id, score`` at or above the query's cutoff."""

    def run(batches):
        for row, at, ids, c, qids, q, norms in _rows(batches):
            cutoff = np.frombuffer(row["cutoffs"], dtype="<i8")[at]
            partial = _lists(q, c, lists, norms)
            kind = partial[0].dtype  # bounds beyond what its floats hold are beyond all sums too
            least = np.array([-(-t // len(partial)) for t in cutoff.tolist()], object).astype(kind)[:, None]  # the uniform threshold, rounded up
            enough = np.zeros((len(qids), len(ids)), bool)
            for p in partial:
                enough |= (p >= least).astype(bool)
            i, j = np.nonzero(enough)
            score = sum((p[i, j] for p in partial[1:]), partial[0][i, j])
            keep = np.flatnonzero((score >= cutoff.astype(kind)[i]).astype(bool) & (ids[j] != qids[i]))
            keep = keep[_best(i[keep], score[keep], ids[j[keep]], k)]
            yield pa.RecordBatch.from_arrays([pa.array(qids[i[keep]]), pa.array(ids[j[keep]]), pa.array(_longs(score[keep]))],
                                             ["query_id", "vec_id", "score"])

    return met.mapInArrow(run, "query_id long, vec_id long, score long")


def _groups(spark, candidates: DataFrame, queries: DataFrame) -> int:
    """Groups of candidate blocks; the queries are copied once a group."""
    blocks, rows = candidates.agg(F.count(F.lit(1)), F.sum(F.length("ids") / 8)).first()
    copies = int(rows or 0) // max(1, queries.count())
    return max(1, min(parts(spark), blocks, max(copies, 4 * spark.sparkContext.defaultParallelism)))


def search(vectors: DataFrame, k: int = 10, every: int = 100, lists: int = 4) -> DataFrame:
    """``query_id, rank, vec_id, score`` of every row whose id ``every`` divides."""
    spark = vectors.sparkSession
    ship(spark)
    whole = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v")).filter(
        F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    # Written, so that both phases see the same query rows.
    queries = written(whole.filter(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v")), "queries")
    candidates = written(_packed(whole, CANDIDATES), "candidate_blocks")
    groups = _groups(spark, candidates, queries)
    seen = _heads(_met(_packed(queries, QUERIES), candidates, groups), k, lists)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"))
    cutoffs = (seen.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k)
               .groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("cutoff")))
    known = (queries.join(cutoffs, F.col("id") == F.col("query_id"), "left")
             .select("id", "v", F.coalesce("cutoff", F.lit(-2 ** 63)).alias("cutoff")))
    found = _resolved(_met(_packed(known, QUERIES, cutoff=True), candidates, groups), k, lists)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

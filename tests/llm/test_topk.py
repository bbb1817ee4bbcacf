import math
import random
import struct

import numpy as np
import pytest

from millrun.llm import topk
from millrun.llm.queries import op5_topk

SCHEMA = "vec_id long, embedding array<float>, label int, score string, rank string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, "s", "r") for i, v in rows], SCHEMA)


def brute(rows, k=10, every=100):
    ok = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows
          if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, a in {i: v for i, v in ok if i % every == 0}.items():
        scores = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in ok if i != q and len(a) == len(b))
        out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])}
    return out


@pytest.mark.parametrize("block", [4096, 7])
def test_ties_repeats_and_bad_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "CANDIDATES", block)
    monkeypatch.setattr(topk, "QUERIES", 2)
    rng = random.Random(1)
    v = lambda n=6: [round(rng.gauss(0, 1) * 8) / 8 for _ in range(n)]
    hot = v()
    rows = [(i, hot if i % 3 == 0 else v()) for i in range(120)]
    rows += [(200, None), (300, []), (400, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (500, [math.nan] * 6), (600, [math.inf] + [0.0] * 5),
             (None, v()), (700, v(3)), (701, v(3)), (800, [0.0] * 6), (5, rows[5][1])]
    got = {tuple(r) for r in topk.search(table(spark, rows), k=10).collect()}
    assert got == brute(rows)


def test_smallest_vector_of_an_id_is_the_query(spark):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(60)]
    rows += [(q, [rng.gauss(0, 3) for _ in range(6)]) for q in range(0, 1000, 100) for _ in range(3)]
    rows = [(i, struct.unpack("6f", struct.pack("6f", *v))) for i, v in rows]
    rows.sort(key=lambda r: r[1], reverse=True)  # brute() takes the last row of an id
    got = [tuple(r) for r in topk.search(table(spark, [(i, list(v)) for i, v in rows])).collect()]
    assert len(got) == 100 and set(got) == brute(rows)


def test_few_candidates_and_empty(spark):
    assert topk.search(table(spark, [])).count() == 0
    rows = [(0, [1.0, 2.0]), (1, [3.0, -1.0])]
    assert {tuple(r) for r in topk.search(table(spark, rows)).collect()} == brute(rows)


def test_large_components(spark):
    rows = [(0, [3e4, 1e30]), (1, [1e6, 0.0]), (2, [-1e6, 3.0]), (100, [1.0, 0.0])]
    got = {tuple(r) for r in topk.search(table(spark, rows)).collect()}
    assert {(q, r, i) for q, r, i, _ in got} == {(q, r, i) for q, r, i, _ in
                                                 brute([(i, [float(__import__("numpy").float32(x)) for x in v]) for i, v in rows])}


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert {tuple(r) for r in op5_topk(spark, sf).collect()} == brute(rows)


def test_queries_are_not_copied_for_every_shuffle_partition(spark):
    """Few candidates a query: no more groups than keep the cores busy; the query side is never broadcast."""
    rows = spark.range(4000).selectExpr("cast(cast(id as string) as binary) as ids")
    queries = spark.range(1000)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 3000)
    try:
        assert topk._groups(spark, rows, queries) == 4 * spark.sparkContext.defaultParallelism
        q = spark.createDataFrame([(2, b"q", b"v")], "dim int, ids binary, body binary")
        c = spark.createDataFrame([(2, 1, b"c", b"v")], "dim int, block long, ids binary, body binary")
        assert "Broadcast" not in topk._met(q, c, 3)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_a_task_sends_its_best_sums_once(spark, monkeypatch):
    """Phase 1 sends k sums a query and task, whatever the number of candidate blocks."""
    monkeypatch.setattr(topk, "CANDIDATES", 10)
    rng = random.Random(6)
    df = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(400)], "id long, v array<double>").coalesce(1)
    blocks = topk._packed(df, 10)
    queries = topk._packed(df.filter("id < 5"), topk.QUERIES)
    met = topk._met(queries, blocks, 1).coalesce(1)
    assert met.count() == 40 and topk._heads(met, 10, 4).count() == 50


def test_sums_are_exact_in_any_float():
    rng = np.random.default_rng(8)
    for size in (2 ** 8, 2 ** 13, 2 ** 30, 2 ** 60):
        q, c = (np.floor(rng.normal(0, size, (5, 12))) for _ in range(2))
        q, c = (np.frombuffer(b, f"<f{len(b) // 60}").reshape(5, 12) for b in (topk._bytes(q), topk._bytes(c)))
        got = sum(topk._lists(q, c, 4, topk._norm(q) * topk._norm(c)))
        assert [[int(x) for x in r] for r in got] == [[sum(int(x) * int(y) for x, y in zip(a, b)) for b in c] for a in q]

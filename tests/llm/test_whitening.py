import math
import random
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from millrun.llm import whitening
from millrun.llm.queries import op12_whitening

SCHEMA = "vec_id long, embedding array<float>, x string, component int, n string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, "s", 1, "r") for i, v in rows], SCHEMA)


def brute(rows, k=16, scale=64, shift=1_000_000):
    """``(n, deviations, whitened rows up to sign, explained)`` by exact sums and a dense eigenvalue routine."""
    ok = [(i, [math.floor(scale * float(np.float32(c))) + shift for c in v]) for i, v in rows
          if v and all(c is not None and math.isfinite(c) for c in v)]
    d = max(Counter(len(x) for _, x in ok).items(), key=lambda c: (c[1], c[0]))[0]
    ok = [(i, x) for i, x in ok if len(x) == d]
    fitted = sorted({tuple(x) for _, x in ok})
    n, sums = len(fitted), [sum(c) for c in zip(*fitted)]
    rest = [[n * c - s for c, s in zip(x, sums)] for x in fitted]
    v = np.array([[float(Fraction(sum(r[i] * r[j] for r in rest), n ** 3)) for j in range(d)] for i in range(d)])
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    out = []
    for i, x in ok:
        r = [n * c - s for c, s in zip(x, sums)]
        w = np.array([c / n for c in r]) @ u / np.sqrt(np.maximum(e, 1e-300))
        out += [(i, j + 1, n, sum(c * c for c in r), w[j], e[j] / np.trace(v)) for j in range(len(e))]
    return out


def check(got, rows, k=16, near=1e-7):
    want = brute(rows, k)
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], r[2], r[3], round(abs(r[4]), 6))
    got, want = sorted((tuple(r) for r in got), key=key), sorted(want, key=key)
    assert [r[:4] for r in got] == [r[:4] for r in want]
    assert max(abs(abs(g[4]) - abs(w[4])) for g, w in zip(got, want)) < near
    assert max(abs(g[5] / w[5] - 1) for g, w in zip(got, want)) < 1e-9
    assert len({r[6] for r in got}) == 1 and got[0][6] < 1e-9
    signs = {}
    for g in got:
        signs.setdefault((g[0], g[3]), {})[g[1]] = g[4]
    return signs


def vectors(seed, n, d):
    rng = np.random.default_rng(seed)
    return [[float(c) for c in v] for v in (rng.standard_normal((n, d)) * np.linspace(3, 0.5, d)).astype(np.float32)]


def test_repeats_and_bad_vectors(spark):
    some = vectors(1, 90, 20)
    rows = list(enumerate(some)) + [(200 + i, some[0]) for i in range(60)] + [
        (3, some[3]), (None, some[4]), (None, some[5]), (300, None), (301, []), (302, [None] * 20), (303, [math.nan] * 20),
        (304, [math.inf] + [0.0] * 19), (305, [1.0] * 19), (306, [-1e-9] * 20)]
    check(whitening.whitened(table(spark, rows)).collect(), rows)


def test_small_dimension_and_large_entries(spark):
    """Fewer components than asked for; sums far beyond 64 bits."""
    rng = random.Random(2)
    rows = [(i, [rng.choice([-1, 1]) * 2.0 ** rng.randrange(40), float(rng.randrange(2 ** 20)), rng.random()]) for i in range(40)]
    got = whitening.whitened(table(spark, rows)).collect()
    assert {r.component for r in got} <= {1, 2, 3}
    want = {(i, j): (n, far) for i, j, n, far, _, _ in brute(rows)}
    assert all((r.n, int(r.deviation)) == want[r.vec_id, r.component] for r in got)
    huge = [(i, [2.0 ** (50 + i % 4), float(i % 2)]) for i in range(8)]
    got = whitening.whitened(table(spark, huge)).collect()
    assert got and all((r.n, int(r.deviation)) == {(a, b): (n, f) for a, b, n, f, _, _ in brute(huge)}[r.vec_id, 1] for r in got)


def test_nothing_to_fit(spark):
    assert whitening.whitened(table(spark, [])).count() == 0
    assert whitening.whitened(table(spark, [(1, None), (2, [])])).count() == 0
    assert whitening.whitened(table(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0


def test_low_rank(spark):
    """Constant and repeated dimensions have no component of their own."""
    rng = random.Random(3)
    rows = [(i, [(a := rng.randrange(100) / 64), a, 5.0, rng.randrange(100) / 64]) for i in range(50)]
    got = whitening.whitened(table(spark, rows)).collect()
    assert {r.component for r in got} == {1, 2} and got[0].identity_error < 1e-9


def test_sums_do_not_depend_on_the_partitions(spark):
    rows = list(enumerate(vectors(4, 70, 17)))
    one = {tuple(r)[:6] for r in whitening.whitened(table(spark, rows).coalesce(1)).collect()}
    assert one == {tuple(r)[:6] for r in whitening.whitened(table(spark, rows).repartition(7)).collect()}


@pytest.mark.parametrize("d", [1, 2, 7, 40])
@pytest.mark.parametrize("kind", ["plain", "equal", "low", "diagonal", "near"])
def test_leading(d, kind):
    """Eigenvalues, residuals and orthogonality on spectra with equal, near and vanishing values."""
    rng = np.random.default_rng(d)
    q, _ = np.linalg.qr(rng.standard_normal((d, d)))
    e = {"plain": rng.random(d) + 0.1, "equal": np.r_[np.repeat(7.0, min(3, d)), np.ones(d - min(3, d))],
         "low": np.r_[rng.random(max(1, d // 3)) + 1, np.zeros(d - max(1, d // 3))], "diagonal": rng.integers(1, 4, d).astype(float),
         "near": 1 + np.arange(d) * 1e-9}[kind]
    v = np.diag(e) if kind == "diagonal" else (q * e) @ q.T
    v = (v + v.T) / 2
    values, vecs = whitening.leading(v, 16)
    want = np.sort(e[e > 0])[::-1][:16]
    assert len(values) == len(want) and np.abs(values - want).max() < 1e-12 * e.max()
    assert np.abs(v @ vecs.T - vecs.T * values).max() < 1e-12 * e.max()
    assert np.abs(vecs @ vecs.T - np.eye(len(values))).max() < 1e-9
    shift = 0.7 * e.max() + 0.01
    assert whitening.inertia(v - shift * np.eye(d)) == ((e > shift).sum(), (e < shift).sum())


def test_products_are_exact():
    rng = np.random.default_rng(5)
    y = rng.integers(-2 ** 59, 2 ** 59, (50, 3))
    want = [[sum(int(a) * int(b) for a, b in zip(y[:, i], y[:, j])) for j in range(3)] for i in range(3)]
    assert whitening.products(y).tolist() == want


def test_query(spark):
    got = op12_whitening(spark, "/root/testdata/sf0.001")
    assert dict(got.dtypes)["deviation"] == "bigint"
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "embedding").collect()]
    check(got.select("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error").collect(), rows)

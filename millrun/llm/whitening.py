"""Embedding whitening (operator 12): leading components by spectrum slicing.

A component c of a vector becomes the integer ``floor(scale * c) + shift``, so
that counts, sums and second moments are exact whatever the order of summation:
every task sums the products of rows centred on the rounded mean, as integers
(in limbs of 16 bits, where a product of doubles would round), and the driver
subtracts the exact rest of the centring. The covariance is then rounded once.
It is fitted on the distinct vectors.

The leading eigenpairs of the covariance V come from slicing its spectrum:

1. The number of eigenvalues above s is the number of positive pivots of the LDL'
   factors of V - sI (Sylvester's law of inertia; pivoting by Bunch and Kaufman).
   Bisection by such counts isolates the k-th largest eigenvalue in an interval.
2. Rayleigh quotient iteration converges cubically from there. A result outside the
   interval, or one that repeats a known component, is refused and the
   interval halved again.
3. Eigenvalues that no double separates stay in one interval; their vectors are found
   one by one, orthogonal to each other.
4. Counts on both sides of every eigenvalue certify its number.

Only d x d sums reach the driver, d being the vectors' dimension.

Defined cases: null and empty vectors, those with null or non-finite entries, and
those with an entry whose integer exceeds 2**60, take no part. Vectors of another
length than most have (the longer at a tie) take no part. Repeated rows and rows
with a null id are whitened each; equal vectors count once in the fit. Components
whose eigenvalue is lost in rounding (below ``d * 2**-52`` of the largest) can't be
whitened and are left out; with one distinct vector, or none, there is no row.
Extra columns are ignored.
"""

from __future__ import annotations

import decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrun.llm.common import ship, written

#: Largest integer entry; rows whose products are summed at once.
LARGEST, ROWS = 1 << 60, 4096
#: Halvings after which eigenvalues in one interval count as equal.
HALVINGS = 60
#: Eigenvalues nearer than this share of the largest have their vectors made orthogonal explicitly.
CLOSE = 1e-4


# ---- exact sums -------------------------------------------------------------------

def _limbs(y: np.ndarray) -> list[np.ndarray]:
    """``y`` as signed limbs of 16 bits, the lowest first; few rows' products of them are exact doubles."""
    out = []
    while not out or y.any():
        low = ((y + (1 << 15)) & 0xFFFF) - (1 << 15)
        out.append(low.astype(np.float64))
        y = (y - low) >> 16
    return out


def products(y: np.ndarray) -> np.ndarray:
    """Exact ``y' y`` of integers, as Python integers."""
    total = np.zeros((y.shape[1], y.shape[1]), dtype=object)
    for a in range(0, len(y), ROWS):
        limbs = _limbs(y[a:a + ROWS])
        for i, p in enumerate(limbs):
            for j, q in enumerate(limbs):
                total = total + ((p.T @ q).astype(np.int64).astype(object) << (16 * (i + j)))
    return total


def _matrix(column: pa.ListArray) -> np.ndarray:
    """Rows of a list column of equal lengths."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0), flat.dtype)


def _summed(vectors: DataFrame, values, d: int) -> list[int]:
    """Sums over all rows of the integers that ``values(x)`` gives for a batch, exact at any size."""

    def run(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                part = values(_matrix(batch.column(0)))
                total = part if total is None else total + part
        if total is not None:
            # base 10**12 digits, so that sums of partial sums stay exact decimals
            at, level, digit = [], [], []
            for i, v in enumerate(total.tolist()):
                sign, v, k = (-1 if v < 0 else 1), abs(v), 0
                while v or not k:
                    at.append(i)
                    level.append(k)
                    digit.append(sign * (v % 10**12))
                    v //= 10**12
                    k += 1
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(level, pa.int32()), pa.array(digit, pa.int64())],
                                             ["at", "level", "digit"])

    got = vectors.select("x").mapInArrow(run, "at int, level int, digit long").groupBy("at", "level").agg(
        F.sum(F.col("digit").cast("decimal(38,0)")).alias("digit")).collect()  # a few rows per entry of a d x d matrix
    out = [0] * d
    for r in got:
        out[r["at"]] += int(r["digit"]) * 10 ** (12 * r["level"])
    return out


# ---- spectrum slicing ---------------------------------------------------------------

def inertia(a: np.ndarray) -> tuple[int, int]:
    """Positive and negative pivots of the LDL' factors of a symmetric matrix (Bunch and Kaufman)."""
    a = a.copy()
    bound, above, below, n = (1 + 17 ** 0.5) / 8, 0, 0, len(a)
    k = 0
    while k < n:
        size = 1
        column = np.abs(a[k + 1:, k])
        if len(column) and column.max() > 0:
            r = k + 1 + int(column.argmax())
            largest = column[r - k - 1]
            if abs(a[k, k]) < bound * largest:
                row = np.abs(a[r, k:])
                row[r - k] = 0
                other = row.max()
                if abs(a[k, k]) * other >= bound * largest * largest:
                    r = k
                elif abs(a[r, r]) < bound * other:
                    size = 2
            else:
                r = k
            swap = k + size - 1
            if r != swap:
                a[[swap, r]] = a[[r, swap]]
                a[:, [swap, r]] = a[:, [r, swap]]
        if size == 1:
            pivot = a[k, k]
            above, below = above + (pivot > 0), below + (pivot < 0)
            if pivot:
                a[k + 1:, k + 1:] -= np.outer(a[k + 1:, k] / pivot, a[k, k + 1:])
        else:  # a 2 x 2 pivot of this rule has one positive and one negative eigenvalue
            above, below = above + 1, below + 1
            a[k + 2:, k + 2:] -= a[k + 2:, k:k + 2] @ np.linalg.solve(a[k:k + 2, k:k + 2], a[k:k + 2, k + 2:])
        k += size
    return int(above), int(below)


def _solve(v: np.ndarray, shift: float, b: np.ndarray, scale: float) -> np.ndarray:
    """A unit vector along ``(v - shift)^-1 b``; a shift that is an eigenvalue is moved by a rounding."""
    eye = np.eye(len(v))
    for step in range(8):
        try:
            x = np.linalg.solve(v - (shift + step * np.spacing(scale)) * eye, b)
        except np.linalg.LinAlgError:
            continue
        if np.isfinite(x).all() and x.any():
            return x / np.linalg.norm(x / np.abs(x).max()) / np.abs(x).max()
    return b


def _refined(v: np.ndarray, shift: float, known: np.ndarray, start: np.ndarray, scale: float) -> tuple[float, np.ndarray]:
    """Inverse iteration, then Rayleigh quotient iteration, orthogonal to the rows ``known``."""

    def apart(x):
        for _ in range(2):
            x = x - known.T @ (known @ x)
        return x / max(np.linalg.norm(x), 1e-300)

    x = apart(start)
    for _ in range(3):
        x = apart(_solve(v, shift, x, scale))
    best = (np.inf, shift, x)
    for _ in range(12):
        rho = float(x @ v @ x)
        rest = float(np.linalg.norm(v @ x - rho * x))
        if rest < best[0]:
            best = (rest, rho, x)
        elif rest >= best[0] and best[0] < 1e-10 * scale:
            break  # cubic convergence has come to the last digits
        x = apart(_solve(v, rho, x, scale))
    return best[1], best[2]


def leading(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues of a symmetric positive matrix, falling, and unit eigenvectors as rows.

    Those lost in rounding are left out."""
    n = len(v)
    scale = float(np.abs(v).sum(axis=1).max()) if n else 0.0
    if not scale:
        return np.zeros(0), np.zeros((0, n))
    eye, floor = np.eye(n), n * 2.0 ** -52 * scale
    counts: dict[float, int] = {}

    def over(s: float) -> int:
        """Eigenvalues above s."""
        if s not in counts:
            counts[s] = inertia(v - s * eye)[0]
        return counts[s]

    starts = np.random.default_rng(1).standard_normal((k + 1, n))  # a fixed start, in general position
    values, vectors = [], np.zeros((0, n))
    top = scale * (1 + 1e-9)
    for j in range(1, min(k, n) + 1):
        low, high = floor, top
        if over(low) < j:
            break
        for s, c in counts.items():  # what is known already
            if c >= j:
                low = max(low, s)
            elif s >= low:
                high = min(high, s)
        found = None
        for halving in range(HALVINGS):
            alone = over(low) == j and over(high) == j - 1
            if alone or high - low < 4 * np.spacing(scale):
                near = vectors[np.abs(np.array(values) - (low + high) / 2) < CLOSE * scale] if values else vectors
                rho, x = _refined(v, (low + high) / 2, near, starts[j], scale)
                inside = low - 2 * np.spacing(scale) <= rho <= high + 2 * np.spacing(scale)
                if inside and (not len(vectors) or np.abs(vectors @ x).max() < 0.5):
                    found = rho, x
                    break
            middle = (low + high) / 2
            if not low < middle < high:
                break
            if over(middle) >= j:
                low = middle
            else:
                high = middle
        if found is None:
            found = _refined(v, (low + high) / 2, vectors, starts[j], scale)
        values.append(found[0])
        vectors = np.vstack([vectors, found[1]])
    values = np.array(values)
    order = np.argsort(-values, kind="stable")
    values, vectors = values[order], vectors[order]
    slack = 64 * n * np.spacing(scale)
    for j, e in enumerate(values):  # j eigenvalues at most are larger, and j + 1 at least as large
        if over(e + slack) > j or over(e - slack) < j + 1:
            raise ArithmeticError(f"eigenvalue {j + 1} is not certified by its counts")
    keep = values > n * 2.0 ** -52 * values.max() if len(values) else np.zeros(0, bool)
    return values[keep], vectors[keep]


# ---- the operator ---------------------------------------------------------------------

def _integers(embedding: Column, scale: int, shift: int) -> Column:
    return F.transform(embedding, lambda c: F.floor(c.cast("double") * scale).cast("long") + shift)


def _usable(embeddings: DataFrame, scale: int, shift: int) -> tuple[DataFrame, int]:
    """``vec_id, x`` of the rows that take part, and their length (0: no such row)."""
    good = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall(
        "embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) * scale <= LARGEST))
    rows = embeddings.select("vec_id", "embedding").filter(good)
    lengths = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = lengths["d"] if lengths else 0
    return rows.filter(F.size("embedding") == d).select("vec_id", _integers(F.col("embedding"), scale, shift).alias("x")), d


class Whitening:
    """A fitted whitening: counts and sums of the fit list, its leading components, and the check of the result."""

    def __init__(self, n: int, sums: list[int], values: np.ndarray, vectors: np.ndarray, trace: float):
        self.n, self.sums, self.values, self.vectors, self.trace = n, sums, values, vectors, trace
        self.identity_error = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        """``n * x - sums``, exact; as 64-bit integers where they fit."""
        bound = (int(np.abs(x).max()) if x.size else 0) * self.n + max(map(abs, self.sums), default=0)
        kind = np.int64 if bound < 2 ** 62 else object
        return x.astype(kind) * self.n - np.array(self.sums, dtype=kind)

    def deviation(self, centred: np.ndarray) -> list[int]:
        if centred.dtype != object and (np.square(centred.astype(np.float64)).sum(axis=1) < 2 ** 62).all():
            return np.square(centred).sum(axis=1).tolist()
        return [sum(v * v for v in map(int, row)) for row in centred]

    def whitened(self, centred: np.ndarray) -> np.ndarray:
        # not by BLAS, whose rounding depends on the batch: equal vectors must give equal results
        return np.einsum("ij,kj->ik", (centred / self.n).astype(np.float64), self.vectors / np.sqrt(self.values)[:, None])


def fit(vectors: DataFrame, d: int, k: int) -> Whitening:
    """Whitening of the distinct vectors ``x`` (of length ``d``), a table that is read three times."""
    n = vectors.count()
    sums = _summed(vectors, lambda x: x.astype(object).sum(axis=0) if x.size and int(np.abs(x).max()) * len(x) >= 2 ** 62
                   else x.sum(axis=0).astype(object), d)
    mean = [(2 * s + n) // (2 * n) for s in sums] if n else sums  # the rounded mean
    at = np.array(mean, dtype=np.int64)
    second = _summed(vectors, lambda x: products(x - at).ravel(), d * d)
    rest = [s - n * m for s, m in zip(sums, mean)]  # what the rounding of the mean left
    v = np.array([[float(Fraction(second[i * d + j] * n - rest[i] * rest[j], n * n)) for j in range(d)] for i in range(d)]) if n else np.zeros((0, 0))
    trace = float(sum((Fraction(second[i * d + i] * n - rest[i] ** 2, n * n) for i in range(d)), Fraction(0))) if n else 0.0
    values, components = leading(v, k)
    model = Whitening(n, sums, values, components, trace)
    if len(values):
        model.identity_error = _identity_error(vectors, model)
    return model


def _identity_error(vectors: DataFrame, model: Whitening) -> float:
    """Largest entry of the whitened fit list's covariance minus the identity."""
    k = len(model.values)
    shared = vectors.sparkSession.sparkContext.broadcast(model)  # d sums and k vectors of d numbers

    def run(batches):
        m = shared.value
        total = np.zeros((k, k + 1))
        for batch in batches:
            w = m.whitened(m.centred(_matrix(batch.column(0)))) if batch.num_rows else np.zeros((0, k))
            total += np.hstack([w.T @ w, w.sum(axis=0)[:, None]])
        yield pa.RecordBatch.from_arrays([pa.array(range(k * (k + 1)), pa.int32()), pa.array(total.ravel(), pa.float64())], ["at", "v"])

    got = vectors.select("x").mapInArrow(run, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()
    total = np.zeros(k * (k + 1))
    for r in got:
        total[r["at"]] = r["v"]
    total = total.reshape(k, k + 1) / model.n
    cov = total[:, :k] - np.outer(total[:, k], total[:, k])
    return float(np.abs(cov - np.eye(k)).max())


def whitened(embeddings: DataFrame, components: int = 16, scale: int = 64, shift: int = 1_000_000) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error``: a row per vector and component.

    ``deviation`` is a decimal of 38 digits, null where it has more."""
    spark = embeddings.sparkSession
    ship(spark)
    rows, d = _usable(embeddings, scale, shift)
    fitted = written(rows.select("x").distinct(), "distinct")
    model = fit(fitted, d, components)
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        k = len(m.values)
        for batch in batches:
            for a in range(0, batch.num_rows if k else 0, ROWS):
                part = batch.slice(a, ROWS)
                centred = m.centred(_matrix(part.column(1)))
                far = [decimal.Decimal(v) if abs(v) < 10 ** 38 else None for v in m.deviation(centred)]
                c, each = part.num_rows, np.repeat(np.arange(part.num_rows), k)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), c)),
                     pa.array(np.full(c * k, m.n, np.int64)), pa.array(far, pa.decimal128(38, 0)).take(pa.array(each)),
                     pa.array(m.whitened(centred).ravel()), pa.array(np.tile(m.values / m.trace, c)),
                     pa.array(np.full(c * k, m.identity_error))],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    kind = embeddings.schema["vec_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"vec_id {kind}, component int, n long, deviation decimal(38,0), whitened double, "
                                "explained double, identity_error double")

"""Language identification (operator 4): nearest of several centroids per language.

A text becomes a vector of hashed letter 2- and 3-grams over its UTF-8 bytes
(ASCII lower-cased, other ASCII symbols as spaces), weighted ``(1 + log tf) *
idf`` and normalised. Every language has ``CENTROIDS`` spherical k-means
centroids; the nearest by cosine gives the language and the score. A text
further from its centroid than nearly all of that language's training texts is
``rejected``.

Document frequencies are counted over all training rows; the centroids are
fitted on at most ``SAMPLE`` rows per language, those with the smallest hashes of
id and text. All texts are predicted whole.

Defined cases: a null text, or one without a letter (a character of the Unicode
letter categories), is ``und`` with score 0; without any training row every text
is ``und``; a null id counts as the empty text for the fold; rows that repeat id
and text are one row of the sample (and each counts in the frequencies); a language
whose sampled texts are all empty isn't learned; repeated rows are predicted each;
extra columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrun.llm.common import by_doc, remainder, ship, utf8, written
from millrun.operators.joins import checked_broadcast

#: Hashed dimensions, centroids and sampled training rows per language, k-means rounds.
DIMENSIONS, CENTROIDS, SAMPLE, ROUNDS = 4096, 4, 800, 8
#: How many times the sample's share of a language's hashes is looked at, and the error of their count.
SPARE, COUNT_ERROR = 2, 0.02
#: Share of a language's training texts within the rejection distance, and slack on it.
WITHIN, SLACK = 0.995, 0.1
#: Bytes of text turned into n-grams at once.
_STEP = 1 << 21

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_PLAIN = re.compile(r"[A-Za-z]")


def has_letter(text: str) -> bool:
    """Whether a character is of a letter category; numbers such as one half or roman eight aren't."""
    return _PLAIN.search(text) is not None or any(map(str.isalpha, text))


def counts(texts: list[bytes]) -> np.ndarray:
    """Hashed n-gram counts, one row per text."""
    out = np.zeros((len(texts), DIMENSIONS), dtype=np.float32)
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) <= _STEP) and j - i < 64:
            size += len(texts[j]) + 2
            j += 1
        # n-grams that start in the two spaces after a text go to a row that is dropped
        own = np.repeat(np.stack([np.arange(j - i), np.full(j - i, j - i)], 1).ravel(),
                        [n for t in texts[i:j] for n in (len(t), 2)])
        data = np.frombuffer(b"".join(t.translate(_FOLD) + b"  " for t in texts[i:j]) + b"  ", dtype=np.uint8)
        for a in range(0, len(own), _STEP):
            at = data[a:a + _STEP + 2].astype(np.uint32)
            two = (at[:-2] << 8 | at[1:-1])
            three = two << np.uint32(8) | at[2:]
            rows = own[a:a + _STEP][:len(two)] * DIMENSIONS
            for code in (two + np.uint32(1 << 24), three):
                h = (code * np.uint32(2654435761)) >> np.uint32(20)
                out[i:j] += np.bincount(rows + h, minlength=(j - i + 1) * DIMENSIONS).reshape(-1, DIMENSIONS)[:j - i]
        i = j
    return out


def weighted(tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.where(tf > 0, 1 + np.log(np.maximum(tf, 1)), 0).astype(np.float32) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def clustered(x: np.ndarray, k: int = CENTROIDS) -> tuple[np.ndarray, float]:
    """Spherical k-means from far-apart starts; centroids and the rejection distance."""
    centres = [x.mean(axis=0)]
    for _ in range(min(k, len(x)) - 1):
        centres.append(x[np.argmin(np.max(x @ np.array(centres).T, axis=1))])
    c = np.array(centres, dtype=np.float32)
    for _ in range(ROUNDS):
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
        near = np.argmax(x @ c.T, axis=1)
        c = np.array([x[near == i].mean(axis=0) if (near == i).any() else c[i] for i in range(len(c))])
    c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    far = 1 - np.max(x @ c.T, axis=1)
    return c.astype(np.float32), float(np.quantile(far, WITHIN) + SLACK)


def _training(docs: DataFrame, fold: int, mod: int) -> DataFrame:
    return docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()
                       & (remainder(F.col("doc_id"), mod) != fold)).select("doc_id", "lang", "text")


def _sample(rows: DataFrame) -> DataFrame:
    """``lang, h, body``: the ``SAMPLE`` rows of each language with the smallest hashes of id and text.

    Hashes are spread evenly, so a language's smallest ones lie below a bound that an
    approximate count of them gives; only rows below it, about ``SPARE * SAMPLE`` a
    language, are shuffled and ranked. Equal rows have equal hashes and count once."""
    keyed = rows.select("lang", F.xxhash64("doc_id", "text").alias("h"), "text")
    sizes = keyed.groupBy(F.col("lang").alias("as")).agg(F.approx_count_distinct("h", COUNT_ERROR).alias("n"))
    sizes = written(sizes, "languages")
    below = (F.col("h").cast("double") / 2.0 ** 64 + 0.5) * F.col("n") <= SPARE * SAMPLE
    near = keyed.join(checked_broadcast(sizes, 500_000), F.col("lang") == F.col("as")).filter(below)
    once = near.groupBy("lang", "h").agg(F.first("text").alias("text"))
    order = Window.partitionBy("lang").orderBy("h")
    kept = once.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= SAMPLE)
    return kept.select("lang", "h", utf8(F.col("text")).alias("body"))


def _idf(rows: DataFrame) -> np.ndarray:
    """Smoothed inverse document frequencies over every training row."""

    def run(batches):
        total, n = np.zeros(DIMENSIONS, np.int64), 0
        for batch in batches:
            for part in by_doc(batch):
                total += (counts(part.column(0).to_pylist()) > 0).sum(axis=0)
                n += part.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[np.arange(DIMENSIONS), -1], pa.int32()),
                                          pa.array(np.r_[total, n], pa.int64())], ["dim", "n"])

    got = rows.select(utf8(F.col("text"))).mapInArrow(run, "dim int, n long").groupBy("dim").agg(F.sum("n").alias("n"))
    n = {r["dim"]: r["n"] for r in got.collect()}  # DIMENSIONS rows
    df = np.array([n.get(i, 0) for i in range(DIMENSIONS)], dtype=np.float64)
    return (np.log((1 + n.get(-1, 0)) / (1 + df)) + 0.1).astype(np.float32)


class Model:
    """Centroids of all languages with their labels and rejection distances."""

    def __init__(self, idf: np.ndarray, langs: list[str], centroids: np.ndarray, limits: list[float]):
        self.idf, self.langs, self.centroids, self.limits = idf, langs, centroids, np.array(limits)

    def predict(self, texts: list[bytes]):
        """Language, score and rejection of each text."""
        if not self.langs:
            return ["und"] * len(texts), [0.0] * len(texts), [True] * len(texts)
        near = weighted(counts(texts), self.idf) @ self.centroids.T
        best = np.argmax(near, axis=1)
        score = np.clip(near[np.arange(len(texts)), best].astype(np.float64), 0, 1)
        return [self.langs[i] for i in best], score.tolist(), (1 - score > self.limits[best]).tolist()


def train(docs: DataFrame, fold: int = 1, mod: int = 3) -> Model:
    """Fit on the rows outside the held-out fold; one bounded task per language."""
    ship(docs.sparkSession)
    rows = _training(docs, fold, mod)
    idf = _idf(rows)
    sample = _sample(rows)

    def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        group = group.sort_by([("h", "ascending")])
        x = weighted(counts(group.column("body").to_pylist()), idf)
        x = x[np.linalg.norm(x, axis=1) > 0.5]
        fitted = [clustered(x)] if len(x) else []
        return pa.table({"lang": pa.array([key[0].as_py()] * len(fitted), pa.string()),
                         "centroids": pa.array([c.tobytes() for c, _ in fitted], pa.binary()),
                         "far": pa.array([far for _, far in fitted], pa.float64())})

    got = sample.groupBy("lang").applyInArrow(run, "lang string, centroids binary, far double").orderBy("lang").collect()
    langs, limits, parts = [], [], [np.zeros((0, DIMENSIONS), np.float32)]
    for r in got:
        c = np.frombuffer(bytes(r["centroids"]), dtype=np.float32).reshape(-1, DIMENSIONS)
        parts.append(c)
        langs += [r["lang"]] * len(c)
        limits += [r["far"]] * len(c)
    return Model(idf, langs, np.concatenate(parts), limits)


def predicted(docs: DataFrame, model: Model, fold: int = 1, mod: int = 3) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, rejected`` for every document row."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)  # CENTROIDS * DIMENSIONS floats per language

    def run(batches):
        for batch in batches:
            for part in by_doc(batch):
                texts = part.column(2).to_pylist()
                lang, score, rejected = shared.value.predict([(t or "").encode() for t in texts])
                for i, t in enumerate(texts):
                    if t is None or not has_letter(t):
                        lang[i], score[i], rejected[i] = "und", 0.0, True
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64()),
                     pa.array(rejected, pa.bool_())], ["doc_id", "held_out", "lang_pred", "score", "rejected"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", (remainder(F.col("doc_id"), mod) == fold).alias("held_out"),
                       F.col("text").cast("string").alias("text")).mapInArrow(
        run, f"doc_id {kind}, held_out boolean, lang_pred string, score double, rejected boolean")

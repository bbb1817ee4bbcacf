"""Toxicity (operator 9): multiple-instance learning with noisy-or.

A document is a bag of sentences. A sentence's probability is logistic in the
summed weights of its words, the document's is ``1 - prod(1 - p_sentence)``,
and the weights (of words and of runs of four bytes in them) are learned from document labels alone, by gradient descent on
the documents' log loss. The sentences that made a document toxic are those with
the highest probabilities, and ``sentences`` returns them.

The model is fitted on at most ``SAMPLE`` labelled rows: of the labelled ids those
with the smallest hashes, and of their rows those with the smallest hashes of id
and text. Which features it has is decided by a significance test alone. Every
document is scored over its whole text.

Defined cases: null and empty texts have no sentence and score 0; a null id
counts as the empty text for the fold and matches no label; rows with a null
label, or ids labelled both ways, teach nothing; rows that repeat id and text teach
once and are scored each; without any labelled row of each class, or where nothing
tells the classes apart, all scores are 0; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Container
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrun.llm.common import by_doc, remainder, ship, utf8

#: Labelled documents used for fitting, the least documents a feature is in, and the least
#: z value of the difference between its shares of toxic and of clean documents.
SAMPLE, MIN_DOCS, LEAST_Z = 6_000, 4, 4.0
#: Fixed gradient descent (Adam) settings.
STEPS, RATE, DECAY = 150, 0.1, 0.1
#: Words whose value a scorer remembers, and the bytes of the longest such word.
MAX_WORDS, MAX_KNOWN = 300_000, 64
BIAS = ""

#: ASCII lower case; sentence ends become new lines; other ASCII symbols become spaces.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else 10 if c in b".!?\n\r" else
              c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 or c == 39 else 32 for c in range(256))


def sentences_of(data: bytes) -> list[list[bytes]]:
    return [w for w in (s.split() for s in data.translate(_FOLD).split(b"\n")) if w]


def features_of(word: bytes, among: Container[bytes] | None = None) -> set[bytes]:
    """The word itself and its runs of four bytes, with marks for its start and end.

    A word of any length is read to its end (text without spaces is one word);
    with ``among``, only the features in it are held."""
    marked = b"^" + word + b"$"
    runs = (marked[i:i + 4] for i in range(len(marked) - 3))
    if among is None:
        return {b"=" + word, *runs}
    return {f for f in chain([b"=" + word], runs) if f in among}


def fit(texts: list[bytes], labels: np.ndarray) -> dict[str, float]:
    """Feature weights (and the bias under ``BIAS``) from bags of sentences.

    A word's value is the sum of its features' weights and a sentence's logit the
    bias plus the values of its different words, so inflected forms of an
    offending stem count even when a form was never seen."""
    bags = [[set(s) for s in sentences_of(t)] for t in texts]
    words: dict[bytes, int] = {}
    seen: tuple[dict[bytes, int], dict[bytes, int]] = ({}, {})
    for bag, label in zip(bags, labels):
        own = set().union(*bag) if bag else set()
        for w in own:
            words.setdefault(w, len(words))
        mine = seen[int(label)]
        for f in set().union(*map(features_of, own)):
            mine[f] = mine.get(f, 0) + 1
    bad, good = int(labels.sum()), int((~labels).sum())
    if not bad or not good:
        return {}

    def z_value(f: bytes) -> float:
        a, b = seen[1].get(f, 0), seen[0].get(f, 0)
        share = (a + b) / (bad + good)
        spread = math.sqrt(share * (1 - share) * (1 / bad + 1 / good))
        return (a / bad - b / good) / spread if spread and a + b >= MIN_DOCS else 0.0

    index = {f: i for i, f in enumerate(sorted(f for f in {**seen[0], **seen[1]} if abs(z_value(f)) >= LEAST_Z))}
    if not index:
        return {}
    pairs = [(i, index[f]) for w, i in words.items() for f in features_of(w, index)]
    of_word, feature = np.array(pairs, dtype=np.int32).T
    told_words = {w for w, i in words.items() if features_of(w, index)}
    in_use = [[words[w] for w in s if w in told_words] for bag in bags for s in bag]
    sizes = [len(s) for s in in_use]
    word = np.fromiter((w for s in in_use for w in s), np.int32, sum(sizes))
    sent = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    doc = np.repeat(np.arange(len(bags), dtype=np.int32), [len(bag) for bag in bags])
    y = labels
    theta = np.zeros(len(index) + 1)  # the last is the bias
    theta[-1] = -5.0
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        value = np.bincount(of_word, theta[feature], len(words))
        z = np.bincount(sent, value[word], len(doc)) + theta[-1]
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        clean = np.exp(np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-12)), len(bags)))
        slope = p * np.where(y[doc], -clean[doc] / np.maximum(1 - clean[doc], 1e-6), 1.0) / len(bags)
        g_value = np.bincount(word, slope[sent], len(words))
        g = np.append(np.bincount(feature, g_value[of_word], len(index)), slope.sum())
        g[:-1] += DECAY * theta[:-1] / len(bags)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta -= RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
    out = {f.decode("latin-1"): float(theta[i]) for f, i in index.items()}
    return {BIAS: float(theta[-1]), **out}


def training_rows(docs: DataFrame, labels: DataFrame, fold: int = 2, mod: int = 4) -> DataFrame:
    """``h, body, toxic`` of at most ``SAMPLE`` rows of labelled documents outside the held-out fold."""
    known = (labels.filter(F.col("toxic").isNotNull() & (remainder(F.col("doc_id"), mod) != fold))
             .groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most"))
             .filter(F.col("toxic") == F.col("most")).select(F.col("doc_id").alias("id"), "toxic"))
    some = F.broadcast(known.orderBy(F.xxhash64("id"), "id").limit(SAMPLE))
    rows = docs.select("doc_id", "text").join(some, F.col("doc_id") == F.col("id")).select(
        F.xxhash64("doc_id", "text").alias("h"), "text", "toxic")
    once = rows.groupBy("h").agg(F.first("text").alias("text"), F.first("toxic").alias("toxic"))
    return once.orderBy("h").limit(SAMPLE).select("h", utf8(F.col("text")).alias("body"), "toxic")


def train(docs: DataFrame, labels: DataFrame, fold: int = 2, mod: int = 4) -> dict[str, float]:
    """Fit in one task on the bounded sample; only the feature weights reach the driver."""
    ship(docs.sparkSession)

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("h", "ascending")])
        model = fit(rows.column("body").to_pylist(), np.array(rows.column("toxic").to_pylist(), dtype=np.int64) == 1)
        return pa.table({"word": pa.array(list(model), pa.string()), "weight": pa.array(list(model.values()), pa.float64())})

    rows = training_rows(docs, labels, fold, mod)
    got = rows.withColumn("task", F.lit(0)).groupBy("task").applyInArrow(run, "word string, weight double").collect()
    return {r["word"]: r["weight"] for r in got}


class Scorer:
    """Noisy-or over sentences with learned feature weights."""

    def __init__(self, model: dict[str, float]):
        self.empty = not model
        self.bias = model.get(BIAS, 0.0)
        self.weight = {f.encode("latin-1"): x for f, x in model.items() if f != BIAS}
        self.value: dict[bytes, float] = {}

    def _value(self, word: bytes) -> float:
        if len(word) > MAX_KNOWN:
            return sum(self.weight[f] for f in features_of(word, self.weight))
        if len(self.value) > MAX_WORDS:
            self.value.clear()
        x = self.value[word] = sum(self.weight.get(f, 0.0) for f in features_of(word))
        return x

    def sentence_scores(self, data: bytes) -> list[float]:
        known, out = self.value, []
        for s in [] if self.empty else sentences_of(data):
            z = self.bias
            for w in set(s):
                x = known.get(w)
                z += self._value(w) if x is None else x
            out.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
        return out

    def score(self, data: bytes) -> float:
        return noisy_or(self.sentence_scores(data))


def noisy_or(p: list[float]) -> float:
    return 1.0 - math.exp(sum(math.log1p(-min(x, 1 - 1e-12)) for x in p))


def scored(docs: DataFrame, model: dict[str, float], threshold: float = 0.3, fold: int = 2, mod: int = 4) -> DataFrame:
    """``doc_id, held_out, score, predicted, worst_sentence`` for every document row."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)  # features of SAMPLE rows

    def run(batches):
        scorer = Scorer(shared.value)
        for batch in batches:
            for part in by_doc(batch):
                score, worst = [], []
                for data in part.column(2).to_pylist():
                    each = scorer.sentence_scores(data)
                    score.append(noisy_or(each))
                    worst.append(max(range(len(each)), key=each.__getitem__) if each else None)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(score, pa.float64()),
                     pa.array([int(s >= threshold) for s in score], pa.int32()), pa.array(worst, pa.int32())],
                    ["doc_id", "held_out", "score", "predicted", "worst_sentence"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", (remainder(F.col("doc_id"), mod) == fold).alias("held_out"),
                       utf8(F.col("text")).alias("body")).mapInArrow(
        run, f"doc_id {kind}, held_out boolean, score double, predicted int, worst_sentence int")


def sentences(docs: DataFrame, model: dict[str, float], threshold: float = 0.3) -> DataFrame:
    """``doc_id, sentence, p, words``: the offending sentences of every document."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        scorer = Scorer(shared.value)
        for batch in batches:
            for part in by_doc(batch):
                own, n, p, text = [], [], [], []
                for k, data in enumerate(part.column(1).to_pylist()):
                    for j, (s, x) in enumerate(zip(sentences_of(data), scorer.sentence_scores(data))):
                        if x >= threshold:
                            own.append(k)
                            n.append(j)
                            p.append(x)
                            text.append(b" ".join(s).decode("utf-8", "replace"))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(own, pa.int64())), pa.array(n, pa.int32()),
                     pa.array(p, pa.float64()), pa.array(text, pa.string())], ["doc_id", "sentence", "p", "words"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", utf8(F.col("text")).alias("body")).mapInArrow(
        run, f"doc_id {kind}, sentence int, p double, words string")


def not_toxic(docs: DataFrame, model: dict[str, float], threshold: float = 0.3) -> DataFrame:
    """The documents (all their columns) that the model does not reject."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        scorer = Scorer(shared.value)
        for batch in batches:
            for part in by_doc(batch):
                keep = [scorer.score((t or "").encode()) < threshold for t in part.column(at).to_pylist()]
                yield part.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)

import math
import random
import zlib

import numpy as np
import pytest

from millrun.llm import toxicity
from millrun.llm.queries import op9_toxicity
from tests.llm.helpers import AWKWARD, docs


def corpus(n=400):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(60)]
    rows, labels = [], []
    for i in range(n):
        s = [" ".join(rng.choices(vocab, k=8)) for _ in range(6)]
        bad = i % 5 == 0
        if bad:
            s[rng.randrange(6)] += rng.choice([" idiot", " scum"])
        rows.append((i, ". ".join(s) + "."))
        labels.append((i, None, int(bad)))
    return rows, labels


def test_learns_and_locates(spark):
    rows, labels = corpus()
    df = docs(spark, rows)
    model = toxicity.train(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    out = {r.doc_id: r for r in toxicity.scored(df, model).collect()}
    assert len(out) == len(rows)
    for i, (_, text) in enumerate(rows):
        assert out[i].predicted == labels[i][2]
        assert out[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
        if labels[i][2]:
            words = toxicity.sentences_of(text.encode())[out[i].worst_sentence]
            assert b"idiot" in words or b"scum" in words
    found = {r.doc_id for r in toxicity.sentences(df, model).collect()}
    assert found == {i for i, _, bad in labels if bad}
    kept = toxicity.not_toxic(df, model)
    assert kept.schema == df.schema and kept.count() == sum(1 - x[2] for x in labels)


def test_noisy_or_is_the_product(spark):
    model = {toxicity.BIAS: -2.0, "=bad": 2.0, "^bad": 1.0, "=good": -1.0}
    s = toxicity.Scorer(model)
    p = [1 / (1 + math.exp(2)), 1 / (1 + math.exp(-1)), 1 / (1 + math.exp(3))]
    assert math.isclose(s.score(b"Plain words. BAD bad word! good one"), 1 - math.prod(1 - x for x in p))


def brute_value(model, word):
    marked = b"^" + word + b"$"
    runs = {b"=" + word} | {marked[i:i + 4] for i in range(len(marked)) if len(marked[i:i + 4]) == 4}
    return sum(w for f, w in model.items() if f != toxicity.BIAS and f.encode("latin-1") in runs)


def test_long_words_count_whole():
    """Runs after byte 64 of a word, its true end included, in scoring."""
    stem = "畜生".encode()
    model = {toxicity.BIAS: -5.0, stem[:4].decode("latin-1"): 3.0, stem[1:5].decode("latin-1"): 4.0, "ine$": 2.0, "^fil": 1.0}
    s = toxicity.Scorer(model)
    for word in [b"fil" + b"x" * 61, b"fil" + b"x" * 62, b"fil" + b"x" * 90 + b"ine", "天気".encode() * 40 + stem + "空".encode() * 9,
                 stem + "海".encode() * 5_000 + stem, "海".encode() * 60]:
        want = 1 / (1 + math.exp(5.0 - brute_value(model, word)))
        for _ in range(2):  # once more with what the scorer remembers
            assert math.isclose(s.score(word), want, rel_tol=1e-9), word[:20]
    assert all(len(w) <= toxicity.MAX_KNOWN for w in s.value)


def test_learns_from_text_without_spaces(spark):
    """An offending stem after byte 64 of a run without spaces is learned, scored and rejected."""
    rng = random.Random(8)
    signs = [chr(0x4E00 + 7 * k) for k in range(60)]
    rows, labels = [], []
    for i in range(300):
        bad = i % 5 == 0
        rows.append((i, "".join(rng.choices(signs, k=40)) + ("畜生" if bad else "") + "".join(rng.choices(signs, k=20))))
        labels.append((i, None, int(bad)))
    df = docs(spark, rows)
    model = toxicity.train(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    out = {r.doc_id: r for r in toxicity.scored(df, model).collect()}
    assert {i for i, r in out.items() if r.predicted} == {i for i, _, bad in labels if bad}
    assert {r.doc_id for r in toxicity.sentences(df, model).collect()} == {i for i, _, bad in labels if bad}
    assert {r.doc_id for r in toxicity.not_toxic(df, model).collect()} == {i for i, _, bad in labels if not bad}


def test_awkward_and_unlabelled(spark):
    df = docs(spark, AWKWARD)
    nothing = spark.createDataFrame([(1, 1, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.train(df, nothing)
    rows = toxicity.scored(df, model).collect()
    assert len(rows) == len(AWKWARD) and all(r.score == 0 and r.predicted == 0 for r in rows)
    assert toxicity.scored(docs(spark, []), model).count() == 0


def test_held_out_accuracy(spark):
    """Trained on the other folds, tested on the held-out fold."""
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet").filter("toxic is not null")
    out = op9_toxicity(spark, sf)
    assert out.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    rows = out.filter("held_out").join(labels, "doc_id").collect()
    assert len(rows) > 50 and all(0 <= r.score <= 1 for r in rows)
    assert sum(r.predicted == r.toxic for r in rows) >= 0.93 * len(rows)


LABELS = "doc_id long, quality int, toxic int"


@pytest.mark.parametrize("case", ["clean", "toxic", "alike", "one text", "empty texts"])
def test_nothing_tells_the_classes_apart(spark, case):
    """No weight is learned, every score is 0 and every document stays."""
    rows = [(i, {"alike": f"w{i // 2} and so on", "one text": "same here", "empty texts": ""}.get(case, f"words {i}. more")) for i in range(60)]
    labels = [(i, None, {"clean": 0, "toxic": 1}.get(case, i % 2)) for i in range(60)]
    df = docs(spark, rows)
    model = toxicity.train(df, spark.createDataFrame(labels, LABELS))
    assert model == {}
    assert all(r.score == 0 and r.predicted == 0 for r in toxicity.scored(df, model).collect())
    assert toxicity.not_toxic(df, model).count() == 60 and toxicity.sentences(df, model).count() == 0


def test_sample_is_bounded(spark, monkeypatch):
    """One id on thousands of rows, equal or not, teaches within the bound, whatever the partitions."""
    monkeypatch.setattr(toxicity, "SAMPLE", 50)
    same = spark.range(5000).selectExpr("1L doc_id", "'you idiot' text")
    other = spark.range(3000).selectExpr("3L doc_id", "concat('word ', id) text")
    rows = same.union(other).union(spark.createDataFrame([(4, None), (5, "x y")], "doc_id long, text string"))
    labels = spark.createDataFrame([(1, 0, 1), (3, 1, 0), (4, 1, 0), (5, 0, 1)], LABELS)
    got = [[tuple(r) for r in toxicity.training_rows(rows.repartition(n), labels, 99, 100).orderBy("h").collect()] for n in (1, 5)]
    assert len(got[0]) == 50 and got[0] == got[1]


def brute(train, rows):
    """Fit and scores of the query in plain steps: {doc_id: score}. ``train``: (hash, text, label)."""
    def bag(text):
        low = "".join(chr(c + 32) if 65 <= c <= 90 else "\n" if c in b".!?\n\r" else
                      chr(c) if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 or c == 39 else " " for c in (text or "").encode())
        return [set(s.split(" ")) - {""} for s in low.split("\n") if s.strip(" ")]

    def features(word):
        marked = f"^{word}$"
        return {"=" + word} | {marked[i:i + 4] for i in range(len(marked) - 3)}

    train = [(bag(t), y) for _, t, y in sorted(train)]
    bad, good = sum(y for _, y in train), sum(1 - y for _, y in train)
    seen = {}
    for b, y in train:
        for f in set().union(*(features(w) for s in b for w in s)) if b else ():
            seen.setdefault(f, [0, 0])[y] += 1
    kept = []
    for f, (g, a) in seen.items():
        p = (a + g) / (bad + good)
        spread = math.sqrt(p * (1 - p) * (1 / bad + 1 / good))
        if a + g >= 4 and spread and abs(a / bad - g / good) / spread >= 4:
            kept.append(f)
    index = {f: i for i, f in enumerate(sorted(kept))}

    def matrix(b):
        x = np.zeros((len(b), len(index) + 1))
        for i, s in enumerate(b):
            x[i, -1] = 1
            for w in s:
                for f in features(w) & index.keys():
                    x[i, index[f]] += 1
        return x

    bags = [(matrix(b), y) for b, y in train]
    theta = np.zeros(len(index) + 1)
    theta[-1] = -5
    m, v = theta * 0, theta * 0
    for step in range(1, toxicity.STEPS + 1):
        g = theta * 0
        for x, y in bags:
            p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
            clean = np.prod(1 - np.minimum(p, 1 - 1e-12))
            g += x.T @ (p * (-clean / max(1 - clean, 1e-6) if y else 1.0)) / len(bags)
        g[:-1] += 0.1 * theta[:-1] / len(bags)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta = theta - 0.1 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
    out = {}
    for i, t in rows:
        p = 1 / (1 + np.exp(-np.clip(matrix(bag(t)) @ theta, -30, 30)))
        out[i] = 1 - math.prod(1 - np.minimum(p, 1 - 1e-12))
    return out


def test_query_against_brute_force(spark):
    """The fitted query, refitted with dense rows, one document at a time."""
    rows, labels = corpus(160)
    df, marks = docs(spark, rows), spark.createDataFrame(labels, LABELS)
    by = {r.doc_id: r.h for r in df.selectExpr("doc_id", "xxhash64(doc_id, text) h").collect()}
    train = [(by[i], t, y) for (i, t), (_, _, y) in zip(rows, labels) if zlib.crc32(str(i).encode()) % 4 != 2]
    want = brute(train, rows)
    for r in toxicity.scored(df, toxicity.train(df, marks)).collect():
        assert abs(r.score - want[r.doc_id]) < 1e-6 and r.predicted == int(want[r.doc_id] >= 0.3)

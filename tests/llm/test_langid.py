import math
import zlib

import numpy as np
from pyspark.sql import functions as F

from millrun.llm import langid
from millrun.llm.queries import op4_langid
from tests.llm.helpers import AWKWARD, docs


def test_awkward(spark):
    df = docs(spark, AWKWARD)
    rows = langid.predicted(df, langid.train(df)).collect()
    assert len(rows) == len(AWKWARD)
    texts = {i: t for i, t in AWKWARD}
    for r in rows:
        letters = any(c.isalpha() for c in texts[r.doc_id] or "")
        assert (r.lang_pred == "und") == (not letters) and 0 <= r.score <= 1
        assert r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 3 == 1)


def test_nothing_to_learn_from(spark):
    df = docs(spark, AWKWARD).withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in langid.predicted(df, langid.train(df)).collect()} == {"und"}
    empty = docs(spark, [])
    assert langid.predicted(empty, langid.train(empty)).count() == 0


def test_held_out_accuracy_and_inputs(spark):
    """Only the text decides: other columns may change without changing a prediction."""
    sf = "/root/testdata/sf0.01"
    out = op4_langid(spark, sf)
    given = spark.read.parquet(f"{sf}/documents.parquet")
    rows = out.filter("held_out and lang_pred <> 'und'").join(given, "doc_id").collect()
    assert len(rows) > 200
    assert sum(r.lang_pred == r.lang for r in rows) >= 0.97 * len(rows)
    assert out.count() == given.count()


def test_distant_texts_are_rejected(spark):
    given = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = langid.train(given)
    lang, score, rejected = model.predict([t.encode() * 40 for t in ("zxq kjv wqx ", "щдфгш лдджэ ")])
    assert rejected == [True, True] and max(score) < 0.5


def test_long_text_is_counted_whole(monkeypatch):
    monkeypatch.setattr(langid, "_STEP", 64)
    texts = [b"abc def " * 50, b"", b"x", b"ghi " * 100]
    cut = langid.counts(texts)
    monkeypatch.setattr(langid, "_STEP", 1 << 21)
    assert (cut == langid.counts(texts)).all() and cut[0].sum() == 2 * 400


TEXTS = [("en", "the cat and the dog of the house %d"), ("de", "der hund und die katze in dem haus %d")]


def some(spark, extra=(), n=40):
    rows = [(i, TEXTS[i % 2][1] % i, TEXTS[i % 2][0]) for i in range(n)]
    return spark.createDataFrame([*rows, *extra], "doc_id long, text string, lang string")


def test_letters():
    assert not any(map(langid.has_letter, ["", "\u00bd \u00b2", "\u2460", "\u2167", "12 _ \u0663 \u0301", "\U0001f642"]))
    assert all(map(langid.has_letter, ["a", "1\u00e9", "\u65e5", "\u02b0", "\u00aa", "\u0e01"]))


def test_numbers_are_undetermined(spark):
    df = some(spark, [(500, "\u00bd \u00b2", None), (501, "\u2167 \u2460", "en")])
    got = {r.doc_id: r for r in langid.predicted(df, langid.train(df)).collect()}
    assert [(got[i].lang_pred, got[i].score) for i in (500, 501)] == [("und", 0.0)] * 2 and got[0].lang_pred == "en"


def test_a_language_of_empty_texts(spark):
    """It isn't learned; the others are."""
    df = some(spark, [(600 + i, "", "xx") for i in range(9)])
    got = langid.predicted(df, langid.train(df)).filter("doc_id < 600").collect()
    assert all(r.lang_pred == TEXTS[r.doc_id % 2][0] for r in got)
    only = df.filter("lang = 'xx'")
    assert {r.lang_pred for r in langid.predicted(df, langid.train(only)).collect()} == {"und"}


def test_sample_is_bounded(spark, monkeypatch):
    """Repeated ids, repeated rows and null ids neither pass the bound nor are lost."""
    monkeypatch.setattr(langid, "SAMPLE", 30)
    same = spark.range(5000).selectExpr("7L doc_id", "'the cat and the dog' text", "'en' lang")
    other = spark.range(300).selectExpr("8L doc_id", "concat('the dog ', id) text", "'en' lang")
    nulls = spark.range(20).selectExpr("cast(null as long) doc_id", "concat('der hund und ', id) text", "'de' lang")
    rows = same.union(other).union(nulls).repartition(4)
    got = langid._sample(rows).collect()
    assert len([r for r in got if r.lang == "en"]) == 30 and len([r for r in got if r.lang == "de"]) == 20
    want = sorted(r.h for r in rows.filter("lang = 'en'").selectExpr("xxhash64(doc_id, text) h").distinct().collect())[:30]
    assert sorted(r.h for r in got if r.lang == "en") == want
    model = langid.train(rows)
    assert set(model.langs) == {"de"} | ({"en"} if any(zlib.crc32(i) % 3 != 1 for i in (b"7", b"8")) else set())


def brute(rows):
    """Fit and prediction of the query, gram by gram: {doc_id: (language, score)}."""
    def grams(text):
        out = {}
        fold = [c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in text.encode()] + [32, 32]
        for k in range(len(fold) - 2):
            two = fold[k] << 8 | fold[k + 1]
            for code in (two + (1 << 24), two << 8 | fold[k + 2]):
                h = (code * 2654435761 % 2 ** 32) >> 20
                out[h] = out.get(h, 0) + 1
        return out

    train = [r for r in rows if r.lang is not None and r.text is not None and zlib.crc32(str(r.doc_id).encode()) % 3 != 1]
    df = {}
    for r in train:
        for g in grams(r.text):
            df[g] = df.get(g, 0) + 1

    def vector(text):
        x = np.zeros(langid.DIMENSIONS)
        for g, n in grams(text).items():
            x[g] = (1 + math.log(n)) * (math.log((1 + len(train)) / (1 + df.get(g, 0))) + 0.1)
        return x / max(np.linalg.norm(x), 1e-12)

    centroids = []
    for lang in sorted({r.lang for r in train}):
        own = sorted((r for r in train if r.lang == lang), key=lambda r: r.h)
        x = np.array([v for v in (vector(r.text) for r in own) if np.linalg.norm(v) > 0.5])
        centroids += [(lang, c) for c in langid.clustered(x.astype(np.float32))[0]] if len(x) else []
    out = {}
    for r in rows:
        near = [(float(c @ vector(r.text)), lang) for lang, c in centroids] if r.text and any(map(str.isalpha, r.text)) else []
        out[r.doc_id] = max(near)[::-1] if near else ("und", 0.0)
    return out


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    want = brute(spark.read.parquet(f"{sf}/documents.parquet").selectExpr("*", "xxhash64(doc_id, text) h").collect())
    got = op4_langid(spark, sf).collect()
    assert len(got) == len(want)
    for r in got:
        assert r.lang_pred == want[r.doc_id][0] and abs(r.score - want[r.doc_id][1]) < 1e-3
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)

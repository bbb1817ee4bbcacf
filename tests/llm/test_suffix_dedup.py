import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
import zstandard

from millrun.llm import suffix_dedup
from millrun.llm.queries import op2_suffix_dedup
from tests.llm.helpers import AWKWARD, docs


def brute(rows, length=50):
    last = 2 ** 63
    least = {}
    data = [(last if i is None else i, (t or "").encode()) for i, t in rows]
    for i, b in data:
        for k in range(len(b) - length + 1):
            s = b[k:k + length]
            least[s] = min(least.get(s, last), i)
    for (doc, _), (i, b) in zip(rows, data):
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - length + 1):
            if least[b[k:k + length]] < i:
                gone[k:k + length] = True
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0]) if len(b) else 0
        yield (doc, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())


def rows_of(df):
    return [tuple(r) for r in df.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()]


def same(got, want):
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_order_is_a_suffix_array():
    rng = np.random.default_rng(2)
    for n in [1, 2, 3, 4, 5, 7, 30, 31, 32, 500, 501, 502]:
        for symbols in (1, 2, 4, 200):
            t = rng.integers(1, symbols + 1, n)
            order = suffix_dedup.dc_order(t, n + 1)
            assert order.tolist() == sorted(range(n), key=lambda i: t[i:].tolist())
            # a bounded depth groups equal prefixes
            order = suffix_dedup.dc_order(t, 5)
            prefixes = [tuple(t[i:i + 5]) for i in order]
            assert prefixes == sorted(prefixes)


def test_awkward(spark):
    same(rows_of(suffix_dedup.report(docs(spark, AWKWARD))), brute(AWKWARD))


def test_empty(spark):
    assert suffix_dedup.report(docs(spark, [])).count() == 0


@pytest.mark.parametrize("pack,hot,sort", [(4 << 20, 256, 1 << 20), (700, 256, 4000), (700, 2, 4000), (300, 0, 200), (5000, 256, 100)])
def test_small_packs_hot_anchors_and_sorts(spark, monkeypatch, pack, hot, sort):
    """Shared passages at all places, near copies, runs of one letter; any packing gives the same."""
    monkeypatch.setattr(suffix_dedup, "PACK_BYTES", pack)
    monkeypatch.setattr(suffix_dedup, "HOT_PACKS", hot)
    monkeypatch.setattr(suffix_dedup, "SORT_BYTES", sort)
    rng = random.Random(7)
    word = lambda: "".join(rng.choices("abcdeé", k=rng.randint(1, 9)))
    passages = [" ".join(word() for _ in range(rng.randint(8, 40))) for _ in range(6)] + ["x" * 120, "ab" * 70]
    rows = []
    for i in range(70):
        parts = [" ".join(word() for _ in range(rng.randint(0, 25))) for _ in range(3)]
        parts.insert(rng.randint(0, 3), rng.choice(passages)[rng.randint(0, 30):])
        rows.append((rng.randint(0, 500), " ".join(parts)))
    for _ in range(25):
        i, t = rng.choice(rows)
        k = rng.randrange(len(t))
        rows.append((rng.randint(0, 500), t[:k] + rng.choice(["", "Z", "zz"]) + t[k + 1:]))
    rows.append((None, rows[0][1]))
    same(rows_of(suffix_dedup.report(docs(spark, rows))), brute(rows))


def test_query_is_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    same(rows_of(op2_suffix_dedup(spark, sf)), brute(rows))


def test_texts_lose_what_is_reported(spark):
    rows = [(1, "one two three four five six seven eight nine ten eleven " * 2), (2, "é" * 60), (3, "x" + "é" * 40),
            (4, "Start. one two three four five six seven eight nine ten eleven one two End."), (5, None)]
    df = docs(spark, rows)
    out = suffix_dedup.deduplicated(df)
    assert out.schema == df.schema
    got = {r.doc_id: r for r in out.collect()}
    want = {r[0]: r for r in brute(rows)}
    for i, t in rows:
        assert got[i].n_chars == len(got[i].text)
        if i not in (3,):
            assert hashlib.sha256(got[i].text.encode()).hexdigest() == want[i][4]
    assert got[4].text == "Start. End."[:6] + got[4].text[6:] and got[3].text == "x"


def test_shares_come_from_the_bytes(spark, monkeypatch):
    """Any number of shares gives the same result, and the shuffles have a task for each."""
    rows = [(i, f"some words {i % 7} and a passage that is longer than fifty bytes, number {i % 5} " * 2) for i in range(40)]
    want = list(brute(rows))
    for size in (16 << 20, 500, 60):
        monkeypatch.setattr(suffix_dedup, "SHARE_BYTES", size)
        same(rows_of(suffix_dedup.report(docs(spark, rows))), want)
    hashes = np.random.default_rng(1).integers(0, 2 ** 63, 1000).astype(np.uint64)
    dealt = list(suffix_dedup._by_share(hashes, 37))
    assert sorted(np.concatenate([at for _, at in dealt]).tolist()) == list(range(1000))
    assert all((suffix_dedup._share(hashes[at], 37) == p).all() and (np.diff(at) > 0).all() for p, at in dealt)
    assert suffix_dedup._dealt(spark.createDataFrame([(1,)], "share int"), 50).rdd.getNumPartitions() == 50


@pytest.mark.parametrize("each,hotter", [(1, 3), (2, 1000), (1, 1)])
def test_longer_anchors_single_strings_and_rounds(spark, monkeypatch, each, hotter):
    """Hot anchors by longer ones or by strings, shares in rounds: the same result."""
    monkeypatch.setattr(suffix_dedup, "PACK_BYTES", 600)
    monkeypatch.setattr(suffix_dedup, "HOT_PACKS", 2)
    monkeypatch.setattr(suffix_dedup, "HOT_EACH", each)
    monkeypatch.setattr(suffix_dedup, "HOTTER", hotter)
    monkeypatch.setattr(suffix_dedup, "SHARE_BYTES", 4000)
    monkeypatch.setattr(suffix_dedup, "ROUND_BYTES", 3000)
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdeé", k=rng.randint(1, 9)))
    passages = [" ".join(word() for _ in range(rng.randint(8, 30))) for _ in range(4)] + ["y" * 90, "abc" * 40]
    rows = []
    for i in range(60):
        parts = [" ".join(word() for _ in range(rng.randint(0, 12))) for _ in range(2)]
        parts.insert(rng.randint(0, 2), rng.choice(passages)[rng.randint(0, 30):])
        rows.append((rng.randint(0, 300), "".join(parts)))
    rows += [(rng.randint(0, 300), t) for _, t in rows[:20]] + [(None, rows[0][1])]
    same(rows_of(suffix_dedup.report(docs(spark, rows))), brute(rows))


def test_hot_anchors_send_little_more():
    """A hot anchor's strings go in a few contexts, not each for itself."""
    rng = random.Random(3)
    text = "".join(rng.choices("abcdefgh ", k=50_000)).encode()
    pack = suffix_dedup.Pack(np.array([1], "<i8").tobytes(), np.array([len(text)], "<i8").tobytes(), zstandard.compress(text), 50)
    sent = {}
    for flag in (1, 2, 3):
        own, s, e, o, number, texts, least, offset, share = pack.contexts(np.full(len(pack.distinct), flag, np.uint8), 50, 7)
        assert (e - s).sum() == len(text) - 49 and sorted(number) == list(range(len(own)))
        assert all(text[a:b + 49] == texts[i].as_py() for a, b, i in zip(s[:500], e[:500], own[:500]))
        sent[flag] = texts.nbytes
    assert sent[2] < 4 * sent[1] < sent[3]


def test_contexts_alone_on_both_sides_are_not_sorted(monkeypatch):
    """Contexts that share their anchor only have no equal string; others are compared."""
    rng = np.random.default_rng(5)
    monkeypatch.setattr(suffix_dedup, "class_minima", lambda *a: pytest.fail("sorted"))
    anchor = b"sixteen bytes!!!"
    text = lambda: rng.integers(1, 255, 34).astype(np.uint8).tobytes()
    texts = [text() + anchor + text() for _ in range(300)]
    n, out = suffix_dedup._minima(pa.array(texts, pa.binary()), np.arange(300), np.full(300, 34), 50)
    assert n.tolist() == [35] * 300 and out.tolist() == np.repeat(np.arange(300), 35).tolist()

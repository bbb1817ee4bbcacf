import hashlib
import random
import re

import numpy as np
import pytest

from millrun.llm import substring_dedup as sd
from millrun.llm.queries import op11_substring_dedup
from tests.llm.helpers import AWKWARD, docs

LAST = 2 ** 63


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute(rows, length=50):
    least, data = {}, [(LAST if i is None else i, words_of(t)) for i, t in rows]
    for i, w in data:
        for k in range(len(w) - length + 1):
            g = tuple(w[k:k + length])
            least[g] = min(least.get(g, LAST), i)
    for (doc, _), (i, w) in zip(rows, data):
        gone = [False] * len(w)
        for k in range(len(w) - length + 1):
            if least[tuple(w[k:k + length])] < i:
                gone[k:k + length] = [True] * length
        yield doc, w, gone


def digests(rows, length=50):
    return [(doc, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest())
            for doc, w, gone in brute(rows, length)]


def same(got, want):
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def corpus(seed, n=60, vocabulary=40):
    """Copies, near copies, passages shared by many documents, runs of one word, odd words."""
    rng = random.Random(seed)
    vocab = [*("w%d" % i for i in range(vocabulary)), "ünï", "日本語のとても長い言葉です", "x" * 9, "y" * 300, "\x1c", " "]
    text = lambda k: rng.choice([" ", "  ", "\n", "\t\r\n"]).join(rng.choice(vocab) for _ in range(k))
    passages = [text(rng.randrange(8, 40)) for _ in range(4)]
    rows = []
    for i in range(n):
        t = text(rng.randrange(60))
        for _ in range(rng.randrange(3)):
            t += " " + rng.choice(passages) + " " + text(rng.randrange(30))
        if rows and rng.random() < 0.3:
            other = words_of(rng.choice(rows)[1])
            if other:
                other[rng.randrange(len(other))] = "changed"
            t = " ".join(other)
        rows.append((rng.choice([i, i, i, max(i - 3, 0), None]), t))
    rows += [(500, "same " * 70), (501, "same " * 33 + "x"), (3, "same " * 40), (900, passages[0]), (901, passages[0] * 2)]
    rng.shuffle(rows)
    return rows


def test_awkward(spark):
    same(sd.report(docs(spark, AWKWARD)).collect(), digests(AWKWARD))


def test_empty(spark):
    assert sd.report(docs(spark, [])).count() == 0
    same(sd.report(docs(spark, [(1, None), (2, ""), (None, " ")])).collect(), digests([(1, None), (2, ""), (None, " ")]))


@pytest.mark.parametrize("length,group,prefixes", [(10, 8 << 20, 1 << 20), (10, 2000, 1 << 20), (7, 300, 1 << 20), (12, 1, 3), (10, 0, 1 << 20)])
def test_prefixes_of_all_lengths(spark, monkeypatch, length, group, prefixes):
    """From groups of one word's suffixes to groups that no prefix makes small enough (bound 0)."""
    monkeypatch.setattr(sd, "GROUP_BYTES", group)
    monkeypatch.setattr(sd, "MOST_PREFIXES", prefixes)
    monkeypatch.setattr(sd, "packed", lambda d, f=sd.packed: f(d, 900))  # many small packs
    rows = corpus(length + group)
    same(sd.report(docs(spark, rows).repartition(3), length).collect(), digests(rows, length))


def test_large_groups_reach_their_own_way(spark, monkeypatch):
    monkeypatch.setattr(sd, "GROUP_BYTES", 300)
    seen = []
    monkeypatch.setattr(sd, "_whole", lambda c, n, f=sd._whole: seen.append(c.count()) or f(c, n))
    monkeypatch.setattr(sd, "packed", lambda d, f=sd.packed: f(d, 900))
    rows = corpus(5)
    same(sd.report(docs(spark, rows), 8).collect(), digests(rows, 8))
    assert seen[0] > 0


def test_spans_and_deduplicated(spark):
    rows = [(i, t) for i, (_, t) in enumerate(corpus(8))]
    table = docs(spark, rows)
    want = set()
    for doc, w, gone in brute(rows, 10):
        a = 0
        while a < len(w):
            b = a
            while b < len(w) and gone[b]:
                b += 1
            if b > a:
                want.add((doc, a, b - a, " ".join(w[a:b])))
            a = b + 1
    assert want and {tuple(r) for r in sd.spans(table, 10).collect()} == want
    got = sd.deduplicated(table, 10)
    assert got.columns == table.columns
    kept = {doc: " ".join(x for x, g in zip(w, gone) if not g) for doc, w, gone in brute(rows, 10)}
    assert {r.doc_id: (r.text, r.source, r.fp) for r in got.collect()} == {d: (t, "s", "x") for d, t in kept.items()}


def test_subtree():
    """Order and common prefixes of the suffixes, against sorting them as lists."""
    rng = np.random.default_rng(3)
    for length in (4, 6, 7, 16, 50):
        t = rng.integers(1, 3, 400)
        starts = np.arange(len(t) - length)
        tree = sd.Subtree(t, starts, length)
        prefixes = [t[i:i + length].tolist() for i in tree.order]
        assert prefixes == sorted(prefixes)
        shared = [next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), length) for a, b in zip(prefixes, prefixes[1:])]
        assert np.minimum(tree.common, length).tolist() == shared
        nodes = tree.deep(length)
        assert len(nodes) == len({tuple(p) for p in prefixes})


def test_a_long_text_and_long_words(spark):
    rng = random.Random(6)
    base = " ".join(rng.choice(["alpha", "beta", "z" * 500, "é" * 200]) + str(rng.randrange(50)) for _ in range(20_000))
    rows = [(2, base), (1, base[5000:60_000]), (3, "q" * 300_000), (4, base[10:])]
    same(sd.report(docs(spark, rows)).collect(), digests(rows))


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    same(op11_substring_dedup(spark, "/root/testdata/sf0.001").collect(), digests(rows))

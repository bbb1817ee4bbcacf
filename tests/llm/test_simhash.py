import random
import re

import numpy as np
import pytest
import xxhash

from millrun.llm import simhash
from millrun.llm.components import components
from millrun.llm.queries import op3_simhash
from tests.llm.helpers import AWKWARD, docs


def brute_fp(text, n=4):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + n]) for i in range(max(1, len(words) - n + 1))]
    hs = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(rows, bits):
    """Smallest id by fingerprint component, by all pairs."""
    fps = sorted({f for _, f in rows})
    a = np.array(fps, dtype=np.uint64)
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, f in enumerate(fps):
        for j in np.flatnonzero(np.bitwise_count(a ^ a[i]) <= bits).tolist():
            x, y = find(f), find(fps[j])
            if x != y:
                root[max(x, y)] = min(x, y)
    least = {}
    for i, f in rows:
        if i is not None:
            least[find(f)] = min(least.get(find(f), i), i)
    return {f: least.get(find(f)) for f in fps}


def check(got, rows, bits=4):
    want = [(i, brute_fp(t)) for i, t in rows]
    comp = brute_components(want, bits)
    assert sorted(map(str, got)) == sorted(str((i, f, comp[f])) for i, f in want)


def test_awkward(spark):
    out = simhash.near_duplicates(docs(spark, AWKWARD)).collect()
    check([(r.doc_id, r.fp & (2 ** 64 - 1), r.component_id) for r in out], AWKWARD)


def test_empty_table(spark):
    assert simhash.near_duplicates(docs(spark, [])).count() == 0


def test_query_is_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    check([(r.doc_id, int(r.fingerprint, 16), r.component_id) for r in op3_simhash(spark, sf).collect()], rows)


@pytest.mark.parametrize("bits,hot", [(4, 4096), (4, 8), (3, 16), (5, 4096), (0, 4096)])
def test_links_of_dense_clusters(spark, monkeypatch, bits, hot):
    """Dense clusters and small blocks give the components of all pairs."""
    monkeypatch.setattr(simhash, "HOT_BUCKET", hot)
    rng = random.Random(bits * 100 + hot)
    fps = set()
    for _ in range(30):
        c = rng.getrandbits(64)
        for _ in range(rng.choice([1, 3, 40])):
            x = c
            for _ in range(rng.randint(0, 7)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    fps = sorted(fps)
    signed = [(f - 2 ** 64 if f >= 2 ** 63 else f,) for f in fps]
    got = components(simhash.links(spark.createDataFrame(signed, "fp long"), bits)).collect()
    root = {r.node & (2 ** 64 - 1): r.root for r in got}
    mine = {}
    for i, f in enumerate(fps):
        mine.setdefault(root.get(f, f - 2 ** 64 if f >= 2 ** 63 else f), []).append(i)
    want = brute_components(list(enumerate(fps)), bits)
    groups = {}
    for i, f in enumerate(fps):
        groups.setdefault(want[f], []).append(i)
    assert sorted(mine.values()) == sorted(groups.values())


def test_probes_of_a_bucket_are_dealt_out(spark, monkeypatch):
    """Many probes at few table rows: no cell holds them all, and no link is lost."""
    monkeypatch.setattr(simhash, "HOT_BUCKET", 64)
    rng = random.Random(3)
    high = [rng.getrandbits(43) << 21 for _ in range(1500)]
    fps = sorted({h | 0b1000 for h in high} | {h | 0b1001 for h in high[:5]})  # segments differ in one bit
    signed = spark.createDataFrame([(f - 2 ** 64 if f >= 2 ** 63 else f,) for f in fps], "fp long")
    cells = simhash._dealt(signed, 4).groupBy("key", "i", "j").count().collect()
    assert max(r["count"] for r in cells) <= 3 * 64
    got = {(r.a, r.b) for r in simhash.links(signed, 4).collect()}
    sign = lambda f: f - 2 ** 64 if f >= 2 ** 63 else f
    assert got == {tuple(sorted((sign(h | 0b1000), sign(h | 0b1001)))) for h in high[:5]}


def test_long_chain(spark):
    """Components of a chain longer than any one bucket."""
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long")
    assert {(r.node, r.root) for r in components(edges).collect()} == {(i, 0) for i in range(201)}


def test_representatives(spark):
    df = docs(spark, AWKWARD)
    out = simhash.representatives(df)
    assert out.schema == df.schema
    fps = brute_components([(i, brute_fp(t)) for i, t in AWKWARD], 4)
    want = sorted({fps[brute_fp(t)] for _, t in AWKWARD})
    assert sorted(r.doc_id for r in out.collect()) == want


def test_representatives_of_one_id_with_two_texts(spark):
    """Each component keeps one row, also where two have the same smallest id."""
    a, b, c = ("alpha beta gamma delta epsilon zeta " * 4, "one two three four five six seven " * 4,
               "red orange yellow green blue indigo violet " * 4)
    rows = [(1, a), (1, b), (2, a), (3, b), (4, c), (4, a), (None, "lone null id"), (1, b)]
    df = docs(spark, rows)
    assert len({brute_fp(t) for t in (a, b, c)}) == len(brute_components([(i, brute_fp(t)) for i, t in enumerate((a, b, c))], 4)) == 3
    assert len(set(brute_components([(i, brute_fp(t)) for i, t in enumerate((a, b, c))], 4).values())) == 3
    out = simhash.representatives(df)
    assert out.schema == df.schema
    want = [(1, a), (1, b), (4, c), (None, "lone null id")]
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted(want, key=str)

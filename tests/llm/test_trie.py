import hashlib
import random
import re
import zlib

import pytest

from millrun.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, c string, depth int, words string, _part string, seq int"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y", "p", 2) for r in rows], SCHEMA)


def brute(rows, group=20, most=4):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % most
        base = c - (abs(c) % group) * (1 if c >= 0 else -1)
        built[c] = own.get(base, [])[:h] + turns[h:]
    members, ends = {}, {}
    for c, turns in sorted(built.items()):
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
        ends.setdefault(tuple(turns), []).append(c)
    kids = {}
    for n in members:
        if n:
            kids.setdefault(n[:-1], []).append(n)
    leaves, saved = {}, {}
    for n in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", n[-1][1])) if n else 0
        leaves[n] = sum(leaves[k] for k in kids.get(n, [])) or 1
        saved[n] = sum(saved[k] for k in kids.get(n, [])) + (len(members[n]) - 1) * words
    return {(m[0], len(n), members[n[:-1]][0] if n else None, len(m), len(kids.get(n, [])), leaves[n], saved[n],
             hashlib.sha256(",".join(map(str, ends.get(n, []))).encode()).hexdigest()) for n, m in members.items()}


def run(spark, rows, group=20, most=4):
    got = [tuple(r)[:8] for r in trie.trie(trie.sequences(table(spark, rows), group, most)).collect()]
    assert len(got) == len(set(got))
    return set(got)


def odd_rows(seed, convs=60, longest=9):
    rng = random.Random(seed)
    texts = ["", None, " \t", "a b", "a  b", "naïve x y", "x" * 50, "one two three " * 5]
    rows = []
    for c in [*range(convs - 10), -3, -20, -41, 1000, 1001, 1002, 10**15, 10**15 + 1]:
        start = rng.choice([[], [("system", "a b")], [("system", "a b"), ("user", "one")]])
        turns = start + [(rng.choice(["user", "assistant", None, "user"]), rng.choice(texts)) for _ in range(rng.randrange(longest))]
        turns = turns or [("user", None)]
        for i, (r, t) in enumerate(turns):
            rows.append((c, i if rng.random() < 0.8 else rng.choice([None, 0, i - 1]), r, t))
    rows += rows[:5] + [(None, 0, "user", "lost"), (None, None, None, None)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("band,hot", [(32, 64), (2, 2), (1 << 40, 0)])
def test_against_brute_force(spark, monkeypatch, band, hot):
    monkeypatch.setattr(trie, "BAND", band)
    monkeypatch.setattr(trie, "HOT_CHILDREN", hot)
    monkeypatch.setattr(trie, "HOT_PARENTS", 10**6)
    rows = odd_rows(band % 97)
    assert run(spark, rows) == brute(rows)


def test_a_long_conversation_and_many_copies(spark, monkeypatch):
    """Bands, chunks of the prefix sums and pieces of the lists of ends all pass their bounds."""
    monkeypatch.setattr(trie, "BAND", 3)
    monkeypatch.setattr(trie, "CHUNK", 4)
    monkeypatch.setattr(trie, "PIECE", 7)
    long = [(40, i, "user", f"t {i}") for i in range(70)]
    twin = [(41, i, "user", f"t {i}") for i in range(70)] + [(40 + 2, i, "user", f"t {i % 30}") for i in range(60)]
    copies = [(c, i, r, t) for c in range(200, 260) for i, (r, t) in enumerate([("system", "s s"), ("user", "hot turn"), ("a", "b")])]
    rows = long + twin + copies
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows, group=1, most=1) == brute(rows, 1, 1)


def test_equal_turn_numbers_and_repeated_rows(spark):
    """One conversation with only null numbers and equal rows is split over ranges like any other."""
    rows = [(4, None, "user", "same words")] * 40 + [(4, None, "user", f"t{i % 5}") for i in range(40)] + [(5, 1, "user", "same words")]
    assert run(spark, rows) == brute(rows)


def test_empty(spark):
    assert run(spark, []) == set()
    assert run(spark, [(None, 1, "user", "x")]) == set()

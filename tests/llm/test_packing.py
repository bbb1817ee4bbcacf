import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from millrun.llm import packing, tokens
from millrun.llm.queries import op7_packing
from tests.llm.helpers import AWKWARD, docs


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokens.default_path())


def check(rows, texts, library, capacity):
    """Every piece is as the library says, and every sequence is gapless."""
    by_seq, by_doc = {}, {}
    for r in rows:
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_doc.setdefault(r.doc_id, []).append((r.piece, r.start, r.length, r.ids_crc32))
    for spans in by_seq.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    want = {}
    for doc, text in texts:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        first = len(ids) % capacity or capacity
        cuts = [0, *range(min(first, len(ids)), len(ids), capacity), len(ids)]
        for j, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want.setdefault(doc, []).append((j, a, b - a, zlib.crc32(ids[a:b].tobytes())))
    assert {d: sorted(p) for d, p in by_doc.items()} == {d: sorted(p) for d, p in want.items()}
    return len(by_seq)


@pytest.mark.parametrize("capacity", [16, 2048])
def test_awkward(spark, library, capacity):
    out = packing.packed(docs(spark, AWKWARD), capacity).collect()
    check(out, AWKWARD, library, capacity)


def test_empty(spark):
    assert packing.packed(docs(spark, [])).count() == 0


def test_query(spark, library):
    sf = "/root/testdata/sf0.001"
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = op7_packing(spark, sf).collect()
    n = check(rows, texts, library, 2048)
    total = sum(r.length for r in rows)
    assert n <= 1.02 * total / 2048 + 1


def test_many_buckets(spark, library, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET_TOKENS", 20_000)
    check(packing.packed(docs(spark, AWKWARD), 256).collect(), AWKWARD, library, 256)


def test_place_pairs_large_items():
    seq, offset = packing.place(np.array([60, 40, 55, 45, 50, 50, 34, 34, 32, 33]), 100)
    used = {}
    for s, o, n in zip(seq, offset, [60, 40, 55, 45, 50, 50, 34, 34, 32, 33]):
        used[s] = used.get(s, 0) + n
    assert len(used) == 5 and max(used.values()) <= 100


def test_place_close_to_bound():
    rng = np.random.default_rng(1)
    lengths = np.minimum(rng.geometric(1 / 500, 20_000), 2048)
    seq, offset = packing.place(lengths, 2048)
    assert seq.max() + 1 <= 1.01 * lengths.sum() / 2048
    order = np.lexsort((offset, seq))
    ends = (offset + lengths)[order]
    same = seq[order][1:] == seq[order][:-1]
    assert (offset[order][1:][same] == ends[:-1][same]).all() and ends.max() <= 2048


def test_pieces_equal_the_library(library):
    enc = tokens.PieceEncoder()
    rng = np.random.default_rng(3)
    parts = ["a", " ", "  ", "\n", "'s", "don't", "é", "日本", "12", "!?", " ", "\x1c", "\x85", "\t", "🙂", "The", "<|endoftext|>"]
    for _ in range(400):
        text = "".join(rng.choice(parts, size=rng.integers(0, 25)))
        assert enc.encode(text) == enc.whole(text), repr(text)

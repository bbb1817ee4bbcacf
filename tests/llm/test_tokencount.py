import random

from millrun.llm import tokencount, tokens
from millrun.llm.queries import op8_token_counts
from tests.llm.helpers import AWKWARD, docs


def test_trees_follow_random_edits(monkeypatch):
    monkeypatch.setattr(tokencount, "BLOCK", 3)
    enc = tokens.PieceEncoder()
    rng = random.Random(4)
    parts = ["a", " ", "  ", "\n", "'s", " don't", "é", "日本", " 12", "!?", "\x1c", " The", "<|endoftext|>", " word"]
    for _ in range(150):
        text = "".join(rng.choices(parts, k=rng.randint(0, 40)))
        tree = tokencount.TokenTree.of(text, enc)
        for _ in range(12):
            start, removed = rng.randint(0, len(text) + 2), rng.choice([0, 0, 1, 3, 10, 100])
            inserted = "".join(rng.choices(parts, k=rng.choice([0, 1, 2, 30])))
            tree.edit(start, removed, inserted)
            at = min(start, len(text))
            text = text[:at] + inserted + text[min(at + removed, len(text)):]
            assert tree.text() == text
            assert tree.total() == len(enc.ordinary(text)) if text else tree.total() == 0
            if text:
                assert [x.tolist() for x in tree.leaves()] == [x.tolist() for x in enc.counted(text)]


def test_pieces_are_never_joined():
    """Each piece has as many tokens apart as within its text."""
    enc = tokens.PieceEncoder()
    rng = random.Random(6)
    parts = ["a", " ", "  ", "\n", " don't", " é", " 日本", "12", " !?", " \x85", " \u3000x", " \u2003", "\t", " 🙂", " \xa0"]
    for _ in range(300):
        text = "".join(rng.choices(parts, k=rng.randint(1, 40)))
        chars, counts = enc.counted(text)
        at = 0
        for n, k in zip(chars.tolist(), counts.tolist()):
            assert len(enc.ordinary(text[at:at + n])) == k
            at += n
        assert at == len(text)


def test_edit_encodes_few_pieces():
    enc = tokens.PieceEncoder()
    tree = tokencount.TokenTree.of("some words in a long text " * 5000, enc)
    tree.edit(60_000, 5, "new text")
    assert tree.encoded < 10


def test_tables_of_edits(spark):
    df = docs(spark, AWKWARD)
    edits = spark.createDataFrame(
        [(1, 2, 0, 4, "First"), (1, 1, 4, 0, " and"), (8, 1, 50_000, 10, None), (None, 1, 0, 1, "x"), (99, 1, 0, 0, "x"),
         (2, None, None, None, "was null")], "doc_id long, edit_no int, start long, removed long, inserted string")
    enc = tokens.PieceEncoder()
    trees = tokencount.built(df)
    assert {(r.doc_id, r.n_tokens) for r in trees.collect()} == {(i, len(enc.ordinary(t or ""))) for i, t in AWKWARD}
    out = {(r.doc_id, r.text): r for r in tokencount.edited(trees, edits).collect()}
    fox = AWKWARD[0][1]
    first = "First" + (fox[:4] + " and" + fox[4:])[4:]
    assert (1, first) in out and (None, fox) in out and (2, "was null") in out
    for (_, text), r in out.items():
        assert r.n_tokens == len(enc.ordinary(text)) and sum(r.piece_tokens) == r.n_tokens
    assert out[(1, first)].n_edits == 2


def test_empty(spark):
    assert tokencount.built(docs(spark, [])).count() == 0


def test_query_counts_the_edited_texts(spark):
    import zlib
    sf = "/root/testdata/sf0.001"
    enc = tokens.PieceEncoder()
    rows = {r.doc_id: r for r in op8_token_counts(spark, sf).collect()}
    for d in spark.read.parquet(f"{sf}/documents.parquet").collect():
        text, n = d.text or "", len(d.text or "")
        assert rows[d.doc_id].n_tokens == len(enc.ordinary(text))
        for k, removed, inserted in [(0, 12, "edited words"), (1, 0, " an insertion, with\n\nlines "), (2, 25, "")]:
            at = min(zlib.crc32(f"{k}:{d.doc_id}".encode()) % (n + 1), len(text))
            text = text[:at] + inserted + text[at + removed:]
        assert rows[d.doc_id].n_tokens_after == len(enc.ordinary(text))
        assert rows[d.doc_id].n_encoded < 60


ODD_TEXTS = {
    "japanese": ("\u5b66\u6821\u3067\u672c\u3092\u8aad\u307f\u307e\u3057\u305f\u3002\u660e\u65e5\u3082\u884c\u304d\u307e\u3059\u3001", 45_000),
    "tabs and commas": ("field,12\tvalue,7.5\tx\t", 30_000), "a word a line": ("word\nother\r\n", 25_000),
    "thai with signs": ("\u0e20\u0e32\u0e29\u0e32\u0e44\u0e17\u0e22/\u0e2a\u0e27\u0e22!", 20_000), "hex": ("a3f9,0b77;", 20_000)}


def test_an_edit_in_text_without_spaces_encodes_little():
    enc = tokens.PieceEncoder()
    for name, (unit, n) in ODD_TEXTS.items():
        text = (unit * (n // len(unit) + 1))[:n]
        tree = tokencount.TokenTree.of(text, enc)
        for at in (0, n // 2, n - 3):
            tree.edit(at, 1, "\u65b0")
            text = text[:at] + "\u65b0" + text[at + 1:]
        assert tree.text() == text and tree.total() == len(enc.ordinary(text))
        assert 0 < tree.chars_encoded < 0.01 * n, name


def test_cuts_are_starts_of_pretokens():
    """On characters of all planes and classes, against the tokenizer's own pattern."""
    import public_tokenizers
    import regex
    pattern = regex.compile(public_tokenizers.PATTERN)
    rng = random.Random(9)
    pool = [chr(c) for c in (*range(0, 0x250), *range(0x300, 0x310), *range(0x2000, 0x2030), *range(0x3000, 0x3060), *range(0x660, 0x66a),
                             *range(0x4e00, 0x4e20), *range(0xff00, 0xff20), 0x1680, 0x180e, 0xe000, 0x1f642, 0x20000, 0x1e900, 0xe0100)]
    usual = [" ", "  ", "\n", "'", "'ll", "'s", "a", "B", "1", "23", ".", ",", "\t", "\u3002", "\u5b66"]
    for _ in range(3000):
        text = "".join(rng.choices(pool, k=rng.randrange(1, 12)) if rng.random() < 0.5 else rng.choices(usual, k=rng.randrange(1, 20)))
        starts, at = tokens.cuts(text)
        real = {m.start() for m in pattern.finditer(text)}
        assert set(starts.tolist()) <= real
        assert at.tolist() == [len(text[:i].encode()) for i in starts.tolist()]


def test_characters_encoded_are_reported(spark):
    rows = [(1, "\u5b66\u6821\u3002" * 4000), (2, "plain words here " * 900)]
    edits = spark.createDataFrame([(1, 1, 6000, 1, "x"), (2, 1, 6000, 1, "x")], "doc_id long, edit_no int, start long, removed long, inserted string")
    for r in tokencount.edited(tokencount.built(docs(spark, rows)), edits).collect():
        assert 0 < r.n_chars_encoded < 60

import hashlib
import re

from millrun.llm import decontaminate
from millrun.llm.queries import op6_decontaminate
from tests.llm.helpers import AWKWARD, docs

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(rows, items, width):
    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - width + 1) if w else 0):
            windows.setdefault(tuple(w[i:i + width]), set()).add(item)
    sizes = {len(w) for w in windows}
    for doc, text in rows:
        w = words(text)
        hit, named = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if tuple(w[i:i + n]) in windows:
                    hit.update(range(i, i + n))
                    named |= windows[tuple(w[i:i + n])]
        named -= {None}
        sha = hashlib.sha256(",".join(sorted(map(str, named))).encode()).hexdigest()
        yield (doc, len(w), len(hit), len(named), sha, bool(hit))


ITEMS = [(1, "Quick brown FOX, jumps over!"), (2, "the lazy dog the quick brown fox"), (3, None), (4, "..."),
         (5, "日本語"), (None, "word"), (11, "Quick brown FOX, jumps over!"), (12, "the the the the the")]


def rows_of(df):
    return [tuple(r) for r in df.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()]


def test_awkward_and_slices(spark, monkeypatch):
    bench = spark.createDataFrame([(i, t, 0) for i, t in ITEMS], "item_id long, text string, doc_id int")
    rows = [*AWKWARD, (20, "the " * 9), (21, "a quick brown fox jumps over b")]
    want = sorted(map(str, brute(rows, ITEMS, 4)))
    assert sorted(map(str, rows_of(decontaminate.scan(docs(spark, rows), bench, 4)))) == want
    monkeypatch.setattr(decontaminate, "MAX_BENCHMARK_WORDS", 6)
    assert sorted(map(str, rows_of(decontaminate.scan(docs(spark, rows), bench, 4)))) == want


def test_empty_tables(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.scan(docs(spark, []), bench).count() == 0
    assert not any(r[5] for r in rows_of(decontaminate.scan(docs(spark, AWKWARD), bench)))


def test_query_is_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = rows_of(op6_decontaminate(spark, sf))
    assert sorted(got) == sorted(brute(rows, items, 10))
    assert any(r[5] for r in got)


def test_clean_documents_keep_all_columns(spark):
    bench = spark.createDataFrame([(1, "quick brown fox jumps")], "item_id long, text string")
    df = docs(spark, AWKWARD)
    out = decontaminate.is_clean(df, bench)
    assert out.schema == df.schema
    assert out.count() == len(AWKWARD) - 3


def test_a_large_benchmark_is_scanned_slice_by_slice(spark, monkeypatch):
    """No set passes the bound, one slice at a time is held, and results stay whole: windows of one
    item in several slices, overlapping hits of several passes, one item larger than the bound."""
    import random
    rng = random.Random(7)
    vocab = [f"w{i}" for i in range(30)]
    items = [(i, " ".join(rng.choices(vocab, k=rng.choice([0, 1, 3, 4, 9, 60])))) for i in range(25)] + [(None, "w1 w2 w3 w4"), (3, None)]
    rows = [(i, " ".join(rng.choices(vocab, k=rng.randrange(80)))) for i in range(60)]
    rows += [(100 + i, f"x {t} y {items[i + 1][1]} {t}") for i, (_, t) in enumerate(items[:20])] + [(None, items[5][1]), (7, None), (7, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = docs(spark, rows)
    want = sorted(map(str, brute(rows, items, 4)))
    monkeypatch.setattr(decontaminate, "MAX_BENCHMARK_WORDS", 200)
    sizes = []

    def watched(*given, real=decontaminate._slices):
        for windows in real(*given):
            sizes.append(sum(map(len, windows.items)))
            yield windows

    monkeypatch.setattr(decontaminate, "_slices", watched)
    assert sorted(map(str, rows_of(decontaminate.scan(df, bench, 4)))) == want
    assert len(sizes) > 5 and max(sizes) < 2 * 200
    clean = decontaminate.is_clean(df.withColumn("row", df.fp), bench, 4)
    dirty = {str((d, t)) for (d, t), r in zip(rows, brute(rows, items, 4)) if r[5]}
    assert sorted(str((r.doc_id, r.text)) for r in clean.collect()) == sorted(str(r) for r in rows if str(r) not in dirty)
    assert clean.columns == [*df.columns, "row"]

"""The pipeline against the stages' own brute-force versions."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from millrun.llm import common, toxicity, tokens
from millrun.llm.common import table
from tests.llm import test_decontaminate, test_packing, test_simhash, test_suffix_dedup
from tests.llm.helpers import AWKWARD
from tests.llm.helpers import docs as docs_of

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    given = {r.doc_id: r.text for r in docs.collect()}
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_dedup", "suffix_dedup", "decontamination", "packing"]
    stage = dict(corpus_pipeline.STAGES)

    clean = stage["toxicity"](spark, docs, SF)
    assert clean.schema == docs.schema
    model = toxicity.train(docs, table(spark, SF, "labels"))
    scorer = toxicity.Scorer(model)
    rows = {r.doc_id: r.text for r in clean.collect()}
    assert rows == {i: t for i, t in given.items() if scorer.score((t or "").encode()) < 0.3}
    assert len(rows) < len(given)

    single = stage["near_dedup"](spark, clean, SF)
    fps = [(i, test_simhash.brute_fp(t)) for i, t in rows.items()]
    comp = test_simhash.brute_components(fps, 4)
    rows = {r.doc_id: r.text for r in single.collect()}
    assert set(rows) == set(comp.values()) and single.schema == docs.schema

    cut = stage["suffix_dedup"](spark, single, SF)
    want = {r[0]: r for r in test_suffix_dedup.brute(list(rows.items()))}
    got = {r.doc_id: r for r in cut.collect()}
    assert cut.schema == docs.schema and set(got) == set(rows)
    for i, r in got.items():
        left = want[i][1] - want[i][2]
        assert 0 <= left - len(r.text.encode()) <= 6 * want[i][3]  # characters cut in two go whole
    rows = {i: r.text for i, r in got.items()}

    fair = stage["decontamination"](spark, cut, SF)
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    dirty = {r[0] for r in test_decontaminate.brute(list(rows.items()), items, 10) if r[5]}
    rows = {i: t for i, t in rows.items() if i not in dirty}
    assert {r.doc_id: r.text for r in fair.collect()} == rows and fair.schema == docs.schema

    library = tokens.PieceEncoder()._tok
    test_packing.check(stage["packing"](spark, fair, SF).collect(), list(rows.items()), library, 2048)


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(out.columns) and out.count() > 50


#: Names that operators use inside, beside those of the helpers' table.
CLASHING = ["id", "row", "rest", "body", "pack", "slice", "n", "__id", "__hash", "__first", "root", "window", "h", "of", "text_hash"]


@pytest.fixture(scope="module")
def small(spark):
    """A folder of labels and benchmark items that meet the awkward texts."""
    d = tempfile.mkdtemp(prefix="millrun-test-")
    labels = [(i, 1, int(i % 2)) for i in range(1, 12)] + [(None, 0, 1), (5, 1, 0), (8, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    items = [(1, "lazy dog the QUICK brown fox jumps over the lazy"), (2, None), (3, ""), (None, "no such words here")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def clashing(df):
    for c in CLASHING:
        df = df.withColumn(c, F.lit(c))
    return df


def keyed(df):
    return sorted(str((r.doc_id, r.text)) for r in df.collect())


def test_stages_on_awkward_rows_and_clashing_columns(spark, small):
    rows = [*AWKWARD, AWKWARD[0], (20, "another text, long enough to be shared by two documents of this table, word by word"), (21, None),
            (22, "first: another text, long enough to be shared by two documents of this table, word by word"), (None, None)]
    given = clashing(docs_of(spark, rows))
    stage = dict(corpus_pipeline.STAGES)
    out = {n: stage[n](spark, given, small) for n in ("toxicity", "near_dedup", "suffix_dedup", "decontamination")}
    for n, df in out.items():
        assert df.schema == given.schema, n
        assert all(r[c] == c for r in df.collect() for c in CLASHING), n
    # nothing is learned from these labels, so all documents stay
    assert keyed(out["toxicity"]) == keyed(given)
    comp = test_simhash.brute_components([(i, test_simhash.brute_fp(t)) for i, t in rows], 4)
    kept = [(r.doc_id, r.text) for r in out["near_dedup"].collect()]
    assert sorted(i for i, _ in kept) == sorted(set(comp.values()))
    assert all(comp[test_simhash.brute_fp(t)] == i for i, t in kept)
    got = out["suffix_dedup"].collect()
    assert len(got) == len(rows) and all(r.text is not None and r.n_chars == len(r.text) for r in got)
    left = sum(r[1] - r[2] for r in test_suffix_dedup.brute(rows))
    assert left - 30 <= sum(len(r.text.encode()) for r in got) <= left  # characters cut in two go whole
    items = [(r.item_id, r.text) for r in table(spark, small, "benchmark").collect()]
    dirty = [r[5] for r in test_decontaminate.brute(rows, items, 10)]
    assert keyed(out["decontamination"]) == sorted(str(r) for r, bad in zip(rows, dirty) if not bad) and any(dirty)
    library = tokens.PieceEncoder()._tok
    packed = stage["packing"](spark, given, small).collect()
    assert len({(r.doc_id, r.piece) for r in packed}) <= len(packed) and sum(r.length for r in packed) == sum(
        len(library.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in rows)


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_on_an_empty_table(spark, small, name, stage):
    given = clashing(docs_of(spark, []))
    out = stage(spark, given, small)
    assert out.count() == 0 and (name == "packing" or out.schema == given.schema)


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_with_empty_side_tables(spark, name, stage):
    d = tempfile.mkdtemp(prefix="millrun-test-")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    rows = [(1, "a b c"), (2, "d e f"), (3, None)]
    assert stage(spark, docs_of(spark, rows), d).count() == 3


def test_equal_rows_with_other_columns_keep_a_defined_row(spark):
    from millrun.llm import simhash
    df = docs_of(spark, [(1, "same text of both rows")]).withColumn("source", F.explode(F.array(*[F.lit(f"s{k}") for k in range(9)])))
    kept = {simhash.representatives(df.repartition(n)).collect()[0].source for n in (1, 4, 7)}
    assert len(kept) == 1


def test_scratch_tables_are_removed(spark):
    made = common.written(spark.range(3), "some")
    folder = common._MADE[-1].removeprefix("file:")
    assert made.count() == 3 and os.path.isdir(folder)
    common.clear_scratch(spark)
    assert not os.path.exists(folder) and not common._MADE

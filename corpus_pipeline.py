"""Corpus pipeline: toxicity, SimHash near-dedup, suffix-array dedup, decontamination, packing.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is
written as Parquet and reread as the next stage's documents. All but the last return
the columns that they were given, others beside those of ``documents`` included
and whatever they are called.

Defined cases of all stages: an empty table gives an empty table; a null text is an
empty one; rows with a null id are documents like any other; repeated rows are
documents each, as far as a stage doesn't drop them as duplicates. Each stage's own
cases are in its docstring.

``python corpus_pipeline.py SF_DIR OUT`` writes the result and removes the scratch tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrun.llm import decontaminate, packing, simhash, suffix_dedup, toxicity
from millrun.llm.common import table, written

#: No SQL: toxicity is a trained model and packing needs a tokenizer.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the noisy-or model, trained as in its own query, rejects go.

    A document without a sentence (null, empty or only signs) stays, as do all documents
    where the labels teach nothing: none, of one class, or with nothing that tells the classes apart."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.not_toxic(docs, model, threshold=0.3)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked fingerprints the document with the smallest id stays.

    Texts without words (null, empty, white space) have one fingerprint and so are one
    group. Of repeated rows one stays. A null id is larger than any other; of a group of
    null ids only, a row of each fingerprint stays. An id on unlinked texts keeps a row of each."""
    return simhash.representatives(docs, shingle=4, max_bits=4)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes covered by a string of 50 bytes that an earlier document has too go.

    No row goes, a text may become empty. A null text becomes empty; ``n_chars`` follows the
    text. A null id is later than any other; rows with one id don't remove from each other."""
    return suffix_dedup.deduplicated(docs, length=50)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of ten words of a benchmark item go.

    A document without words stays, as do all where no item has words; a benchmark of any
    size is used whole."""
    return decontaminate.is_clean(docs, table(spark, sf_dir, "benchmark"), width=10)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The remaining documents as pieces of sequences of 2048 tokens.

    An empty or null text is one piece, the end mark; repeated rows are packed each."""
    return packing.packed(docs, capacity=2048)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("suffix_dedup", drop_repeats),
    ("decontamination", drop_benchmark),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


def main(argv: list[str]) -> int:
    from millrun.llm.common import clear_scratch
    from millrun.session import get_session
    spark = get_session(profile="cluster")
    run(spark, argv[0]).write.mode("overwrite").parquet(argv[1])
    clear_scratch(spark)
    return 0


if __name__ == "__main__":
    import sys
    sys.exit(main(sys.argv[1:]))

"""Small document tables with the awkward cases every operator must survive."""

from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()),
    # names that operators use inside
    T.StructField("fp", T.StringType()), T.StructField("score", T.StringType()),
    T.StructField("key", T.StringType()), T.StructField("component_id", T.StringType()),
])


def docs(spark, rows):
    """``rows``: ``(doc_id, text)``; all other columns hold clashing junk."""
    return spark.createDataFrame(
        [(i, t, "en", "s", len(t) if t else None, "x", "y", "z", "w") for i, t in rows], DOCS)


AWKWARD = [
    (1, "The quick brown fox jumps over the lazy dog. " * 3), (2, None), (3, ""), (4, " \t\n"), (5, "word"),
    (None, "The quick brown fox jumps over the lazy dog. " * 3), (7, "Ünïcode straße 日本語 🙂 text here and there"),
    (8, "long " * 20_000), (1, "The quick brown fox jumps over the lazy dog. " * 3), (9, "<|endoftext|> a   b \n\n c"),
    (10, " nbsp\x1cfs \x85 nel  two   three    four"),
]

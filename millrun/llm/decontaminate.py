"""Benchmark decontamination (operator 6): broadcast set of normalised test n-grams.

Words are ``[0-9a-z]`` and non-ASCII runs after ASCII lower-casing. A benchmark
item gives every window of ``width`` words, or itself when it is shorter. The
windows of all items are the broadcast set. A
training text is scanned in one pass: words become ids of the benchmark's
vocabulary, runs of known words are hashed with a rolling polynomial, and every
hash hit is verified word by word.

The set is bounded by ``MAX_BENCHMARK_WORDS``. The windows of a larger benchmark are dealt
out by their hashes to as many slices as keep the bound. One slice at a time reaches the
driver, is broadcast, scanned for and destroyed; the hits of each pass are written,
and at the end a document's hits of all passes are put together.

Defined cases: null or empty texts have no words; an item without words gives no
window; an item with a null id marks words but is not counted or listed; equal
items are listed each; repeated rows stay repeated; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from millrun.llm.common import by_doc, free_names, ship, utf8, written

#: Words of the benchmark held by one broadcast set.
MAX_BENCHMARK_WORDS = 2_000_000
#: Words of a text, before lower-casing, as Spark counts them.
_WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"

#: Every byte to its lower case, or to a space if it can't be part of a word.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
              for c in range(256))
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words(data: bytes) -> list[bytes]:
    return data.translate(_FOLD).split()


class Windows:
    """The benchmark's windows: vocabulary ids, hashes by width, and verified tuples."""

    def __init__(self, items: list[tuple[object, bytes]], width: int = 10):
        self.vocab: dict[bytes, int] = {}
        self.items: dict[tuple, set] = {}
        for item_id, data in items:
            ids = [self.vocab.setdefault(w, len(self.vocab) + 1) for w in words(data)]
            n = min(width, len(ids))
            for i in range(len(ids) - n + 1 if n else 0):
                named = self.items.setdefault(tuple(ids[i:i + n]), set())
                if item_id is not None:
                    named.add(item_id)
        by_width: dict[int, list[tuple]] = {}
        for w in self.items:
            by_width.setdefault(len(w), []).append(w)
        self.hashes = {n: np.unique(_rolled(np.array(ws, dtype=np.int64).reshape(len(ws), n).T))
                       for n, ws in by_width.items()}

    def scan(self, data: bytes):
        """Number of words, mask of hit words, ids of the items found."""
        found = words(data)
        hit = np.zeros(len(found) + 1, dtype=np.int64)
        get = self.vocab.get
        ids = np.array([get(w, 0) for w in found], dtype=np.int64)
        known = np.r_[0, np.cumsum(ids > 0)]
        named: set = set()
        for n, hashes in self.hashes.items():
            at = np.flatnonzero(known[n:] - known[:-n] == n) if len(ids) >= n else np.empty(0, np.int64)
            if not len(at):
                continue
            h = _rolled([ids[at + k] for k in range(n)])
            place = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            for i in at[hashes[place] == h].tolist():
                items = self.items.get(tuple(ids[i:i + n].tolist()))
                if items is not None:
                    named |= items
                    hit[i] += 1
                    hit[i + n] -= 1
        return len(found), np.cumsum(hit)[:-1] > 0, named


def _rolled(columns) -> np.ndarray:
    h = np.zeros(len(columns[0]), dtype=np.uint64)
    for c in columns:
        h = h * _BASE + c.astype(np.uint64)
    return h


def _benchmark_words(benchmark: DataFrame) -> int:
    return benchmark.agg(F.sum(F.regexp_count(F.coalesce("text", F.lit("")), F.lit(_WORD)).cast("long"))).first()[0] or 0


def _all_windows(benchmark: DataFrame, width: int) -> Windows:
    """The set of a benchmark whose size has been checked."""
    rows = benchmark.select("item_id", utf8(F.col("text")).alias("body")).collect()
    return Windows([(r["item_id"], bytes(r["body"])) for r in rows], width)


def _slices(benchmark: DataFrame, width: int, total: int):
    """The windows of a large benchmark in sets of at most about ``MAX_BENCHMARK_WORDS`` words, one at a time."""
    n = -(-total * width // MAX_BENCHMARK_WORDS)

    def cut(batches):
        for batch in batches:
            items, texts = batch.columns
            for i, data in enumerate(texts.to_pylist()):
                own = words(data)
                size = min(width, len(own))
                texts_of = list({b" ".join(own[k:k + size]) for k in range(len(own) - size + 1 if size else 0)})
                yield pa.RecordBatch.from_arrays([items.take(pa.array([i] * len(texts_of), pa.int64())), pa.array(texts_of, pa.binary())],
                                                 ["item_id", "window"])

    kind = benchmark.schema["item_id"].dataType.simpleString()
    windows = benchmark.select("item_id", utf8(F.col("text")).alias("body")).mapInArrow(cut, f"item_id {kind}, window binary")
    windows = written(windows.withColumn("slice", F.pmod(F.xxhash64("window"), F.lit(n)).cast("int")), "windows")
    for k in range(n):
        rows = windows.filter(F.col("slice") == k).select("item_id", "window").collect()
        yield Windows([(r["item_id"], bytes(r["window"])) for r in rows], width)


def _runs(mask: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.r_[0, mask.astype(np.int8), 0]))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def _hits(texts: DataFrame, benchmark: DataFrame, width: int, total: int) -> DataFrame:
    """``row, runs, items`` of the rows of ``texts`` (``row, body``) that hold windows, a pass for each slice."""
    spark = texts.sparkSession
    kind = benchmark.schema["item_id"].dataType.simpleString()
    schema = f"row long, runs array<struct<start:int,end:int>>, items array<{kind}>"
    found = spark.createDataFrame([], schema)
    columns = to_arrow_schema(found.schema).remove(0)
    for windows in _slices(benchmark, width, total):
        shared = spark.sparkContext.broadcast(windows)

        def run(batches):
            for batch in batches:
                for part in by_doc(batch):
                    at, runs, items = [], [], []
                    for i, data in enumerate(part.column(1).to_pylist()):
                        _, mask, named = shared.value.scan(data)
                        if mask.any():
                            at.append(i)
                            runs.append([{"start": a, "end": b} for a, b in _runs(mask)])
                            items.append(list(named))
                    whole = pa.Table.from_pydict({"runs": runs, "items": items}, schema=columns)
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at, pa.int64())),
                                                      *[c.combine_chunks() for c in whole.columns]], ["row", "runs", "items"])

        found = found.unionByName(written(texts.mapInArrow(run, schema), "hits"))
        shared.destroy()
    return found


def scan(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` per document row."""
    spark = docs.sparkSession
    ship(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
    names = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]

    def result(ids, rows):
        """Rows of ``(words, hit words, items)``."""
        listed = [",".join(sorted(map(str, named))) for _, _, named in rows]
        return pa.RecordBatch.from_arrays(
            [ids, pa.array([n for n, _, _ in rows], pa.int64()), pa.array([h for _, h, _ in rows], pa.int64()),
             pa.array([len(x) for _, _, x in rows], pa.int64()),
             pa.array([hashlib.sha256(x.encode()).hexdigest() for x in listed], pa.string()),
             pa.array([h > 0 for _, h, _ in rows], pa.bool_())], names)

    total = _benchmark_words(benchmark)
    if total <= MAX_BENCHMARK_WORDS:
        shared = spark.sparkContext.broadcast(_all_windows(benchmark, width))

        def run(batches):
            for batch in batches:
                for part in by_doc(batch):
                    rows = [shared.value.scan(data) for data in part.column(1).to_pylist()]
                    yield result(part.column(0), [(n, int(mask.sum()), named) for n, mask, named in rows])

        return docs.select("doc_id", utf8(F.col("text")).alias("body")).mapInArrow(run, schema)

    def together(batches):
        for batch in batches:
            rows = []
            for n, runs, items in zip(*[batch.column(c).to_pylist() for c in ("n", "runs", "items")]):
                end = covered = 0
                for r in sorted(r["start"] << 32 | r["end"] for some in runs or [] for r in some):
                    a, b = r >> 32, r & 0xFFFFFFFF
                    covered += max(0, b - max(a, end))
                    end = max(end, b)
                rows.append((n, covered, {x for some in items or [] for x in some}))
            yield result(batch.column("doc_id"), rows)

    texts = written(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", utf8(F.col("text")).alias("body"),
                                F.regexp_count(F.coalesce("text", F.lit("")), F.lit(_WORD)).alias("n")), "texts")
    found = _hits(texts.select("row", "body"), benchmark, width, total)
    found = found.groupBy("row").agg(F.collect_list("runs").alias("runs"), F.collect_list("items").alias("items"))
    return texts.select("row", "doc_id", "n").join(found, "row", "left").mapInArrow(together, schema)


def is_clean(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """The documents (all their columns) in which no benchmark window occurs.

    The scan runs in the same pass that reads the text, so nothing is joined or
    shuffled: the operator's rows ride along as a filter over whole rows. Only for a
    benchmark in slices are the rows found in all passes joined away."""
    spark = docs.sparkSession
    ship(spark)
    total = _benchmark_words(benchmark)
    if total > MAX_BENCHMARK_WORDS:
        row = free_names(docs, "row")[0]
        held = written(docs.withColumn(row, F.monotonically_increasing_id()), "documents")
        found = _hits(held.select(F.col(row).alias("row"), utf8(F.col("text")).alias("body")), benchmark, width, total)
        return held.join(found.select(F.col("row").alias(row)).distinct(), row, "left_anti").drop(row)
    shared = spark.sparkContext.broadcast(_all_windows(benchmark, width))
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            for part in by_doc(batch):
                keep = [not shared.value.scan((t or "").encode())[1].any() for t in part.column(at).to_pylist()]
                yield part.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)

"""Substring dedup (operator 11): words covered by a window that an earlier document has too.

A window is ``length`` consecutive words of one document. A word goes if a window that
covers it also starts in a document with a smaller id. Repeats are found in suffix
trees that are partitioned by variable-length prefixes:

1. Suffixes. Every window has an anchor, the least-hashed run of ``GRAM`` words among
   those that leave ``reach(length)`` words (half a window) after their start, so equal
   windows have equal anchors and the tree's branches can be told apart by a prefix
   of up to that many words from the anchor on. Windows of one anchor are
   consecutive and travel as one string, the anchor's context: words before the
   anchor, and the suffix from it on. An anchor whose prefix of full length is seen
   in one document only can't be in a repeat (a hash may let too many in, never too few).
2. Prefixes. A suffix belongs to the prefix of its first word; prefixes whose contexts
   exceed ``GROUP_BYTES`` are extended to two words, four and so on, until each
   prefix's group fits in memory. Small groups share a task.
3. Subtrees. A task sorts the suffixes of its group that start a window, by ranks of
   runs of 1, 2, 4, ... words, and gets the common words of neighbours from the same
   ranks: the tree in array form, its internal nodes being the runs of neighbours
   with a common prefix. The suffixes below a node at least ``length`` words deep
   share a window: a repeat. The least id below the node keeps it.
4. A group that is too large even by its longest prefix (a passage that very many
   packs have, in contexts that differ) is resolved by its single windows, the
   prefixes of full length: the least id of each is an aggregate, combined before the
   shuffle, so nothing of it is gathered in one place.

Words are compared as bytes in the trees, and in step 4 by SHA-256. Documents travel
in packs of about four megabytes (a longer one is a pack of its own).

Defined cases: a null text has no words; a null id counts as larger than any other and
not smaller than another null; rows with the same id don't remove from each other;
texts shorter than a window stay whole; extra columns are kept by ``deduplicated``
and otherwise ignored. A document's words take about 150 bytes each of a task's memory.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrun.llm.common import ship, written
from millrun.llm.packs import pack_rows, packed

#: Words of an anchor; bytes of contexts in one group, and most prefixes that may be over it (so the list of them is bounded).
GRAM, GROUP_BYTES, MOST_PREFIXES = 3, 8 << 20, 1 << 20
#: Shares that a single window's rows are dealt out to when they meet its least id.
SALTS = 16
#: Bytes of a word hashed eight at a time; longer words go through another hash.
LONG_WORD = 256

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_MASK = np.array([0, *[(1 << (8 * k)) - 1 for k in range(1, 9)]], dtype=np.uint64)
_PLACE = np.uint64((1 << 30) - 1)
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def reach(length: int) -> int:
    """Words of a suffix that every window of its anchor has: the longest prefix."""
    return length // 2


def levels(length: int) -> list[int]:
    """Lengths of prefixes, in words."""
    out = [1]
    while 2 * out[-1] < reach(length):
        out.append(2 * out[-1])
    return out + [reach(length)] if out[-1] < reach(length) else out


# ---- words, anchors and contexts of a pack ----------------------------------------

def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = (a * _A + b) * _B
    return h ^ (h >> np.uint64(31))


def _word_hashes(text: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(text) + 1,), dtype="<u8", buffer=padded.data, strides=(1,))
    h = _mixed(size.astype(np.uint64), eight[start] & _MASK[np.minimum(size, 8)])
    more, k = np.flatnonzero(size > 8), 8
    while len(more) and k < LONG_WORD:
        h[more] = _mixed(h[more], eight[start[more] + k] & _MASK[np.minimum(size[more] - k, 8)])
        more, k = more[size[more] > k + 8], k + 8
    for i in more.tolist():
        word = text[start[i]:start[i] + size[i]].tobytes()
        h[i] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
    return h


class Pack:
    """A pack's words, one space after each, and the runs of windows with one anchor."""

    def __init__(self, ids: bytes, sizes: bytes, body: bytes, length: int):
        self.ids, self.length = np.frombuffer(ids, "<i8"), length
        ends = np.cumsum(np.frombuffer(sizes, "<i8"))
        text = np.insert(np.frombuffer(zstandard.decompress(body), np.uint8), ends, 32)  # words end with their document
        space = _SPACE[text]
        after = np.r_[True, space[:-1]]
        begins = np.flatnonzero(~space & after)
        #: words before each document, and its own
        self.first = np.searchsorted(begins, np.r_[0, ends[:-1] + np.arange(1, len(ends))]) if len(ends) else np.empty(0, np.int64)
        self.n_words = np.diff(np.r_[self.first, len(begins)])
        text[space] = 32
        self.text = text[~(space & after)]
        end = np.flatnonzero(self.text == 32)
        self.start = np.r_[0, end + 1]  # of each word, and the end of all
        self.raw = self.text.tobytes()
        self._windows()

    def _windows(self) -> None:
        length, n = self.length, len(self.start) - 1
        h = _word_hashes(self.text, self.start[:-1], np.diff(self.start) - 1)
        longest, width = reach(length), length - reach(length) + 1  # of a prefix; places of an anchor in a window
        none = np.empty(0, np.int64)
        self.begin, self.end, self.anchor, self.doc, self.key = none, none, none, none, np.empty(0, np.uint64)
        if n < length:
            return
        span, prefix = 1, h
        while span < longest:  # hashes of the runs of `longest` words
            step = min(span, longest - span)
            if span == 2:
                gram = _mixed(prefix[:-1], prefix[1:])
            prefix, span = _mixed(prefix[:-step], prefix[step:]), span + step
        n -= length - 1  # windows
        key = (gram[:n + width - 1] & ~_PLACE) | np.arange(n + width - 1, dtype=np.uint64)
        span = 1
        while span < width:
            step = min(span, width - span)
            key, span = np.minimum(key[:-step], key[step:]), span + step
        anchor = (key & _PLACE).astype(np.int64)
        room = np.maximum(self.n_words - length + 1, 0)
        cut = np.zeros(n + 1, bool)
        cut[0] = True
        cut[1:n] = anchor[1:] != anchor[:-1]
        bounds = np.concatenate([self.first, self.first + room])
        cut[bounds[bounds < n]] = True
        begin = np.flatnonzero(cut[:n])
        end = np.r_[begin[1:], n]
        doc = np.searchsorted(self.first, begin, side="right") - 1
        use = begin < (self.first + room)[doc]
        self.begin, self.end, self.doc = begin[use], end[use], doc[use]
        self.anchor = anchor[self.begin]
        self.key = prefix[self.anchor].astype(np.int64)

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """The different anchors' hashes, and of how many documents each is, up to two."""
        if not len(self.key):
            return self.key.astype(np.int64), np.empty(0, np.int64)
        ids = self.ids[self.doc]
        by = np.argsort(self.key, kind="stable")
        key, own = self.key[by], ids[by]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        return key[first], 1 + (np.minimum.reduceat(own, first) != np.maximum.reduceat(own, first)).astype(np.int64)

    def contexts(self, keys: np.ndarray):
        """Runs ``(which context, begin, end, doc id)`` of the anchors in ``keys``, and of the
        different contexts ``(words before, words from the anchor on, least doc id)``."""
        use = np.flatnonzero(np.isin(self.key, keys))
        begin, end, ids = self.begin[use], self.end[use], self.ids[self.doc[use]]
        left, middle = self.start[begin].tolist(), self.start[self.anchor[use]].tolist()
        right = (self.start[end + (self.length - 1)] - 1).tolist()
        raw, known, own = self.raw, {}, np.empty(len(use), np.int64)
        for i, span in enumerate(zip(left, middle, right)):
            own[i] = known.setdefault((raw[span[0]:span[1]], raw[span[1]:span[2]]), len(known))
        least = np.full(len(known), np.iinfo(np.int64).max)
        np.minimum.at(least, own, ids)
        return own, begin, end, ids, list(known), least


def _shared(packs: DataFrame, length: int) -> DataFrame:
    """``pack, keys``: the anchors of a pack that more than one document has."""

    def run(batches):
        for batch in batches:
            for row in pack_rows(batch):
                key, docs = Pack(row["ids"], row["sizes"], row["body"], length).anchors()
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), row["pack"])), pa.array(key), pa.array(docs)],
                                                 ["pack", "key", "docs"])

    anchors = packs.select("pack", "ids", "sizes", "body").mapInArrow(run, "pack long, key long, docs long")
    # an anchor has one row a pack, so none is hot
    seen = anchors.withColumn("seen", F.sum("docs").over(Window.partitionBy("key"))).filter("seen > 1")
    return seen.groupBy("pack").agg(F.collect_list("key").alias("keys"))


def _contexts(packs: DataFrame, length: int) -> DataFrame:
    """``pack, no, left, right, id``: the different contexts of the shared anchors of each pack, numbered."""

    def run(batches):
        for batch in batches:
            for row in pack_rows(batch):
                _, _, _, _, texts, least = Pack(row["ids"], row["sizes"], row["body"], length).contexts(np.array(row["keys"], np.int64))
                for a in range(0, len(texts), 50_000):
                    some = texts[a:a + 50_000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(some), row["pack"])), pa.array(np.arange(a, a + len(some), dtype=np.int32)),
                         pa.array([x for x, _ in some], pa.binary()).cast(pa.string()),
                         pa.array([x for _, x in some], pa.binary()).cast(pa.string()), pa.array(least[a:a + 50_000])],
                        ["pack", "no", "left", "right", "id"])

    return packs.select("pack", "ids", "sizes", "body", "keys").mapInArrow(
        run, "pack long, no int, left string, right string, id long")


# ---- prefixes -----------------------------------------------------------------------

def _grouped(contexts: DataFrame, length: int) -> tuple[DataFrame, DataFrame, int]:
    """``contexts`` with the ``prefix`` of their group; those whose group is never small enough; and how many tasks share the groups."""
    weight = F.octet_length("left") + F.octet_length("right") + 32
    total = contexts.agg(F.sum(weight)).first()[0] or 0
    most = max(GROUP_BYTES, total // MOST_PREFIXES, 1)

    def prefix(words: int):
        return F.substring_index("right", " ", words)

    every = levels(length)
    out = contexts.withColumn("prefix", prefix(every[0])).withColumn("open", F.lit(True))
    for k, more in zip(every, [*every[1:], None]):
        large = (out.filter("open").groupBy(F.xxhash64("prefix").alias("large")).agg(F.sum(weight).alias("n"))
                 .filter(F.col("n") > most).select("large"))
        large = written(large, f"prefixes-{k}")
        if large.isEmpty():
            out = out.withColumn("open", F.lit(False))
            break
        # at most total / most, so MOST_PREFIXES, rows
        out = out.join(F.broadcast(large), F.col("open") & (F.xxhash64("prefix") == F.col("large")), "left")
        out = out.withColumn("open", F.col("large").isNotNull()).drop("large")
        if more:
            out = out.withColumn("prefix", F.when(F.col("open"), prefix(more)).otherwise(F.col("prefix")))
    return out.filter("NOT open").drop("open"), out.filter("open").drop("open", "prefix"), -(-2 * total // most)


# ---- subtrees -----------------------------------------------------------------------

class Subtree:
    """Suffixes of ``words`` (integers) that start at ``starts``, in order, as an array with common prefixes.

    Orders and common prefixes hold for the first ``length`` words, which every such suffix has."""

    def __init__(self, words: np.ndarray, starts: np.ndarray, length: int):
        words = np.concatenate([words, np.zeros(length, words.dtype)])
        ranks, span = [(1, np.unique(words, return_inverse=True)[1])], 1
        while 2 * span <= length:
            r = ranks[-1][1]
            ranks.append((2 * span, np.unique(r[:-span] << 32 | r[span:], return_inverse=True)[1]))
            span *= 2
        last = ranks[-1][1]
        self.order = starts[np.argsort(last[starts] << 32 | last[starts + (length - span)], kind="stable")]
        a, b = self.order[:-1], self.order[1:]
        self.common = np.zeros(len(a), np.int64)
        for span, r in reversed(ranks):
            x, y = np.minimum(a + self.common, len(r) - 1), np.minimum(b + self.common, len(r) - 1)
            self.common += span * (r[x] == r[y])

    def deep(self, depth: int) -> np.ndarray:
        """Where the suffixes below each node of at least that depth begin; a suffix alone is its own."""
        return np.flatnonzero(np.r_[True, self.common < depth]) if len(self.order) else np.empty(0, np.int64)


def least_ids(texts: list[tuple[bytes, bytes]], ids: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Per window of each different context, in order, the least id of its class; and windows per context."""
    vocabulary: dict[bytes, int] = {}
    place = vocabulary.setdefault
    lists = [b"".join(t).split(b" ") for t in texts]
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    words = np.fromiter((place(w, len(vocabulary)) for some in lists for w in some), np.int64, sizes.sum())
    # a word of its own ends each context
    base = np.cumsum(sizes + 1) - sizes - 1
    full = np.empty(sizes.sum() + len(sizes), np.int64)
    full[base + sizes] = len(vocabulary) + 1 + np.arange(len(sizes))
    inside = np.ones(len(full), bool)
    inside[base + sizes] = False
    full[inside] = words
    n = sizes - length + 1
    first = np.cumsum(n) - n
    starts = np.repeat(base - first, n) + np.arange(n.sum())
    tree = Subtree(full, starts, length)
    window = np.empty(len(full), np.int64)
    window[starts] = np.arange(len(starts))
    below = window[tree.order]
    nodes = tree.deep(length)
    owner = np.repeat(ids, n)
    least = np.minimum.reduceat(owner[below], nodes)
    out = np.empty(len(starts), np.int64)
    out[below] = np.repeat(least, np.diff(np.r_[nodes, len(below)]))
    return out, n


_FOUND = "pack long, no int, start int, end int"


def _subtrees(grouped: DataFrame, tasks: int, length: int) -> DataFrame:
    """Runs of windows of the packs' contexts that start in earlier documents."""

    def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        known: dict[tuple[bytes, bytes], int] = {}
        lefts, rights = (group.column(c).cast(pa.binary()).to_pylist() for c in ("left", "right"))
        own = np.fromiter((known.setdefault(t, len(known)) for t in zip(lefts, rights)), np.int64, group.num_rows)
        ids = group.column("id").to_numpy()
        least = np.full(len(known), np.iinfo(np.int64).max)
        np.minimum.at(least, own, ids)
        found, n = least_ids(list(known), least, length)
        first, reps = (np.cumsum(n) - n)[own], n[own]
        who = np.repeat(np.arange(len(own)), reps)
        step = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
        covered = found[first[who] + step] < ids[who]
        new = np.r_[True, who[1:] != who[:-1]]  # a run ends with its context
        start = np.flatnonzero(covered & (new | ~np.r_[False, covered[:-1]]))
        last = np.flatnonzero(covered & (np.r_[new[1:], True] | ~np.r_[covered[1:], False]))
        return pa.table({"pack": group.column("pack").take(pa.array(who[start])), "no": group.column("no").take(pa.array(who[start])),
                         "start": pa.array(step[start].astype(np.int32)), "end": pa.array((step[last] + 1).astype(np.int32))})

    bins = F.pmod(F.xxhash64("prefix"), F.lit(max(tasks, 1))).alias("bin")
    return grouped.select(bins, "pack", "no", "left", "right", "id").groupBy("bin").applyInArrow(run, _FOUND)


def _whole(contexts: DataFrame, length: int) -> DataFrame:
    """As ``_subtrees`` for contexts in too large groups, by their single windows."""

    def run(batches):
        for batch in batches:
            own, at, key = [], [], []
            for i, text in enumerate(zip(batch.column("left").to_pylist(), batch.column("right").to_pylist())):
                words = "".join(text).encode().split(b" ")
                for k in range(len(words) - length + 1):
                    own.append(i)
                    at.append(k)
                    key.append(hashlib.sha256(b" ".join(words[k:k + length])).digest())
            take = pa.array(own, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("pack").take(take), batch.column("no").take(take),
                                              batch.column("id").take(take), pa.array(at, pa.int32()), pa.array(key, pa.binary())],
                                             ["pack", "no", "id", "start", "window"])

    windows = written(contexts.select("pack", "no", "left", "right", "id").mapInArrow(
        run, "pack long, no int, id long, start int, window binary"), "windows")
    least = windows.groupBy("window").agg(F.min("id").alias("least"), F.max("id").alias("most")).filter("least < most")
    least = least.select("window", "least", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    return windows.withColumn("salt", F.pmod("pack", F.lit(SALTS)).cast("int")).join(least, ["window", "salt"]).filter(
        "least < id").select("pack", "no", "start", (F.col("start") + 1).alias("end"))


# ---- the documents again --------------------------------------------------------------

def _decided(docs: DataFrame, length: int) -> DataFrame:
    """Packs with the shared anchors and findings that decide their words."""
    if reach(length) < GRAM:
        raise ValueError(f"length must be {2 * GRAM} or more")
    ship(docs.sparkSession)
    packs = written(packed(docs), "packs")
    shared = written(_shared(packs, length).withColumnRenamed("pack", "of"), "shared")
    contexts = written(_contexts(packs.join(shared, F.col("pack") == F.col("of")).drop("of"), length), "contexts")
    grouped, large, tasks = _grouped(contexts, length)
    found = _subtrees(grouped, tasks, length).unionByName(_whole(large, length))
    found = found.groupBy("pack").agg(F.collect_list(F.struct("no", "start", "end")).alias("found")).withColumnRenamed("pack", "with")
    small = shared.join(written(found, "found"), F.col("of") == F.col("with"), "left").drop("with")
    return packs.join(small, F.col("pack") == F.col("of"), "left").drop("of")


def _covered(batch, k: int, row, length: int) -> tuple[Pack, np.ndarray]:
    """The pack and, per word, whether it goes."""
    pack = Pack(row["ids"], row["sizes"], row["body"], length)
    own, begin, end, ids, _, least = pack.contexts(np.array(row["keys"] or [], np.int64))
    mark = np.zeros(len(pack.start), np.int64)
    late = ids > least[own] if len(own) else np.empty(0, bool)  # an equal context stands earlier in this pack
    np.add.at(mark, begin[late], 1)
    np.add.at(mark, end[late] + (length - 1), -1)
    found = batch.column("found")[k].values
    if found is not None and len(found):
        no, a, b = (found.field(c).to_numpy() for c in ("no", "start", "end"))
        by = np.argsort(no, kind="stable")
        no, a, b = no[by], a[by].astype(np.int64), b[by].astype(np.int64)
        rest = np.flatnonzero(~late)
        i = np.searchsorted(no, own[rest])
        n = np.searchsorted(no, own[rest], side="right") - i
        who = np.repeat(rest, n)
        at = np.repeat(i - (np.cumsum(n) - n), n) + np.arange(n.sum())
        np.add.at(mark, begin[who] + a[at], 1)
        np.add.at(mark, begin[who] + b[at] + (length - 1), -1)
    return pack, np.cumsum(mark)[:-1] > 0


def _kept(pack: Pack, gone: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The remaining words with a space after each, and where each document's end."""
    size = np.diff(pack.start)
    kept = pack.text[np.repeat(~gone, size)].tobytes()
    before = np.r_[0, np.cumsum(np.where(gone, 0, size))]
    return kept, before[np.r_[pack.first, len(size)]]


def _each(docs: DataFrame, length: int, make, schema: str) -> DataFrame:
    """``make(pack, gone, rest)`` for every pack, as rows."""
    decided = _decided(docs, length)

    def run(batches):
        for batch in batches:
            for k, row in enumerate(r for r in pack_rows(batch.drop_columns(["found"]))):
                pack, gone = _covered(batch, k, row, length)
                yield make(pack, gone, batch.column("rest")[k].values)

    return decided.mapInArrow(run, schema)


def report(docs: DataFrame, length: int = 50) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` per document row; the kept words are joined by a space."""

    def make(pack: Pack, gone: np.ndarray, rest) -> pa.RecordBatch:
        kept, at = _kept(pack, gone)
        total = np.r_[0, np.cumsum(gone)]
        sha = [hashlib.sha256(kept[a:max(b - 1, a)]).hexdigest() for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
        return pa.RecordBatch.from_arrays(
            [rest.field("doc_id"), pa.array(pack.n_words.astype(np.int64)),
             pa.array(total[pack.first + pack.n_words] - total[pack.first]), pa.array(sha)],
            ["doc_id", "n_words", "n_removed", "kept_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return _each(docs.select("doc_id", "text"), length, make, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string")


def spans(docs: DataFrame, length: int = 50) -> DataFrame:
    """``doc_id, start, n_words, text``: the maximal removed runs of words of every document."""

    def make(pack: Pack, gone: np.ndarray, rest) -> pa.RecordBatch:
        edge = np.zeros(len(gone) + 1, bool)
        edge[pack.first] = True  # a run ends with its document
        a = np.flatnonzero(gone & (edge[:-1] | ~np.r_[False, gone[:-1]]))
        b = np.flatnonzero(gone & (np.r_[edge[1:-1], True] | ~np.r_[gone[1:], False])) + 1 if len(gone) else a
        doc = np.searchsorted(pack.first, a, side="right") - 1
        texts = [pack.raw[x:y - 1].decode() for x, y in zip(pack.start[a].tolist(), pack.start[b].tolist())]
        return pa.RecordBatch.from_arrays(
            [rest.field("doc_id").take(pa.array(doc)), pa.array(a - pack.first[doc]), pa.array(b - a), pa.array(texts, pa.string())],
            ["doc_id", "start", "n_words", "text"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return _each(docs.select("doc_id", "text"), length, make, f"doc_id {kind}, start long, n_words long, text string")


def deduplicated(docs: DataFrame, length: int = 50) -> DataFrame:
    """The documents, all columns, with the remaining words, joined by a space, as text; a null text becomes empty."""
    names = docs.columns

    def make(pack: Pack, gone: np.ndarray, rest) -> pa.RecordBatch:
        kept, at = _kept(pack, gone)
        texts = pa.array([kept[a:max(b - 1, a)].decode() for a, b in zip(at[:-1].tolist(), at[1:].tolist())], pa.string())
        return pa.RecordBatch.from_arrays([texts if c == "text" else rest.field(c) for c in names], names)

    return _each(docs, length, make, docs.schema)

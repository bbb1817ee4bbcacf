"""Conversation prefix trie (operator 13): totals of every prefix by a depth-band rollup.

A node is a distinct sequence of the first ``depth`` turns (role and text) of some
conversation; the conversations that start with it are its members, and its
smallest member names it together with its depth. What a training job saves by
encoding shared prefixes once is summed over every node's subtree.

1. Turns are numbered over key ranges (``common.numbered_cells``), so one
   conversation may hold any share of the rows.
2. A prefix is known by the xor of hashes of its (place, turn) pairs. An xor can be
   summed in two steps, within ``CHUNK`` places and over chunks, so a long
   conversation isn't one task either. That equal sums are equal prefixes is
   checked, not assumed: all rows of a node must agree in their last turn's SHA-256
   digest and in their parent, and so by induction in the whole prefix.
3. Totals are rolled up by bands of ``BAND`` depths. A node adds to its ancestors
   within its band only, down the rows of the conversation that names it (a
   conversation's nodes of a band are summed per ancestor before the shuffle). The
   roots of the bands form a tree of a ``BAND``-th of the depth, which is rolled up
   in the same way; each completed total of a band root then counts at the node
   above it, and one more pass in the band below takes it to all its ancestors. So
   a trie of depth ``n`` takes ``log(n) / log(BAND)`` rounds, and no node is
   exploded to more than ``BAND`` ancestors a round.

Hot nodes (a first turn that a third of all conversations share) only meet
partial aggregates; names of parents with very many children, at most
``HOT_PARENTS`` by their definition, are broadcast to the children. A SHA-256 runs
over bytes in order, so a node's list of ends is hashed as a stream of pieces that
other tasks have joined; at no time is the list in memory.

Defined cases: rows with a null conversation id belong to no conversation; turns
with a null number come first; equal numbers are ordered by role, then text; null
roles and texts are empty; repeated rows are repeated turns; a conversation
without any turn left is a member of the root only; an empty table has no node;
extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrun.llm.common import numbered_cells, parts, written

#: Depths of a band; places of one step of the prefix sums; most ids in a piece of a list of ends.
BAND, CHUNK, PIECE = 32, 1024, 8192
#: Parents with over ``max(HOT_CHILDREN, nodes / HOT_PARENTS)`` children are hot; so at most HOT_PARENTS are.
HOT_CHILDREN, HOT_PARENTS = 64, 1000
#: What separates words in a text.
_WORD = r"[^\x20\x09-\x0D]+"
_NODE = ["depth", "f1", "f2"]


def _digest(lane: int) -> Column:
    """Sixty bits of the turn's SHA-256."""
    sha = F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    return F.conv(F.substring(sha, 1 + 15 * lane, 15), 16, 10).cast("long")


def sequences(conversations: DataFrame, group: int = 1, most: int = 1) -> DataFrame:
    """``c, pos, d1, d2, words, last``: the numbered turns of every conversation, rebuilt.

    Conversation c is rebuilt from the first h turns of conversation ``c - c % group`` and its
    own turns after the first h, where h is ``crc32(c as text) % most``; with ``most`` 1 it stays as it is.
    A row with ``pos`` 0 stands for each conversation's start."""
    turns = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("c"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows, cells = numbered_cells(turns, ["c"], ["turn", "role", "text"])
    base, h = F.col("c") - F.col("c") % group, F.pmod(F.crc32(F.col("c").cast("string").cast("binary")), F.lit(most))
    sizes = cells.groupBy("c").agg(F.max("_all").alias("n"))
    given = sizes.select(F.col("c").alias("base"), F.col("n").alias("n_base"))
    convs = (sizes.select("c", "n", base.alias("base"), h.alias("h")).join(given, "base", "left")
             .withColumn("off", F.least("h", F.coalesce("n_base", F.lit(0))))
             .withColumn("size", F.col("off") + F.greatest(F.col("n") - F.col("h"), F.lit(0))))
    convs = written(convs.select("c", "base", "h", "off", "size"), "convs")
    turns = rows.select("_part", "c", "_nth", _digest(0).alias("d1"), _digest(1).alias("d2"),
                        F.regexp_count("text", F.lit(_WORD)).cast("long").alias("words"))
    turns = written(turns.join(cells.join(convs, "c"), ["_part", "c"]).select(
        "c", (F.col("_nth") + F.col("_before")).alias("seq"), "h", "off", "size", "d1", "d2", "words"), "turns")
    own = turns.filter("seq > h").withColumn("pos", F.col("seq") - F.col("h") + F.col("off"))
    first = turns.filter((F.col("seq") < most) & (base == F.col("c"))).select(
        F.col("c").alias("base"), F.col("seq").alias("pos"), "d1", "d2", "words")
    copied = convs.join(first, "base").filter("pos <= h")
    starts = convs.select("c", F.lit(0).cast("long").alias("pos"), F.lit(0).cast("long").alias("d1"),
                          F.lit(0).cast("long").alias("d2"), F.lit(0).cast("long").alias("words"), "size")
    out = ["c", "pos", "d1", "d2", "words", (F.col("pos") == F.col("size")).alias("last")]
    return own.select(*out).unionByName(copied.select(*out)).unionByName(starts.select(*out))


def _prefixes(turns: DataFrame) -> DataFrame:
    """``c, depth, f1, f2, p1, p2`` and the turn's columns: each row's prefix and the one before it."""
    turns = turns.withColumn("chunk", F.floor(F.col("pos") / CHUNK))
    for lane in (1, 2):  # the start of a conversation is no turn
        turns = turns.withColumn(f"x{lane}", F.when(F.col("pos") == 0, 0).otherwise(F.xxhash64(F.lit(lane), "pos", "d1", "d2")))
    own = Window.partitionBy("c", "chunk").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("c").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = turns.groupBy("c", "chunk").agg(F.bit_xor("x1").alias("y1"), F.bit_xor("x2").alias("y2"))
    chunks = chunks.select("c", "chunk", *[F.coalesce(F.bit_xor(y).over(earlier), F.lit(0)).alias(y) for y in ("y1", "y2")])
    rows = turns.select("*", F.bit_xor("x1").over(own).alias("z1"), F.bit_xor("x2").over(own).alias("z2")).join(
        chunks, ["c", "chunk"])
    return rows.select("c", F.col("pos").alias("depth"), F.col("z1").bitwiseXOR(F.col("y1")).alias("f1"),
                       F.col("z2").bitwiseXOR(F.col("y2")).alias("f2"),
                       F.col("z1").bitwiseXOR(F.col("y1")).bitwiseXOR(F.col("x1")).alias("p1"),
                       F.col("z2").bitwiseXOR(F.col("y2")).bitwiseXOR(F.col("x2")).alias("p2"), "d1", "d2", "words", "last")


def _nodes(rows: DataFrame) -> DataFrame:
    """One row per node: ``depth, f1, f2, c, n_convs, n_children, words`` and its parent's ``p1, p2``."""
    same = ["p1", "p2", "d1", "d2"]
    nodes = rows.groupBy(*_NODE).agg(
        F.min("c").alias("c"), F.count(F.lit(1)).alias("n_convs"), F.max("words").alias("words"),
        *[F.min(x).alias(x) for x in same], *[F.max(x).alias(f"{x}_max") for x in same])
    agree = F.lit(True)
    for x in same:
        agree = agree & (F.col(x) == F.col(f"{x}_max"))
    nodes = written(nodes.withColumn("c", F.when(agree, F.col("c")).otherwise(
        F.raise_error(F.lit("two prefixes have equal hash sums")).cast("long"))).select(*_NODE, "c", "n_convs", "words", "p1", "p2"), "nodes")
    kids = nodes.filter("depth > 0").groupBy(
        (F.col("depth") - 1).alias("depth"), F.col("p1").alias("f1"), F.col("p2").alias("f2")).agg(F.count(F.lit(1)).alias("n_children"))
    return written(nodes.join(kids, _NODE, "left").fillna(0, ["n_children"]), "trie")


def rolled(paths: DataFrame, top: int) -> DataFrame:
    """``c, at, f1, f2, leaves, saved``: totals over each node's subtree.

    ``paths`` has a row per conversation ``c`` and depth ``at`` up to ``top``; the values ``leaves`` and
    ``saved`` stand at the row of the conversation that names the node and are null in the others'."""
    band = F.floor(F.col("at") / BAND)
    paths = written(paths, "paths").withColumn("band", band)
    named = F.col("leaves").isNotNull()
    paths = paths.withColumn("more_leaves", F.lit(None).cast("long")).withColumn("more_saved", F.lit(None).cast("long"))
    if top >= BAND:
        at_root = F.col("at") % BAND == 0
        # a band's values go to its root, whose row every conversation of the band has
        whole = paths.groupBy("c", "band").agg(
            F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"), F.max(F.when(at_root, F.col("f1"))).alias("f1"),
            F.max(F.when(at_root, F.col("f2"))).alias("f2"), F.max(F.when(at_root & named, F.col("c"))).alias("name"))
        roots = whole.groupBy("band", "f1", "f2").agg(
            F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"), F.max("name").alias("c"))
        up = paths.filter(at_root).select("c", F.col("band").alias("at"), "f1", "f2").join(
            roots.select("c", F.col("band").alias("at"), "leaves", "saved"), ["c", "at"], "left")
        done = rolled(up.select("c", "at", "f1", "f2", "leaves", "saved"), top // BAND)
        above = done.filter("at > 0").select("c", (F.col("at") * BAND - 1).alias("at"), F.col("leaves").alias("more_leaves"),
                                             F.col("saved").alias("more_saved"))
        paths = paths.drop("more_leaves", "more_saved").join(above, ["c", "at"], "left")

    def either(a: str, b: str) -> Column:
        return F.when(F.col(a).isNotNull() | F.col(b).isNotNull(), F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))

    down = Window.partitionBy("c", "band").orderBy(F.col("at").desc()).rowsBetween(Window.unboundedPreceding, 0)
    exploded = paths.select("c", "at", "f1", "f2", F.when(named, F.col("c")).alias("name"),
                            F.sum(either("leaves", "more_leaves")).over(down).alias("leaves"),
                            F.sum(either("saved", "more_saved")).over(down).alias("saved")).filter("leaves IS NOT NULL")
    return written(exploded.groupBy("at", "f1", "f2").agg(
        F.max("name").alias("c"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")), "rolled")


def _listed(table: pa.Table):
    """Bounds of the runs of equal nodes in a sorted table."""
    a = [table.column(x).to_numpy() for x in _NODE]
    if not len(a[0]):
        return []
    new = np.flatnonzero(np.logical_or.reduce([x[1:] != x[:-1] for x in a])) + 1
    bounds = np.r_[0, new, len(a[0])].tolist()
    return [(tuple(int(x[i]) for x in a), i, j) for i, j in zip(bounds, bounds[1:])]


def _ends(rows: DataFrame) -> DataFrame:
    """``depth, f1, f2, ends_sha256`` of the conversations that end at a node, in order of their ids."""

    def pieces(batches):
        for batch in batches:
            ids = batch.column("c").to_pylist()
            out = [(*node, ids[i + k], ",".join(map(str, ids[i + k:min(i + k + PIECE, j)])))
                   for node, i, j in _listed(pa.Table.from_batches([batch])) for k in range(0, j - i, PIECE)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[n] for r in out], pa.int64()) for n in range(4)] + [pa.array([r[4] for r in out], pa.string())],
                [*_NODE, "c", "ids"])

    def hashed(batches):
        node, sha = None, None

        def row():
            return pa.RecordBatch.from_arrays([*[pa.array([x], pa.int64()) for x in node], pa.array([sha.hexdigest()])],
                                              [*_NODE, "ends_sha256"])

        for batch in batches:
            texts, out = batch.column("ids"), []
            for own, i, j in _listed(pa.Table.from_batches([batch])):
                if own != node:
                    if node is not None:
                        out.append(row())
                    node, sha = own, hashlib.sha256()
                    sha.update(texts[i].as_py().encode())
                    i += 1
                for k in range(i, j):
                    sha.update(b"," + texts[k].as_py().encode())
            yield from [pa.Table.from_batches(out).combine_chunks().to_batches()[0]] if out else []
        if node is not None:
            yield row()

    n = parts(rows.sparkSession)
    node = "depth long, f1 long, f2 long, "
    joined = (rows.filter("last").select(*_NODE, "c").repartitionByRange(n, *_NODE, "c").sortWithinPartitions(*_NODE, "c")
              .mapInArrow(pieces, node + "c long, ids string"))
    return joined.repartition(n, *_NODE).sortWithinPartitions(*_NODE, "c").mapInArrow(hashed, node + "ends_sha256 string")


def _with_parents(nodes: DataFrame) -> DataFrame:
    """``nodes`` with ``parent_conv_id``; the children of a hot parent don't meet in one task."""
    most = max(HOT_CHILDREN, nodes.count() // HOT_PARENTS)
    hot = F.col("n_children") > most

    def names(which: Column, alias: str) -> DataFrame:
        return nodes.filter(which).select((F.col("depth") + 1).alias("depth"), F.col("f1").alias("p1"), F.col("f2").alias("p2"),
                                          F.col("c").alias(alias))

    key = ["depth", "p1", "p2"]
    tops = nodes.filter("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long"))
    rest = nodes.filter("depth > 0").join(F.broadcast(names(hot, "parent_conv_id")), key, "left")  # at most HOT_PARENTS rows
    found = rest.filter("parent_conv_id IS NOT NULL")
    cold = rest.filter("parent_conv_id IS NULL").drop("parent_conv_id").join(
        names(~hot & (F.col("n_children") > 0), "parent_conv_id"), key)
    return tops.unionByName(found).unionByName(cold)


def trie(turns: DataFrame) -> DataFrame:
    """One row per node over ``sequences``; see the contract columns in ``op13_prefix_trie``.

    ``words`` are those of the node's last turn."""
    rows = written(_prefixes(turns), "prefixes")
    nodes = _nodes(rows)
    top = rows.agg(F.max("depth")).first()[0]
    if top is None:
        top = 0
    leaf = F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long")
    values = nodes.select("c", F.col("depth").alias("at"), leaf.alias("leaves"),
                          ((F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    paths = rows.select("c", F.col("depth").alias("at"), "f1", "f2").join(values, ["c", "at"], "left")
    totals = rolled(paths, top).select("c", F.col("at").alias("depth"), F.col("leaves").alias("n_leaves"),
                                       F.col("saved").alias("saved_tokens"))
    out = _with_parents(nodes).join(totals, ["c", "depth"]).join(_ends(rows), _NODE, "left")
    return out.select(F.col("c").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                      F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"), "words")

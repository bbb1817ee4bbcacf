"""WARC archives with a two-level capture index (operator 1).

Archives: every task writes its rows as WARC/1.1 records, each a gzip member of
its own, so one range read fetches one record. Of pages with equal payloads of
at least ``LEAST_REVISIT`` bytes the one with the largest id is stored and the
others are revisit records that refer to it.

Index: captures sorted by reversed-host URL key are cut into compressed blocks
of ``BLOCK_LINES`` lines, one block file and one block directory per range of
keys. The root (one entry per range, so bounded by the number of partitions) is
binary-searched for a key's ranges, a range's directory for its blocks, and only
those blocks, then only the wanted records, are read.

All files lie in the cluster's shared folder; a retried task writes a new file,
and only files named by a finished task are ever read.

Defined cases: a null html is an empty payload; a null URL has the key ``-``; a
null page id is written as empty, and is a response unless another page has its
payload; rows that repeat the largest id of a group are responses each; empty
tables give an empty index; extra columns are ignored.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import json
import re
import urllib.parse
import uuid
import zlib

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrun.llm.common import by_doc, parts, scratch, ship, utf8, written
from millrun.operators.joins import checked_broadcast

LEAST_REVISIT = 1000
#: Lines of a compressed index block; bytes after which an archive is closed.
BLOCK_LINES, ARCHIVE_BYTES = 3000, 64 << 20
#: Gaps of unwanted bytes up to this are read over rather than skipped.
READ_OVER = 64 << 10
#: Captures have no time in the source table.
CAPTURED = "1970-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def url_key(url: str | None) -> str:
    """Reversed-host sort key: ``http://a.b.org:80/X?q#f`` is ``org,b,a)/X?q``."""
    if url is None:
        return "-"
    try:
        u = urllib.parse.urlsplit(url.strip())
        host, port = u.hostname or "", u.port
    except ValueError:
        return _plain(url)
    if not host:
        return _plain(url)
    usual = {"http": 80, "https": 443}.get(u.scheme)
    key = ",".join(reversed(host.split("."))) + (f":{port}" if port not in (None, usual) else "")
    return _plain(f"{key}){u.path or '/'}" + (f"?{u.query}" if u.query else ""))


def _plain(text: str) -> str:
    """Without characters that would end a header or an index line."""
    return re.sub(r"[\x00-\x20\x7f\ud800-\udfff]", lambda m: urllib.parse.quote(m[0], errors="replace"), text)


def record_id(page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC record; ``refers_to`` is a page id for a revisit, else None."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page_id)),
            ("WARC-Date", CAPTURED), ("WARC-Payload-Digest", f"sha1:{digest}"),
            ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block))),
            ("X-Page-Id", "" if page_id is None else str(page_id))]
    if url is not None:
        head.append(("WARC-Target-URI", _plain(url)))
    if revisit:
        head += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", record_id(refers_to)), ("X-Refers-To-Page", str(refers_to))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def parsed(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """Headers, HTTP headers and payload of one whole record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(line.split(": ", 1) for line in (x if ": " in x else x + " " for x in lines))
    block = rest[:int(headers["Content-Length"])]
    if rest[len(block):] != b"\r\n\r\n":
        raise ValueError("record is not whole")
    http, _, payload = block.partition(b"\r\n\r\n")
    return headers, dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), payload


def _files(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(uri)


def _new_file(folder: str, suffix: str) -> tuple[str, object]:
    """A file of this task attempt alone."""
    ctx = TaskContext.get()
    uri = f"{folder}/{ctx.partitionId() if ctx else 0:06d}-{uuid.uuid4().hex}{suffix}"
    fs, path = _files(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    return uri, fs.open_output_stream(path, compression=None)


def _revisits(pages: DataFrame) -> DataFrame:
    """``id, sha1, refers_to`` of the pages whose payload a page of larger id has too."""
    narrow = pages.select(F.col("page_id").alias("id"), F.sha1("body").alias("sha1"), F.octet_length("body").alias("n"))
    groups = (narrow.filter(F.col("n") >= LEAST_REVISIT).groupBy(F.col("sha1").alias("of"))
              .agg(F.max("id").alias("refers_to"), F.count(F.lit(1)).alias("c")).filter("c > 1 and refers_to is not null"))
    return (narrow.join(groups, F.col("sha1") == F.col("of")).filter("id is null or id < refers_to")
            .select("id", "sha1", "refers_to").distinct())


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write all pages; ``key, page_id, archive, offset, length`` per record."""
    spark = pages.sparkSession
    ship(spark)
    kind = pages.schema["page_id"].dataType.simpleString()
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), utf8(F.col("html")).alias("body"))
    seen = checked_broadcast(written(_revisits(rows), "revisits"), 200_000)
    rows = rows.withColumn("digest", F.sha1("body"))
    rows = (rows.join(seen, (F.col("digest") == F.col("sha1")) & F.col("page_id").eqNullSafe(F.col("id")), "left")
            .select("page_id", "url", "body", "digest", "refers_to"))

    def run(batches):
        uri, out, at = None, None, 0
        try:
            for batch in batches:
                for part in by_doc(batch, 64):
                    found = []
                    for page_id, url, body, digest, refers_to in zip(*[c.to_pylist() for c in part.columns]):
                        if out is None or at >= ARCHIVE_BYTES:
                            if out is not None:
                                out.close()
                            (uri, out), at = _new_file(folder, ".warc.gz"), 0
                        gz = zlib.compressobj(3, zlib.DEFLATED, 31)
                        data = gz.compress(record(page_id, url, body, digest, refers_to)) + gz.flush()
                        out.write(data)
                        found.append((url_key(url), page_id, uri, at, len(data)))
                        at += len(data)
                    cols = list(zip(*found))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(cols[0], pa.string()), pa.array(cols[1], part.column(0).type), pa.array(cols[2], pa.string()),
                         pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int64())],
                        ["key", "page_id", "archive", "offset", "length"])
        finally:
            if out is not None:
                out.close()

    return rows.mapInArrow(run, f"key string, page_id {kind}, archive string, offset long, length long")


class Index:
    """The root of a written index: ``(first key, last key, directory)`` per range, sorted."""

    def __init__(self, root: list[tuple[str, str, str]]):
        self.root = sorted(root)
        self.lasts = [r[1] for r in self.root]

    def ranges(self, key: str) -> list[str]:
        """Directories of the ranges that may hold ``key``, by binary search."""
        out, i = [], bisect.bisect_left(self.lasts, key)
        while i < len(self.root) and self.root[i][0] <= key:
            out.append(self.root[i][2])
            i += 1
        return out


def build_index(captures: DataFrame, folder: str) -> Index:
    """Sort ``captures`` into blocks and directories; only the root reaches the driver."""
    spark = captures.sparkSession
    ship(spark)
    order = ["key", "archive", "offset"]
    ranged = captures.repartitionByRange(parts(spark), *order).sortWithinPartitions(*order)

    def run(batches):
        uri, out, at, lines, directory = None, None, 0, [], []

        def close_block():
            nonlocal at, lines
            data = zlib.compress("\n".join(x for _, x in lines).encode(), 6)
            out.write(data)
            directory.append((lines[0][0], lines[-1][0], at, len(data)))
            at += len(data)
            lines = []

        for batch in batches:
            for key, archive, offset, length in zip(*[batch.column(c).to_pylist() for c in ("key", "archive", "offset", "length")]):
                if out is None:
                    uri, out = _new_file(folder, ".cdx")
                lines.append((key, f"{key} {json.dumps([archive, offset, length])}"))
                if len(lines) == BLOCK_LINES:
                    close_block()
        if out is not None:
            if lines:
                close_block()
            out.close()
            where, listed = _new_file(folder, ".dir")
            listed.write(json.dumps({"blocks": uri, "directory": directory}).encode())
            listed.close()
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (directory[0][0], directory[-1][1], where)],
                                             ["first", "last", "directory"])

    root = written(ranged.mapInArrow(run, "first string, last string, directory string"), "root")
    return Index([tuple(r) for r in root.collect()])


@functools.lru_cache(maxsize=4)
def _directory(uri: str):
    fs, path = _files(uri)
    with fs.open_input_stream(path, compression=None) as f:
        found = json.loads(f.read())
    return found["blocks"], found["directory"], [b[1] for b in found["directory"]]


@functools.lru_cache(maxsize=4)
def _block(uri: str, offset: int, length: int) -> tuple[list[str], list[str]]:
    fs, path = _files(uri)
    with fs.open_input_file(path) as f:
        lines = zlib.decompress(f.read_at(length, offset)).decode().split("\n")
    return [x.partition(" ")[0] for x in lines], lines


def captures_in(directory: str, key: str):
    """``(archive, offset, length)`` of the captures of one key in one range."""
    blocks, entries, lasts = _directory(directory)
    i = bisect.bisect_left(lasts, key)
    while i < len(entries) and entries[i][0] <= key:
        keys, lines = _block(blocks, entries[i][2], entries[i][3])
        for j in range(bisect.bisect_left(keys, key), bisect.bisect_right(keys, key)):
            yield tuple(json.loads(lines[j].partition(" ")[2]))
        i += 1


def captures_of(index: Index, key: str):
    """``(archive, offset, length)`` of every capture of one key."""
    for directory in index.ranges(key):
        yield from captures_in(directory, key)


def _ranges_of(keys: DataFrame, index: Index) -> DataFrame:
    """``key, directory``: the ranges that may hold each of the different ``keys``."""
    shared = keys.sparkSession.sparkContext.broadcast(index)  # one entry per range

    def run(batches):
        for batch in batches:
            rows = [(k, d) for k in batch.column(0).to_pylist() for d in shared.value.ranges(k)]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.string()), pa.array([d for _, d in rows], pa.string())],
                                             ["key", "directory"])

    return keys.select("key").filter(F.col("key").isNotNull()).distinct().mapInArrow(run, "key string, directory string")


def lookup(keys: DataFrame, index: Index) -> DataFrame:
    """``key, archive, offset, length`` of every capture of the different ``keys``.

    The root is searched first, so that a key whose captures fill many ranges is
    searched in each of them by a task of its own."""
    spark = keys.sparkSession
    ship(spark)

    def run(batches):
        names = ["key", "archive", "offset", "length"]
        for batch in batches:
            rows = []
            for key, directory in zip(*[c.to_pylist() for c in batch.columns]):
                for hit in captures_in(directory, key):
                    rows.append((key, *hit))
                    if len(rows) == 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names)
                        rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names)

    wanted = _ranges_of(keys, index).repartitionByRange(parts(spark), "directory", "key").sortWithinPartitions("directory", "key")
    return wanted.mapInArrow(run, "key string, archive string, offset long, length long")


def url_keys(urls: DataFrame) -> DataFrame:
    """The key of every URL."""
    ship(urls.sparkSession)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([url_key(u) for u in batch.column(0).to_pylist()], pa.string())], ["key"])

    return urls.select(F.col("url").cast("string")).mapInArrow(run, "key string")


def _chunks(rows: list[tuple[int, int]], most: int = 8 << 20):
    """Sorted ``(offset, length)`` rows joined to reads of bounded size."""
    group: list[tuple[int, int]] = []
    for r in rows:
        if group and (r[0] - group[-1][0] - group[-1][1] > READ_OVER or r[0] + r[1] - group[0][0] > most):
            yield group
            group = []
        group.append(r)
    if group:
        yield group


def fetch(hits: DataFrame) -> DataFrame:
    """Range-read every hit: ``page_id, url, record_type, refers_to, payload_bytes,
    payload_digest, stored_digest, payload``; a revisit's payload is null."""
    spark = hits.sparkSession
    ship(spark)

    def run(batches):
        for batch in batches:
            by_file: dict[str, list[tuple[int, int]]] = {}
            for a, o, n in zip(*[batch.column(c).to_pylist() for c in ("archive", "offset", "length")]):
                by_file.setdefault(a, []).append((o, n))
            for uri, rows in by_file.items():
                fs, path = _files(uri)
                with fs.open_input_file(path) as f:
                    for group in _chunks(sorted(rows)):
                        first = group[0][0]
                        data = f.read_at(group[-1][0] + group[-1][1] - first, first)
                        found = [_row(zlib.decompress(data[o - first:o - first + n], 31)) for o, n in group]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(c, t) for c, t in zip(zip(*found), _TYPES)], _NAMES)

    near = hits.repartitionByRange(parts(spark), "archive", "offset").sortWithinPartitions("archive", "offset")
    return near.mapInArrow(run, "page_id string, url string, record_type string, refers_to string, payload_bytes long, "
                                "payload_digest string, stored_digest string, payload binary")


_NAMES = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "stored_digest", "payload"]
_TYPES = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary()]


def _row(data: bytes) -> tuple:
    """A record's row. A response's digest is taken from its payload; a revisit's is what it says."""
    headers, http, payload = parsed(data)
    revisit = headers["WARC-Type"] == "revisit"
    stored = headers["WARC-Payload-Digest"].removeprefix("sha1:")
    digest = stored if revisit else hashlib.sha1(payload).hexdigest()
    size = int(http["Content-Length"]) if revisit else len(payload)
    return (headers["X-Page-Id"] or None, headers.get("WARC-Target-URI"), headers["WARC-Type"],
            headers.get("X-Refers-To-Page"), size, digest, stored, None if revisit else payload)


def archived(spark: SparkSession, pages: DataFrame, folder: str | None = None) -> tuple[DataFrame, Index]:
    """Write archives and index of ``pages``; the capture rows and the index."""
    folder = folder or scratch(spark, "warc")
    captures = written(write_archives(pages, f"{folder}/archive"), "captures")
    return captures, build_index(captures, f"{folder}/index")

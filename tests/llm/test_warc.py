import hashlib

import pytest

from millrun.llm import warc
from millrun.llm.common import scratch
from millrun.llm.queries import op1_warc

SCHEMA = "page_id long, url string, html string, key string, digest string"
BIG = "<html>" + "payload é " * 200


def table(spark, rows):
    return spark.createDataFrame([(*r, "k", "d") for r in rows], SCHEMA)


ROWS = [(1, "http://a.example.org/x", BIG), (5, "http://a.example.org/x", BIG), (3, None, BIG), (4, "not a url \r\n x", "small"),
        (6, "http://b.example.org:8080/y?q=1#f", "small"), (7, "", None), (8, "HTTP://A.example.org:80/x", ""), (None, "http://n/", BIG),
        (9, "http://[bad", "a\r\n\r\nb"), (9, "http://[bad", "a\r\n\r\nb"), (10, "http://ünï.example/ö", "x" * 1000), (11, "u", "x" * 1000)]


def brute(rows):
    last = {}
    for i, _, h in rows:
        b = (h or "").encode()
        if len(b) >= 1000 and i is not None:
            last[b] = max(last.get(b, i), i)
    for i, _, h in rows:
        b = (h or "").encode()
        to = last.get(b)
        revisit = to is not None and (i is None or i < to)
        yield (i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", to if revisit else None)


def rows_of(df):
    return sorted(str((None if r[0] is None else int(r[0]), *r[1:4], None if r[4] is None else int(r[4]))) for r in
                  df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())


@pytest.mark.parametrize("lines,archive", [(3000, 64 << 20), (2, 600), (1, 1)])
def test_archives_are_read_back(spark, monkeypatch, lines, archive):
    monkeypatch.setattr(warc, "BLOCK_LINES", lines)
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", archive)
    pages = table(spark, ROWS)
    captures, index = warc.archived(spark, pages)
    assert captures.count() == len(ROWS)
    out = warc.fetch(warc.lookup(warc.url_keys(pages), index))
    assert rows_of(out) == sorted(map(str, brute(ROWS)))
    for r in out.collect():
        assert (r.payload is None) == (r.record_type == "revisit")
        if r.payload is not None:
            assert r.stored_digest == r.payload_digest == hashlib.sha1(bytes(r.payload)).hexdigest()


def test_keys_and_lookups(spark):
    assert warc.url_key("http://www.Example.org:80/A?b#c") == "org,example,www)/A?b"
    assert warc.url_key("https://example.org:8443") == "org,example:8443)/"
    assert warc.url_key(None) == "-" and "\n" not in warc.url_key("http://x/\n")
    rows = [(i, f"http://h{i % 7}.org/{i % 50}", f"text {i}") for i in range(400)]
    _, index = warc.archived(spark, table(spark, rows), scratch(spark, "some"))
    keys = spark.createDataFrame([("org,h3)/3",), ("org,h3)/3",), ("org,nowhere)/",), ("",), ("zzz",)], "key string")
    got = warc.fetch(warc.lookup(keys, index)).collect()
    assert sorted(int(r.page_id) for r in got) == [i for i in range(400) if i % 7 == 3 and i % 50 == 3]


def test_empty(spark):
    _, index = warc.archived(spark, table(spark, []))
    assert warc.fetch(warc.lookup(spark.createDataFrame([("x",)], "key string"), index)).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    assert rows_of(op1_warc(spark, sf)) == sorted(map(str, brute(rows)))


def test_captures_of_a_hot_url_are_looked_up_range_by_range(spark, monkeypatch):
    """One URL on most pages: its key spans many ranges, and each is searched on its own."""
    monkeypatch.setattr(warc, "BLOCK_LINES", 7)
    rows = [(i, "http://hot.org/" if i % 8 else f"http://cold.org/{i}", f"text {i}") for i in range(600)]
    pages = table(spark, rows)
    _, index = warc.archived(spark, pages)
    keys = warc.url_keys(pages)
    spans = warc._ranges_of(keys, index).filter("key = 'org,hot)/'").collect()
    assert len(spans) > 3 and len({r.directory for r in spans}) == len(spans)
    assert rows_of(warc.fetch(warc.lookup(keys, index))) == sorted(map(str, brute(rows)))
    assert warc.lookup(spark.createDataFrame([(None,), ("org,hot)/",)], "key string"), index).count() == 525

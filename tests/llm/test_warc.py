import gzip
import hashlib

from burstmill.llm import warc as W
from pyspark.sql import functions as F

SCHEMA = "page_id long, url string, html string"


def check(rows, found):
    """rows: (page_id, url, html); found: what reading gave."""
    groups = {}
    for page, _, html in rows:
        raw = (html or "").encode()
        if len(raw) >= 1000 and page is not None:
            groups[raw] = max(page, groups.get(raw, page))
    expected = []
    for page, url, html in rows:
        raw = (html or "").encode()
        first = groups.get(raw) if len(raw) >= 1000 else None
        revisit = first is not None and page != first
        link = None if url is None else url.replace("\r", "%0D").replace("\n", "%0A")
        expected.append((page, link, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    order = lambda r: tuple(map(str, r))
    assert sorted((tuple(r)[:6] for r in found), key=order) == sorted(expected, key=order)


def test_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    rows = [(r.page_id, r.url, r.html) for r in pages.collect()]
    found = W.read_records(W.write_archives(pages)).collect()
    check(rows, found)
    assert {r.page_id: bytes(r.payload).decode() for r in found} == {p: h for p, _, h in rows}


def test_copies_odd_and_empty(spark):
    big = "é" * 500
    rows = [(i, "http://x/", big) for i in range(40)] + [(39, "http://y/", big), (50, None, None), (51, "u\r\nWARC-Type: x", ""), (None, "z", big), (None, "n", "b" * 2000), (60, "s", "short"), (61, "s", "short"), (62, "t", "\r\n\r\nWARC/1.1\r\n")]
    pages = spark.createDataFrame(rows, SCHEMA).withColumn("digest", F.lit(1)).withColumn("first", F.lit(2))
    index = W.write_archives(pages)
    check(rows, W.read_records(index, payloads=False).collect())
    few = W.read_records(index.filter("page_id IN (3, 60)")).collect()
    assert sorted(r.page_id for r in few) == [3, 60]
    empty = spark.createDataFrame([], SCHEMA)
    assert W.read_records(W.write_archives(empty)).collect() == []


def test_archives_are_gzip_members_at_their_offsets(spark):
    pages = spark.createDataFrame([(1, "http://a/", "x" * 1500), (2, "http://b/", "x" * 1500)], SCHEMA).coalesce(1)
    index = W.write_archives(pages).collect()
    for r in index:
        with open(r.file.removeprefix("file://"), "rb") as f:
            data = f.read()
        text = gzip.decompress(data[r.offset : r.offset + r.length])
        assert text.startswith(b"WARC/1.1\r\n") and text.endswith(b"\r\n\r\n") and W.parse(text)["page_id"] == r.page_id
    assert b"".join([gzip.decompress(data)]).count(b"WARC-Type: ") == 2


def test_reading_is_dealt_by_bytes(spark, monkeypatch):
    """The index is small, the archives are not: the number of reading tasks follows the archives."""
    monkeypatch.setattr(W, "STRETCH", 20_000)
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url", "html")
    index = W.write_archives(pages)
    total = index.agg(F.sum("length")).first()[0]
    plan = W.read_records(index)._jdf.queryExecution().optimizedPlan().toString()
    assert f"RepartitionByExpression" in plan and f", {-(-total // 20_000)}" in plan
    assert W.read_records(index).count() == pages.count()

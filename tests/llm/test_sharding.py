import zlib

from burstmill.llm import queries
from burstmill.llm import sharding as H
from pyspark.sql import functions as F


def test_documents(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.QUERIES["op10_shards"](spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    slots = {}
    for r in rows:
        raw = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law) == (len(raw) + 16, zlib.crc32(raw), "key")
        assert 0 <= r.shard < 40 and r.grown_shard in (r.shard, 40)
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len(slots) == 40 and 10 <= sum(r.grown_shard == 40 for r in rows) <= 50
    order = [r.doc_id for r in sorted(rows, key=lambda r: (r.shard, r.slot))]
    assert order != sorted(order)


def test_buckets_and_reruns(spark, monkeypatch):
    monkeypatch.setattr(H, "BUCKET_BYTES", 2000)
    docs = spark.range(500).selectExpr("id AS doc_id", "repeat(cast(id AS string), 10) AS text")
    once = H.with_slots(H.shuffle_into_shards(docs, 3)).select("doc_id", "shard", "slot")
    again = H.with_slots(H.shuffle_into_shards(docs.repartition(9), 3)).select("doc_id", "shard", "slot")
    assert sorted(once.collect()) == sorted(again.collect())
    written = H.shuffle_into_shards(docs, 3)
    assert written.select("bucket").distinct().count() > 1
    assert written.select("doc_id", "text").exceptAll(docs).isEmpty() and written.count() == 500


def test_slots_spread(spark):
    """A row's place in its shard does not follow its id."""
    docs = spark.range(4000).selectExpr("id AS doc_id", "'t' AS text")
    rows = H.with_slots(H.shuffle_into_shards(docs, 2)).select("doc_id", "slot", "shard")
    assert all(abs(r[1]) < 0.1 for r in rows.groupBy("shard").agg(F.corr("doc_id", "slot")).collect())


def test_odd_and_empty(odd_docs, no_docs):
    out = H.with_slots(H.shuffle_into_shards(odd_docs, 4))
    assert out.columns[: len(odd_docs.columns)] == odd_docs.columns and len(out.columns) == len(odd_docs.columns) + 2
    assert out.count() == odd_docs.count()
    assert H.with_slots(H.shuffle_into_shards(no_docs, 4)).collect() == []


def test_buckets_are_bounded(spark, monkeypatch):
    """Null ids with different texts, and one row that is repeated: no bucket holds more than twice BUCKET_BYTES."""
    monkeypatch.setattr(H, "BUCKET_BYTES", 20_000)
    nulls = spark.range(3000).selectExpr("CAST(NULL AS bigint) AS doc_id", "concat(repeat('x', 180), id) AS text")
    same = spark.range(4000).selectExpr("7L AS doc_id", "repeat('y', 200) AS text")
    docs = nulls.union(same).union(spark.range(500).selectExpr("id + 100", "'text'"))
    written = H.shuffle_into_shards(docs, 8)
    sizes = written.groupBy("shard", "bucket").agg(F.sum(H.size_of("text")).alias("bytes")).collect()
    assert max(r.bytes for r in sizes) <= 2 * H.BUCKET_BYTES
    assert written.count() == 7500 and written.select("doc_id", "text").exceptAll(docs).isEmpty()
    slots = {}
    for r in H.with_slots(written).select("shard", "slot").collect():
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_law_by_brute_force(spark):
    """The shard is the one of the largest hash among all shards, so one more shard takes rows only into itself."""
    rows = spark.range(200).select(F.col("id").alias("doc_id"), *(H.shard_of("id", n).alias(f"s{n}") for n in (1, 5, 6)), *(F.xxhash64(F.lit(H.SEED), F.lit(s), "id").alias(f"w{s}") for s in range(6))).collect()
    for r in rows:
        assert r.s1 == 0 and r.s5 == max(range(5), key=lambda s: r[f"w{s}"]) and r.s6 == max(range(6), key=lambda s: r[f"w{s}"])

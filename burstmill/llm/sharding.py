"""Sharding by a two-pass external shuffle.

First pass: a seeded hash of the id deals each row to a shard, and a seeded hash of id and text to one of the shard's
buckets, as many as the shard's counted bytes need at BUCKET_BYTES each. Rows that repeat id and text until they make
half a bucket or more are interchangeable; of these the row's number among its input's rows is hashed too, so that they
are dealt to all buckets of their shard. Second pass: each bucket, which fits in memory, is put in a fixed order, shuffled
by Fisher and Yates with a seed of its own, and written. A row's slot is its bucket's offset in the shard plus its place
in the bucket.

The law is `key`: the shard is the one whose seeded hash of the id is the largest (highest random weight). It depends
on nothing but id and number of shards, and one more shard takes rows only into itself. Equal texts with different
ids are dealt independently. Null ids count as one id. A row's size is its text's UTF-8 bytes (null: none) plus 16.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from burstmill.shared import fresh, materialize, maybe_broadcast, new_path, ship_package, with_field

SEED = 7
BUCKET_BYTES = 32 << 20
ROW_BYTES = 16
#: Tasks of the second pass at most; beyond it a task takes several buckets one after the other.
MAX_TASKS = 100_000


def shard_of(key: str, shards: int, seed: int = SEED) -> Column:
    """The shard with the largest hash of (seed, shard, id)."""
    weights = [F.struct(F.xxhash64(F.lit(seed), F.lit(s), F.col(key)).alias("w"), F.lit(s).alias("s")) for s in range(shards)]
    return F.greatest(*weights)["s"] if shards > 1 else F.lit(0)


def size_of(text: str) -> Column:
    return F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long") + ROW_BYTES


def shuffle_into_shards(docs: DataFrame, shards: int, text: str = "text", key: str = "doc_id", seed: int = SEED, path: str | None = None) -> DataFrame:
    """Write docs as Parquet folders shard=0, shard=1, ... below path (a new one in the shared folder, if not given).

    Returns the rows read back, with the columns shard, bucket and place after docs' own (names that docs has already
    get a trailing underscore).
    """
    spark = docs.sparkSession
    ship_package(spark)
    path = path or new_path(spark, "shards")
    shard, bucket, place = fresh(docs, "shard"), fresh(docs, "bucket"), fresh(docs, "place")
    content, row, many = (fresh(docs, c) for c in ("content_hash", "row_number", "repeats"))
    at = shard_of(key, shards, seed)
    repeated = docs.groupBy(F.xxhash64(F.lit(seed + 1), F.col(key), F.col(text)).alias(content)).agg(F.sum(size_of(text)).alias("bytes"), F.count("*").alias("n"))
    repeated = materialize(repeated.filter((F.col("n") > 1) & (2 * F.col("bytes") >= BUCKET_BYTES)).select(content, F.lit(True).alias(many)), "shards-repeated")
    found = {r["s"]: max(1, -(-r["bytes"] // BUCKET_BYTES)) for r in docs.groupBy(at.alias("s")).agg(F.sum(size_of(text)).alias("bytes")).collect()}
    buckets = F.element_at(F.array(*(F.lit(found.get(s, 1)) for s in range(shards))), F.col(shard) + 1)
    dealt = docs.withColumn(shard, at).withColumn(content, F.xxhash64(F.lit(seed + 1), F.col(key), F.col(text)))
    dealt = dealt.withColumn(row, F.monotonically_increasing_id()).join(maybe_broadcast(repeated), content, "left")
    dealt = dealt.withColumn(bucket, F.pmod(F.when(F.col(many), F.xxhash64(content, row)).otherwise(F.col(content)), buckets).cast("int"))
    dealt = dealt.select(*docs.columns, shard, bucket).repartition(min(MAX_TASKS, sum(found.values())) or 1, shard, bucket)
    schema = with_field(dealt.schema, place, "bigint")

    def shuffled(keys: tuple, rows: pa.Table) -> pa.Table:
        order = pc.sort_indices(rows, sort_keys=[(key, "ascending"), (text, "ascending")]).to_numpy().copy()
        np.random.default_rng([seed, keys[0].as_py(), keys[1].as_py()]).shuffle(order)
        return rows.take(pa.array(order)).append_column(place, pa.array(np.arange(len(order), dtype=np.int64)))

    dealt.groupBy(shard, bucket).applyInArrow(shuffled, schema).write.partitionBy(shard).option("compression", "zstd").parquet(path)
    back = spark.read.schema(schema).parquet(path)
    return back.select(*docs.columns, shard, bucket, place)


def with_slots(written: DataFrame) -> DataFrame:
    """written (its last columns: shard, bucket, place) with the slot instead of bucket and place; wide columns stay unread unless chosen."""
    shard, bucket, place = written.columns[-3:]
    slot = fresh(written, "slot")
    counts = written.groupBy(shard, bucket).agg(F.count("*").alias("n"))
    before = Window.partitionBy(shard).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col(shard).alias("s"), F.col(bucket).alias("b"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    joined = written.join(offsets, (F.col(shard) == F.col("s")) & (F.col(bucket) == F.col("b")))
    return joined.withColumn(slot, F.col("offset") + F.col(place)).drop(bucket, place, "s", "b", "offset")

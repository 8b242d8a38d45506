"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A document's size is its number of words (runs of characters other than space and U+0009 to U+000D; null: 0). Sources
share BUDGET times the total size by weight; a source takes at most MAX_EPOCHS times its own size, and what it leaves
is shared among the others by weight until none is above. A source first takes its whole documents as many complete
times as its target holds. Of the rest each document gets an exponential key, -ln(u) / w, with u from a seeded hash of
its id (of its text, if the id is null) and w its quality weight; documents are taken in the order of keys as long as
their prefix sum stays within the rest, and one more may follow: the one whose size comes nearest to the gap, if taking
it lessens the gap.

Prefix sums are two-level: sums over BUCKETS key ranges of each source, then a window inside the one range where the
budget ends. So no task holds a source. Rows with the same source, id, key and size stand together: all of them are
taken or none. A null source is a source of its own, the last. Empty tables give an empty result; with no words all
targets are 0. Everything is DataFrame code, and reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from burstmill.shared import fresh, materialize, maybe_broadcast

WEIGHTS = (3, 1, 2)
BUDGET = 1.5
MAX_EPOCHS = 2
SEED = 20_011
#: Key ranges of a source; only the one where the budget ends is sorted.
BUCKETS = 4096

WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(text: str) -> Column:
    """Between 1/4 and 1: the more of a text's characters are symbols of markup and tables, the less."""
    symbols = F.regexp_count(F.col(text), F.lit(r"[#*$%&|<>]"))
    return F.coalesce(1 / (1 + F.least(F.lit(3.0), 10 * symbols / F.greatest(F.length(F.col(text)), F.lit(1)))), F.lit(1.0))


def exponential_key(key: str, text: str, weight: Column) -> Column:
    """-ln(u) / w with u in (0, 1) from the hashed id; of rows without one from the hashed text, so that each has its own."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(SEED), F.col(key), F.when(F.col(key).isNull(), F.col(text))), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    return -F.ln(u) / weight


def _bucket(e: str) -> Column:
    """Keys in equal ranges of 1 - exp(-key / 2), which grows with the key."""
    return F.least(F.floor((1 - F.exp(-F.col(e) / 2)) * BUCKETS), F.lit(BUCKETS - 1)).cast("int")


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row for each source.

    Sharing again and again ends where a common level, times the weight, meets each source's cap. Sources in the order
    of cap / weight reach the cap one after the other, so the level follows from prefix sums over that order.
    """
    named = Window.orderBy(F.col("source").asc_nulls_last())
    rank = (F.row_number().over(named) - 1) % len(WEIGHTS)
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (rank + 1).cast("int")).cast("double")
    w = sizes.withColumn("w", weight).withColumn("cap", F.lit(float(MAX_EPOCHS)) * F.col("source_size"))
    by_level = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    w = w.withColumn("total", F.lit(BUDGET) * F.sum("source_size").over(whole))
    w = w.withColumn("left", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    w = w.withColumn("open", F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    w = w.withColumn("level", F.try_divide("left", "open"))
    # the first source in that order whose share stays below its cap sets the level for all that follow
    w = w.withColumn("place", F.row_number().over(by_level))
    met = F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct("place", "level"))).over(whole)
    w = w.withColumn("met", met["level"])
    target = F.when(F.col("met").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("met") * F.col("w")))
    return w.select("source", "source_size", target.alias("target"))


def sized(docs: DataFrame, text: str, source: str, key: str, weight: Column | None, name: str) -> DataFrame:
    """docs and the struct `name` of source, size, id and key."""
    e = exponential_key(key, text, quality_weight(text) if weight is None else weight)
    return docs.withColumn(name, F.struct(F.col(source).alias("source"), size_of(text).alias("size"), F.col(key).alias("id"), e.alias("e")))


def plan(units: DataFrame) -> DataFrame:
    """One row for each source: its size and target, the complete epochs, and how far the fractional one goes.

    units: (source, size, id, e), one row for each document.
    """
    sums = units.groupBy("source", _bucket("e").alias("bucket")).agg(F.sum("size").alias("bucket_size"))
    sums = materialize(sums, "mix-buckets")
    goal = targets(sums.groupBy("source").agg(F.sum("bucket_size").alias("source_size")))
    goal = goal.withColumn("epochs", F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0)).cast("long"))
    goal = materialize(goal.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")), "mix-goals")
    running = Window.partitionBy("source").orderBy("bucket")
    at = sums.withColumn("upto", F.sum("bucket_size").over(running)).withColumnRenamed("source", "s")
    same = F.col("source").eqNullSafe(F.col("s"))
    at = at.join(goal.select("source", "rest"), same).filter("upto > rest").groupBy("source")
    # the range where the rest ends, and what the ranges before it hold
    edge = at.agg(F.min(F.struct("bucket", (F.col("upto") - F.col("bucket_size")).alias("before"))).alias("x"))
    goal = goal.withColumnRenamed("source", "s").join(edge, same, "left").select(F.col("s").alias("source"), "source_size", "target", "epochs", "rest", F.col("x.bucket").alias("edge"), F.coalesce("x.before", "source_size").alias("before"))
    goal = materialize(goal, "mix-edges")
    few = maybe_broadcast(goal.withColumnRenamed("source", "s"))
    near = units.withColumn("bucket", _bucket("e")).join(few, same).filter("bucket = edge")
    ties = near.groupBy("source", "e", F.col("id"), "size").agg(F.sum("size").alias("tied"), F.first("before").alias("before"), F.first("rest").alias("rest"))
    inside = Window.partitionBy("source").orderBy("e", F.col("id").asc_nulls_last(), "size")
    run = ties.withColumn("upto", F.col("before") + F.sum("tied").over(inside)).filter("upto <= rest")
    last = run.groupBy("source").agg(F.max(F.struct("e", F.col("id").isNull().alias("last"), "id", "size", "upto")).alias("cut"))
    goal = goal.withColumnRenamed("source", "s").join(last, same, "left").drop("source").withColumnRenamed("s", "source")
    goal = materialize(goal.withColumn("gap", F.col("rest") - F.coalesce("cut.upto", "before")), "mix-cuts")
    # the closing document: of those not taken, the one whose size comes nearest to the gap
    few = maybe_broadcast(goal.withColumnRenamed("source", "s"))
    left = units.withColumn("bucket", _bucket("e")).join(few, same).filter(~_taken() & (F.col("size") < 2 * F.col("gap")) & (F.col("size") > 0))
    left = left.groupBy("source", "e", "id", "size").agg(F.sum("size").alias("tied"), F.first("gap").alias("gap")).filter("tied < 2 * gap")
    closing = left.groupBy("source").agg(F.min(F.struct(F.abs(F.col("tied") - F.col("gap")).alias("off"), "e", F.col("id").isNull().alias("last"), "id", "size")).alias("closing"))
    goal = goal.withColumnRenamed("source", "s").join(closing, same, "left").drop("source").withColumnRenamed("s", "source")
    return materialize(goal, "mix-plan")


def _taken() -> Column:
    """Whether a unit lies before its source's cut."""
    here = F.struct("e", F.col("id").isNull().alias("last"), F.col("id").alias("id"), F.col("size").alias("size"))
    cut = F.struct(F.col("cut.e").alias("e"), F.col("cut.last").alias("last"), F.col("cut.id").alias("id"), F.col("cut.size").alias("size"))
    return F.coalesce(F.col("edge").isNull() | (F.col("bucket") < F.col("edge")) | (F.col("cut").isNotNull() & (F.col("bucket") == F.col("edge")) & (here <= cut)), F.lit(False))


def _closes() -> Column:
    c = F.col("closing")
    return F.coalesce((F.col("e") == c["e"]) & F.col("id").eqNullSafe(c["id"]) & (F.col("size") == c["size"]), F.lit(False))


def copies(units: DataFrame, made: DataFrame) -> DataFrame:
    """units with source_size, target and n, the number of times that a document is taken."""
    few = maybe_broadcast(made.withColumnRenamed("source", "s"))
    found = units.withColumn("bucket", _bucket("e")).join(few, F.col("source").eqNullSafe(F.col("s")))
    taken = F.col("epochs") + (F.col("rest") > 0).cast("long") * (_taken() | _closes()).cast("long")
    return found.withColumn("n", F.when(F.col("size") > 0, taken).otherwise(0))


def mix(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", weight: Column | None = None) -> DataFrame:
    """(key, size, source_size, target, taken) for every document; taken counts words, repeats included."""
    name = fresh(docs, "unit")
    units = materialize(sized(docs, text, source, key, weight, name).select(f"{name}.*"), "mix-units")
    found = copies(units, plan(units))
    return found.select(F.col("id").alias(key), "size", "source_size", "target", (F.col("n") * F.col("size")).alias("taken"))


def mixture(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", weight: Column | None = None) -> DataFrame:
    """docs with each row as many times as the mix takes it (rows without words: never)."""
    columns = docs.columns
    name, whole = fresh(docs, "unit"), fresh(docs, "document")
    rows = sized(docs.select(F.struct(*columns).alias(whole), *columns), text, source, key, weight, name).select(whole, f"{name}.*")
    units = materialize(rows.select("source", "size", "id", "e"), "mix-units")
    found = copies(rows, plan(units)).filter("n > 0")
    return found.select(whole, F.explode(F.sequence(F.lit(1), F.col("n")))).select(f"{whole}.*")

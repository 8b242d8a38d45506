"""Acquisition pairs: constant offset, small baseline, one reference; and what is missing.

Temporal rules are written as equi-joins: offsets on days, bands on bins as wide as the band, so that a row is dealt to
its own bin and the next one (or both next ones) and no pair rule plans as a product of two tables.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from burstmill.shared import fresh, maybe_broadcast

# Fixed value: a sentence of the error that users look for.
MIDNIGHT_HINT = "Is the end time intentionally put in the very beginning of that day?"


def offset_pairs(dates: DataFrame, days: int, date: str = "date", by: tuple[str, ...] = ()) -> DataFrame:
    """(by, prm_date, sec_date), sec = prm + days, with repeats: a day that occurs twice pairs twice."""
    keys = [F.col(c) for c in by]
    a = dates.select(*keys, F.to_date(F.col(date)).alias("prm_date")).withColumn("sec_date", F.date_add("prm_date", days))
    b = dates.select(*keys, F.to_date(F.col(date)).alias("sec_date"))
    return a.join(b, [*by, "sec_date"]).select(*by, "prm_date", "sec_date")


def offset_pairs_of_paths(paths: DataFrame, days: int, date: str, path: str, order: str, by: tuple[str, ...] = ()) -> DataFrame:
    """The same as a set: one path for each date, the last by `order`."""
    keys = [F.col(c) for c in by]
    one = paths.groupBy(*keys, F.to_date(F.col(date)).alias("d")).agg(F.max_by(path, order).alias("path"))
    a = one.select(*by, F.col("d").alias("prm_date"), F.col("path").alias("prm_path"), F.date_add("d", days).alias("sec_date"))
    return a.join(one.select(*by, F.col("d").alias("sec_date"), F.col("path").alias("sec_path")), [*by, "sec_date"]).select(*by, "prm_date", "sec_date", "prm_path", "sec_path")


def unpaired(dates: DataFrame, days: int, date: str = "date", by: tuple[str, ...] = ()) -> DataFrame:
    """Days without an acquisition `days` later."""
    d = dates.select(*by, F.to_date(F.col(date)).alias("prm_date")).distinct()
    return d.withColumn("sec_date", F.date_add("prm_date", days)).join(d.select(*by, F.col("prm_date").alias("sec_date")), [*by, "sec_date"], "left_anti").select(*by, "prm_date")


def require_pairs(pairs: DataFrame, end: str) -> DataFrame:
    """pairs, or an error that says why there may be none."""
    if pairs.isEmpty():
        hint = f" {MIDNIGHT_HINT}" if "T00:00:00" in end else ""
        raise ValueError(f"no pairs in the temporal extent.{hint}")
    return pairs


def in_any_pair(bursts: DataFrame, pairs: DataFrame, begin: str, end: str) -> DataFrame:
    """Bursts whose begin day or end day is a day of some pair: two look-ups by day, as one with OR plans as a product."""
    days = maybe_broadcast(pairs.select(F.explode(F.array("prm_date", "sec_date")).alias("_begin")).distinct())
    met = bursts.withColumns({"_b": F.to_date(F.col(begin)), "_e": F.to_date(F.col(end))})
    met = met.join(days, F.col("_b") == F.col("_begin"), "left").join(days.withColumnRenamed("_begin", "_end"), F.col("_e") == F.col("_end"), "left")
    return met.filter("_begin IS NOT NULL OR _end IS NOT NULL").select(*bursts.columns)


def extent(pairs: DataFrame) -> DataFrame:
    """First and last day over both dates of all pairs, compared as dates."""
    return pairs.agg(F.min(F.least("prm_date", "sec_date")).alias("first_date"), F.max(F.greatest("prm_date", "sec_date")).alias("last_date"))


def repeated_primaries(pairs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return pairs.groupBy(*by, "prm_date").agg(F.count("*").alias("n")).filter("n > 1")


def baselines(acquisitions: DataFrame, by: tuple[str, ...] = (), date: str = "date", perp: str = "perp") -> DataFrame:
    """(by, master_date, slave_date, perp_baseline, temp_baseline) of all ordered pairs within `by`, self-pairs included.

    temp_baseline is master minus slave in days. For one burst this is the table of a year or a few of dates.
    """
    a = acquisitions.select(*by, F.to_date(F.col(date)).alias("master_date"), F.col(perp).alias("p1"))
    b = acquisitions.select(*by, F.to_date(F.col(date)).alias("slave_date"), F.col(perp).alias("p2"))
    both = a.join(b, list(by)) if by else a.crossJoin(F.broadcast(b))
    return both.select(*by, "master_date", "slave_date", (F.col("p2") - F.col("p1")).alias("perp_baseline"), F.datediff("master_date", "slave_date").alias("temp_baseline"))


def within_days(a: DataFrame, b: DataFrame, first: str, second: str, least: int, most: int, by: tuple[str, ...] = ()) -> DataFrame:
    """a and b joined on `by` where the day `second` of b is least to most days after the day `first` of a.

    Days are cut into bins as wide as the larger bound; rows of a go to two bins (three, if least is negative). Bins are join
    keys and no columns: they aren't shuffled, and what a and b are read from is filtered alike, so that two views of one
    table share its shuffle.
    """
    width = max(abs(least), abs(most), 1)
    number = lambda c: F.floor(F.datediff(c, F.lit("1970-01-01")) / width)
    step = fresh(a.join(b, F.lit(False)), "step")
    dealt = a.withColumn(step, F.explode(F.array(*(F.lit(k) for k in range(-1 if least < 0 else 0, 2 if most > 0 else 1)))))
    on = [*(F.col(f"a.{c}") == F.col(f"b.{c}") for c in by), number(F.col(f"a.{first}")) + F.col(f"a.{step}") == number(F.col(f"b.{second}"))]
    near = dealt.alias("a").join(b.alias("b"), reduce(and_, on)).filter(F.datediff(F.col(f"b.{second}"), F.col(f"a.{first}")).between(least, most))
    keys, named = {c.lower() for c in by}, {c.lower(): c for c in a.columns}
    return near.select(*(F.col(f"a.{named[c.lower()]}") for c in by), *(F.col(f"{x}.{c}") for x, df in (("a", a), ("b", b)) for c in df.columns if c.lower() not in keys))


def small_baseline_pairs(acquisitions: DataFrame, max_days: int, max_perp: float, min_days: int = 1, by: tuple[str, ...] = (), date: str = "date", perp: str = "perp") -> DataFrame:
    """(by, prm_date, sec_date, perp_baseline) with sec - prm in min_days..max_days and |perp| at most max_perp."""
    a = acquisitions.select(*by, F.to_date(F.col(date)).alias("prm_date"), F.col(perp).alias("p1"))
    b = acquisitions.select(*by, F.to_date(F.col(date)).alias("sec_date"), F.col(perp).alias("p2"))
    near = within_days(a, b, "prm_date", "sec_date", min_days, max_days, by).withColumn("perp_baseline", F.col("p2") - F.col("p1"))
    return near.filter(F.abs("perp_baseline") <= max_perp).select(*by, "prm_date", "sec_date", "perp_baseline")


def small_baseline_pairs_symmetric(acquisitions: DataFrame, max_days: int, max_perp: float, by: tuple[str, ...] = (), date: str = "date", perp: str = "perp") -> DataFrame:
    """The older rule: |days| at most max_days, with reverse and self-pairs."""
    return small_baseline_pairs(acquisitions, max_days, max_perp, -max_days, by, date, perp)


def reference_pairs(acquisitions: DataFrame, reference: DataFrame, by: tuple[str, ...] = (), with_self: bool = False, date: str = "date", perp: str = "perp") -> DataFrame:
    """(by, prm_date, sec_date, perp_baseline): the reference (by, ref_date, ref_perp) with every other acquisition."""
    b = acquisitions.select(*by, F.to_date(F.col(date)).alias("sec_date"), F.col(perp).alias("p2"))
    both = b.join(reference, list(by)) if by else b.crossJoin(F.broadcast(reference.limit(1)))
    rows = both.select(*by, F.col("ref_date").alias("prm_date"), "sec_date", (F.col("p2") - F.col("ref_perp")).alias("perp_baseline"))
    return rows if with_self else rows.filter("prm_date <> sec_date")


def modelled_coherence(perp: Column, days: Column, max_perp: float, max_days: float) -> Column:
    """Linear decay in both baselines, not below 0: a stand-in for the model of the processing toolbox."""
    return F.greatest(1 - F.abs(perp) / max_perp, F.lit(0.0)) * F.greatest(1 - F.abs(days) / max_days, F.lit(0.0))


def optimal_reference(acquisitions: DataFrame, by: tuple[str, ...], max_perp: float, max_days: float, date: str = "date", perp: str = "perp") -> DataFrame:
    """(by, ref_date, score): the date with the largest sum of modelled coherence (ties: the earliest).

    It compares all dates of a group with each other: a burst has some hundreds.
    """
    table = baselines(acquisitions, by, date, perp)
    score = F.round(F.sum(modelled_coherence(F.col("perp_baseline"), F.col("temp_baseline"), max_perp, max_days)), 6)
    each = table.groupBy(*by, "master_date").agg(score.alias("score"))
    first = F.min(F.struct((-F.col("score")).alias("s"), "master_date")).alias("x")
    return each.groupBy(*by).agg(first).select(*by, F.col("x.master_date").alias("ref_date"), (-F.col("x.s")).alias("score"))

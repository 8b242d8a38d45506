"""Pairing as a stream: each acquisition that arrives meets the one `days` earlier."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def offset_pairs_stream(arrivals: DataFrame, days: int, time: str = "start", by: tuple[str, ...] = (), delay: str = "2 days") -> DataFrame:
    """(by, prm_time, sec_time) from a stream of acquisitions, days apart by calendar day; the join's state is bounded by watermarks."""
    day = F.date_trunc("day", F.col(time))
    a = arrivals.select(*(F.col(c).alias(f"p_{c}") for c in by), F.col(time).alias("prm_time"), (day + F.expr(f"INTERVAL {days} DAYS")).alias("p_day")).withWatermark("prm_time", f"{days + 3} days")
    b = arrivals.select(*(F.col(c).alias(f"s_{c}") for c in by), F.col(time).alias("sec_time"), day.alias("s_day")).withWatermark("sec_time", delay)
    same = F.col("p_day") == F.col("s_day")
    for c in by:
        same &= F.col(f"p_{c}") == F.col(f"s_{c}")
    soon = (F.col("sec_time") >= F.col("prm_time") + F.expr(f"INTERVAL {days - 1} DAYS")) & (F.col("sec_time") <= F.col("prm_time") + F.expr(f"INTERVAL {days + 1} DAYS"))
    return a.join(b, same & soon).select(*(F.col(f"p_{c}").alias(c) for c in by), "prm_time", "sec_time")


def new_days(arrivals: DataFrame, time: str = "start", by: tuple[str, ...] = ("track",), delay: str = "2 days") -> DataFrame:
    """The first acquisition of each track and day."""
    return arrivals.withWatermark(time, delay).withColumn("day", F.to_date(F.col(time))).dropDuplicatesWithinWatermark([*by, "day"])

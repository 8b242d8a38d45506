"""Deburst and merge: neighbouring bursts of a sub-swath and neighbouring sub-swaths of a scene as one grid of samples.

A burst begins at a line time and has a number of lines, a sub-swath at a slant range time and has a number of samples, both
on grids of a common spacing. Neighbours overlap. The seam lies in the middle of the overlap: what lies before it is taken
from the earlier burst (or the nearer sub-swath), the rest from the later one, so each line of a sub-swath and each sample
of a line stands there once. Only the small tables of bursts and sub-swaths are sorted and windowed; the samples meet them
in one equi-join, behind a count of their rows, and are then only filtered and renumbered. They are not shuffled where
those tables are small.

Bursts that don't meet leave a gap of lines. One that ends no later than an earlier one gives nothing. Two that begin at the same time are taken in the order of their ids. Samples of a burst that
is not in the table, and bursts without samples, give no row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from burstmill.shared import maybe_broadcast


def strips(parts: DataFrame, by: list[str], number: str, start: str, count: str, spacing: float) -> DataFrame:
    """parts and (shift, first, past) of each: its place on the grid of its group, and from where to where it is taken.

    start: a time, count: how many places from there; the grid's place 0 is the group's earliest start. Places are whole
    multiples of the spacing; a start between two is rounded to the nearer one.
    """
    group = Window.partitionBy(*by)
    line = group.orderBy(start, number)
    shift = F.round((F.col(start) - F.min(start).over(group)) / F.lit(spacing)).cast("long")
    placed = parts.withColumn("shift", shift).withColumn("_past", F.col("shift") + F.col(count))
    placed = placed.withColumn("_reach", F.max("_past").over(line.rowsBetween(Window.unboundedPreceding, -1)))  # the farthest of those before
    begun = F.when(F.col("_reach") > F.col("shift"), F.floor((F.col("_reach") + F.col("shift")) / 2)).otherwise(F.col("shift"))
    covered = F.coalesce(F.col("_past") <= F.col("_reach"), F.lit(False))
    placed = placed.withColumn("first", F.when(~covered, begun.cast("long")))
    later = F.min("first").over(line.rowsBetween(1, Window.unboundedFollowing))
    return placed.withColumn("past", F.least("_past", F.coalesce(later, "_past"))).drop("_past", "_reach")


def deburst(samples: DataFrame, bursts: DataFrame, spacing: float, by: tuple[str, ...] = ("swath", "pol", "date"), burst: str = "burst_id") -> DataFrame:
    """samples (by, burst, y, x, ...) on one grid of lines for each group: y is the line of the sub-swath, from 0.

    bursts: (by, burst, start, lines), start the time of the burst's line 0 in the unit of spacing.
    """
    where = strips(bursts.select(*by, burst, "start", "lines"), list(by), burst, "start", "lines", spacing).select(*by, burst, "shift", "first", "past")
    met = samples.join(maybe_broadcast(where), [*by, burst]).withColumn("y", F.col("y") + F.col("shift"))
    return met.filter("y >= first AND y < past").select(samples.columns)


def merged(samples: DataFrame, swaths: DataFrame, line_spacing: float, range_spacing: float, by: tuple[str, ...] = ("pol", "date"), swath: str = "swath") -> DataFrame:
    """Debursted samples (by, swath, y, x, ...) of all sub-swaths on one grid: y from the earliest line, x from the nearest sample.

    swaths: (by, swath, start, near, samples): the time of the sub-swath's line 0, and the range time and number of samples of a line.
    """
    where = strips(swaths.select(*by, swath, "start", "near", "samples"), list(by), swath, "near", "samples", range_spacing)
    down = F.round((F.col("start") - F.min("start").over(Window.partitionBy(*by))) / F.lit(line_spacing)).cast("long")
    where = where.withColumn("down", down).select(*by, swath, "shift", "first", "past", "down")
    met = samples.join(maybe_broadcast(where), [*by, swath]).withColumns({"x": F.col("x") + F.col("shift"), "y": F.col("y") + F.col("down")})
    return met.filter("x >= first AND x < past").select(samples.columns)

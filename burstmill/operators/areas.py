"""Areas joined to footprints: each different ring once, an equi-join on quadtree cells, then the polygon rule, each pair once.

Footprints repeat with every pass, so rings are numbered first, compared once however many rows have them, and the pairs
of numbers are joined to the rows of both sides.

A ring is covered by the cells of one level, at most four, as wide as its box or wider. Rings of different size meet
where one's cell is the other's or lies above it in the tree, so each side also names the cells above its own, but only those of
levels that the other side uses: cells at the top, where all rings would meet, name nobody unless areas are that large. Two
boxes that overlap share the corner (the greater west, the greater south), and the pair is taken in the cell of the finer
level that holds it, so no pair comes twice and nothing needs to be sorted out afterwards.

Rings are arrays of [lon, lat] pairs whose last point repeats the first; null rings, rings of fewer than four points and
those with a null, NaN or infinite coordinate meet nothing. Rings that touch meet. Rows that repeat are rows of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from burstmill.functions.geometry import box_of, edges, outlines_meet, wkt_points
from burstmill.shared import materialize, maybe_broadcast

#: Degrees that a cell of level 0 is wide, and the finest level.
SPAN, FINEST = 512.0, 28


def _wide(level: Column) -> Column:
    return F.lit(SPAN) / F.pow(F.lit(2.0), level)


def _ringed(rows: DataFrame, ring: str) -> DataFrame:
    """(row, points) of the rows whose ring is one; points: its x, y, x, y and so on."""
    fine = F.forall(F.col(ring), lambda p: (F.size(p) >= 2) & F.coalesce(F.abs(p[0]) < 1e6, F.lit(False)) & F.coalesce(F.abs(p[1]) < 1e6, F.lit(False)))
    points = F.flatten(F.transform(ring, lambda p: F.array(p[0], p[1])))
    # exploded, not filtered: a filter would be pushed to the scan and make the ring once more for each of its conditions
    return rows.select(F.struct(*rows.columns).alias("row"), F.explode(F.when((F.size(ring) > 3) & fine, F.array(points))).alias("points"))


def _shapes(ringed: DataFrame) -> DataFrame:
    """(points, shape): each ring once, under a number."""
    return materialize(ringed.select("points").distinct().withColumn("shape", F.monotonically_increasing_id()), "shapes")


def _boxed(shapes: DataFrame) -> DataFrame:
    """(shape, edges, box, level)"""
    ring = F.transform(F.sequence(F.lit(0), F.size("points") - 2, F.lit(2)), lambda i: F.array(F.get("points", i), F.get("points", i + 1)))
    used = shapes.select("shape", ring.alias("ring")).select("shape", edges(F.col("ring")).alias("edges"), box_of(F.col("ring")).alias("box"))
    size = F.greatest(F.col("box.east") - F.col("box.west"), F.col("box.north") - F.col("box.south"))
    # a whole number of halvings after which a cell is still as wide as the box
    level = F.least(F.floor(F.log2(F.lit(SPAN) / F.greatest(size, F.lit(1e-9)))), F.lit(FINEST))
    return used.withColumn("level", F.greatest(level, F.lit(0)).cast("int"))


def _cells(boxes: DataFrame, others: list[int]) -> DataFrame:
    """boxes once for each cell (at, ix, iy): at is their own level or a coarser one among others."""
    at = F.array_union(F.array("level"), F.filter(F.array(*(F.lit(x) for x in others)).cast("array<int>"), lambda x: x < F.col("level")))
    spread = boxes.withColumn("at", F.explode(at))
    number = lambda c: F.floor(F.col(f"box.{c}") / _wide(F.col("at"))).cast("long")
    spread = spread.withColumn("ix", F.explode(F.sequence(number("west"), number("east"))))
    return spread.withColumn("iy", F.explode(F.sequence(number("south"), number("north"))))


def _shapes_meet(one: DataFrame, two: DataFrame) -> DataFrame:
    """(_sa, _sb): the numbers of the shapes of both sides that touch or overlap."""
    one, two = _boxed(one), _boxed(two)
    levels = [sorted(r["level"] for r in t.select("level").distinct().collect()) for t in (one, two)]  # at most FINEST + 1 each
    side = lambda boxes, others, s: _cells(boxes, others).select("at", "ix", "iy", F.col("shape").alias(f"_s{s}"), F.col("edges").alias(f"_e{s}"), F.col("box").alias(f"_b{s}"), F.col("level").alias(f"_l{s}"))
    # merged even if a side is small: comparing costs more than moving, and the shuffle deals it to all tasks
    met = side(one, levels[1], "a").hint("merge").join(side(two, levels[0], "b"), ["at", "ix", "iy"]).filter(F.col("at") == F.least("_la", "_lb"))
    corner = [F.greatest(F.col(f"_ba.{c}"), F.col(f"_bb.{c}")) for c in ("west", "south")]
    past = [F.least(F.col(f"_ba.{c}"), F.col(f"_bb.{c}")) for c in ("east", "north")]
    once = (corner[0] <= past[0]) & (corner[1] <= past[1]) & (F.floor(corner[0] / _wide(F.col("at"))) == F.col("ix")) & (F.floor(corner[1] / _wide(F.col("at"))) == F.col("iy"))
    return met.filter(once).filter(outlines_meet(F.col("_ea"), F.col("_eb"))).select("_sa", "_sb")


def meeting(a: DataFrame, b: DataFrame, a_ring: str = "ring", b_ring: str = "ring") -> DataFrame:
    """(a, b): structs of the rows of both sides whose rings touch or overlap (planar)."""
    one, two = _ringed(a, a_ring), _ringed(b, b_ring)
    shapes = [_shapes(one), _shapes(two)]
    left, right = (t.join(maybe_broadcast(s), "points").select(F.col("row").alias(n), F.col("shape").alias(f"_s{n}")) for t, s, n in zip((one, two), shapes, "ab"))
    return left.join(_shapes_meet(*shapes), "_sa").join(right, "_sb").select("a", "b")


def of_wkt(areas: DataFrame, wkt: str, ring: str = "ring") -> DataFrame:
    """areas with the outer ring of a POLYGON text as a column of points."""
    return areas.withColumn(ring, wkt_points(F.regexp_extract(wkt, r"\(\(([^)]*)\)", 1)))

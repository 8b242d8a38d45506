"""Areas of cells as polygons with holes: boundary edges, chained into rings by pointer doubling.

Cell (y, x) covers x..x+1 and y..y+1. An area is a 4-connected component of flagged cells. Each side of a cell that no cell of
its own area shares is an edge, directed so that the cell lies to its left; so outer rings turn from the x axis to the y
axis (a positive area) and holes the other way. Where two cells of an area meet at a corner alone, rings touch there
and don't cross: an edge goes on to the cell ahead to the right, else to the one ahead, else around its own cell. So every
area has one outer ring and no ring meets itself, and the areas of an area's rings add up to its number of cells.

An edge's successor is known from the eight cells around its own. Rings are found by doubling: after t rounds an edge knows
the smallest edge among the 2^t from itself on, how far away it is, and the edge 2^t ahead; when a round teaches no
edge anything, all of them know the first edge of their ring and their distance from it. A ring of n edges takes
log2(n) rounds of one equi-join each, written to the shared folder.

Images without flagged cells have no rings; a null flag is none; rows that repeat a cell count once.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from burstmill.operators.kernels import labelled_cells
from burstmill.shared import discard, materialize, new_path

MAX_ROUNDS = 60
#: (dx, dy) in which the sides of a cell run (bottom, right, top, left), and what lies beyond them.
_ALONG = ((1, 0), (0, 1), (-1, 0), (0, -1))
_BEYOND = ((0, -1), (1, 0), (0, 1), (-1, 0))
#: Where a side starts, from the cell's own corner.
_START = ((0, 0), (1, 0), (1, 1), (0, 1))
_AROUND = [(dx, dy) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]


def _number(y: Column, x: Column, side: int) -> Column:
    return y * F.lit(1 << 33) + x * 4 + F.lit(side)


def boundary_edges(cells: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, component, edge, after, side, x0, y0): the boundary of labelled cells (by, component, y, x), each edge with its successor."""
    marks = F.array(*(F.struct((F.col("y") - dy).alias("y"), (F.col("x") - dx).alias("x"), F.lit(1 << k).alias("bit")) for k, (dx, dy) in enumerate(_AROUND)))
    around = cells.select(*by, "component", F.explode(marks).alias("m")).groupBy(*by, "component", "m.y", "m.x").agg(F.bit_or("m.bit").alias("have"))
    has = lambda dx, dy: F.col("have").bitwiseAND(F.lit(1 << _AROUND.index((dx, dy)))) != 0
    sides = []
    for s in range(4):
        (ax, ay), (bx, by_) = _ALONG[s], _BEYOND[s]
        right = _number(F.col("y") + ay + by_, F.col("x") + ax + bx, (s + 3) % 4)
        after = F.when(has(ax + bx, ay + by_), right).when(has(ax, ay), _number(F.col("y") + ay, F.col("x") + ax, s)).otherwise(_number(F.col("y"), F.col("x"), (s + 1) % 4))
        start = [(F.col(c) + d).alias(f"{c}0") for c, d in zip("xy", _START[s])]
        sides.append(F.when(~has(bx, by_), F.struct(_number(F.col("y"), F.col("x"), s).alias("edge"), after.alias("after"), F.lit(s).alias("side"), *start)))
    found = around.filter(has(0, 0)).select(*by, "component", F.explode(F.array(*sides)).alias("s"))
    return found.filter("s IS NOT NULL").select(*by, "component", "s.*")


def _chained(edges: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """(by, edge, ring, ahead): each edge's ring, named by its smallest edge, and how many edges ahead of it that one lies."""
    now = materialize(edges.select(*by, "edge", F.col("after").alias("jump"), F.col("edge").alias("ring"), F.lit(0).cast("long").alias("ahead")), "chain")
    for t in range(MAX_ROUNDS):
        far = now.select(*by, F.col("edge").alias("jump"), F.col("jump").alias("_jump"), F.col("ring").alias("_ring"), (F.col("ahead") + F.lit(1 << t)).alias("_ahead"))
        less = F.col("_ring") < F.col("ring")
        after = now.join(far, [*by, "jump"]).select(*by, "edge", F.col("_jump").alias("jump"), F.least("ring", "_ring").alias("ring"), F.when(less, F.col("_ahead")).otherwise(F.col("ahead")).alias("ahead"), less.alias("learnt"))
        after = materialize(after, "chain")
        learnt = not after.filter("learnt").isEmpty()
        discard(now)
        now = after
        if not learnt:
            return now.select(*by, "edge", "ring", "ahead")
    raise RuntimeError(f"rings did not close in {MAX_ROUNDS} rounds")


def rings(image: DataFrame, flag: str, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, component, ring, outer, position, x, y): the corners of each ring in order, from 0; the first does not repeat.

    component: the smallest cell number of the area, y * 2^31 + x; outer: whether the ring is the area's outer one.
    """
    edges = materialize(boundary_edges(labelled_cells(image, flag, by), by), "edges")
    chain = _chained(edges, by)
    met = edges.join(chain, [*by, "edge"])
    end = [F.col(f"{c}0") + F.element_at(F.array(*(F.lit(a[k]) for a in _ALONG)), F.col("side") + 1) for k, c in enumerate("xy")]
    met = materialize(met.select(*by, "component", "ring", "ahead", "x0", "y0", end[0].alias("x1"), end[1].alias("y1"), (F.pmod("after", F.lit(4)) != F.col("side")).alias("turns")), "chained-edges")
    whole = met.groupBy(*by, "ring").agg(F.count("*").alias("n"), (F.sum(F.col("x0") * F.col("y1") - F.col("x1") * F.col("y0")) > 0).alias("outer"))
    # the edge after the first one lies n - 1 edges before it
    corners = met.filter("turns").join(whole, [*by, "ring"]).withColumn("step", F.pmod(F.col("n") - F.col("ahead"), F.col("n")))
    return corners.select(*by, "component", "ring", "outer", "step", F.col("x1").alias("x"), F.col("y1").alias("y")).withColumn("position", F.row_number().over(Window.partitionBy(*by, "ring").orderBy("step")) - 1).drop("step")


def measured(corners: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, component, ring, outer, area, length) of the rings by their corners: the area is negative for holes."""
    ring = Window.partitionBy(*by, "ring").orderBy("position")
    ahead = lambda c: F.coalesce(F.lead(c).over(ring), F.first(c).over(ring))
    sides = corners.withColumns({"x1": ahead("x"), "y1": ahead("y")})
    area = F.sum(F.col("x") * F.col("y1") - F.col("x1") * F.col("y")) / 2
    length = F.sum(F.abs(F.col("x1") - F.col("x")) + F.abs(F.col("y1") - F.col("y")))
    return sides.groupBy(*by, "component", "ring", "outer").agg(area.cast("long").alias("area"), length.cast("long").alias("length"))


def features(corners: DataFrame, by: tuple[str, ...] = (), origin: tuple[float, float] = (0.0, 0.0), step: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """(by, component, feature): each area as the text of a GeoJSON feature, its outer ring first, then holes.

    Point (x, y) becomes origin + step * (x, y). With a negative product of steps rings would turn the wrong way and are
    turned round. A polygon is one value, so its corners meet in one row.
    """
    turned = step[0] * step[1] < 0
    point = F.array(*(F.lit(float(o)) + F.lit(float(s)) * F.col(c) for o, s, c in zip(origin, step, "xy")))
    one = corners.groupBy(*by, "component", "ring", "outer").agg(F.sort_array(F.collect_list(F.struct("position", point.alias("p")))).alias("points"))
    line = F.transform("points", lambda p: p["p"])
    line = F.concat(line, F.slice(line, 1, 1))
    line = F.reverse(line) if turned else line
    # outer first: false sorts before true
    lines = F.sort_array(F.collect_list(F.struct((~F.col("outer")).alias("hole"), "ring", line.alias("line"))))
    areas = one.groupBy(*by, "component").agg(F.transform(lines, lambda r: r["line"]).alias("coordinates"))
    properties = F.struct(*(F.col(c) for c in (*by, "component")))
    geometry = F.struct(F.lit("Polygon").alias("type"), "coordinates")
    return areas.select(*by, "component", F.to_json(F.struct(F.lit("Feature").alias("type"), properties.alias("properties"), geometry.alias("geometry"))).alias("feature"))


def write_geojson(found: DataFrame, path: str | None = None) -> str:
    """Features as a folder of line-delimited GeoJSON, in the shared folder if no path is given; returns the path."""
    path = path or new_path(found.sparkSession, "areas")
    found.select(F.col("feature").alias("value")).write.text(path)
    return path


def collection(found: DataFrame) -> dict:
    """A small set of features as one collection: for reports and tests, it comes to the driver."""
    return {"type": "FeatureCollection", "features": [json.loads(r["feature"]) for r in found.orderBy("component").toLocalIterator()]}

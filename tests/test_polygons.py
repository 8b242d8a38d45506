import json
from collections import defaultdict

import numpy as np
import pytest
from burstmill.operators import kernels, polygons

SCHEMA = "image string, y long, x long, class boolean"


def flood(grid):
    """Component of each cell, named by its smallest (y, x)."""
    found = {}
    for y, x in np.argwhere(grid).tolist():
        if (y, x) not in found:
            stack = [(y, x)]
            while stack:
                c = stack.pop()
                if c not in found:
                    found[c] = (y << 31) + x
                    stack += [(c[0] + a, c[1] + b) for a, b in ((0, 1), (1, 0), (0, -1), (-1, 0)) if 0 <= c[0] + a < grid.shape[0] and 0 <= c[1] + b < grid.shape[1] and grid[c[0] + a, c[1] + b]]
    return found


def frame(spark, grids):
    return spark.createDataFrame([(k, y, x, bool(v)) for k, g in grids.items() for (y, x), v in np.ndenumerate(g)], SCHEMA)


def inside(ring, y, x):
    n, hit = len(ring), False
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
        if (ay > y) != (by > y) and x < ax + (bx - ax) * (y - ay) / (by - ay):
            hit = not hit
    return n > 3 and hit


@pytest.fixture(scope="module")
def grids():
    r = np.random.default_rng(4)
    return {"a": r.random((14, 17)) < 0.62, "b": r.random((12, 9)) < 0.5}


def test_rings_by_image(spark, grids):
    rows = polygons.rings(frame(spark, grids), "class", ("image",)).collect()
    by_ring = defaultdict(list)
    for r in rows:
        by_ring[r["image"], r["component"], r["ring"], r["outer"]].append((r["position"], (r["x"], r["y"])))
    areas, covers, outers = defaultdict(float), defaultdict(set), defaultdict(int)
    for (image, component, _, outer), points in by_ring.items():
        points.sort()
        assert [p for p, _ in points] == list(range(len(points)))
        ring = [p for _, p in points]
        assert len(set(ring)) == len(ring)  # no ring meets itself
        assert all((a[0] == b[0]) != (a[1] == b[1]) for a, b in zip(ring, ring[1:] + ring[:1]))
        area = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1])) / 2
        assert (area > 0) == outer
        outers[image, component] += outer
        areas[image, component] += area
        covers[image, component] ^= {(y, x) for y in range(14) for x in range(17) if inside(ring, y + 0.5, x + 0.5)}
    for image, g in grids.items():
        truth = defaultdict(set)
        for cell, component in flood(g).items():
            truth[image, component].add(cell)
        for key, cells in truth.items():
            assert covers[key] == cells and areas[key] == len(cells) and outers[key] == 1
    assert len(areas) == sum(len(set(flood(g).values())) for g in grids.values())


def test_components_by_image(spark, grids):
    found = kernels.raster_components(frame(spark, grids), "class", ("image",)).collect()
    truth = {(k, c): sum(v == c for v in flood(g).values()) for k, g in grids.items() for c in set(flood(g).values())}
    assert {(r["image"], r["component"]): r["cells"] for r in found} == truth


def test_touching_corners_and_holes(spark):
    g = np.ones((4, 5), bool)
    g[1, 1] = g[2, 2] = False  # two holes that touch
    g[3, 3] = False  # and one that touches the second and opens to the border
    measured = polygons.measured(polygons.rings(frame(spark, {"a": g}), "class")).collect()
    assert sorted((r["outer"], r["area"], r["length"]) for r in measured) == [(False, -1, 4), (False, -1, 4), (True, 19, 20)]


def test_features(spark):
    g = np.ones((3, 3), bool)
    g[1, 1] = False
    corners = polygons.rings(frame(spark, {"a": g}), "class")
    found = polygons.collection(polygons.features(corners, origin=(100.0, 50.0), step=(10.0, -10.0)))
    outer, hole = found["features"][0]["geometry"]["coordinates"]
    assert outer[0] == outer[-1] and len(outer) == len(hole) == 5
    turn = lambda ring: sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:]))
    assert turn(outer) / 2 == 900 and turn(hole) / 2 == -100
    path = polygons.write_geojson(polygons.features(corners))
    assert [json.loads(r["value"])["geometry"]["type"] for r in spark.read.text(path).collect()] == ["Polygon"]


def test_repeated_null_and_no_cells(spark):
    rows = [("a", 0, 0, True), ("a", 0, 0, True), ("a", 0, 1, None), ("a", 5, 5, False)]
    corners = polygons.rings(spark.createDataFrame(rows, SCHEMA), "class").collect()
    assert sorted((r["x"], r["y"]) for r in corners) == [(0, 0), (0, 1), (1, 0), (1, 1)]
    assert polygons.rings(spark.createDataFrame(rows[2:], SCHEMA), "class").count() == 0

import numpy as np
import pytest
from burstmill.functions.geometry import rings_meet
from burstmill.operators import areas
from pyspark.sql import functions as F


def triangles(spark, n, seed, sizes):
    r = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        x, y, s = r.uniform(-20, 20), r.uniform(-20, 20), float(r.choice(sizes))
        p = [[float(x + s * np.cos(t)), float(y + s * np.sin(t))] for t in sorted(r.uniform(0, 6.28, 3))]
        rows.append((k, [*p, p[0]]))
    return spark.createDataFrame(rows, "id long, ring array<array<double>>")


def pairs(found):
    return sorted((r["a"]["id"], r["b"]["id"]) for r in found.collect())


@pytest.mark.parametrize("sizes", [([0.5], [0.5]), ([0.1, 3, 15], [1.0]), ([0.01], [0.001, 30])])
def test_against_all_pairs(spark, sizes):
    a, b = triangles(spark, 70, 1, sizes[0]), triangles(spark, 60, 2, sizes[1])
    slow = a.select(F.col("id").alias("x"), F.col("ring").alias("r")).crossJoin(b.select(F.col("id").alias("y"), F.col("ring").alias("s"))).filter(rings_meet(F.col("r"), F.col("s")))
    found = areas.meeting(a, b)
    assert pairs(found) == sorted((r["x"], r["y"]) for r in slow.collect())
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_touching_odd_and_repeated(spark):
    square = lambda x, y, s=1.0: [[x, y], [x + s, y], [x + s, y + s], [x, y + s], [x, y]]
    nan = float("nan")
    a = [(1, square(0.0, 0.0)), (1, square(0.0, 0.0)), (2, None), (3, []), (4, [[0.0, 0.0], [1.0, 1.0], [0.0, 0.0]]), (5, square(nan, 0.0)), (6, [[0.0, None], [1.0, 0.0], [1.0, 1.0], [0.0, None]])]
    b = [(1, square(1.0, 1.0)), (2, square(1.1, 0.0)), (3, square(-50.0, -50.0, 100.0)), (4, square(0.25, 0.25, 0.5))]
    frame = lambda rows: spark.createDataFrame(rows, "id long, ring array<array<double>>")
    assert pairs(areas.meeting(frame(a), frame(b))) == [(1, 1), (1, 1), (1, 3), (1, 3), (1, 4), (1, 4)]
    assert pairs(areas.meeting(frame([]), frame(b))) == [] == pairs(areas.meeting(frame(a), frame([])))


def test_areas_of_text(spark):
    area = areas.of_wkt(spark.createDataFrame([(7, "POLYGON ((0 0, 4 0, 4 4, 0 0), (1 0.5, 2 0.5, 2 1, 1 0.5))")], "id long, wkt string"), "wkt")
    assert area.first()["ring"] == [[0.0, 0.0], [4.0, 0.0], [4.0, 4.0], [0.0, 0.0]]

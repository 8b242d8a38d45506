"""Rings that many rows share: compared once, and every row of both sides in the result."""

import pytest
from burstmill.operators import areas


def square(x, y, s=1.0):
    return [[x, y], [x + s, y], [x + s, y + s], [x, y + s], [x, y]]


def repeated(spark, rings, times):
    return spark.createDataFrame([(n * len(rings) + k, r) for n in range(times) for k, r in enumerate(rings)], "id long, ring array<array<double>>")


@pytest.mark.parametrize("threshold", ["10m", "-1"])
def test_repeated_rings_are_compared_once(spark, monkeypatch, threshold):
    compared, cells = [], areas._cells
    monkeypatch.setattr(areas, "_cells", lambda boxes, others: compared.append(boxes.count()) or cells(boxes, others))
    monkeypatch.setattr(areas, "maybe_broadcast", lambda df: df, raising=False)
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        a = repeated(spark, [square(0.0, 0.0), square(-0.0, 0.0), square(5.0, 5.0), square(2.0, 0.0)], 60)
        b = repeated(spark, [square(0.5, 0.5), square(1.0, 0.0), square(40.0, 40.0)], 50)
        found = sorted((r["a"]["id"], r["b"]["id"]) for r in areas.meeting(a, b).collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    meet = {(0, 0), (0, 1), (1, 0), (1, 1), (3, 1)}
    assert found == sorted((x, y) for x in range(240) for y in range(150) if (x % 4, y % 3) in meet)
    assert compared == [3, 3]  # 0.0 and -0.0 are one ring


def test_rows_keep_their_columns(spark):
    a = spark.createDataFrame([(1, [[0, 0, 7], [2, 0, 7], [2, 2, 8], [0, 0, 7]], "p"), (2, [[0, 0, 9], [2, 0, 9], [2, 2, 9], [0, 0, 9]], "q")], "shape int, points array<array<int>>, row string")
    b = spark.createDataFrame([(3, square(1.0, 0.0))], "edges int, ring array<array<double>>")
    found = sorted(areas.meeting(a, b, a_ring="points").collect())
    assert [(r["a"]["shape"], r["a"]["points"][2], r["a"]["row"], r["b"]["edges"]) for r in found] == [(1, [2, 2, 8], "p", 3), (2, [2, 2, 9], "q", 3)]

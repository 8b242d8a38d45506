import re

import numpy as np
import pytest
from burstmill import shared
from burstmill.operators import cube, resampling
from pyspark.sql import functions as F


def field(y, x):
    """Band-limited, up to 0.3 cycles a sample, and of amplitude 1 at most."""
    return (np.exp(2j * np.pi * (0.21 * x - 0.13 * y)) + 0.5 * np.exp(2j * np.pi * (0.3 * y + 0.05 * x)) + 0.3) / 1.8


def image(spark, h, w, f=field, name="a"):
    return spark.createDataFrame([(name, y, x, float(f(y, x).real), float(f(y, x).imag)) for y in range(h) for x in range(w)], "image string, y long, x long, i double, q double")


@pytest.mark.parametrize("kernel", ["bilinear", "bicubic", "sinc"])
def test_weights(kernel):
    at = np.array([0.0, 0.25, 3.5, -1.75, 7.999])
    first, w = resampling.weights(kernel, at)
    assert np.allclose(w.sum(1), 1)
    places = first[:, None] + np.arange(w.shape[1])
    if kernel != "sinc":
        assert np.allclose((places * w).sum(1), at)
    assert np.allclose(w[0], places[0] == 0)


def test_a_shifted_band_limited_image_comes_back(spark):
    h, w = 44, 52
    r = np.random.default_rng(1)
    rows = [("a", y, x, float(y + r.uniform(-1, 1)), float(x + r.uniform(-1, 1)), "extra") for y in range(12, 32) for x in range(12, 40)]
    places = spark.createDataFrame(rows, "image string, y long, x long, at_y double, at_x double, values string")
    found = resampling.resampled_complex(image(spark, h, w), places, "sinc", ("image",), tile=16)
    assert found.columns == ["image", "y", "x", "at_y", "at_x", "values", "i", "q"]
    rows = found.collect()
    assert len(rows) == 20 * 28
    assert max(abs(complex(v["i"], v["q"]) - field(v["at_y"], v["at_x"])) for v in rows) < 1e-3


def test_a_carrier_is_taken_off_and_put_on(spark):
    ramp = lambda y, x: 0.06 * (y - 20) ** 2 + 2.5 * x  # noqa: E731  beyond the band alone
    f = lambda y, x: field(y, x) * np.exp(1j * ramp(y, x))
    places = spark.createDataFrame([("a", 15 + 0.37 * k, 14.2 + 0.61 * k) for k in range(20)], "image string, at_y double, at_x double")
    found = resampling.resampled_complex(image(spark, 40, 44, f), places, "sinc", ("image",), "0.06 * (y - 20) * (y - 20) + 2.5 * x", 16).collect()
    assert max(abs(complex(v["i"], v["q"]) - f(v["at_y"], v["at_x"])) for v in found) < 1e-3


def slow(values, y, x, kernel):
    (y0, wy), (x0, wx) = (resampling.weights(kernel, np.array([v])) for v in (y, x))
    total = mass = core = 0.0
    for j in range(wy.shape[1]):
        for i in range(wx.shape[1]):
            at = (int(y0[0] + j), int(x0[0] + i))
            if at in values:
                total, mass = total + wy[0, j] * wx[0, i] * values[at], mass + wy[0, j] * wx[0, i]
                core += max(0, 1 - abs(y - at[0])) * max(0, 1 - abs(x - at[1]))
    return total / mass if core > 1 - 1e-9 else None


@pytest.mark.parametrize("kernel", ["bilinear", "bicubic", "sinc"])
def test_gaps_borders_tiles_and_repeated_places(spark, kernel):
    r = np.random.default_rng(2)
    values = {(y, x): float(r.normal()) for y in range(-3, 30) for x in range(20) if r.random() < 0.95}
    img = spark.createDataFrame([(y, x, v) for (y, x), v in values.items()] + [(40, 3, float("nan")), (41, 3, None)], "y long, x long, v double")
    places = [(float(r.uniform(-5, 32)), float(r.uniform(-2, 22))) for _ in range(300)] + [(4.0, 5.0)] * 2 + [(None, 1.0), (40.0, 3.0), (41.0, 3.0)]
    found = resampling.resampled(img, spark.createDataFrame(places, "at_y double, at_x double"), ["v"], kernel, tile=8).collect()
    assert len(found) == len(places)
    for row in found:
        truth = None if row["at_y"] is None else slow(values, row["at_y"], row["at_x"], kernel)
        assert row["v"] == (None if truth is None else pytest.approx(truth, abs=1e-9))


@pytest.mark.parametrize("kernel", ["bilinear", "bicubic"])
def test_elevation(spark, kernel):
    r = np.random.default_rng(3)
    heights = {(b, a): float(r.normal()) for b in range(-2, 12) for a in range(9) if (b, a) != (4, 4)}
    dem = spark.createDataFrame([(a, b, v) for (b, a), v in heights.items()], "col long, row long, height double")
    at = [(float(r.uniform(-0.1, 0.8)), float(r.uniform(-0.3, 1.2)), k % 3) for k in range(200)] + [(0.2, 0.3, 1)] * 3 + [(None, 0.1, 1), (float("nan"), 0.1, 1)]
    points = spark.createDataFrame(at, "lon double, lat double, row int")
    found = cube.with_elevation(points, dem, "lon", "lat", 0.1, kernel).collect()
    assert len(found) == len(at)
    for p in found:
        truth = None if p["lon"] is None or np.isnan(p["lon"]) else slow(heights, p["lat"] / 0.1, p["lon"] / 0.1, kernel)
        assert p["elevation"] == (None if truth is None else pytest.approx(truth, abs=1e-6))


@pytest.mark.parametrize("kernel", ["bilinear", "bicubic"])
def test_elevation_is_compiled(spark, kernel):
    dem = spark.range(400).selectExpr("id % 20 AS col", "id div 20 AS row", "cast(id AS double) AS height")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # an adaptive plan shows its code only when it has run
    try:
        found = cube.with_elevation(spark.range(50).selectExpr("id", "id * 0.3 AS lon", "id * 0.2 AS lat"), dem, "lon", "lat", 1.0, kernel)
        plan = found._jdf.queryExecution()
        sizes = re.findall(r"maxMethodCodeSize:(\d+)", spark._jvm.PythonSQLUtils.explainString(plan, "codegen"))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert "lambda" not in plan.optimizedPlan().toString()
    assert sizes and max(map(int, sizes)) < 8000  # the JVM interprets longer ones


def test_large_grid_is_not_gathered_to_be_counted(spark):
    costly = spark.range(10).select(F.raise_error(F.lit("it was counted")).alias("x"))
    assert shared.maybe_broadcast(costly.filter("x IS NULL"), 5, least=spark.range(6)) is not None
    few = shared.maybe_broadcast(spark.range(5), 5, least=spark.range(5))
    assert "broadcast" in few._jdf.queryExecution().analyzed().toString().lower()
    assert "broadcast" not in shared.maybe_broadcast(spark.range(6), 5, least=spark.range(2))._jdf.queryExecution().analyzed().toString().lower()


@pytest.mark.parametrize("kernel", ["bilinear", "bicubic"])
def test_elevation_of_odd_rows(spark, kernel):
    heights = {(b, a): float(10 * b + a * a) for b in range(1, 9) for a in range(1, 9) if (b, a) not in ((5, 5), (2, 7))}
    rows = [(a, b, v) for (b, a), v in heights.items()]
    rows += [(a, b, v - 1) for a, b, v in rows[::5]] + [(a, b, None) for a, b, _ in rows[::7]] + [(5, 5, float("nan")), (7, 2, None), (None, 3, 1.0), (3, None, 1.0)]
    dem = spark.createDataFrame(rows, "col long, row long, height double")
    below = 1 - 2**-52  # as good as the next node, so the cell's own node may be missing
    at = [(float(x), float(y)) for x in (0.5, below, 1.0, 2.25, 4.5, 5.0, 5.5, 7.75, 8.0, 8.5) for y in (below, 1.0, 3.5, 5.0, 6.25, 8.0)] * 2
    at += [(None, 2.0), (2.0, None), (float("nan"), 2.0), (float("inf"), 2.0), (2.0, float("-inf"))]
    found = cube.with_elevation(spark.createDataFrame(at, "lon double, lat double"), dem, "lon", "lat", 1.0, kernel).collect()
    assert len(found) == len(at) and sum(p["elevation"] is not None for p in found) > 60
    for p in found:
        odd = any(c is None or not np.isfinite(c) for c in (p["lon"], p["lat"]))
        truth = None if odd else slow(heights, p["lat"], p["lon"], kernel)
        assert p["elevation"] == (None if truth is None else pytest.approx(truth, abs=1e-6))


def test_empty(spark):
    none = image(spark, 1, 1).limit(0)
    places = spark.createDataFrame([("a", 0.0, 0.0)], "image string, at_y double, at_x double")
    assert resampling.resampled(none, places, ["i"], by=("image",)).collect()[0]["i"] is None
    assert resampling.resampled(image(spark, 2, 2), places.limit(0), ["i"], by=("image",)).count() == 0


def test_pairs_with_offsets(spark):
    import datetime as dt

    from burstmill.plans import workflows

    days = [dt.date(2024, 1, 1), dt.date(2024, 1, 13)]
    rows = [(7, "IW2", "VV", days[k], y, x, float(field(y + 0.4 * k, x - 0.7 * k).real), float(field(y + 0.4 * k, x - 0.7 * k).imag)) for k in (0, 1) for y in range(40) for x in range(40)]
    slc = spark.createDataFrame(rows, "burst_id long, swath string, pol string, date date, y long, x long, i double, q double")
    pairs = spark.createDataFrame([(7, "IW2", "VV", *days)], "burst_id long, swath string, pol string, prm_date date, sec_date date")
    grid = slc.filter(F.col("date") == F.lit(days[0])).filter("y BETWEEN 12 AND 28 AND x BETWEEN 12 AND 28")
    offsets = grid.select("burst_id", "swath", "pol", F.lit(days[0]).alias("prm_date"), F.lit(days[1]).alias("sec_date"), "y", "x", F.lit(-0.4).alias("dy"), F.lit(0.7).alias("dx"))
    found = workflows.paired_samples(slc, pairs, offsets).collect()
    assert len(found) == 17 * 17 and max(abs(complex(p["i1"], p["q1"]) - complex(p["i2"], p["q2"])) for p in found) < 1e-3


def test_degrees_and_metres_there_and_back(spark):
    from burstmill.functions.geometry import with_projected

    at = spark.createDataFrame([(9.3, 46.2), (5.9, -33.0), (11.99, 0.0), (8.0, 79.0)], "lon double, lat double")
    for epsg in (32632, 32732):
        there = with_projected(at, F.col("lon"), F.col("lat"), 4326, epsg, ("e", "n"))
        for r in with_projected(there, F.col("e"), F.col("n"), epsg, 4326, ("x", "y")).collect():
            assert (r["x"], r["y"]) == (pytest.approx(r["lon"], abs=1e-8), pytest.approx(r["lat"], abs=1e-8))
    with pytest.raises(ValueError):
        with_projected(at, F.col("lon"), F.col("lat"), 3035, 4326, ("x", "y"))


@pytest.mark.parametrize("target", [(32633, 25.0), (4326, 0.0003), (32632, 13.0)])
def test_warps_between_grids(spark, target):
    """A smooth surface of the place on the ground, sampled on one grid, is that surface on the other."""
    from burstmill.functions.geometry import with_projected

    size, row0, col0 = 20.0, 5_100_000 // 20, 740_000 // 20
    cells = spark.range(150 * 130).select((F.col("id") % 150 + row0).alias("row"), (F.floor(F.col("id") / 150) + col0).alias("col"))
    value = lambda x, y: F.sin(x / 700) + F.cos(y / 900)
    grid = cells.withColumn("v", value((F.col("col") + 0.5) * size, (F.col("row") + 0.5) * size))
    found = resampling.warped(grid, ["v"], (32632, size), target, "bicubic")
    found = with_projected(found, (F.col("col") + 0.5) * target[1], (F.col("row") + 0.5) * target[1], target[0], 32632, ("x", "y"))
    rows = found.withColumn("truth", value(F.col("x"), F.col("y"))).collect()
    area = 149 * 20 * 129 * 20 / (target[1] ** 2 if target[0] != 4326 else (target[1] * 111_000) ** 2 * np.cos(np.radians(46)))
    assert len({(r["row"], r["col"]) for r in rows}) == len(rows) == pytest.approx(area, rel=0.03)
    inner = [r for r in rows if col0 * 20 + 60 < r["x"] < (col0 + 127) * 20 and row0 * 20 + 60 < r["y"] < (row0 + 147) * 20]
    assert len(inner) > 0.85 * len(rows) and max(abs(r["v"] - r["truth"]) for r in inner) < 1e-3

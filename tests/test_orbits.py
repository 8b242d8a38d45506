import numpy as np
import pytest
from burstmill.operators import orbits
from pyspark.sql import functions as F

RADIUS, PERIOD, TILT = 7_071_000.0, 5924.0, 1.71


def truth(t, shift=0.0):
    w = 2 * np.pi / PERIOD
    r = RADIUS + shift
    p = np.array([r * np.cos(w * t), r * np.cos(TILT) * np.sin(w * t), r * np.sin(TILT) * np.sin(w * t)])
    v = w * np.array([-r * np.sin(w * t), r * np.cos(TILT) * np.cos(w * t), r * np.sin(TILT) * np.cos(w * t)])
    return p, v


def vectors(spark, shifts=None, step=10.0):
    rows = [(o, float(t), *map(float, truth(t, s)[0])) for o, s in (shifts or {1: 0.0}).items() for t in np.arange(600, 900, step)]
    return spark.createDataFrame(rows, "orbit long, t double, x double, y double, z double")


def test_states_between_vectors(spark):
    lines = spark.createDataFrame([(1, 605.0, "before"), (1, 610.0, "a"), (1, 731.37, "b"), (1, 880.0, "c"), (1, 885.0, "behind"), (9, 700.0, "other"), (1, None, "null"), (1, 731.37, "b")], "orbit long, when double, position2 string")
    found = orbits.with_state(lines, vectors(spark), "when").collect()
    assert len(found) == 8 and {r["position2"] for r in found if r["position"] is None} == {"before", "behind", "other", "null"}
    for r in found:
        if r["position"] is not None:
            p, v = truth(r["when"])
            assert np.abs(np.array(r["position"]) - p).max() < 0.02 and np.abs(np.array(r["velocity"]) - v).max() < 0.02


def test_cubic_tracks_are_exact(spark):
    f = lambda t: (3.0 + 2 * t - 0.1 * t**2 + 0.003 * t**3, 5.0 * t, -1.0)
    v = spark.createDataFrame([(1, float(t), *f(t)) for t in (0, 1, 2, 3.5, 4, 7, 7, 9)] + [(2, 0.0, 1.0, 1.0, 1.0)], "orbit long, t double, x double, y double, z double")
    found = orbits.with_state(spark.createDataFrame([(1, t) for t in (1.0, 2.2, 3.9, 6.9, 7.0)] + [(2, 0.0)], "orbit long, t double"), v, "t").orderBy("orbit", "t").collect()
    assert [r["position"] and r["position"]["x"] for r in found] == [pytest.approx(f(r["t"])[0]) if r["orbit"] == 1 else None for r in found]
    assert found[1]["velocity"]["x"] == pytest.approx(2 - 0.2 * 2.2 + 0.009 * 2.2**2)


def test_states_shuffle_lines_and_intervals_once(spark):
    lines = spark.createDataFrame([(1, 5, 605.0)], "orbit long, line long, t double")
    plan = orbits.with_state(lines, vectors(spark), "t")._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and plan.count("Join") == 1  # what is known of an orbit's last interval comes with it
    between = orbits.spans(vectors(spark)).orderBy("t1").collect()
    assert [r["last"] for r in between] == [False] * 26 + [True]
    assert all((r["t0"], r["t1"], r["t2"], r["x1"]) == (s["t1"], s["t2"], s["t3"], s["x2"]) for r, s in zip(between[1:], between))  # repeated as they are, for the compression


def test_states_of_odd_rows(spark):
    f = lambda t: (1.0 + t**3, 2.0 * t, None)
    v = [(o, float(t), *f(t)) for o in (1, None) for t in (-3, 0, 1, 1, 5, 6)] + [(1, None, 1.0, 1.0, 1.0), (1, 5.0, 900.0, 900.0, 900.0), (2, 0.0, *f(0)), (2, 1.0, *f(1)), (2, 2.0, *f(2))]
    lines = [(1, t) for t in (-1.0, -0.0, 0.5, 1.0, 4.9, 5.0, 5.0, 5.5, None, float("nan"))] + [(2, 1.0), (None, 1.0), (None, None)]
    found = orbits.with_state(spark.createDataFrame(lines, "orbit long, t double"), spark.createDataFrame(v, "orbit long, t double, x double, y double, z double"), "t").collect()
    assert len(found) == len(lines)
    held = [r for r in found if r["position"] is not None]
    assert sorted(r["t"] for r in held) == [0.0, 0.5, 1.0, 4.9, 5.0, 5.0] and {r["orbit"] for r in held} == {1}
    assert all(r["position"]["x"] == pytest.approx(f(r["t"])[0]) and r["velocity"]["y"] == pytest.approx(2.0) for r in held)
    assert all(r["position"]["z"] is None and r["velocity"]["z"] is None for r in held) and all(r["velocity"] is None for r in found if r["position"] is None)


def test_baselines(spark):
    v = vectors(spark, {1: 0.0, 2: 120.0, 3: -75.0})
    p, vel = truth(700.0)
    across = np.cross(p, vel)
    target = p * (6_378_000 / RADIUS) + across / np.linalg.norm(across) * 300_000
    images = spark.createDataFrame([(f"i{o}", o, 700.0, tuple(map(float, target))) for o in (1, 2, 3)], "image string, orbit long, t double, target struct<x:double,y:double,z:double>")
    pairs = spark.createDataFrame([("i1", "i2"), ("i1", "i3"), ("i1", "i1")], "prm string, sec string")
    found = {r["sec"]: r for r in orbits.baselines(images, v, pairs).collect()}
    look = target - p
    look /= np.linalg.norm(look)
    for sec, shift in (("i2", 120.0), ("i3", -75.0), ("i1", 0.0)):
        b = p / RADIUS * shift
        along = b @ look
        assert found[sec]["parallel"] == pytest.approx(along, abs=1e-3)
        assert found[sec]["perpendicular"] == pytest.approx(np.sign(shift) * np.sqrt(max(0, b @ b - along**2)), abs=1e-3)


def test_round_trip_of_known_points(spark):
    image = {"start": 690.0, "interval": 0.002, "near": 0.005, "spacing": 1.5e-8}
    rows, wanted = [], {}
    for k, (line, sample) in enumerate([(0.0, 0.0), (1234.5, 800.25), (20000.0, 21000.0), (7.75, 3.5)]):
        t, slant = image["start"] + line * image["interval"], (image["near"] + sample * image["spacing"]) * orbits.LIGHT / 2
        p, v = truth(t)
        up, along = p / np.linalg.norm(p), v / np.linalg.norm(v)
        side = np.cross(along, up)
        look = 0.8 * -up + 0.6 * side  # at right angles to the track
        rows.append((k, 1, tuple(map(float, p + slant * look))))
        wanted[k] = (line, sample)
    points = spark.createDataFrame(rows + [(9, 7, (1.0, 2.0, 3.0))], "id long, orbit long, place struct<x:double,y:double,z:double>")
    found = orbits.radar_places(points, vectors(spark, step=5.0), image).collect()
    assert {r["id"] for r in found} == set(wanted)
    for r in found:
        assert (r["line"], r["sample"]) == (pytest.approx(wanted[r["id"]][0], abs=0.05), pytest.approx(wanted[r["id"]][1], abs=0.05))


def test_geocentric(spark):
    p = spark.range(1).select(orbits.geocentric(F.lit(90.0), F.lit(0.0), F.lit(100.0)).alias("p"), orbits.geocentric(F.lit(0.0), F.lit(90.0), F.lit(0.0)).alias("q")).first()
    assert p["p"]["y"] == pytest.approx(6378237.0) and abs(p["p"]["x"]) < 1e-6
    assert p["q"]["z"] == pytest.approx(6356752.3142, abs=1e-3)


def test_empty(spark):
    none = vectors(spark).limit(0)
    assert orbits.with_state(spark.createDataFrame([(1, 5.0)], "orbit long, t double"), none, "t").first()["position"] is None

import math

import numpy as np
import pytest
from burstmill.operators import unwrapping
from pyspark.sql import functions as F


def wrap(v):
    return v - 2 * math.pi * np.round(v / (2 * math.pi))


def surface(h, w, seed=0):
    """A hill over a ramp, and a noisy strip whose random phases are full of residues."""
    r = np.random.default_rng(seed)
    y, x = np.mgrid[:h, :w]
    z = 0.35 * y + 0.2 * x + 40 * np.exp(-((y - h / 2) ** 2 + (x - w / 2) ** 2) / (2 * (w / 4) ** 2))
    noisy = (np.abs(y - h // 3) < 4) & (x > 3)
    phase = np.where(noisy, r.uniform(-math.pi, math.pi, z.shape), wrap(z))
    return z, phase, np.where(noisy, 0.05 * r.random(z.shape), 0.9)


def rows_of(h, w, seed=0, name="a"):
    z, phase, q = surface(h, w, seed)
    return z, q, [(name, int(a), int(b), float(phase[a, b]), float(q[a, b])) for a in range(h) for b in range(w)]


SCHEMA = "image string, y long, x long, phase double, coh double"


def test_a_forest_takes_the_best_edges():
    # a loop 0-1-2-3 whose cycles don't add up: the worst edge is left out
    a, b, k = np.array([0, 1, 2, 0]), np.array([1, 2, 3, 3]), np.array([1, 0, 2, 7])
    part, cycles, edges = unwrapping.spanning_cycles(5, a, b, k)
    assert part.tolist() == [0, 0, 0, 0, 4] and cycles.tolist() == [0, 1, 1, 3, 0] and edges.tolist() == [0, 1, 2]
    _, cycles, _ = unwrapping.spanning_cycles(5, a[::-1], b[::-1], k[::-1])
    assert cycles.tolist() == [0, 5, 5, 7, 0]


@pytest.mark.parametrize("seed", range(5))
def test_forest_against_one_edge_at_a_time(seed):
    r = np.random.default_rng(seed)
    n, m = 40, 70
    a, b, k, order = r.integers(n, size=m), r.integers(n, size=m), r.integers(-3, 4, m), r.permutation(m)
    tree, cycle = list(range(n)), [0] * n
    for e in order:
        if tree[a[e]] != tree[b[e]]:
            old, off = tree[b[e]], cycle[a[e]] + k[e] - cycle[b[e]]
            for i in range(n):
                if tree[i] == old:
                    tree[i], cycle[i] = tree[a[e]], cycle[i] + off
    part, cycles, _ = unwrapping.spanning_cycles(n, a[order], b[order], k[order])
    for i in range(n):
        first = min(j for j in range(n) if tree[j] == tree[i])
        assert part[i] == first and cycles[i] == cycle[i] - cycle[first]


@pytest.mark.parametrize("seed", range(2))
def test_joins_find_the_same_forest(spark, seed):
    r = np.random.default_rng(seed)
    n, edges = 30, {}
    for _ in range(60):
        a, b = sorted(r.integers(n, size=2).tolist())
        if a != b:
            edges[a, b] = (int(r.integers(-3, 4)), float(r.integers(5)))
    rows = [(g, a, b, k, w, 100 * a + b) for g in ("p", "q") for (a, b), (k, w) in edges.items()]
    found = unwrapping.aligned(spark.createDataFrame(rows, "g string, a long, b long, k long, w double, place long"), ("g",)).collect()
    keys = list(edges)
    order = sorted(range(len(keys)), key=lambda i: (-edges[keys[i]][1], keys[i]))
    a, b = (np.array(v)[order] for v in zip(*keys))
    part, cycles, _ = unwrapping.spanning_cycles(n, a, b, np.array([edges[e][0] for e in keys])[order])
    assert {(r["g"], r["node"]): (r["root"], r["cycles"]) for r in found} == {(g, i): (part[i], cycles[i]) for g in ("p", "q") for e in keys for i in e}


def test_known_integers_by_image_over_tiles(spark):
    images = {"a": (60, 50, 1), "b": (45, 70, 2)}
    made = {k: rows_of(*v, k) for k, v in images.items()}
    df = spark.createDataFrame([r for _, _, rows in made.values() for r in rows], SCHEMA)
    found = unwrapping.unwrap(df, "phase", "coh", ("image",), (16, 20)).collect()
    assert len(found) == sum(h * w for h, w, _ in images.values())
    wrapped = {(r["image"], r["y"], r["x"]): r["phase"] for r in df.collect()}
    for name, (z, q, _) in made.items():
        got = {(r["y"], r["x"]): r["unw_phase"] for r in found if r["image"] == name}
        off = np.array([got[y, x] - z[y, x] for y in range(z.shape[0]) for x in range(z.shape[1]) if q[y, x] > 0.5])
        assert np.ptp(off) < 1e-9
        assert all(abs(wrap(v - wrapped[name, y, x])) < 1e-9 for (y, x), v in got.items())


def test_tiles_do_not_matter(spark):
    r = np.random.default_rng(9)  # noise alone: residues everywhere
    rows = [("a", y, x, float(r.uniform(-math.pi, math.pi)), float(r.integers(4))) for y in range(23) for x in range(31) if r.random() < 0.9]
    df = spark.createDataFrame(rows, SCHEMA)
    whole, parts = ({(q["y"], q["x"]): round(q["unw_phase"], 6) for q in unwrapping.unwrap(df, "phase", "coh", tile=t).collect()} for t in ((64, 64), (7, 5)))
    assert whole == parts and len(whole) == len(rows)


def test_without_quality_second_differences_decide(spark):
    z, q, rows = rows_of(40, 40, 3)
    found = unwrapping.unwrap(spark.createDataFrame(rows, SCHEMA), tile=(20, 20)).collect()
    off = [r["unw_phase"] - z[r["y"], r["x"]] for r in found if q[r["y"], r["x"]] > 0.5]
    turns = np.round((np.array(off) - np.median(off)) / (2 * math.pi))
    assert (turns == 0).mean() > 0.98


def test_gaps_part_areas_and_rows_repeat(spark):
    rows = [("a", y, x, float(wrap(1.5 * x)), 1.0) for y in range(4) for x in range(30) if x not in (9, 10)]
    rows += [("a", 0, 9, None, 1.0), ("a", 1, 9, float("nan"), 1.0), ("a", 0, 0, 0.0, 1.0), ("a", 2, 12, float(wrap(18.0)), None)]
    df = spark.createDataFrame(rows, SCHEMA)
    found = {(r["y"], r["x"]): r["unw_phase"] for r in unwrapping.unwrap(df, "phase", "coh", tile=(2, 8)).collect()}
    assert len(found) == 4 * 28
    left, right = ({round(found[y, x] - 1.5 * x, 6) for y, x in found if side(x)} for side in (lambda x: x < 9, lambda x: x > 10))
    assert left == {0.0} and len(right) == 1


def test_empty_image(spark):
    assert unwrapping.unwrap(spark.createDataFrame([], SCHEMA)).count() == 0


def test_tiles_are_bounded(spark):
    with pytest.raises(ValueError, match="1024"):
        unwrapping.unwrap(spark.createDataFrame([], SCHEMA).withColumn("z", F.lit(1)), tile=(2048, 16))

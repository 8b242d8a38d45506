import math

import numpy as np
import pytest
from burstmill.llm import negatives
from pyspark.sql import functions as F

SCHEMA = "vec_id long, embedding array<float>, label int"


def slow(rows, every=50, positives=5, negatives=3):
    rows = [(i, [math.floor(256 * float(np.float32(x))) for x in v], label) for i, v, label in rows if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for i, v, label in {(i, tuple(v), label) for i, v, label in rows if i % every == 0}:
        scored = [(-sum(a * b for a, b in zip(v, w)), j, m) for j, w, m in rows if j != i]
        near = sorted((s, j) for s, j, m in scored if m == label)[:positives]
        for k, (s, j) in enumerate(near):
            fit = sorted((t, n) for t, n, m in scored if m != label and 50 * -s <= 100 * -t <= 95 * -s)[:negatives]
            out |= {(i, j, rank, n, -s, -t, k) for rank, (t, n) in enumerate(fit, 1)}
    return sorted(r[:6] for r in out)


def found(df):
    return sorted(tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def mine(spark, rows, every=50, schema=SCHEMA, **more):
    return found(negatives.mine(spark.createDataFrame(rows, schema), F.col("vec_id") % every == 0, **more))


def some(n, dims, labels, seed, digits=None):
    r = np.random.default_rng(seed)
    v = r.normal(size=(n, dims)) / math.sqrt(dims)
    v = v if digits is None else v.round(digits)
    return [(k, [float(np.float32(x)) for x in v[k]], int(r.integers(labels))) for k in range(n)]


def test_against_all_scores(spark):
    rows = some(400, 8, 4, 1)
    assert mine(spark, rows, 10) == slow(rows, 10)


def test_small_blocks_slices_and_digits(spark, monkeypatch):
    for name, value in (("ANCHORS", 5), ("SLICE", 60), ("DIGIT", 3), ("STRIP", 2)):
        monkeypatch.setattr(negatives, name, value)
    rows = some(300, 4, 3, 2, 1)  # many ties
    assert mine(spark, rows, 12) == slow(rows, 12)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = some(120, 4, 2, 3, 1) + [(None, [1.0, 1.0], 0), (500, None, 0), (501, [1.0], None), (502, [nan, 1.0], 0), (503, [inf], 1), (504, [None, 1.0], 1), (505, [], 1), (506, [0.5], 0), (550, [0.25, 0.5], 1)]
    rows += [rows[7], rows[7], rows[50]]  # repeated ids, of an anchor too
    assert mine(spark, rows, 10) == slow(rows, 10)


def test_equal_vectors_and_zero_scores(spark):
    rows = [(k, [0.5, 0.5], k % 2) for k in range(60)] + [(100 + k, [0.3, 0.5], k % 2) for k in range(30)] + [(200 + k, [0.0, 0.0], k % 2) for k in range(20)]
    assert mine(spark, rows, 20) == slow(rows, 20)


def test_large_components_are_exact(spark):
    r = np.random.default_rng(5)
    rows = [(k, [float(x) for x in r.integers(-(2**21), 2**21, 3)], int(r.integers(2))) for k in range(80)]
    assert mine(spark, rows, 10) == slow(rows, 10)
    with pytest.raises(ValueError, match="62 bits"):
        mine(spark, [(0, [1e30], 0), (1, [1.0], 1)])


def test_clashing_columns_and_text_labels(spark):
    rows = [(i, v, str(label), 1, 2) for i, v, label in some(60, 4, 2, 6)]
    got = mine(spark, rows, 10, "vec_id long, embedding array<float>, label string, key int, score int")
    assert got == slow([r[:3] for r in rows], 10)


def test_empty_tables(spark):
    assert mine(spark, []) == []
    assert mine(spark, [(1, [1.0], 0), (2, [1.0], 1)]) == []
    assert mine(spark, [(0, [1.0], 0), (2, [1.0], 1)]) == []

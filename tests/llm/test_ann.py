import math

import numpy as np
import pytest
from burstmill.llm import ann as A
from pyspark.sql import functions as F


def slow(rows, asked, k=10):
    """rows: id -> vector; the k nearest of each asked id by all distances, ties to the smaller id."""
    out = {}
    for q in asked:
        d = sorted((math.dist(v, rows[q]), i) for i, v in rows.items() if i != q)
        out[q] = [(i, x) for x, i in d[:k]]
    return out


def test_recall(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    ids, x = zip(*((r.vec_id, r.embedding) for r in table.collect()))
    ids, x = np.array(ids), np.array(x, float)
    found = {}
    for r in A.nearest(table, F.col("id") % 100 == 0).collect():
        found.setdefault(r.query_id, []).append(r)
    hits = []
    for i in np.flatnonzero(ids % 100 == 0):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        d[i] = np.inf
        own = sorted(found[ids[i]], key=lambda r: r.rank)
        assert [r.rank for r in own] == list(range(1, 11))
        assert [r.score for r in own] == sorted(r.score for r in own)
        for r in own:
            assert r.score == pytest.approx(d[np.flatnonzero(ids == r.vec_id)[0]], abs=1e-12)
        hits.append(len(set(ids[np.lexsort((ids, d))[:10]]) & {r.vec_id for r in own}) / 10)
    assert np.mean(hits) >= 0.95


def test_ties_copies_and_odd_rows(spark):
    """One vector that many rows have, and rows that take no part."""
    rng = np.random.default_rng(3)
    good = {i: [1.0, 2.0, 3.0] if i % 3 == 0 else [float(v) for v in rng.integers(-3, 4, 3)] for i in range(90)}
    good = {i: v for i, v in good.items() if any(v)}
    rows = [(i, v, "x") for i, v in good.items()] + [(12, good[12], "again")]
    rows += [(200, None, ""), (300, [0.0, -0.0, 0.0], ""), (400, [1.0, None, 2.0], ""), (500, [math.nan, 1.0, 1.0], ""), (600, [math.inf, 1.0, 1.0], ""), (700, [1.0, 2.0], ""), (None, [1.0, 1.0, 1.0], "")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, node string")
    found = {}
    for r in A.nearest(table, F.col("id") % 6 == 0).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    exact = slow(good, [i for i in good if i % 6 == 0])
    assert found.keys() == exact.keys()
    for q, near in exact.items():
        assert [(i, pytest.approx(s)) for _, i, s in sorted(found[q])] == near


def test_few_and_none(spark):
    schema = "vec_id long, embedding array<float>"
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])], schema)
    assert [(r.rank, r.vec_id) for r in A.nearest(few, F.col("id") == 0).orderBy("rank").collect()] == [(1, 2), (2, 1)]
    assert A.nearest(spark.createDataFrame([(0, [1.0])], schema), F.lit(True)).collect() == []
    assert A.nearest(spark.createDataFrame([], schema), F.lit(True)).collect() == []

import numpy as np
import pyarrow as pa
import pytest
from burstmill.llm import ann as A
from pyspark.sql import functions as F


def test_the_graph_does_the_search(spark, monkeypatch):
    """The graph's edges are near ones, and a search over it finds the nearest of 6,000 vectors while it measures a
    tenth of them at most; over a random graph of the same size it does not."""
    monkeypatch.setattr(A, "POOL", 12)
    monkeypatch.setattr(A, "EXPAND", 6)
    rng = np.random.default_rng(9)
    x = rng.standard_normal((6000, 6))
    table = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "node long, v array<double>")
    nodes = A.numbered(table)
    number = {r.node: r.number for r in nodes.select("number", "node").collect()}
    node = {k: i for i, k in number.items()}
    edges = A.build_graph(nodes)
    far = ((x[:, None, :] - x[None, ::60, :]) ** 2).sum(2).T
    far[np.arange(100), np.arange(0, 6000, 60)] = np.inf
    near = np.argsort(far, 1)
    of = {u: set(vs) for u, vs in edges.filter(F.col("u").isin([number[q] for q in range(0, 6000, 60)])).groupBy("u").agg(F.collect_list("v").alias("v")).collect()}
    assert np.mean([len({number[i] for i in near[k, : A.NEIGHBOURS]} & of[number[60 * k]]) / A.NEIGHBOURS for k in range(100)]) > 0.95
    asked = nodes.filter("node % 60 = 0").select(F.col("number").alias("q"), "v", F.col("number").alias("start"))

    def recall(graph):
        found = {node[r.q]: r for r in A.search(asked, nodes, graph).collect()}
        hits = [len({node[p.node] for p in found[60 * k].pool[1:11]} & set(near[k, :10].tolist())) / 10 for k in range(100)]
        return np.mean(hits), np.mean([r.measured for r in found.values()]) / 6000

    found, share = recall(edges)
    assert found > 0.95 and share < 0.1
    random = [(number[u], number[int(v)], 0.0, True) for u in range(6000) for v in rng.choice(6000, A.NEIGHBOURS, replace=False) if u != v]
    assert recall(spark.createDataFrame(random, "u long, v long, d float, old boolean"))[0] < 0.5


def test_recall_of_the_settings_as_they_are(spark):
    """20,000 vectors of 64 dimensions that lie near a space of 16."""
    rng = np.random.default_rng(4)
    x = (rng.standard_normal((20_000, 16)) @ rng.standard_normal((16, 64)) + 0.1 * rng.standard_normal((20_000, 64))).astype("f4")
    table = spark.createDataFrame(pa.table({"vec_id": np.arange(20_000), "embedding": pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), 64).cast(pa.list_(pa.float32()))}))
    rows = A.nearest(table, F.col("id") % 100 == 0).collect()
    found = {}
    for r in rows:
        found.setdefault(r.query_id, set()).add(r.vec_id)
    x = x.astype(float)
    hits = []
    for q in range(0, 20_000, 100):
        far = ((x - x[q]) ** 2).sum(1)
        far[q] = np.inf
        hits.append(len(found[q] & set(np.argsort(far)[:10].tolist())) / 10)
    print("recall", np.mean(hits), "measured", np.mean([r.measured for r in rows]))
    assert np.mean(hits) > 0.95 and np.mean([r.measured for r in rows]) < 5000


@pytest.mark.parametrize("meeting", [40, 1 << 40])
def test_crowded_parts_change_nothing(spark, monkeypatch, meeting):
    """All 300 queries meet at the entries; dealt to many groups or to one, they find the same."""
    rng = np.random.default_rng(6)
    x = rng.standard_normal((1500, 5))
    table = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    monkeypatch.setattr(A, "MEETING", meeting)
    found = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in A.nearest(table, F.col("id") % 5 == 0).collect())
    far = np.sqrt(((x[::5, None] - x[None]) ** 2).sum(2))
    far[np.arange(300), np.arange(0, 1500, 5)] = np.inf
    assert len(found) == 3000 and np.mean([v == np.argsort(far[q // 5])[r - 1] for q, r, v, _ in found]) > 0.99


def test_no_silent_end(spark, monkeypatch):
    monkeypatch.setattr(A, "MAX_ROUNDS", 1)
    table = spark.createDataFrame([(i, [float(i % 7), float(i)]) for i in range(300)], "vec_id long, embedding array<double>")
    with pytest.raises(RuntimeError):
        A.nearest(table, F.col("id") == 5)

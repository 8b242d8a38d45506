import numpy as np
from burstmill.llm import ann as A


def test_edges_among_near_copies(spark):
    """A third of the rows differ from one vector by a thousandth of a standard deviation; their edges are the near ones."""
    rng = np.random.default_rng(4)
    x = rng.standard_normal((2700, 16)).astype(np.float32)
    x[:900] = x[0] + 0.001 * rng.standard_normal((900, 16))
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    nodes = A.numbered(spark.createDataFrame(rows, "node long, v array<double>"))
    node = {r.number: r.node for r in nodes.select("number", "node").collect()}
    edges = A.build_graph(nodes).toPandas()
    assert len(node) == len(rows)
    edges["u"], edges["v"] = edges.u.map(node), edges.v.map(node)
    x = x[:900].astype(float)
    hits = []
    for u, of in edges[edges.u < 900].groupby("u"):
        d = ((x - x[u]) ** 2).sum(1)
        d[u] = np.inf
        hits.append(len(set(np.argsort(d)[: A.NEIGHBOURS]) & set(of.v)) / A.NEIGHBOURS)
    assert len(hits) == 900 and np.mean(hits) > 0.9, np.mean(hits)

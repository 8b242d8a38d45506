"""Approximate nearest neighbours: an NN-descent graph, searched greedily.

Numbering: random planes, set at the medians of a bounded sample (SAMPLE vectors), cut space into cells; a cell of many
nodes is cut further by hash. A node's number holds its part, so near nodes lie together, and joining lists with the
vectors that they mention sends few copies.

Building: the cells of BLOCKINGS sets of planes give each node its first NEIGHBOURS neighbours. Then, iteration by
iteration, neighbours of a node (with as many of those that have it as neighbour) are compared with each other, if one of
the two became a neighbour in the iteration before, and each keeps the nearest it has met. The comparison is a Spark
cogroup: parts of the node lists with the vectors that they mention, each vector once for a part. It ends when an
iteration replaces at most SETTLED of all edges.

Searching: all queries go on together. In each round every query opens the nearest EXPAND nodes of its pool that it
has not opened yet, joins their edges, drops the nodes it has seen, computes exact distances where the vectors lie,
and keeps the POOL nearest. It ends when all of every pool is open; it is an error if that takes MAX_ROUNDS rounds.
Queries start at their own node and a few entries.

Rows whose vector is null, zero, or holds null or non-finite components take no part, nor do null ids and vectors of
another length than the most frequent one (the longer among equally frequent). Rows that share an id count once, with
the smallest vector. Equal vectors are one node; the search returns nodes, and these give their ids back, smallest
first. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from burstmill.shared import discard, materialize, maybe_broadcast, ship_package

NEIGHBOURS = 36
#: Vectors that the planes are set by.
SAMPLE = 4096
#: Nodes of a cell on average, and at most before it is cut by hash; sets of planes.
CELL, BLOCK = 256, 512
BLOCKINGS = 3
#: Bits of a node's number below its part.
_PLACE = 20
#: Descent ends when an iteration replaces at most SETTLED of the edges; it is an error if none of so many does.
MAX_ITERATIONS = 60
SETTLED = 0.02
#: Better neighbours of a node that one part reports in one iteration: all that can become its neighbours.
REPORTED = 36
#: Nodes that a search holds, a parameter. Recall falls as a table grows: where it is short on a sample of queries held
#: against all distances, double the pool; what is measured grows nearly as much.
POOL = 130
EXPAND = 32
#: Candidates that one group measures on average, with their queries' vectors, before its queries are dealt to several.
MEETING = 65_536
ENTRIES = 8
MAX_ROUNDS = 400
SEED = 13


def usable_vectors(table: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v): v as doubles, one row for each id that takes part."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    # 0.0 and -0.0 are the same component
    rows = table.select(F.col(key).cast("long").alias("id"), v.alias("v")).filter(F.col("id").isNotNull() & F.col("v").isNotNull() & fine)
    rows = rows.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))
    most = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    rows = rows.filter(F.size("v") == (most[0]["n"] if most else 0))
    return rows.groupBy("id").agg(F.min("v").alias("v"))


def nodes_of(vectors: DataFrame, members: int) -> DataFrame:
    """(node, v, members): one row for each distinct vector, named by its smallest id, with its smallest ids."""
    rank = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    first = vectors.withColumn("rank", rank).filter(F.col("rank") <= members)
    return first.groupBy("v").agg(F.min("id").alias("node"), F.sort_array(F.collect_list("id")).alias("members"))


def _planes(nodes: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """Directions (BLOCKINGS x planes x dimensions), their medians over a sample of at most SAMPLE nodes, and the number of nodes."""
    n = nodes.count()
    drawn = nodes.filter(F.pmod(F.xxhash64(F.lit(SEED), "node"), F.lit(1 << 40)) < F.lit(int((2 * SAMPLE << 40) // max(1, n)))).limit(SAMPLE)
    x = np.array([r["v"] for r in drawn.select("v").collect()] or [[0.0]])
    bits = max(0, n // CELL).bit_length()
    planes = np.random.default_rng(SEED).standard_normal((BLOCKINGS, bits, x.shape[1]))
    return planes, np.median(np.einsum("tbd,nd->tbn", planes, x), 2), n


def numbered(nodes: DataFrame) -> DataFrame:
    """nodes (node, v, ...) with `number`, whose upper bits are a part of at most some BLOCK near nodes, w and blocks:
    the vector as floats, if that loses nothing, and the node's block in each set of planes."""
    ship_package(nodes.sparkSession)
    planes, medians, _ = _planes(nodes)
    rounds = F.exists("v", lambda x: x.cast("float").cast("double") != x)
    kind = "double" if nodes.agg(F.bool_or(rounds)).first()[0] else "float"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = 1 << np.arange(planes.shape[1], dtype=np.int64)
        for b in batches:
            x = b.column(1).flatten().to_numpy().reshape(b.num_rows, -1)
            codes = np.stack([((x @ p.T > m) @ weights) * BLOCKINGS + t for t, (p, m) in enumerate(zip(planes, medians))], 1)
            cells = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * BLOCKINGS), pa.array(codes.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), cells], names=["node", "cells"])

    cells = materialize(nodes.select("node", "v").mapInArrow(cut, "node bigint, cells array<bigint>"), "ann-cells")
    each = cells.select("node", F.explode("cells").alias("cell"))
    # cells are as many as blocks, so their counts are a small part of the nodes
    sizes = materialize(each.groupBy("cell").agg(F.count("*").alias("n")), "ann-cell-sizes")
    piece = F.pmod(F.xxhash64(F.lit(SEED), "node"), F.ceil(F.col("n") / BLOCK))
    dealt = each.join(maybe_broadcast(sizes), "cell").select("node", "cell", F.xxhash64("cell", piece).alias("block"))
    first = dealt.filter(F.col("cell") % BLOCKINGS == 0)
    place = F.row_number().over(Window.partitionBy("block").orderBy("node"))
    # two blocks that share the upper bits make one part of twice the size; the places of both are then counted together
    number = first.select("node", F.shiftrightunsigned("block", _PLACE + 1).alias("block")).withColumn("number", F.shiftleft("block", _PLACE).bitwiseOR(place))
    blocks = dealt.groupBy("node").agg(F.collect_list("block").alias("blocks"))
    found = nodes.withColumn("w", F.col("v").cast(f"array<{kind}>")).join(number.select("node", "number"), "node").join(blocks, "node")
    return materialize(found, "ann-numbered")


def _vectors(rows: pa.Table) -> np.ndarray:
    """As doubles: distances come from norms and products, which cancel among near copies."""
    return _matrix(rows["w"]).astype(np.float64)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _keep_nearest(u: np.ndarray, v: np.ndarray, d: np.ndarray, most: int, old: np.ndarray) -> tuple[np.ndarray, ...]:
    """Each u's nearest distinct v; of equal pairs an old one stays."""
    order = np.lexsort((~old, v, u))
    u, v, d, old = u[order], v[order], d[order], old[order]
    new = np.r_[True, (u[1:] != u[:-1]) | (v[1:] != v[:-1])] if len(u) else np.zeros(0, bool)
    u, v, d, old = u[new], v[new], d[new], old[new]
    order = np.lexsort((v, d, u))
    u, v, d, old = u[order], v[order], d[order], old[order]
    kept = np.arange(len(u)) - np.searchsorted(u, u) < most
    return u[kept], v[kept], d[kept], old[kept]


_EDGES = "u bigint, v bigint, d float, old boolean"


def _edge_table(u: np.ndarray, v: np.ndarray, d: np.ndarray, old: np.ndarray) -> pa.Table:
    return pa.table({"u": pa.array(u.astype(np.int64)), "v": pa.array(v.astype(np.int64)), "d": pa.array(d.astype(np.float32)), "old": pa.array(old)})


def _in_block(rows: pa.Table) -> pa.Table:
    """Each node's nearest in its block, by all distances inside a block of bounded size."""
    ids, x = rows["number"].to_numpy(), _vectors(rows)
    norms = (x * x).sum(1)
    out = [[], [], []]
    for s in range(0, len(ids), BLOCK):
        far = norms[s : s + BLOCK, None] + norms[None, :] - 2 * x[s : s + BLOCK] @ x.T
        far[np.arange(len(far)), np.arange(s, s + len(far))] = np.inf
        k = min(NEIGHBOURS, len(ids) - 1)
        near = np.argpartition(far, k - 1, 1)[:, :k] if k > 0 else np.zeros((len(far), 0), int)
        for part, found in zip(out, (np.repeat(ids[s : s + BLOCK], k), ids[near].ravel(), np.take_along_axis(far, near, 1).ravel())):
            part.append(found)
    u, v, d = map(np.concatenate, out)
    return _edge_table(u, v, d, np.zeros(len(u), bool))


def _merge(rows: pa.Table) -> pa.Table:
    u, v, d, old = (rows[c].to_numpy() for c in ("u", "v", "d", "old"))
    return _edge_table(*_keep_nearest(u, v, d, NEIGHBOURS, old))


def _join_locally(lists: pa.Table, vectors: pa.Table) -> pa.Table:
    """The members of each list, compared with each other where one of two is new; what improves on a member's worst neighbour."""
    if not lists.num_rows or not vectors.num_rows:
        return _edge_table(*(np.zeros(0),) * 3, np.zeros(0, bool))
    ids = vectors["number"].to_numpy()
    order = np.argsort(ids)
    ids, x, worst = ids[order], _vectors(vectors)[order], vectors["worst"].to_numpy()[order]
    norms = (x * x).sum(1)
    col = lists["members"].combine_chunks()
    at, flat, new = col.offsets.to_numpy(), np.searchsorted(ids, col.values.field(0).to_numpy()), col.values.field(1).to_numpy(zero_copy_only=False)
    found = [[], [], []]

    def settle() -> None:
        u, v, d = map(np.concatenate, found)
        u, v, d, _ = _keep_nearest(u, v, d, REPORTED, np.zeros(len(u), bool))
        found[:] = [u], [v], [d]

    held = 0
    for k in range(len(col)):
        m, fresh = flat[at[k] : at[k + 1]], new[at[k] : at[k + 1]]
        far = norms[m][:, None] + norms[m][None, :] - 2 * x[m] @ x[m].T
        np.fill_diagonal(far, np.inf)
        i, j = np.nonzero((far < worst[m][:, None]) & (fresh[:, None] | fresh[None, :]))
        for part, met in zip(found, (m[i], m[j], far[i, j])):
            part.append(met)
        held += len(i)
        if held > 2_000_000:
            settle()
            held = len(found[0][0])
    settle()
    return _edge_table(ids[found[0][0]], ids[found[1][0]], found[2][0], np.zeros(len(found[0][0]), bool))


def _part(number: str) -> Column:
    return F.shiftright(number, _PLACE)


def _both_ways(edges: DataFrame) -> DataFrame:
    """(m, x, new): each node's neighbours, and of the nodes that have it as neighbour as many, new ones first, drawn by hash."""
    drawn = F.row_number().over(Window.partitionBy("v").orderBy("old", F.xxhash64(F.lit(SEED), "u", "v"), "u"))
    back = edges.select("u", "v", "old").withColumn("rank", drawn).filter(F.col("rank") <= NEIGHBOURS)
    return edges.select(F.col("u").alias("m"), F.col("v").alias("x"), ~F.col("old")).union(back.select(F.col("v").alias("m"), F.col("u").alias("x"), ~F.col("old"))).toDF("m", "x", "new")


def build_graph(nodes: DataFrame) -> DataFrame:
    """(u, v, d, old): the NN-descent graph over numbered nodes; u and v are numbers."""
    ship_package(nodes.sparkSession)
    dealt = nodes.select("number", "w", F.explode("blocks").alias("block"))
    first = dealt.groupBy("block").applyInArrow(lambda rows: _in_block(rows), _EDGES)
    edges = materialize(first.groupBy(_part("u")).applyInArrow(lambda rows: _merge(rows), _EDGES), "ann-graph")
    for _ in range(MAX_ITERATIONS):
        lists = _both_ways(edges).groupBy("m", "x").agg(F.bool_or("new").alias("new")).groupBy("m").agg(F.collect_list(F.struct("x", "new")).alias("members"))
        lists = materialize(lists.filter(F.exists("members", lambda x: x["new"])).withColumn("part", _part("m")), "ann-lists")
        worst = edges.groupBy("u").agg(F.when(F.count("*") >= NEIGHBOURS, F.max("d")).otherwise(F.lit(float("inf"))).cast("float").alias("worst"))
        wanted = lists.select(F.col("part").alias("to"), F.explode("members.x").alias("number")).distinct()
        light = nodes.select("number", "w").join(worst, F.col("number") == F.col("u"), "left").select("number", "w", F.coalesce("worst", F.lit(float("inf")).cast("float")).alias("worst"))
        met = lists.groupBy("part").cogroup(wanted.join(light, "number").groupBy("to")).applyInArrow(lambda a, b: _join_locally(a, b), _EDGES)
        merged = edges.withColumn("old", F.lit(True)).union(met).groupBy(_part("u")).applyInArrow(lambda rows: _merge(rows), _EDGES)
        before, edges = edges, materialize(merged, "ann-graph")
        total, new = edges.agg(F.count("*"), F.count_if(~F.col("old"))).first()
        discard(before)
        discard(lists)
        if new <= SETTLED * total:
            return edges
    raise RuntimeError(f"the graph did not settle in {MAX_ITERATIONS} iterations")


def _measure(asked: pa.Table, vectors: pa.Table) -> pa.Table:
    """Exact distances of each query to its candidates in this part."""
    names = {"q": pa.int64(), "found": pa.list_(pa.struct([("d", pa.float64()), ("node", pa.int64())]))}
    if not asked.num_rows or not vectors.num_rows:
        return pa.table({k: pa.array([], t) for k, t in names.items()})
    ids = vectors["number"].to_numpy()
    order = np.argsort(ids)
    ids, x, y = ids[order], _matrix(vectors["v"])[order], _matrix(asked["v"])
    col = asked["cands"].combine_chunks()
    at, flat = col.offsets.to_numpy(), col.values.to_numpy()
    where = np.searchsorted(ids, flat)
    far = np.empty(len(flat))
    for k in range(len(col)):
        s, e = at[k], at[k + 1]
        diff = x[where[s:e]] - y[k]
        far[s:e] = np.sqrt((diff * diff).sum(1))
    pairs = pa.StructArray.from_arrays([pa.array(far), pa.array(flat)], names=["d", "node"])
    return pa.table({"q": asked["q"], "found": pa.ListArray.from_arrays(pa.array(at, pa.int32()), pairs)})


def _pieces(each: DataFrame) -> DataFrame:
    """(part, pieces) of the parts that more than MEETING of the candidates (q, node, part) lie in: their queries are dealt
    to so many groups, each with a copy of the part's vectors. All queries start at the same entries, and many nodes have a
    hub near them, so a part may be asked by any share of all queries."""
    loads = each.groupBy("part").agg(F.count("*").alias("n")).filter(F.col("n") > MEETING)
    return maybe_broadcast(materialize(loads.select("part", F.ceil(F.col("n") / MEETING).alias("pieces")), "ann-pieces"))


def search(queries: DataFrame, nodes: DataFrame, edges: DataFrame, pool: int | None = None) -> DataFrame:
    """(q, pool, measured): for each query (q, v, start) the nearest nodes found, as an array of (d, number), nearest
    first, and how many nodes its distance was computed to. Nodes are numbered; start: the number of a node, or null.
    """
    pool = pool or POOL
    ship_package(nodes.sparkSession)
    around = materialize(_both_ways(edges).groupBy(F.col("m").alias("node")).agg(F.collect_set("x").alias("near")), "ann-adjacency")
    vectors = materialize(nodes.select("number", "v", _part("number").alias("home")), "ann-vectors")
    entry = [r["number"] for r in nodes.select("number").orderBy(F.xxhash64(F.lit(SEED), "number")).limit(ENTRIES).collect()]
    empty = F.array().cast("array<struct<d:double,node:bigint>>")
    ids = F.array().cast("array<bigint>")
    begin = F.array_distinct(F.array_compact(F.concat(F.array("start"), F.array(*map(F.lit, entry)).cast("array<bigint>"))))
    asked = materialize(queries.select("q", "v"), "ann-queries")
    state = queries.select("q", empty.alias("pool"), ids.alias("seen"), ids.alias("open"), begin.alias("cands"))
    state = materialize(state, "ann-search")
    for _ in range(MAX_ROUNDS):
        each = state.select("q", F.explode("cands").alias("node")).withColumn("part", _part("node"))
        pieces = _pieces(each)
        sent = each.groupBy("q", "part").agg(F.collect_list("node").alias("cands")).join(pieces, "part", "left").join(asked, "q")
        sent = sent.withColumn("piece", F.pmod(F.xxhash64(F.lit(SEED), "q"), F.coalesce("pieces", F.lit(1))))
        copies = vectors.join(pieces, F.col("home") == F.col("part"), "left").select("number", "v", "home", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("pieces", F.lit(1)) - 1)).alias("copy"))
        found = sent.groupBy("part", "piece").cogroup(copies.groupBy("home", "copy")).applyInArrow(lambda a, b: _measure(a, b), "q bigint, found array<struct<d:double,node:bigint>>")
        found = found.groupBy("q").agg(F.flatten(F.collect_list("found")).alias("found"))
        now = state.join(found, "q", "left").withColumn("pool", F.slice(F.array_sort(F.concat("pool", F.coalesce("found", empty))), 1, pool))
        now = now.withColumn("next", F.slice(F.array_except(F.transform("pool", lambda p: p["node"]), "open"), 1, EXPAND))
        now = materialize(now.select("q", "pool", F.concat("seen", "cands").alias("seen"), F.concat("open", "next").alias("open"), "next"), "ann-opened")
        if now.filter(F.size("next") > 0).isEmpty():
            return now.select("q", "pool", F.size("seen").cast("long").alias("measured"))
        near = now.select("q", F.explode("next").alias("node")).join(around, "node").groupBy("q").agg(F.flatten(F.collect_list("near")).alias("near"))
        after = now.join(near, "q", "left").withColumn("cands", F.array_except(F.coalesce("near", ids), "seen"))
        before, state = state, materialize(after.select("q", "pool", "seen", "open", "cands"), "ann-search")
        discard(before)
        discard(now)
    raise RuntimeError(f"searches did not end in {MAX_ROUNDS} rounds")


def nearest(table: DataFrame, asked: Column, k: int = 10, key: str = "vec_id", vector: str = "embedding", pool: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score, measured): the k nearest found of each row of the table for which `asked` (over
    `id`) holds, and how many distinct vectors were measured for it."""
    vectors = materialize(usable_vectors(table, key, vector), "ann-input")
    nodes = numbered(nodes_of(vectors, k + 1))
    edges = build_graph(nodes)
    rows = materialize(vectors.filter(asked).join(nodes.select("v", "number"), "v").select(F.col("id").alias("query_id"), "number"), "ann-asked")
    own = rows.select("number").distinct().join(nodes.select("number", "v"), "number").select(F.col("number").alias("q"), "v", F.col("number").alias("start"))
    pools = search(own, nodes, edges, max(pool or POOL, k + 1)).select("q", "measured", F.explode(F.slice("pool", 1, k + 1)).alias("p")).select("q", "measured", "p.d", F.col("p.node").alias("number"))
    ids = pools.join(nodes.select("number", "members"), "number").select("q", "measured", "d", F.explode("members").alias("id"))
    rank = Window.partitionBy("q").orderBy("d", "id")
    ids = materialize(ids.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= k + 1), "ann-found")
    pairs = rows.join(ids, F.col("number") == F.col("q")).filter("id <> query_id")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("d", "id"))
    return pairs.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias("vec_id"), F.col("d").alias("score"), "measured")

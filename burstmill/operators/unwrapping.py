"""Two-dimensional phase unwrapping along the spanning forest of greatest quality, found in tiles and joined over them.

Unwrapped along a spanning tree, phases of neighbours in it differ by their wrapped step. Which tree does not matter where
no loop has a residue; with residues it must avoid the bad samples, so the tree of greatest quality is taken: the quality
of a step is that of its worse sample, equal ones go by the step's place, so that the forest is unique and the result does
not depend on tiles. It is found in two levels:

* A tile is a group of bounded size. Its own forest is found by Boruvka rounds over arrays; no step outside it can be of the
  image's. Its best steps are taken up as long as they join no two areas that both touch the tile's border: such a step
  is in the image's forest whatever lies outside. The other steps of the tile's forest may be worse than a way outside. They
  remain as edges between areas, which are as many as the border has samples, some hundredth of the tile.
* Those edges and the steps across borders make a graph; Boruvka rounds of joins give each area its whole cycles.

Samples without phase (null or NaN) are no part of it; what they separate is unwrapped by itself, each part from the
wrapped phase of its first sample (by line, then place in the line). Rows that repeat a sample count once, the smallest
phase. A missing quality is the worst. Images without rows give none.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from burstmill.functions.phasors import no_nan
from burstmill.operators import cube
from burstmill.shared import discard, materialize, ship_package

MAX_ROUNDS = 60
_TURN = 2 * math.pi


def spanning_cycles(n: int, a: np.ndarray, b: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(part, cycles, edges) of n nodes for edges a-b, best first, on which cycles[b] - cycles[a] should be k.

    part: the smallest node of each node's tree, whose cycles are 0; edges: those of the trees, best first. Boruvka: every
    tree takes its best edge to another one.
    """
    part, cycles, number, taken = np.arange(n), np.zeros(n, np.int64), np.arange(len(a)), [np.zeros(0, np.int64)]
    while len(a):
        ra, rb = part[a], part[b]
        live = ra != rb
        a, b, k, ra, rb, number = (v[live] for v in (a, b, k, ra, rb, number))
        if not len(a):
            break
        edge = np.full(n, -1)
        both = np.stack([ra, rb], 1).ravel()
        edge[both[::-1]] = np.repeat(np.arange(len(a)), 2)[::-1]  # the last assignment stays: the best edge
        tree = np.flatnonzero(edge >= 0)
        e = edge[tree]
        taken.append(number[np.unique(e)])
        off = cycles[a[e]] + k[e] - cycles[b[e]]  # what the tree of b lacks
        forward = ra[e] == tree
        parent, shift = np.arange(n), np.zeros(n, np.int64)
        parent[tree], shift[tree] = np.where(forward, rb[e], ra[e]), np.where(forward, -off, off)
        mutual = tree[(parent[parent[tree]] == tree) & (tree < parent[tree])]
        parent[mutual], shift[mutual] = mutual, 0
        while True:
            above = parent[parent]
            if (above == parent).all():
                break
            shift = shift + shift[parent]
            parent = above
        cycles = cycles + shift[part]
        part = parent[part]
    first = np.full(n, n)
    np.minimum.at(first, part, np.arange(n))
    part = first[part]
    return part, cycles - cycles[part], np.sort(np.concatenate(taken))


def reliability(phase: np.ndarray) -> np.ndarray:
    """The quality of each sample of a grid (NaN: none) by its second differences, after Herraez and others 2002."""
    wrap = lambda v: v - _TURN * np.round(v / _TURN)
    wide = np.pad(phase, 1, constant_values=np.nan)
    h, w = phase.shape
    total = np.zeros_like(phase)
    for dy, dx in ((0, 1), (1, 0), (1, 1), (1, -1)):
        before, behind = wide[1 - dy : 1 - dy + h, 1 - dx : 1 - dx + w], wide[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w]
        second = wrap(before - phase) - wrap(phase - behind)
        total += np.where(np.isnan(second), math.pi, second) ** 2
    return 1 / (1e-9 + np.sqrt(total))


def unwrap_tile(y: np.ndarray, x: np.ndarray, phase: np.ndarray, quality: np.ndarray, border: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple]:
    """(area, unwrapped phase, (a, b, quality, place)) of the samples of a tile, sorted by y and x, none of which repeats.

    An area is named by its sample on the border, or by its first sample if it has none. The last item has the steps of the
    tile's forest between areas a and b, along which the phases are unwrapped already; place: that of the step, as `steps` numbers it.
    """
    n = len(y)
    place, a, b = steps(y, x)
    worse = np.minimum(quality[a], quality[b])
    order = np.lexsort((place, -worse))
    a, b, worse, place = a[order], b[order], worse[order], place[order]
    _, cycles, tree = spanning_cycles(n, a, b, -np.round((phase[b] - phase[a]) / _TURN).astype(np.int64))
    up, on_border, open_steps = list(range(n)), border.tolist(), []
    for e, i, j in zip(tree.tolist(), a[tree].tolist(), b[tree].tolist()):
        while up[i] != i:
            up[i] = i = up[up[i]]
        while up[j] != j:
            up[j] = j = up[up[j]]
        if on_border[i] and on_border[j]:
            open_steps.append((i, j, e))
        elif on_border[j] or not on_border[i] and j < i:
            up[i] = j
        else:
            up[j] = i
    area = np.array(up)
    while (area[area] != area).any():
        area = area[area]
    i, j, e = np.array(open_steps, np.int64).reshape(-1, 3).T
    return area, phase + _TURN * cycles, (area[i], area[j], worse[e], place[e])


def steps(y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, a, b): steps from a sample to the next one in its line (even places) and in the next line (odd ones)."""
    grid = np.full((y.max() - y.min() + 2, x.max() - x.min() + 2), -1)
    grid[y - y.min(), x - x.min()] = np.arange(len(y))
    number = 2 * (y * (1 << 31) + x)
    out = []
    for side, (dy, dx) in enumerate(((0, 1), (1, 0))):
        beside = grid[y - y.min() + dy, x - x.min() + dx]
        a = np.flatnonzero(beside >= 0)
        out.append((number[a] + side, a, beside[a]))
    return tuple(np.concatenate(v) for v in zip(*out))


def aligned(edges: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, node, root, cycles) for edges (by, a, b, k, w, place) on which cycles of b minus cycles of a should be k: those of
    the spanning forest of greatest weight; root is the smallest node of the node's tree, whose cycles are 0.

    Of equal weights the smaller place, which is unique, wins. Rounds are written to the shared folder and end when no edge leads to another tree.
    """
    by = list(by)
    edges = materialize(edges.select(*by, "a", "b", "k", "w", "place").filter("a <> b"), "tile-edges")
    ends = edges.select(*by, F.col("a").alias("node")).union(edges.select(*by, F.col("b").alias("node"))).distinct()
    nodes = materialize(ends.select(*by, "node", F.col("node").alias("root"), F.lit(0).cast("long").alias("cycles")), "tile-nodes")
    of = lambda name: nodes.select(*by, F.col("node").alias(name), F.col("root").alias(f"r{name}"), F.col("cycles").alias(f"c{name}"))
    for _ in range(MAX_ROUNDS):
        live = edges.join(of("a"), [*by, "a"]).join(of("b"), [*by, "b"]).filter("ra <> rb").withColumn("off", F.expr("ca + k - cb"))
        ways = [F.struct(F.col(f).alias("root"), F.col(t).alias("to"), s.alias("shift")) for f, t, s in (("ra", "rb", -F.col("off")), ("rb", "ra", F.col("off")))]
        both = live.select(*by, "w", "place", F.explode(F.array(*ways)).alias("e"))
        best = both.groupBy(*by, F.col("e.root").alias("root")).agg(F.max_by(F.struct("e.to", "e.shift"), F.struct("w", -F.col("place"))).alias("e")).select(*by, "root", "e.*")
        best = materialize(best, "tile-best")
        if best.isEmpty():
            break
        back = best.select(*by, F.col("root").alias("to"), F.col("to").alias("back"))
        top = (F.col("back") == F.col("root")) & (F.col("root") < F.col("to"))
        up = best.join(back, [*by, "to"]).select(*by, "root", F.when(top, F.col("root")).otherwise(F.col("to")).alias("parent"), F.when(top, 0).otherwise(F.col("shift")).alias("shift"))
        up = materialize(up, "tile-up")
        for _ in range(MAX_ROUNDS):
            above = up.select(*by, F.col("root").alias("parent"), F.col("parent").alias("_p"), F.col("shift").alias("_s"))
            after = materialize(up.join(above, [*by, "parent"]).select(*by, "root", F.col("_p").alias("parent"), (F.col("shift") + F.col("_s")).alias("shift"), (F.col("_p") != F.col("parent")).alias("moved")), "tile-up")
            moved = not after.filter("moved").isEmpty()
            discard(up)
            up = after
            if not moved:
                break
        joined = nodes.join(up.select(*by, "root", "parent", "shift"), [*by, "root"], "left")
        after = materialize(joined.select(*by, "node", F.coalesce("parent", "root").alias("root"), (F.col("cycles") + F.coalesce("shift", F.lit(0))).alias("cycles")), "tile-nodes")
        for t in (nodes, best, up):
            discard(t)
        nodes = after
    else:
        raise RuntimeError(f"tiles did not settle in {MAX_ROUNDS} rounds")
    least = nodes.groupBy(*by, "root").agg(F.min_by(F.struct(F.col("node").alias("first"), F.col("cycles").alias("base")), "node").alias("f")).select(*by, "root", "f.*")
    return nodes.join(least, [*by, "root"]).select(*by, "node", F.col("first").alias("root"), (F.col("cycles") - F.col("base")).alias("cycles"))


def unwrapped_tiles(image: DataFrame, phase: str = "phase", quality: str | None = None, by: tuple[str, ...] = (), tile: tuple[int, int] = (512, 512)) -> DataFrame:
    """(by, node, y, x, phase, quality, unw, open): every tile unwrapped by itself. A node is an area, named by the number of
    one of its samples, y * 2^31 + x; open: in the row of that sample, the steps (b, w, place) to other areas of its tile."""
    height, width = tile
    if max(height, width) > 1 << 10:
        raise ValueError("a tile has at most 1024 lines and samples")
    ship_package(image.sparkSession)
    given = quality is not None
    q = F.coalesce(no_nan(F.col(quality).cast("double")), F.lit(-1.0)) if given else F.lit(0.0)
    cells = image.select(*by, F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), no_nan(F.col(phase).cast("double")).alias("phase"), q.alias("quality")).filter("phase IS NOT NULL")
    # second differences look one sample over the border
    dealt = cube.tiled(cells, height, width, 0 if given else 1)
    n = len(by)
    fields = "node bigint, y bigint, x bigint, phase double, quality double, unw double, open array<struct<b:bigint,w:double,place:bigint>>"
    schema = StructType([*cells.select(*by).schema.fields, *StructType.fromDDL(fields).fields])

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        from burstmill.operators.unwrapping import reliability, unwrap_tile

        rows = rows.sort_by([("y", "ascending"), ("x", "ascending"), ("phase", "ascending")])
        y, x = rows["y"].to_numpy(), rows["x"].to_numpy()
        once = np.r_[True, (np.diff(y) != 0) | (np.diff(x) != 0)]
        own = once & (y // height == key[n].as_py()) & (x // width == key[n + 1].as_py())
        if given:
            value = rows["quality"].to_numpy()[own]
        else:
            dense = np.full((y.max() - y.min() + 1, x.max() - x.min() + 1), np.nan)
            dense[y[once] - y.min(), x[once] - x.min()] = rows["phase"].to_numpy()[once]
            value = reliability(dense)[y[own] - y.min(), x[own] - x.min()]
        rows, y, x = rows.filter(pa.array(own)), y[own], x[own]
        if not len(y):
            return schema_table(rows.select(list(by)))
        border = (y % height == 0) | (y % height == height - 1) | (x % width == 0) | (x % width == width - 1)
        area, unw, (a, b, w, place) = unwrap_tile(y, x, rows["phase"].to_numpy(), value, border)
        number = y * (1 << 31) + x
        lists: list[list[dict] | None] = [None] * len(y)
        for i, j, u, p in zip(a.tolist(), number[b].tolist(), w.tolist(), place.tolist()):
            lists[i] = (lists[i] or []) + [{"b": j, "w": u, "place": p}]
        return schema_table(rows.select(list(by)), number[area], y, x, rows["phase"], value, unw, lists)

    def schema_table(keys: pa.Table, *columns) -> pa.Table:
        kinds = [pa.int64()] * 3 + [pa.float64()] * 3 + [pa.list_(pa.struct([("b", pa.int64()), ("w", pa.float64()), ("place", pa.int64())]))]
        names = ["node", "y", "x", "phase", "quality", "unw", "open"]
        for name, kind, c in zip(names, kinds, columns or [[]] * len(names)):
            keys = keys.append_column(name, c if isinstance(c, pa.ChunkedArray) else pa.array(c, kind))
        return keys

    return dealt.groupBy(*by, "ty", "tx").applyInArrow(run, schema)


def border_edges(tiles: DataFrame, tile: tuple[int, int], by: tuple[str, ...] = ()) -> DataFrame:
    """(by, a, b, k, w, place): the open steps inside tiles, and those between samples on either side of a border."""
    inside = tiles.filter("open IS NOT NULL").select(*by, F.col("node").alias("a"), F.explode("open").alias("o"))
    edges = inside.select(*by, "a", "o.b", F.lit(0).cast("long").alias("k"), "o.w", "o.place")
    for side, (axis, size) in enumerate((("x", tile[1]), ("y", tile[0]))):
        end = F.pmod(axis, F.lit(size))
        kept = lambda k: [F.col("node").alias(k), F.col("phase").alias(f"p{k}"), F.col("unw").alias(f"u{k}"), F.col("quality").alias(f"q{k}")]
        last = tiles.filter(end == size - 1).select(*by, "y", "x", *kept("a"))
        after = tiles.filter(end == 0).select(*by, *((F.col(c) - 1).alias(c) if c == axis else c for c in ("y", "x")), *kept("b"))
        step = F.col("pb") - F.col("pa")
        k = F.round((step - _TURN * F.round(step / _TURN) - F.col("ub") + F.col("ua")) / _TURN).cast("long")
        place = 2 * (F.col("y") * F.lit(1 << 31) + F.col("x")) + F.lit(side)
        edges = edges.union(last.join(after, [*by, "y", "x"]).select(*by, "a", "b", k.alias("k"), F.least("qa", "qb").alias("w"), place.alias("place")))
    return edges


def unwrap(image: DataFrame, phase: str = "phase", quality: str | None = None, by: tuple[str, ...] = (), tile: tuple[int, int] = (512, 512)) -> DataFrame:
    """(by, y, x, unw_phase) of each image, for samples with a phase. quality: a column, greater is better; without it, that
    of second differences."""
    tiles = materialize(unwrapped_tiles(image, phase, quality, by, tile), "tiles")
    cycles = aligned(border_edges(tiles, tile, by), by).select(*by, "node", "root", "cycles")
    met = tiles.join(cycles, [*by, "node"], "left").select(*by, "y", "x", "phase", F.coalesce("root", "node").alias("root"), (F.col("unw") + _TURN * F.coalesce("cycles", F.lit(0))).alias("unw"))
    met = materialize(met, "unwrapped")
    turns = F.round((F.col("unw") - F.col("phase")) / _TURN)
    base = met.groupBy(*by, "root").agg(F.min_by(turns, F.struct("y", "x")).alias("base"))
    return met.join(base, [*by, "root"]).select(*by, "y", "x", (F.col("unw") - _TURN * F.col("base")).alias("unw_phase"))

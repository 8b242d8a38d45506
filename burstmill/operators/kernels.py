"""Tile kernels: phase unwrapping, Goldstein filtering, network inversion and raster components."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, DoubleType, StructField, StructType

from burstmill.functions.phasors import wrapped
from burstmill.operators.components import connected_components
from burstmill.shared import ship_package


def unwrap_rows(image: DataFrame, phase: str = "phase", by: tuple[str, ...] = ()) -> DataFrame:
    """Itoh's rule along each line: the first phase plus the sum of wrapped steps. Exact only without residues."""
    line = Window.partitionBy(*by, "y").orderBy("x")
    step = wrapped(F.col(phase) - F.lag(phase).over(line))
    steps = image.withColumn("_step", F.coalesce(step, F.col(phase)))
    return steps.withColumn("unw_phase", F.sum("_step").over(line.rowsBetween(Window.unboundedPreceding, 0))).drop("_step")


def residues(image: DataFrame, phase: str = "phase", by: tuple[str, ...] = ()) -> DataFrame:
    """(by, residues): loops of 2 x 2 pixels around which the wrapped steps do not cancel; 0 means that unwrapping is safe."""
    line = Window.partitionBy(*by, "y").orderBy("x")
    pairs = image.select(*by, "y", "x", F.col(phase).alias("a"), F.lead("x").over(line).alias("nx"), F.lead(phase).over(line).alias("b")).filter("nx = x + 1")
    below = pairs.select(*by, (F.col("y") - 1).alias("y"), "x", F.col("a").alias("d"), F.col("b").alias("c"))
    around = wrapped(F.col("b") - F.col("a")) + wrapped(F.col("c") - F.col("b")) + wrapped(F.col("d") - F.col("c")) + wrapped(F.col("a") - F.col("d"))
    loops = pairs.join(below, [*by, "y", "x"])
    return loops.groupBy(*by).agg(F.count_if(F.abs(around) > math.pi).alias("residues"))


def goldstein(image: DataFrame, alpha: float = 0.5, patch: int = 64, window: int = 3, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, y, x, re, im) filtered after Goldstein and Werner 1998, each image by itself.

    Pixels are dealt to patches that overlap by half; each patch's spectrum is weighted by its smoothed magnitude to
    the power alpha, and patches are blended with triangular weights. A patch is a group of bounded size.
    """
    ship_package(image.sparkSession)
    half = patch // 2
    starts = lambda c: F.array(F.floor(F.col(c) / half) - 1, F.floor(F.col(c) / half))
    dealt = image.select(*by, "y", "x", "re", "im", F.explode(starts("y")).alias("py")).select("*", F.explode(starts("x")).alias("px"))
    n = len(by)
    schema = StructType([*image.select(*by).schema.fields, *StructType.fromDDL("y bigint, x bigint, re double, im double, w double").fields])

    def filtered(key: tuple, rows: pa.Table) -> pa.Table:
        py, px = key[n].as_py() * half, key[n + 1].as_py() * half
        y, x = rows["y"].to_numpy() - py, rows["x"].to_numpy() - px
        tile = np.zeros((patch, patch), complex)
        tile[y, x] = rows["re"].to_numpy() + 1j * rows["im"].to_numpy()
        spectrum = np.fft.fft2(tile)
        size = np.abs(spectrum)
        smooth = sum(np.roll(size, (i, j), (0, 1)) for i in range(-(window // 2), window // 2 + 1) for j in range(-(window // 2), window // 2 + 1)) / window**2
        out = np.fft.ifft2(spectrum * (smooth / smooth.max() if smooth.max() else smooth) ** alpha)
        ramp = 1 - np.abs((np.arange(patch) + 0.5) / half - 1)
        w = ramp[y] * ramp[x]
        return pa.table({**{c: rows[c] for c in by}, "y": rows["y"], "x": rows["x"], "re": out.real[y, x] * w, "im": out.imag[y, x] * w, "w": w})

    parts = dealt.groupBy(*by, "py", "px").applyInArrow(filtered, schema)
    total = F.sum("w")
    return parts.groupBy(*by, "y", "x").agg((F.sum("re") / total).alias("re"), (F.sum("im") / total).alias("im"))


def _groups(table: pa.Table, keys: int) -> np.ndarray:
    """Where groups of equal leading columns start in a sorted table, and its length."""
    n = table.num_rows
    new = np.zeros(max(0, n - 1), bool)
    for c in table.columns[:keys]:
        c = c.combine_chunks()
        same = pc.fill_null(pc.equal(c[1:], c[:-1]), False).to_numpy(zero_copy_only=False)
        both_null = pc.and_(pc.is_null(c[1:]), pc.is_null(c[:-1])).to_numpy(zero_copy_only=False)
        new |= ~(same | both_null)
    return np.r_[0, np.flatnonzero(new) + 1, n] if n else np.zeros(1, int)


def invert_network(pairs: DataFrame, key: list[str], value: str = "phase", weight: str | None = None) -> DataFrame:
    """(key, date, displacement): least squares over the increments between dates (Berardino 2002), first date 0.

    pairs: key, prm_date, sec_date and the value of the pair. weight: a column, or null for equal weights. Pixels are
    read in the order of their key, and those of a batch that share network and weights are solved together.
    """
    ship_package(pairs.sparkSession)
    day = lambda c: F.datediff(c, F.lit("1970-01-01"))
    w = [F.col(weight).cast("double").alias("_w")] if weight else []
    table = pairs.select(*key, day("prm_date").alias("_a"), day("sec_date").alias("_b"), F.col(value).cast("double").alias("_v"), *w)
    schema = StructType([*pairs.select(*key).schema.fields, StructField("date", DateType()), StructField("displacement", DoubleType())])
    k = len(key)

    def solve(rows: pa.Table) -> pa.RecordBatch:
        at = _groups(rows, k)
        a, b, v = (rows.column(k + j).to_numpy() for j in range(3))
        w = rows.column(k + 3).to_numpy() if weight else np.ones(len(v))
        alike: dict[bytes, list[int]] = {}
        for g in range(len(at) - 1):
            s = slice(at[g], at[g + 1])
            alike.setdefault(a[s].tobytes() + b[s].tobytes() + w[s].tobytes(), []).append(g)
        first, dates, moved = [], [], []
        for members in alike.values():
            s = slice(at[members[0]], at[members[0] + 1])
            days = np.unique(np.r_[a[s], b[s]])
            lo, hi = np.searchsorted(days, np.minimum(a[s], b[s])), np.searchsorted(days, np.maximum(a[s], b[s]))
            steps = np.arange(len(days) - 1)
            design = ((steps >= lo[:, None]) & (steps < hi[:, None])) * np.where(b[s] > a[s], 1.0, -1.0)[:, None]
            root = np.sqrt(w[s])[:, None]
            values = np.stack([v[at[g] : at[g + 1]] for g in members], 1)
            found = np.linalg.lstsq(design * root, values * root, rcond=None)[0] if len(steps) else np.zeros((0, len(members)))
            moved.append(np.vstack([np.zeros(len(members)), np.cumsum(found, 0)]).T.ravel())
            dates.append(np.tile(days, len(members)))
            first.append(np.repeat(at[members], len(days)))
        picked = rows.select(range(k)).take(pa.array(np.concatenate(first)))
        columns = [*(c.combine_chunks() for c in picked.columns), pa.array(np.concatenate(dates).astype(np.int32)).cast(pa.date32()), pa.array(np.concatenate(moved))]
        return pa.RecordBatch.from_arrays(columns, names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if rest is None else pa.concat_tables([rest, rows]).combine_chunks()
            last = _groups(rows, k)[-2] if rows.num_rows else 0
            if last:
                yield solve(rows.slice(0, last).combine_chunks())
            rest = rows.slice(last)  # the last pixel may go on in the next batch
        if rest is not None and rest.num_rows:
            yield solve(rest.combine_chunks())

    return table.repartition(*key).sortWithinPartitions(*key, "_a", "_b").mapInArrow(run, schema)


def labelled_cells(image: DataFrame, flag: str, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, y, x, component) of the cells whose flag is set: 4-connected areas, those of one image never with another's.

    A component is named by its smallest cell number, y * 2^31 + x within one image.
    """
    cells = image.filter(F.col(flag)).select(*by, F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x")).distinct()
    cells = cells.withColumn("cell", F.col("y") * F.lit(1 << 31) + F.col("x"))
    node = F.struct(*by, "cell") if by else F.col("cell")
    at = cells.select(*by, "y", "x", node.alias("node"))
    links = None
    for c in ("x", "y"):
        before = at.select(*by, *((F.col(k) + 1).alias(k) if k == c else k for k in ("y", "x")), F.col("node").alias("a"))
        more = before.join(at.withColumnRenamed("node", "b"), [*by, "y", "x"]).select("a", "b")
        links = more if links is None else links.union(more)
    found = connected_components(links)
    cell = lambda c: F.col(c)["cell"] if by else F.col(c)
    roots = found.select(*(F.col("node")[c].alias(c) for c in by), cell("node").alias("cell"), cell("root").alias("root"))
    return cells.join(roots, [*by, "cell"], "left").select(*by, "y", "x", F.coalesce("root", "cell").alias("component"))


def raster_components(image: DataFrame, flag: str, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, component, cells, y0, y1, x0, x1): 4-connected areas of the cells whose flag is set, with their boxes."""
    named = labelled_cells(image, flag, by)
    return named.groupBy(*by, "component").agg(F.count("*").alias("cells"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("x").alias("x0"), F.max("x").alias("x1"))

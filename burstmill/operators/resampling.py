"""Images at fractional places: bilinear, bicubic and windowed-sinc kernels, phase-preserving for complex samples.

A kernel is separable: weights along the line times weights across lines. Images are dealt to tiles with a halo as wide as the
kernel reaches; a place goes to the tile that it lies in. Each tile's samples come first, as a small array, and places stream
past them, so memory does not grow with the number of places. A result is null unless the samples that bilinear weights
touch are all there; of the others, missing ones are left out and the weights of the rest scaled up to a sum of one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add, mul

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from burstmill.functions.phasors import no_nan
from burstmill.shared import fresh, maybe_broadcast, ship_package

#: How far taps lie from the sample below a place, at most: the sinc kernel has 21 around the nearest sample.
REACH = {"bilinear": 1, "bicubic": 2, "sinc": 11}
#: Samples of a tile's side.
TILE = 256


def weights(kernel: str, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, w): the first sample that counts for each place and the weights from it on, one row a place."""
    below = np.floor(at)
    if kernel == "bilinear":
        f = at - below
        return below.astype(np.int64), np.stack([1 - f, f], 1)
    if kernel == "bicubic":
        first = below - 1
        d = np.abs(at[:, None] - first[:, None] - np.arange(4))
        return first.astype(np.int64), np.where(d <= 1, (1.5 * d - 2.5) * d * d + 1, ((-0.5 * d + 2.5) * d - 4) * d + 2)  # Keys 1981
    first = np.floor(at + 0.5) - 10
    d = at[:, None] - first[:, None] - np.arange(21)
    w = np.sinc(d) * np.i0(7 * np.sqrt(1 - (d / 11) ** 2))  # a Kaiser window: errors of a thousandth up to 0.4 cycles a sample
    return first.astype(np.int64), w / w.sum(1, keepdims=True)


def interpolate(grid: np.ndarray, y: np.ndarray, x: np.ndarray, kernel: str) -> np.ndarray:
    """The values of grid (bands, lines, samples; NaN: missing) at places (y, x), one row a place."""
    (y0, wy), (x0, wx), n = weights(kernel, y), weights(kernel, x), len(y)
    total, mass, core = np.zeros((len(grid), n)), np.zeros((len(grid), n)), np.zeros((len(grid), n))
    h, w = grid.shape[1:]
    for j in range(wy.shape[1]):
        for i in range(wx.shape[1]):
            yy, xx = y0 + j, x0 + i
            there = (yy >= 0) & (yy < h) & (xx >= 0) & (xx < w)
            v = np.where(there, grid[:, np.clip(yy, 0, h - 1), np.clip(xx, 0, w - 1)], np.nan)
            has = ~np.isnan(v)
            weight = wy[:, j] * wx[:, i]
            total += np.where(has, v * weight, 0)
            mass += has * weight
            core += has * np.maximum(0, 1 - np.abs(y - yy)) * np.maximum(0, 1 - np.abs(x - xx))
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(core > 1 - 1e-9, total / mass, np.nan).T


def resampled(image: DataFrame, places: DataFrame, bands: list[str], kernel: str = "bicubic", by: tuple[str, ...] = (), at_y: str = "at_y", at_x: str = "at_x", tile: int = TILE) -> DataFrame:
    """All columns of places (by, at_y, at_x, ...) and the bands of image (by, y, x, bands) there. Images must not repeat a
    sample; of places that repeat, each gets its values. Places with a null coordinate get nulls."""
    ship_package(image.sparkSession)
    reach, name = REACH[kernel], fresh(places, "_values")
    key = lambda df, ty, tx: F.to_json(F.struct(*(F.col(c) for c in by), ty.alias("ty_"), tx.alias("tx_")))
    near = lambda c: F.sequence(F.floor((F.col(c) - reach) / tile), F.floor((F.col(c) + reach) / tile))
    dealt = image.withColumn("_ty", F.explode(near("y"))).withColumn("_tx", F.explode(near("x")))
    values = F.array(*(no_nan(F.col(b).cast("double")) for b in bands))
    kind = places.schema.simpleString()
    zero = F.lit(0.0)
    first = dealt.select(key(dealt, F.col("_ty"), F.col("_tx")).alias("tile"), F.lit(0).alias("side"), (F.col("y") - F.col("_ty") * tile).cast("double").alias("y"), (F.col("x") - F.col("_tx") * tile).cast("double").alias("x"), values.alias("values"), F.lit(None).cast(kind).alias("row"))
    ty, tx = (F.floor(no_nan(F.col(c).cast("double")) / tile) for c in (at_y, at_x))
    known = ty.isNotNull() & tx.isNotNull()
    wanted = places.select(key(places, ty, tx).alias("tile"), F.lit(1).alias("side"), F.when(known, F.col(at_y) - ty * tile).cast("double").alias("y"), F.when(known, F.col(at_x) - tx * tile).cast("double").alias("x"), F.array(zero).alias("values"), F.struct(*places.columns).alias("row"))
    met = first.unionByName(wanted).repartition("tile").sortWithinPartitions("tile", "side")
    size, n = tile + 2 * reach + 1, len(bands)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from burstmill.operators.resampling import interpolate

        tile_now, grid = None, None
        for b in batches:
            names, side = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy()
            edge = np.r_[0, np.flatnonzero((names[1:] != names[:-1]) | (side[1:] != side[:-1])) + 1, len(side)]
            for s, e in zip(edge[:-1].tolist(), edge[1:].tolist()):
                if s == e:
                    continue
                if names[s] != tile_now:
                    tile_now, grid = names[s], np.full((n, size, size), np.nan)
                y, x = (b.column(k).slice(s, e - s).to_numpy(zero_copy_only=False) for k in (2, 3))
                if side[s] == 0:
                    flat = b.column(4).slice(s, e - s).flatten().to_numpy(zero_copy_only=False).astype(float)
                    grid[:, y.astype(int) + reach, x.astype(int) + reach] = flat.reshape(-1, n).T
                    continue
                known = ~(np.isnan(y) | np.isnan(x))
                found = np.full((e - s, n), np.nan)
                found[known] = interpolate(grid, y[known] + reach, x[known] + reach, kernel)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(e - s + 1) * n, pa.int32()), pa.array(found.ravel(), mask=np.isnan(found.ravel())))
                yield pa.RecordBatch.from_arrays([b.column(5).slice(s, e - s), lists], names=["row", name])

    schema = StructType([StructField("row", places.schema), StructField(name, ArrayType(DoubleType()))])
    out = met.mapInArrow(run, schema)
    return out.select("row.*", *(F.col(name)[k].alias(b) for k, b in enumerate(bands)))


def turned(i: Column, q: Column, phase: Column) -> tuple[Column, Column]:
    """The complex sample (i, q) turned by a phase."""
    return i * F.cos(phase) - q * F.sin(phase), i * F.sin(phase) + q * F.cos(phase)


def resampled_complex(image: DataFrame, places: DataFrame, kernel: str = "sinc", by: tuple[str, ...] = (), carrier: str | None = None, tile: int = TILE) -> DataFrame:
    """Columns of places (by, at_y, at_x, ...) and i, q of image (by, y, x, i, q) there.

    carrier: the phase of the image's carrier, an expression of y and x (as the azimuth ramp of a burst). It is taken off before
    and put on again at the fractional place, so that the kernel sees a low-pass signal and phases are kept.
    """
    if carrier is None:
        return resampled(image, places, ["i", "q"], kernel, by, tile=tile)
    i, q = turned(F.col("i"), F.col("q"), -F.expr(carrier))
    base = resampled(image.select(*by, "y", "x", i.alias("i"), q.alias("q")), places, ["i", "q"], kernel, by, tile=tile)
    # the expression speaks of y and x: those of the place, for a moment
    there = base.select(F.struct(*places.columns).alias("_row"), F.col("at_y").alias("y"), F.col("at_x").alias("x"), F.col("i").alias("_i"), F.col("q").alias("_q"))
    i, q = turned(F.col("_i"), F.col("_q"), F.expr(carrier))
    return there.select("_row.*", i.alias("i"), q.alias("q"))


def warped(grid: DataFrame, bands: list[str], source: tuple[int, float], target: tuple[int, float], kernel: str = "bilinear", by: tuple[str, ...] = (), tile: int = 64) -> DataFrame:
    """(by, row, col, bands) of an aligned grid (by, row, col, bands) on the aligned grid of another system or resolution.

    source, target: EPSG code and resolution; a cell's value stands for its centre, (col + 0.5, row + 0.5) times the resolution. Every
    target node is taken to the source's system and sampled there. Nodes are found tile by tile: a tile's outline, brought to the
    target's system, bounds those that may lie in it, and of these the ones that do are kept, so none comes twice. Nodes
    without all samples beside them are dropped. A band without data there is null.
    """
    (epsg, size), (aim, step) = source, target
    down, across = F.floor(F.col("row") / tile), F.floor(F.col("col") / tile)
    tiles = grid.select(*by, down.alias("_ty"), across.alias("_tx")).distinct()
    from burstmill.functions.geometry import with_projected

    # a tile holds the places from its first centre to the next tile's; curved outlines bulge by less than a cell beyond the eight points
    spots = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(3) for j in range(3) if (i, j) != (1, 1)))
    outline = tiles.withColumn("_s", F.explode(spots))
    outline = with_projected(outline, *((F.col(c) * tile + F.col(f"_s.{k}") * tile / 2 + 0.5) * size for c, k in (("_tx", "i"), ("_ty", "j"))), epsg, aim, ("_x", "_y"))
    ends = [e for c, k in (("col", "_x"), ("row", "_y")) for e in ((F.floor(F.min(F.col(k) / step - 0.5)) - 1).alias(f"_{c}0"), (F.ceil(F.max(F.col(k) / step - 0.5)) + 1).alias(f"_{c}1"))]
    boxes = outline.groupBy(*by, "_ty", "_tx").agg(*ends)
    nodes = boxes.withColumn("row", F.explode(F.sequence("_row0", "_row1"))).withColumn("col", F.explode(F.sequence("_col0", "_col1")))
    nodes = with_projected(nodes, (F.col("col") + 0.5) * step, (F.col("row") + 0.5) * step, aim, epsg, ("_x", "_y"))
    nodes = nodes.withColumns({"at_x": F.col("_x") / size - 0.5, "at_y": F.col("_y") / size - 0.5}).filter((F.floor(F.col("at_y") / tile) == F.col("_ty")) & (F.floor(F.col("at_x") / tile) == F.col("_tx")))
    image = grid.select(*by, F.col("row").alias("y"), F.col("col").alias("x"), *bands)
    found = resampled(image, nodes.select(*by, "row", "col", "at_y", "at_x"), bands, kernel, by)
    return found.filter(" OR ".join(f"`{b}` IS NOT NULL" for b in bands)).select(*by, "row", "col", *bands)


def with_elevation(cube: DataFrame, dem: DataFrame, lon: str, lat: str, step: float, kernel: str = "bilinear") -> DataFrame:
    """cube and elevation from a regular grid dem(col, row, height), node (col, row) at step times itself: bilinear or bicubic.

    Each node gathers the heights around it once, so a sample needs one join and keeps its row, however often rows repeat.
    The rules for missing heights are those above; a null place has no elevation.
    """
    taps = {"bilinear": (0, 1), "bicubic": (-1, 0, 1, 2)}[kernel]
    spots = [(a, b) for b in taps for a in taps]
    # two explodes of whole numbers, as an array of structs is made anew for each node
    moved = dem.select("col", "row", no_nan(F.col("height").cast("double")).alias("height"))
    for c in ("_a", "_b"):
        moved = moved.withColumn(c, F.explode(F.array(*map(F.lit, taps))))
    heights = [F.max(F.when((F.col("_a") == a) & (F.col("_b") == b), F.col("height"))).alias(f"_h{k}") for k, (a, b) in enumerate(spots)]
    around = moved.groupBy((F.col("col") - F.col("_a")).alias("_col"), (F.col("row") - F.col("_b")).alias("_row")).agg(*heights)
    u, v = no_nan(F.col(lon)) / step, no_nan(F.col(lat)) / step
    part = lambda c: F.coalesce(c - F.floor(c), F.lit(0.0))  # noqa: E731  of a null place, which no cell meets
    at = cube.withColumns({"_col": F.floor(u), "_row": F.floor(v), "_u": part(u), "_v": part(v)})
    met = at.join(maybe_broadcast(around, least=dem), ["_col", "_row"], "left")

    def tap(d: Column) -> Column:
        if kernel == "bilinear":
            return 1 - d
        return F.when(d <= 1, (1.5 * d - 2.5) * d * d + 1).otherwise(((-0.5 * d + 2.5) * d - 4) * d + 2)

    # plain additions, which Spark compiles; without nulls but in the heights, so that the method is short enough for the JVM's compiler, too
    for c in ("_u", "_v"):
        met = met.withColumns({f"{c}{n}": tap(F.abs(F.col(c) - k)) for n, k in enumerate(taps)})
    met = met.withColumns({f"_w{k}": F.col(f"_u{k % len(taps)}") * F.col(f"_v{k // len(taps)}") for k in range(len(spots))})
    summed = lambda parts: reduce(add, parts, F.lit(0.0))
    there = lambda k, w: F.when(F.col(f"_h{k}").isNull(), 0.0).otherwise(w)
    beside = lambda k: reduce(mul, (1 - F.abs(F.col(c) - n) for c, n in zip(("_u", "_v"), spots[k])))
    core = summed(there(k, beside(k)) for k, spot in enumerate(spots) if {*spot} <= {0, 1})  # the bilinear weights of the others are 0
    mass = summed(there(k, F.col(f"_w{k}")) for k in range(len(spots)))
    total = summed(F.col(f"_w{k}") * F.coalesce(F.col(f"_h{k}"), F.lit(0.0)) for k in range(len(spots)))
    return met.select(*(F.col(c) for c in cube.columns), F.when(core > 1 - 1e-9, F.try_divide(total, mass)).alias("elevation"))

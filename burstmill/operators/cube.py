"""Datacubes in long form: rows keyed by time, line y and sample x, one column for each band."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from burstmill.functions import phasors


def filter_temporal(cube: DataFrame, start: str, end: str, t: str = "t") -> DataFrame:
    """start inclusive, end exclusive."""
    return cube.filter((F.col(t) >= F.lit(start)) & (F.col(t) < F.lit(end)))


def filter_bands(cube: DataFrame, bands: list[str | int], keys: tuple[str, ...] = ("t", "y", "x")) -> DataFrame:
    """Bands by label or by their index among the bands."""
    every = [c for c in cube.columns if c not in keys]
    return cube.select(*keys, *(every[b] if isinstance(b, int) else b for b in bands))


def rename_labels(cube: DataFrame, target: list[str], source: list[str]) -> DataFrame:
    return cube.withColumnsRenamed(dict(zip(source, target)))


def drop_dimension(cube: DataFrame, name: str) -> DataFrame:
    """cube without the dimension, which must have one label."""
    if cube.select(name).distinct().limit(2).count() > 1:
        raise ValueError(f"dimension {name} has more than one label")
    return cube.drop(name)


def add_dimension(cube: DataFrame, name: str, label: object) -> DataFrame:
    return cube.withColumn(name, F.lit(label))


def merge_bands(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Cubes with different bands: the cells that both have."""
    return a.join(b, keys)


def merge_time(a: DataFrame, b: DataFrame) -> DataFrame:
    """Cubes with the same bands at different times."""
    return a.unionByName(b)


def apply(cube: DataFrame, **bands: Column) -> DataFrame:
    """New or changed bands as expressions of the others."""
    return cube.withColumns(bands)


def reduce_time(cube: DataFrame, bands: list[str], how: Callable[[Column], Column] = F.max, keys: tuple[str, ...] = ("y", "x")) -> DataFrame:
    """One value for each cell and band; NaN is no data."""
    return cube.groupBy(*keys).agg(*(how(phasors.no_nan(F.col(b))).alias(b) for b in bands))


def mosaic(cubes: list[DataFrame], bands: list[str], keys: tuple[str, ...] = ("y", "x")) -> DataFrame:
    """The maximum where cubes overlap."""
    out = cubes[0].select(*keys, *bands)
    for more in cubes[1:]:
        out = out.unionByName(more.select(*keys, *bands))
    return reduce_time(out, bands, F.max, keys)


def _reach(n: int) -> tuple[int, int]:
    """How far a window of n goes to either side; an even one reaches one more ahead."""
    return -((n - 1) // 2), n // 2


def densified(cube: DataFrame, bands: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """Every cell of each image's bounding box; missing ones are 0, as a border is. Images without gaps are passed on as they are."""
    box = cube.groupBy(*by).agg(F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.count("*").alias("n"))
    if by:
        box = box.filter(F.col("n") < (F.col("y1") - F.col("y0") + 1) * (F.col("x1") - F.col("x0") + 1))
    rows = box.select(*by, F.explode(F.sequence("y0", "y1")).alias("y"), "x0", "x1")
    cells = rows.select(*by, "y", F.explode(F.sequence("x0", "x1")).alias("x"))
    filled = cells.join(cube, [*by, "y", "x"], "left").na.fill(0.0, bands)
    return filled.unionByName(cube.join(box.select(*by), list(by), "left_anti").select(filled.columns)) if by else filled


#: Lines that one window of the second pass holds, besides those that its kernel reaches beyond them.
STRIPE = 4096


def boxcar(cube: DataFrame, bands: list[str], width: int, height: int, by: tuple[str, ...] = (), factor: float | None = None) -> DataFrame:
    """Sums over width samples (x) and height lines (y), times factor (1 / (width * height), if not given).

    Two one-dimensional passes. The windows are by value, so the grid must be dense in the second pass; cells outside
    count as 0, and the factor does not change at the border. The second pass works on stripes of STRIPE lines; a line
    near an edge is also dealt to the stripe that its kernel reaches into, so a task's rows do not grow with the image.
    """
    before, behind = _reach(height)
    along = Window.partitionBy(*by, "y").orderBy("x").rangeBetween(*_reach(width))
    across = Window.partitionBy(*by, "x", "_stripe").orderBy("y").rangeBetween(before, behind)
    scale = 1 / (width * height) if factor is None else factor
    once = cube.select(*by, "y", "x", *(F.sum(b).over(along).alias(b) for b in bands))
    # line y adds to the lines from y - behind to y - before
    stripes = F.sequence(F.floor((F.col("y") - behind) / STRIPE), F.floor((F.col("y") - before) / STRIPE))
    dealt = once.withColumn("_stripe", F.explode(stripes))
    twice = dealt.select(*by, "y", "x", "_stripe", *((F.sum(b).over(across) * scale).alias(b) for b in bands))
    return twice.filter(F.col("_stripe") == F.floor(F.col("y") / STRIPE)).drop("_stripe")


def coherence(pairs: DataFrame, width: int, height: int, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, y, x, coh) from (by, y, x, i1, q1, i2, q2) on a dense grid."""
    made = phasors.parts(*(F.col(c).cast("double") for c in ("i1", "q1", "i2", "q2")))
    parts = pairs.select(*by, "y", "x", *(c.alias(n) for n, c in made.items()))
    smooth = boxcar(parts, list(made), width, height, by)
    return smooth.select(*by, "y", "x", phasors.coherence(*(F.col(n) for n in made)).alias("coh"))


def interferogram(pairs: DataFrame, by: tuple[str, ...] = (), reference_phase: str | None = None) -> DataFrame:
    """(by, y, x, re, im, p1, p2); with a reference phase column the interferogram is turned back by it."""
    made = phasors.parts(*(F.col(c).cast("double") for c in ("i1", "q1", "i2", "q2")))
    if reference_phase:
        c, s = F.cos(reference_phase), F.sin(reference_phase)
        made["re"], made["im"] = made["re"] * c + made["im"] * s, made["im"] * c - made["re"] * s
    return pairs.select(*by, "y", "x", *(c.alias(n) for n, c in made.items()))


def multilook(cube: DataFrame, bands: list[str], range_looks: int, azimuth_looks: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Block means; an incomplete block at the edge is the mean of what it has."""
    y, x = F.floor(F.col("y") / azimuth_looks).alias("y"), F.floor(F.col("x") / range_looks).alias("x")
    return cube.groupBy(*by, y, x).agg(*(F.avg(b).alias(b) for b in bands))


def below(cube: DataFrame, band: str, limit: float, name: str = "class") -> DataFrame:
    """Whether the band lies below the limit; no data: false."""
    return cube.withColumn(name, F.coalesce(phasors.no_nan(F.col(band)) < limit, F.lit(False)))


def within_box(cube: DataFrame, x0: float, y0: float, x1: float, y1: float) -> DataFrame:
    return cube.filter(F.col("x").between(x0, x1) & F.col("y").between(y0, y1))


def resample_spatial(cube: DataFrame, bands: list[str], lon: str, lat: str, resolution: float, zone: int | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Geocoding: the mean of each band in cells of an aligned grid, in degrees or in metres of a UTM zone.

    lon and lat must be columns of the cube; orbits and elevation, from which toolboxes derive them, are not modelled.
    """
    from burstmill.functions.geometry import utm

    east, north = (F.col(lon), F.col(lat)) if zone is None else utm(F.col(lon), F.col(lat), zone)
    cells = cube.groupBy(*by, F.floor(north / resolution).alias("row"), F.floor(east / resolution).alias("col"))
    return cells.agg(*(F.avg(phasors.no_nan(F.col(b))).alias(b) for b in bands), F.count("*").alias("n"))


def grid_nodes(places: DataFrame, lon: str, lat: str, resolution: float, epsg: int = 4326, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, row, col, y0, x0, y, x, weight): the samples around each node of the aligned grid and their bilinear weights.

    places: (by, y, x, lon, lat). A node is the centre of a cell, (col + 0.5, row + 0.5) times the resolution. It lies in a
    quadrilateral of four adjacent samples, of which (y0, x0) is the first, at fractions u along the line and v across lines
    that solve a + u (b - a) + v (d - a) + u v (a - b + c - d) = node. Quadrilaterals without one of their samples hold no node.
    A quadrilateral is dealt to the nodes of its own box only, so rows grow with the grid.
    """
    from burstmill.functions.geometry import projected

    east, north = projected(F.col(lon), F.col(lat), 4326, epsg)
    at = places.select(*by, "y", "x", F.struct(phasors.no_nan(east).alias("e"), phasors.no_nan(north).alias("n")).alias("_a"))
    line = Window.partitionBy(*by, "y").orderBy("x")
    edge = at.filter("_a.e IS NOT NULL AND _a.n IS NOT NULL").withColumns({"_next": F.lead("x").over(line), "_b": F.lead("_a").over(line)}).filter("_next = x + 1").drop("_next")
    under = edge.select(*by, (F.col("y") - 1).alias("y"), "x", F.col("_a").alias("_d"), F.col("_b").alias("_c"))
    ends = {}
    for name, f in (("col", "e"), ("row", "n")):
        corners = [F.col(f"_{k}.{f}") / resolution - 0.5 for k in "abcd"]
        ends |= {f"_{name}0": F.ceil(F.least(*corners) - 1e-9), f"_{name}1": F.floor(F.greatest(*corners) + 1e-9)}
    quads = edge.join(under, [*by, "y", "x"]).withColumns(ends).filter("_row0 <= _row1 AND _col0 <= _col1")
    nodes = quads.withColumn("row", F.explode(F.sequence("_row0", "_row1"))).withColumn("col", F.explode(F.sequence("_col0", "_col1")))

    c = F.col
    side = lambda p, q: (c(f"_{p}.e") - c(f"_{q}.e"), c(f"_{p}.n") - c(f"_{q}.n"))
    cross = lambda p, q: p[0] * q[1] - p[1] * q[0]
    along, across = side("b", "a"), side("d", "a")
    twist = tuple(r - s for r, s in zip(side("c", "d"), along))
    to = ((c("col") + 0.5) * resolution - c("_a.e"), (c("row") + 0.5) * resolution - c("_a.n"))
    k0, k1, k2 = cross(to, along), cross(to, twist) + cross(along, across), cross(twist, across)
    solved = nodes.withColumns({"_k0": k0, "_k1": k1, "_k2": k2})
    half = -(c("_k1") + F.when(c("_k1") < 0, -1.0).otherwise(1.0) * F.sqrt(c("_k1") * c("_k1") - 4 * c("_k0") * c("_k2"))) / 2
    fits = lambda v: v.between(-1e-9, 1 + 1e-9)
    solved = solved.withColumn("_half", half).withColumn("_v", F.explode(F.array_distinct(F.filter(F.array(F.try_divide("_k0", "_half"), F.try_divide("_half", "_k2")), fits))))
    step = tuple(r + c("_v") * s for r, s in zip(along, twist))
    u = [F.try_divide(to[k] - c("_v") * across[k], step[k]) for k in (0, 1)]
    solved = solved.withColumn("_u", F.when(F.abs(step[0]) >= F.abs(step[1]), u[0]).otherwise(u[1])).filter(fits(c("_u")))
    around = F.array(*(F.struct((c("y") + dy).alias("y"), (c("x") + dx).alias("x"), ((c("_u") if dx else 1 - c("_u")) * (c("_v") if dy else 1 - c("_v"))).alias("weight")) for dy in (0, 1) for dx in (0, 1)))
    return solved.select(*by, "row", "col", c("y").alias("y0"), c("x").alias("x0"), c("_v").alias("v0"), F.explode(around).alias("_s")).select(*by, "row", "col", "y0", "x0", "v0", "_s.*")


def at_nodes(cube: DataFrame, nodes: DataFrame, bands: list[str], by: tuple[str, ...], site: tuple[str, ...] = (), angles: tuple[str, ...] = ()) -> DataFrame:
    """(by, row, col, bands) of images whose samples share nodes (site, row, col, ...) of grid_nodes; site: some of by.

    A band without data at a corner is null. Nodes of several quadrilaterals (common edges, layover) take the mean of those
    that hold all four samples. Bands in `angles` are interpolated on the circle.
    """
    parts = {b: phasors.no_nan(F.col(b).cast("double")) for b in bands if b not in angles}
    parts |= {f"{f.__name__}_{b}": f(phasors.no_nan(F.col(b).cast("double"))) for b in angles for f in (F.cos, F.sin)}
    values = cube.select(*by, "y", "x", *(c.alias(f"_{k}") for k, c in parts.items()))
    met = values.join(nodes, [*site, "y", "x"])
    quad = met.groupBy(*by, "row", "col", "y0", "x0", "v0").agg(F.count("*").alias("_n"), *(F.when(F.count(f"_{k}") == 4, F.sum(F.col("weight") * F.col(f"_{k}"))).alias(f"_{k}") for k in parts))
    found = quad.filter("_n = 4").groupBy(*by, "row", "col").agg(*(F.avg(f"_{k}").alias(k) for k in parts))
    return found.select(*by, "row", "col", *(F.atan2(f"sin_{b}", f"cos_{b}").alias(b) if b in angles else b for b in bands))


def geocoded(cube: DataFrame, bands: list[str], lon: str, lat: str, resolution: float, epsg: int = 4326, by: tuple[str, ...] = (), angles: tuple[str, ...] = ()) -> DataFrame:
    """(by, row, col, bands) on the aligned grid of a reference system, bilinear between samples; lon and lat are columns of
    the cube. Images that share their places are better served by one grid_nodes for all."""
    return at_nodes(cube, grid_nodes(cube, lon, lat, resolution, epsg, by), bands, by, by, angles)


def with_elevation(cube: DataFrame, dem: DataFrame, lon: str, lat: str, step: float, kernel: str = "bilinear") -> DataFrame:
    """cube and elevation from a regular grid dem(col, row, height), see resampling.with_elevation."""
    from burstmill.operators import resampling

    return resampling.with_elevation(cube, dem, lon, lat, step, kernel)


def unpivoted(cube: DataFrame, bands: list[str], keys: list[str]) -> DataFrame:
    """(keys, band, value): one row for each band."""
    return cube.unpivot(keys, bands, "band", "value")


def health(cube: DataFrame, bands: list[str]) -> DataFrame:
    """(band, width, height, nan_ratio, healthy) by the acceptance rule: both sides over 100, less than 0.8 no data."""
    long = unpivoted(cube, bands, ["y", "x"])
    missing = F.avg((F.col("value").isNull() | F.isnan("value")).cast("double"))
    width, height = F.max("x") - F.min("x") + 1, F.max("y") - F.min("y") + 1
    found = long.groupBy("band").agg(width.cast("long").alias("width"), height.cast("long").alias("height"), missing.alias("nan_ratio"))
    return found.withColumn("healthy", (F.col("width") > 100) & (F.col("height") > 100) & (F.col("nan_ratio") < 0.8))


def mismatch(a: DataFrame, b: DataFrame, band: str, tolerance: float = 1e-6, most: float = 0.01) -> DataFrame:
    """(n, ratio, accepted): cells that differ by more than tolerance; no data equals no data and a missing cell nothing."""
    one, two = (t.select("y", "x", F.col(band).alias(k), F.lit(True).alias(f"in_{k}")) for t, k in ((a, "a"), (b, "b")))
    both = one.join(two, ["y", "x"], "full")
    differs = F.coalesce(F.abs(F.col("a") - F.col("b")) > tolerance, F.col("a").isNull() != F.col("b").isNull())
    differs |= F.col("in_a").isNull() | F.col("in_b").isNull()
    return both.agg(F.count("*").alias("n"), F.avg(differs.cast("double")).alias("ratio")).withColumn("accepted", F.col("ratio") <= most)


def referenced(series: DataFrame, value: str, by: tuple[str, ...], t: str = "t", reference: str | None = None) -> DataFrame:
    """Values minus that of the first time, or of the reference time, of each pixel."""
    at = F.first(F.col(value)) if reference is None else F.max(F.when(F.col(t) == F.lit(reference), F.col(value)))
    w = Window.partitionBy(*by)
    w = w.orderBy(t).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing) if reference is None else w
    return series.withColumn(value, F.col(value) - at.over(w))


def within_polygon(cube: DataFrame, ring: Column, x: str = "x", y: str = "y") -> DataFrame:
    """Cells inside a closed ring of [x, y] points (planar); its box filters first."""
    from burstmill.functions.geometry import box_of, inside

    b = box_of(ring)
    near = F.col(x).between(b["west"], b["east"]) & F.col(y).between(b["south"], b["north"])
    return cube.filter(near).filter(inside(ring, F.col(x), F.col(y)))


def tiled(cube: DataFrame, height: int, width: int, overlap: int) -> DataFrame:
    """cube with each cell once for every tile (ty, tx) whose core of height x width, widened by overlap, holds it."""

    def tiles(c: str, size: int) -> Column:
        first = F.greatest(F.floor((F.col(c) - overlap) / size), F.lit(0))
        return F.sequence(first.cast("long"), F.floor((F.col(c) + overlap) / size).cast("long"))

    return cube.withColumn("ty", F.explode(tiles("y", height))).withColumn("tx", F.explode(tiles("x", width)))

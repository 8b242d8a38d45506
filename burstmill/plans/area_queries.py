"""Unwrapping, polygons of areas, deburst and resampling over the rasters that the embeddings stand in for, each with its SQL."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from burstmill.functions.phasors import wrapped
from burstmill.operators import cube, mosaics, orbits, polygons, resampling, timeseries, unwrapping
from burstmill.plans.catalog_queries import table
from burstmill.plans.raster_queries import _R, _coherence_sql, pair, raster

QUERIES, ORACLES = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


_Z = "(0.9 + 0.3 * k.image) * x + 0.3 * y + 0.5 * i"
_TURN = 2 * math.pi


@query(f"""WITH r AS ({_R}), z AS (SELECT k.image, y, x, {_Z} AS z, x % 3 = 1 AND q > 0.05 AS noisy FROM r, (VALUES (CAST(0 AS BIGINT)), (CAST(1 AS BIGINT))) k(image)),
c AS (SELECT image, y, x, noisy, CAST(round((z - atan2(sin(z), cos(z))) / {_TURN}) AS BIGINT) AS turns FROM z), b AS (SELECT image, arg_min(turns, y) AS base FROM c WHERE x = 0 GROUP BY 1)
SELECT image, y, x, CASE WHEN NOT noisy THEN turns - base END AS cycles, true AS wraps FROM c JOIN b USING (image)""")
def unwrap_tiles(spark, sf_dir):
    """Two images of a known surface, wrapped, with noise of low quality in many places: whole cycles of all good samples,
    and whether each result wraps to the phase that was given. Tiles of 64 lines and 16 samples, so that many meet."""
    r = raster(spark, sf_dir)
    images = r.withColumn("k", F.explode(F.array(*(F.struct(F.lit(n).cast("long").alias("image")) for n in (0, 1))))).select("k.image", "y", "x", F.expr(_Z).alias("z"), "q")
    noisy = (F.col("x") % 3 == 1) & (F.col("q") > 0.05)
    phase = wrapped(F.when(noisy, 97 * F.col("q")).otherwise(F.col("z")))
    given = images.select("image", "y", "x", phase.alias("phase"), F.when(noisy, 0.1).otherwise(0.9).alias("quality"), noisy.alias("noisy"))
    found = unwrapping.unwrap(given, "phase", "quality", ("image",), (64, 16)).join(given, ["image", "y", "x"])
    cycles = F.round((F.col("unw_phase") - F.col("phase")) / _TURN)
    wraps = F.abs(F.col("unw_phase") - F.col("phase") - _TURN * cycles) < 1e-6
    return found.select("image", "y", "x", F.when(~F.col("noisy"), cycles.cast("long")).alias("cycles"), wraps.alias("wraps"))


@query(f"""WITH RECURSIVE n AS MATERIALIZED (SELECT y, x, y * 2147483648 + x AS cell FROM ({_coherence_sql((2, 2), (1, 1), 12)}) WHERE coh < 0.35),
e AS (SELECT a.cell AS a, b.cell AS b FROM n a JOIN n b ON b.y = a.y AND b.x = a.x + 1 UNION ALL SELECT a.cell, b.cell FROM n a JOIN n b ON b.y = a.y + 1 AND b.x = a.x), d AS MATERIALIZED (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
c(cell, component) USING KEY (cell) AS (SELECT cell, cell FROM n UNION SELECT d.b, min(c.component) FROM c JOIN d ON d.a = c.cell JOIN recurring.c o ON o.cell = d.b WHERE c.component < o.component GROUP BY 1),
f AS (SELECT component, count(*) AS cells FROM c GROUP BY 1), s AS (SELECT component, count(*) AS shared FROM e JOIN c ON c.cell = e.a GROUP BY 1),
v AS (SELECT component, count(DISTINCT (y + k.dy) * 2147483648 + x + k.dx) AS corners FROM n JOIN c USING (cell), (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) k(dy, dx) GROUP BY 1)
SELECT component, cells AS area, 4 * cells - 2 * coalesce(shared, 0) AS length, 1 - corners + 3 * cells - coalesce(shared, 0) AS holes FROM f LEFT JOIN s USING (component) JOIN v USING (component)""")
def area_polygons(spark, sf_dir):
    """Rings of the areas of low coherence. The SQL counts cells, shared sides and corners: holes by Euler's formula."""
    low = cube.below(cube.coherence(pair(spark, sf_dir), 5, 3), "coh", 0.35)
    rings = polygons.measured(polygons.rings(low, "class"))
    return rings.groupBy("component").agg(F.sum("area").alias("area"), F.sum("length").alias("length"), F.count_if(~F.col("outer")).alias("holes"))


#: Lines of a burst and lines that it shares with the next one; samples of a sub-swath and those that it shares.
_LINES, _SHARED, _WIDE, _NEAR = 50, 9, 32, 5


@query(f"""WITH r AS ({_R}), s AS (SELECT k.swath, y // {_LINES} AS burst, y % {_LINES} AS line, x, i FROM r, (VALUES (0), (1)) k(swath)),
p AS (SELECT swath, burst, line + burst * {_LINES - _SHARED} + 3 * swath AS y, x + swath * {_WIDE - _NEAR} AS x, line, x AS col, i FROM s)
SELECT CAST(swath AS BIGINT) AS swath, burst, y, x, round(i, 6) + 0.0 AS i FROM p, (SELECT max(burst) AS last FROM s)
WHERE (burst = 0 OR line >= {_SHARED // 2}) AND (burst = last OR line < {_LINES - _SHARED + _SHARED // 2}) AND (swath = 0 OR col >= {_NEAR // 2}) AND (swath = 1 OR col < {_WIDE - _NEAR + _NEAR // 2})""")
def deburst_merge(spark, sf_dir):
    """Bursts of fifty lines, nine of which the next one has too, in two sub-swaths that share five samples and of which the
    second begins three lines later: one grid, each line and sample once."""
    r = raster(spark, sf_dir)
    number = F.floor(F.col("y") / _LINES)
    samples = r.select(F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))).alias("swath"), number.alias("burst_id"), (F.col("y") % _LINES).alias("y"), "x", "i")
    bursts = samples.select("swath", "burst_id").distinct().select("swath", "burst_id", (0.002 * (_LINES - _SHARED) * F.col("burst_id") + 0.006 * F.col("swath")).alias("start"), F.lit(_LINES).cast("long").alias("lines"))
    swaths = bursts.groupBy("swath").agg(F.min("start").alias("start")).select("swath", "start", (5e-3 + 1e-6 * (_WIDE - _NEAR) * F.col("swath")).alias("near"), F.lit(_WIDE).cast("long").alias("samples"))
    found = mosaics.merged(mosaics.deburst(samples, bursts, 0.002, ("swath",)), swaths, 0.002, 1e-6, ())
    return found.select("swath", F.col("burst_id").alias("burst"), "y", "x", (F.round("i", 6) + F.lit(0.0)).alias("i"))


def _taps_sql(points: str, grid: str, values: list[str], digits: int) -> str:
    """Bicubic values of grid (gy, gx, values) at points (py, px, ...), null without all samples beside the place."""
    w = lambda d: f"CASE WHEN abs({d}) <= 1 THEN (1.5 * abs({d}) - 2.5) * {d} * {d} + 1 ELSE ((-0.5 * abs({d}) + 2.5) * abs({d}) - 4) * abs({d}) + 2 END"
    core = "greatest(0, 1 - abs(py - gy)) * greatest(0, 1 - abs(px - gx))"
    out = ", ".join(f"CASE WHEN sum(c) > 1 - 1e-9 THEN round(sum(w * {v}) / sum(w), {digits}) + 0.0 END AS {v}" for v in values)
    return f"""p AS ({points}), n AS (SELECT id, py, px, CAST(floor(py) AS BIGINT) + a.n AS gy, CAST(floor(px) AS BIGINT) + b.n AS gx FROM p, (SELECT unnest(range(-1, 3)) AS n) a, (SELECT unnest(range(-1, 3)) AS n) b),
g AS ({grid}), m AS (SELECT id, ({w("(py - gy)")}) * ({w("(px - gx)")}) AS w, {core} AS c, {", ".join(values)} FROM n JOIN g USING (gy, gx)), v AS (SELECT id, {out} FROM m GROUP BY 1)"""


@query(f"""WITH r AS ({_R}), {_taps_sql("SELECT y * 32 + x AS id, y, x, y + 0.6 - 0.01 * x AS py, x - 0.4 + 0.3 * i AS px FROM r", "SELECT y AS gy, x AS gx, i, q FROM r", ["i", "q"], 6)}
SELECT y, x, v.i, v.q FROM p LEFT JOIN v USING (id)""")
def resample_bicubic(spark, sf_dir):
    """Complex samples at places off the grid, which differ from line to line and sample to sample."""
    r = raster(spark, sf_dir).select("y", "x", "i", "q")
    places = r.select("y", "x", (F.col("y") + 0.6 - 0.01 * F.col("x")).alias("at_y"), (F.col("x") - 0.4 + 0.3 * F.col("i")).alias("at_x"))
    found = resampling.resampled_complex(r, places, "bicubic", tile=64)
    return found.select("y", "x", *((F.round(c, 6) + F.lit(0.0)).alias(c) for c in "iq"))


@query(f"""WITH {_taps_sql("SELECT row_number() OVER () AS id, l_orderkey, l_linenumber, 0.013 * (l_partkey % 4000) AS py, 0.17 * (l_suppkey % 190) AS px FROM lineitem", f"SELECT y AS gy, x AS gx, 100 * i AS elevation FROM ({_R})", ["elevation"], 5)}
SELECT l_orderkey, l_linenumber, elevation FROM p LEFT JOIN v USING (id)""")
def elevation_bicubic(spark, sf_dir):
    """The elevation of places of which many repeat, from a grid of heights."""
    dem = raster(spark, sf_dir).select(F.col("x").alias("col"), F.col("y").alias("row"), (100 * F.col("i")).alias("height"))
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (0.013 * (F.col("l_partkey") % 4000)).alias("lat"), (0.17 * (F.col("l_suppkey") % 190)).alias("lon"))
    found = cube.with_elevation(items, dem, "lon", "lat", 1.0, "bicubic")
    return found.select("l_orderkey", "l_linenumber", (F.round("elevation", 5) + F.lit(0.0)).alias("elevation"))


_POLY = "3 + 2 * u - u * u + 0.5 * u * u * u"


@query(f"""WITH d AS (SELECT DISTINCT o_custkey AS orbit, CAST(o_orderdate AS DATE) - DATE '1996-01-01' AS t FROM orders WHERE o_custkey IS NOT NULL AND o_orderdate IS NOT NULL),
n AS (SELECT orbit, t, row_number() OVER (PARTITION BY orbit ORDER BY t) AS k, count(*) OVER (PARTITION BY orbit) AS n FROM d),
r AS (SELECT orbit, max(t) FILTER (WHERE k = 2) AS first, max(t) FILTER (WHERE k = n - 1) AS last FROM n WHERE n > 3 GROUP BY 1),
l AS (SELECT l_orderkey, l_linenumber, o_custkey AS orbit, CAST(l_shipdate AS DATE) - DATE '1996-01-01' AS t FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
s AS (SELECT l_orderkey, l_linenumber, CAST(t AS DOUBLE) / 997 AS u, t >= first AND t <= last AS held, l.orbit FROM l LEFT JOIN r ON r.orbit = l.orbit)
SELECT l_orderkey, l_linenumber, CASE WHEN held THEN round({_POLY}, 6) + 0.0 END AS x, CASE WHEN held THEN round(u * l.orbit, 5) + 0.0 END AS y, CASE WHEN held THEN round((2 - 2 * u + 1.5 * u * u) / 997, 8) + 0.0 END AS vx FROM (SELECT l_orderkey, l_linenumber, u, held, orbit FROM s) l""")
def orbit_states(spark, sf_dir):
    """Positions and velocities of lines between the state vectors of their orbit, each customer's orders; along a cubic, so
    that four vectors tell all."""
    day = lambda c: F.datediff(F.to_date(c), F.lit("1996-01-01")).cast("double")
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("orbit"), day("o_orderdate").alias("t"))
    u = F.col("t") / 997
    vectors = o.withColumn("u", u).select("orbit", "t", F.expr(_POLY).alias("x"), (F.col("u") * F.col("orbit")).alias("y"), F.lit(7.0).alias("z"))
    lines = table(spark, sf_dir, "lineitem").join(o.drop("t"), F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", "orbit", day("l_shipdate").alias("t"))
    found = orbits.with_state(lines, vectors, "t")
    digits = {"x": ("position.x", 6), "y": ("position.y", 5), "vx": ("velocity.x", 8)}
    return found.select("l_orderkey", "l_linenumber", *((F.round(c, n) + F.lit(0.0)).alias(k) for k, (c, n) in digits.items()))


@query("""WITH s AS (SELECT l_partkey AS y, CAST(l_shipdate AS DATE) AS d, sum(l_quantity) AS v FROM lineitem WHERE l_partkey IS NOT NULL AND l_shipdate IS NOT NULL GROUP BY 1, 2),
r AS (SELECT y, (d - DATE '2000-01-01') AS t, CASE WHEN d >= DATE '1995-06-17' THEN 1 ELSE 0 END AS j, v FROM s WHERE v IS NOT NULL),
m AS (SELECT y, count(*) AS n, CAST(sum(t) AS HUGEINT) AS st, CAST(sum(t * t) AS HUGEINT) AS stt, CAST(sum(j) AS HUGEINT) AS sj, CAST(sum(t * j) AS HUGEINT) AS stj, CAST(sum(v) AS DOUBLE) AS sv, CAST(sum(v * t) AS DOUBLE) AS svt, CAST(sum(v * j) AS DOUBLE) AS svj FROM r GROUP BY 1),
e AS (SELECT *, n * (stt * sj - stj * stj) - st * (st * sj - stj * sj) + sj * (st * stj - stt * sj) AS det FROM m)
SELECT y, n, CASE WHEN det <> 0 THEN round(365.25 * (n * (svt * sj - stj * svj) - sv * (st * sj - stj * sj) + sj * (st * svj - svt * sj)) / det, 3) + 0.0 END AS velocity,
CASE WHEN det <> 0 THEN round((n * (stt * svj - svt * stj) - st * (st * svj - svt * sj) + sv * (st * stj - stt * sj)) / det, 3) + 0.0 END AS step FROM e""")
def timeseries_velocity(spark, sf_dir):
    """Velocity and a step of each pixel's series. The SQL solves the normal equations by Cramer's rule, in whole numbers."""
    i = table(spark, sf_dir, "lineitem").filter("l_partkey IS NOT NULL AND l_shipdate IS NOT NULL")
    s = i.groupBy(F.col("l_partkey").alias("y"), F.to_date("l_shipdate").alias("date")).agg(F.sum("l_quantity").alias("v"))
    found = timeseries.velocity(s, "v", ("y",), steps=["1995-06-17"])
    return found.select("y", "n", *((F.round(c, 3) + F.lit(0.0)).alias(k) for k, c in (("velocity", "velocity"), ("step", "step_1"))))


@query(f"""WITH r AS ({_R}), b AS (SELECT y AS gy, x AS gx, i FROM r), h AS (SELECT max(gy) AS top, max(gx) AS wide FROM b),
n AS (SELECT unnest(range(0, CAST(floor((top + 1) * 20 / 12.0) AS BIGINT) + 1)) AS row FROM h), m AS (SELECT unnest(range(0, CAST(floor((wide + 1) * 20 / 12.0) AS BIGINT) + 1)) AS col FROM h),
p AS (SELECT row, col, (row + 0.5) * 12 / 20 - 0.5 AS py, (col + 0.5) * 12 / 20 - 0.5 AS px FROM n, m),
t AS (SELECT row, col, CAST(floor(py) AS BIGINT) + a.n AS gy, CAST(floor(px) AS BIGINT) + c.n AS gx, (CASE a.n WHEN 1 THEN py - floor(py) ELSE 1 - py + floor(py) END) * (CASE c.n WHEN 1 THEN px - floor(px) ELSE 1 - px + floor(px) END) AS w FROM p, (VALUES (0), (1)) a(n), (VALUES (0), (1)) c(n))
SELECT row, col, round(sum(w * i) / sum(w), 6) + 0.0 AS i FROM t JOIN b USING (gy, gx) GROUP BY ALL HAVING sum(w) > 1 - 1e-9""")
def warp_grid(spark, sf_dir):
    """A grid of 20 m on one of 12 m in the same zone, bilinear."""
    grid = raster(spark, sf_dir).select(F.col("y").alias("row"), F.col("x").alias("col"), "i")
    found = resampling.warped(grid, ["i"], (32632, 20.0), (32632, 12.0))
    return found.select("row", "col", (F.round("i", 6) + F.lit(0.0)).alias("i"))

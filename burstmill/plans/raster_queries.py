"""Queries over rasters, with the SQL that gives the same rows.

The driver's embeddings stand in for a complex raster: line y is vec_id, sample x is half the position, i and q are
the even and the odd positions; line y + 1 is the secondary of line y. lineitem stands in for pixel time series.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burstmill.functions import phasors
from burstmill.operators import cube, kernels
from burstmill.operators.pairs import within_days
from burstmill.plans.catalog_queries import table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _samples(lines: DataFrame, *names: str) -> DataFrame:
    """lines (y, label, one array for each name) as cells: name 1 gives i1 and q1, and so on."""
    cells = lines.withColumn("x", F.explode(F.sequence(F.lit(0), F.floor(F.size(names[0]) / 2).cast("int") - 1)))
    parts = [F.get(n, 2 * F.col("x") + k).cast("double").alias(f"{c}{n}") for n in names for k, c in enumerate("iq")]
    return cells.select("label", "y", F.col("x").cast("long").alias("x"), *parts)


def raster(spark, sf_dir) -> DataFrame:
    """(label, y, x, i, q)"""
    e = table(spark, sf_dir, "embeddings").select("label", F.col("vec_id").alias("y"), F.col("embedding").alias("1"))
    return _samples(e, "1").withColumnsRenamed({"i1": "i", "q1": "q"})


def pair(spark, sf_dir) -> DataFrame:
    """(y, x, i1, q1, i2, q2): each line with the next one. Whole lines are joined, so windows along a line need no
    further shuffle."""
    e = table(spark, sf_dir, "embeddings")
    first = e.select("label", F.col("vec_id").alias("y"), F.col("embedding").alias("1"))
    second = e.select((F.col("vec_id") - 1).alias("y"), F.col("embedding").alias("2"))
    return _samples(first.join(second, "y"), "1", "2").drop("label")


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    # adding 0.0 turns -0.0 into 0.0
    return df.withColumns({c: F.round(c, 6) + F.lit(0.0) for c in columns})


_R = """SELECT label, vec_id AS y, CAST(g.x AS BIGINT) AS x, CAST(embedding[2 * g.x + 1] AS DOUBLE) AS i, CAST(embedding[2 * g.x + 2] AS DOUBLE) AS q
FROM embeddings, (SELECT unnest(range(0, 32)) AS x) g"""
_PAIR = f"""r AS ({_R}), s AS (SELECT a.y, a.x, a.i AS i1, a.q AS q1, b.i AS i2, b.q AS q2 FROM r a JOIN r b ON b.y = a.y + 1 AND b.x = a.x),
parts AS (SELECT y, x, i1 * i2 + q1 * q2 AS re, q1 * i2 - i1 * q2 AS im, i1 * i1 + q1 * q1 AS p1, i2 * i2 + q2 * q2 AS p2 FROM s)"""


def _coherence_sql(wx: tuple[int, int], wy: tuple[int, int], digits: int = 6) -> str:
    n = (wx[0] + wx[1] + 1) * (wy[0] + wy[1] + 1)
    one = ", ".join(f"sum({c}) OVER (PARTITION BY y ORDER BY x RANGE BETWEEN {wx[0]} PRECEDING AND {wx[1]} FOLLOWING) AS {c}" for c in ("re", "im", "p1", "p2"))
    two = ", ".join(f"sum({c}) OVER (PARTITION BY x ORDER BY y RANGE BETWEEN {wy[0]} PRECEDING AND {wy[1]} FOLLOWING) / {n}.0 AS {c}" for c in ("re", "im", "p1", "p2"))
    return f"""WITH {_PAIR}, h AS (SELECT y, x, {one} FROM parts), v AS (SELECT y, x, {two} FROM h)
SELECT y, x, round(sqrt(pow(re / sqrt(p1 * p2 + 1e-12), 2) + pow(im / sqrt(p1 * p2 + 1e-12), 2)), {digits}) AS coh FROM v"""


@query(_coherence_sql((2, 2), (1, 1)))
def coherence_boxcar(spark, sf_dir):
    return rounded(cube.coherence(pair(spark, sf_dir), 5, 3), "coh")


@query(_coherence_sql((0, 0), (2, 2)))
def coherence_boxcar_swapped(spark, sf_dir):
    return rounded(cube.coherence(pair(spark, sf_dir), 1, 5), "coh")


@query(_coherence_sql((4, 5), (0, 1)))
def coherence_default_window(spark, sf_dir):
    return rounded(cube.coherence(pair(spark, sf_dir), 10, 2), "coh")


@query(f"""WITH r AS ({_R}) SELECT y, x, round(sqrt(i * i + q * q), 6) AS amplitude, CASE WHEN sqrt(i * i + q * q) > 0 THEN round(10 * log10(sqrt(i * i + q * q)), 6) END AS db FROM r""")
def slc_amplitude_db(spark, sf_dir):
    a = phasors.amplitude(F.col("i"), F.col("q"))
    return rounded(raster(spark, sf_dir).select("y", "x", a.alias("amplitude"), phasors.decibel(a).alias("db")), "amplitude", "db")


@query(f"WITH {_PAIR} SELECT y, x, round(re, 6) + 0.0 AS re, round(im, 6) + 0.0 AS im, round(p1, 6) AS p1, round(p2, 6) AS p2 FROM parts")
def interferogram_parts(spark, sf_dir):
    return rounded(cube.interferogram(pair(spark, sf_dir)), "re", "im", "p1", "p2")


@query(f"WITH {_PAIR} SELECT y, x, round(atan2(im, re), 6) + 0.0 AS phase FROM parts")
def interferogram_phase(spark, sf_dir):
    p = cube.interferogram(pair(spark, sf_dir)).select("y", "x", phasors.phase(F.col("re"), F.col("im")).alias("phase"))
    return rounded(p, "phase")


@query(f"WITH {_PAIR} SELECT y // 2 AS y, x // 4 AS x, round(avg(re), 6) + 0.0 AS re, round(avg(im), 6) + 0.0 AS im FROM parts GROUP BY 1, 2")
def multilook(spark, sf_dir):
    return rounded(cube.multilook(cube.interferogram(pair(spark, sf_dir)), ["re", "im"], 4, 2), "re", "im")


_SERIES = "SELECT l_partkey AS y, l_linenumber AS x, CAST(l_shipdate AS DATE) AS t, l_discount AS coh, l_quantity AS value FROM lineitem"


def series(spark, sf_dir) -> DataFrame:
    i = table(spark, sf_dir, "lineitem")
    return i.select(F.col("l_partkey").alias("y"), F.col("l_linenumber").alias("x"), F.to_date("l_shipdate").alias("t"), F.col("l_discount").alias("coh"), F.col("l_quantity").alias("value"))


@query(f"WITH s AS ({_SERIES}) SELECT y, x, max(coh) AS coh FROM s GROUP BY 1, 2")
def cube_temporal_max(spark, sf_dir):
    return cube.reduce_time(series(spark, sf_dir), ["coh"])


@query(f"WITH s AS ({_SERIES}) SELECT y // 10 AS y, x, max(coh) AS coh FROM s GROUP BY 1, 2")
def cube_mosaic_max(spark, sf_dir):
    s = series(spark, sf_dir).withColumn("y", F.floor(F.col("y") / 10))
    return cube.mosaic([s.filter("t < '1997-01-01'"), s.filter("t >= '1997-01-01' OR t IS NULL")], ["coh"])


@query(f"WITH r AS ({_R}), v AS (SELECT y, x, i FROM r), h AS (SELECT y + 1 AS y, x, q FROM r) SELECT v.y, v.x, round(i, 6) + 0.0 AS i, round(q, 6) + 0.0 AS q FROM v JOIN h ON v.y = h.y AND v.x = h.x")
def cube_merge_bands(spark, sf_dir):
    r = raster(spark, sf_dir)
    before = r.select((F.col("y") + 1).alias("y"), "x", "q")
    return rounded(cube.merge_bands(r.select("y", "x", "i"), before, ["y", "x"]), "i", "q")


@query(f"WITH s AS ({_SERIES}) SELECT t, y, x, coh FROM s WHERE t IS NOT NULL")
def cube_merge_time(spark, sf_dir):
    s = series(spark, sf_dir).select("t", "y", "x", "coh")
    return cube.merge_time(cube.filter_temporal(s, "0001-01-01", "1996-01-01"), cube.filter_temporal(s, "1996-01-01", "9999-12-31"))


@query(f"WITH s AS ({_SERIES}) SELECT t, y, x, coh AS coherence, value AS amp, 'VV' AS pol FROM s WHERE t >= DATE '1996-01-01' AND t < DATE '1996-07-01'")
def cube_filter_rename(spark, sf_dir):
    s = cube.filter_temporal(series(spark, sf_dir), "1996-01-01", "1996-07-01")
    s = cube.rename_labels(cube.filter_bands(s, ["coh", 1]), ["coherence", "amp"], ["coh", "value"])
    return cube.add_dimension(s, "pol", "VV")


@query(f"WITH s AS ({_SERIES}), m AS (SELECT y, x, max(coh) AS coh FROM s GROUP BY 1, 2) SELECT y, x, coh, coalesce(coh < 0.05, false) AS class FROM m WHERE x BETWEEN 1 AND 5 AND y BETWEEN 10 AND 900")
def coherence_threshold_class(spark, sf_dir):
    return cube.below(cube.within_box(cube_temporal_max(spark, sf_dir), 1, 10, 5, 900), "coh", 0.05)


@query(f"""WITH r AS ({_R}), l AS (SELECT y, x, 'i' AS band, i AS value FROM r UNION ALL SELECT y, x, 'q', q FROM r)
SELECT band, CAST(max(x) - min(x) + 1 AS BIGINT) AS width, CAST(max(y) - min(y) + 1 AS BIGINT) AS height, round(avg(CASE WHEN value IS NULL OR isnan(value) THEN 1.0 ELSE 0.0 END), 6) AS nan_ratio,
(max(x) - min(x) + 1 > 100) AND (max(y) - min(y) + 1 > 100) AND avg(CASE WHEN value IS NULL OR isnan(value) THEN 1.0 ELSE 0.0 END) < 0.8 AS healthy FROM l GROUP BY 1""")
def raster_health(spark, sf_dir):
    return rounded(cube.health(raster(spark, sf_dir), ["i", "q"]), "nan_ratio")


@query(f"WITH s AS (SELECT y, x, i, round(i, 2) AS j FROM ({_R})) SELECT count(*) AS n, round(avg(CASE WHEN abs(i - j) > 0.0025 THEN 1.0 ELSE 0.0 END), 6) AS ratio, avg(CASE WHEN abs(i - j) > 0.0025 THEN 1.0 ELSE 0.0 END) <= 0.01 AS accepted FROM s")
def raster_compare(spark, sf_dir):
    r = raster(spark, sf_dir)
    return rounded(cube.mismatch(r, r.withColumn("i", F.round("i", 2)), "i", 0.0025), "ratio")


@query(f"""WITH r AS ({_R}) SELECT CAST(floor((46 + y * 0.001) / 0.05) AS BIGINT) AS row, CAST(floor((10 + x * 0.01) / 0.05) AS BIGINT) AS col, round(avg(sqrt(i * i + q * q)), 6) AS amplitude, count(*) AS n FROM r GROUP BY 1, 2""")
def geocode_grid(spark, sf_dir):
    # whole steps first, so that each place is the double next to its decimal, as in the SQL: 46 + 34300 * 0.001 would lie a cell further
    r = raster(spark, sf_dir).select(((46_000.0 + F.col("y")) / 1000).alias("lat"), ((1000.0 + F.col("x")) / 100).alias("lon"), phasors.amplitude(F.col("i"), F.col("q")).alias("amplitude"))
    return rounded(cube.resample_spatial(r, ["amplitude"], "lon", "lat", 0.05), "amplitude")


@query(f"WITH r AS ({_R}) SELECT y, x, 'i' AS band, round(i, 6) + 0.0 AS value FROM r UNION ALL SELECT y, x, 'q', round(q, 6) + 0.0 FROM r")
def band_unpivot(spark, sf_dir):
    return rounded(cube.unpivoted(raster(spark, sf_dir), ["i", "q"], ["y", "x"]), "value")


@query(f"""WITH {_PAIR}, f AS (SELECT y, x, atan2(im, re) AS p FROM parts), d AS (SELECT y, x, p, p - lag(p) OVER (PARTITION BY y ORDER BY x) AS s FROM f),
w AS (SELECT y, x, CASE WHEN s IS NULL THEN p ELSE atan2(sin(s), cos(s)) END AS s FROM d) SELECT y, x, round(sum(s) OVER (PARTITION BY y ORDER BY x ROWS UNBOUNDED PRECEDING), 5) + 0.0 AS unw_phase FROM w""")
def unwrap_rowwise(spark, sf_dir):
    p = cube.interferogram(pair(spark, sf_dir)).select("y", "x", phasors.phase(F.col("re"), F.col("im")).alias("phase"))
    return kernels.unwrap_rows(p).select("y", "x", (F.round("unw_phase", 5) + F.lit(0.0)).alias("unw_phase"))


@query(f"""WITH s AS ({_SERIES}), m AS (SELECT y, t, sum(value) AS value FROM s GROUP BY 1, 2) SELECT y, t, round(value - first_value(value) OVER (PARTITION BY y ORDER BY t), 6) AS value FROM m""")
def timeseries_reference(spark, sf_dir):
    s = series(spark, sf_dir).groupBy("y", "t").agg(F.sum("value").alias("value"))
    return rounded(cube.referenced(s, "value", ("y",)), "value")


def _network(spark, sf_dir) -> DataFrame:
    """Pairs of each pixel's dates at most 200 days apart, with the difference of their values."""
    s = series(spark, sf_dir).groupBy("y", "t").agg(F.sum("value").alias("v"))
    a = s.select("y", F.col("t").alias("prm_date"), F.col("v").alias("v1"))
    b = s.select("y", F.col("t").alias("sec_date"), F.col("v").alias("v2"))
    return within_days(a, b, "prm_date", "sec_date", 1, 200, ("y",)).select("y", "prm_date", "sec_date", (F.col("v2") - F.col("v1")).alias("phase"))


@query(f"""WITH RECURSIVE s AS (SELECT y, t, sum(value) AS v, row_number() OVER (PARTITION BY y ORDER BY t) AS k FROM ({_SERIES}) GROUP BY 1, 2),
g AS (SELECT y, t, v, t - lag(t) OVER (PARTITION BY y ORDER BY t) AS gap, lead(t) OVER (PARTITION BY y ORDER BY t) - t AS ahead FROM s),
i AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 200 THEN 1 ELSE 0 END) OVER (PARTITION BY y ORDER BY t) AS island FROM g),
n AS (SELECT *, first_value(v) OVER (PARTITION BY y, island ORDER BY t) AS base, count(*) OVER (PARTITION BY y, island) AS size FROM i),
e AS (SELECT y, island, max(v - base) AS m, arg_max(v - base, t) AS last FROM n WHERE size > 1 GROUP BY 1, 2),
o AS (SELECT y, island, coalesce(sum(last) OVER (PARTITION BY y ORDER BY island ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS moved FROM e)
SELECT n.y, n.t AS date, round(v - base + moved, 4) + 0.0 AS displacement FROM n JOIN o ON n.y = o.y AND n.island = o.island WHERE size > 1""")
def sbas_inversion(spark, sf_dir):
    """The pairs are consistent, so least squares gives each date's own value relative to the first of its connected
    dates; between unconnected ones the solution of least norm has no step."""
    found = kernels.invert_network(_network(spark, sf_dir), ["y"])
    return found.select("y", "date", (F.round("displacement", 4) + F.lit(0.0)).alias("displacement"))


def _turn(at: str, by: str, sign: int, source: str, group: str) -> str:
    """One direction of a discrete Fourier transform of 32 points, from index `by` to index `at`."""
    c, s = f"cos(pi() * k.n * {by} / 16)", f"{sign} * sin(pi() * k.n * {by} / 16)"
    return f"SELECT {group}, k.n AS {at}, sum(re * {c} - im * {s}) AS re, sum(re * {s} + im * {c}) AS im FROM {source}, k GROUP BY ALL"


@query(f"""WITH {_PAIR}, k AS (SELECT unnest(range(0, 32)) AS n), t AS (SELECT y // 16 - a.n AS py, x // 16 - b.n AS px, y - 16 * (y // 16 - a.n) AS r, x - 16 * (x // 16 - b.n) AS c, y, x, re, im FROM parts, k a, k b WHERE a.n < 2 AND b.n < 2),
f AS ({_turn("h", "c", -1, "t", "py, px, r")}), z AS ({_turn("w", "r", -1, "f", "py, px, h")}),
m AS (SELECT py, px, (h + a.n - 1 + 32) % 32 AS h, (w + b.n - 1 + 32) % 32 AS w, sum(sqrt(re * re + im * im)) / 9 AS size FROM z, k a, k b WHERE a.n < 3 AND b.n < 3 GROUP BY ALL),
e AS (SELECT py, px, h, w, re * sqrt(size / top) AS re, im * sqrt(size / top) AS im FROM z JOIN m USING (py, px, h, w) JOIN (SELECT py, px, max(size) AS top FROM m GROUP BY ALL) USING (py, px) WHERE top > 0),
g AS ({_turn("c", "h", 1, "e", "py, px, w")}), o AS ({_turn("r", "w", 1, "g", "py, px, c")}),
b AS (SELECT t.y, t.x, coalesce(o.re, 0) / 1024 AS re, coalesce(o.im, 0) / 1024 AS im, (1 - abs((r + 0.5) / 16 - 1)) * (1 - abs((c + 0.5) / 16 - 1)) AS q FROM t LEFT JOIN o USING (py, px, r, c))
SELECT y, x, round(sum(re * q) / sum(q), 6) + 0.0 AS re, round(sum(im * q) / sum(q), 6) + 0.0 AS im FROM b GROUP BY ALL""")
def goldstein_filter(spark, sf_dir):
    """The SQL writes the transforms out as sums."""
    p = cube.interferogram(pair(spark, sf_dir)).select("y", "x", "re", "im")
    return rounded(kernels.goldstein(p, patch=32), "re", "im")


@query(f"WITH {_PAIR} SELECT CAST(0 AS BIGINT) + count(*) AS residues FROM (SELECT y, x, a, b, c, d FROM (SELECT f.y, f.x, atan2(f.im, f.re) AS a, atan2(g.im, g.re) AS b, atan2(h.im, h.re) AS c, atan2(k.im, k.re) AS d FROM parts f JOIN parts g ON g.y = f.y AND g.x = f.x + 1 JOIN parts h ON h.y = f.y + 1 AND h.x = f.x + 1 JOIN parts k ON k.y = f.y + 1 AND k.x = f.x)) WHERE abs(atan2(sin(b - a), cos(b - a)) + atan2(sin(c - b), cos(c - b)) + atan2(sin(d - c), cos(d - c)) + atan2(sin(a - d), cos(a - d))) > pi()")
def phase_residues(spark, sf_dir):
    p = cube.interferogram(pair(spark, sf_dir)).select("y", "x", phasors.phase(F.col("re"), F.col("im")).alias("phase"))
    return kernels.residues(p)


@query(f"""WITH RECURSIVE n AS (SELECT y, x, y * 2147483648 + x AS cell FROM ({_coherence_sql((2, 2), (1, 1), 12)}) WHERE coh < 0.35),
e AS (SELECT a.cell AS a, b.cell AS b FROM n a JOIN n b ON b.y = a.y AND b.x = a.x + 1 UNION ALL SELECT a.cell, b.cell FROM n a JOIN n b ON b.y = a.y + 1 AND b.x = a.x), d AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach AS (SELECT cell, cell AS root FROM n UNION SELECT d.b, reach.root FROM reach JOIN d ON d.a = reach.cell WHERE reach.root < d.b), c AS (SELECT cell, min(root) AS component FROM reach GROUP BY 1)
SELECT component, count(*) AS cells, min(y) AS y0, max(y) AS y1, min(x) AS x0, max(x) AS x1 FROM n JOIN c USING (cell) GROUP BY 1""")
def connected_components(spark, sf_dir):
    """Areas of low coherence; a test holds them against a flood fill, too."""
    low = cube.below(cube.coherence(pair(spark, sf_dir), 5, 3), "coh", 0.35)
    return kernels.raster_components(low, "class")


_RING = [(2.0, 10.0), (28.0, 60.0), (15.0, 300.0), (2.0, 10.0)]


def _crossing(a: tuple[float, float], b: tuple[float, float]) -> str:
    return f"CASE WHEN ({a[1]} > y) <> ({b[1]} > y) AND x < {a[0]} + ({b[0]} - {a[0]}) * (y - {a[1]}) / ({b[1]} - {a[1]}) THEN 1 ELSE 0 END"


@query(f"WITH r AS ({_R}) SELECT y, x, round(i, 6) + 0.0 AS i FROM r WHERE ({' + '.join(_crossing(a, b) for a, b in zip(_RING, _RING[1:]))}) % 2 = 1")
def cube_polygon_mask(spark, sf_dir):
    ring = F.array(*(F.array(F.lit(a), F.lit(b)) for a, b in _RING))
    return rounded(cube.within_polygon(raster(spark, sf_dir).select("y", "x", "i"), ring), "i")


@query(f"""WITH r AS ({_R}), t AS (SELECT y, x, unnest(range(CAST(greatest(floor((y - 5) / 50.0), 0) AS BIGINT), CAST(floor((y + 5) / 50.0) AS BIGINT) + 1)) AS ty FROM r),
u AS (SELECT y, x, ty, unnest(range(CAST(greatest(floor((x - 5) / 16.0), 0) AS BIGINT), CAST(floor((x + 5) / 16.0) AS BIGINT) + 1)) AS tx FROM t) SELECT ty, tx, count(*) AS n, min(y) AS y0, max(x) AS x1 FROM u GROUP BY 1, 2""")
def tile_halo(spark, sf_dir):
    t = cube.tiled(raster(spark, sf_dir).select("y", "x"), 50, 16, 5)
    return t.groupBy("ty", "tx").agg(F.count("*").alias("n"), F.min("y").alias("y0"), F.max("x").alias("x1"))

"""The three products over a stack of images made of the embeddings: fifty lines an image, an image every twelve days.

The stack holds three bursts in two sub-swaths and two polarizations of each, all different; products run over all at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burstmill.plans import workflows
from burstmill.plans.raster_queries import _R, raster, rounded
from burstmill.shared import new_path
from burstmill.sources import geotiff
from burstmill.sources.parameters import job

QUERIES, ORACLES = {}, {}
_LINES = 50


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


#: (burst, sub-swath, polarization, added to i, factor of q) of each image of the stack.
IMAGES = [(7 + k, f"IW{2 + k % 2}", pol, 0.02 * k, 1.0 if pol == "VV" else 0.5) for k in range(3) for pol in ("VV", "VH")]


def stack(spark, sf_dir) -> DataFrame:
    """(burst_id, swath, pol, date, y, x, i, q)"""
    day = F.date_add(F.lit("2024-01-01").cast("date"), (12 * F.floor(F.col("y") / _LINES)).cast("int"))
    kinds = F.array(*(F.struct(F.lit(b).cast("long").alias("burst_id"), F.lit(s).alias("swath"), F.lit(p).alias("pol"), F.lit(a).alias("a"), F.lit(f).alias("f")) for b, s, p, a, f in IMAGES))
    rows = raster(spark, sf_dir).select(day.alias("date"), (F.col("y") % _LINES).alias("y"), "x", "i", "q", F.explode(kinds).alias("k"))
    return rows.select("k.burst_id", "k.swath", "k.pol", "date", "y", "x", (F.col("i") + F.col("k.a")).alias("i"), (F.col("q") * F.col("k.f")).alias("q"))


def acquisitions(images: DataFrame) -> DataFrame:
    """The catalogue of the stack's images."""
    days = images.select("burst_id", "swath", "pol", "date").distinct()
    return days.select(F.datediff("date", F.lit("2024-01-01")).cast("long").alias("abs_id"), "burst_id", "swath", "pol", F.to_timestamp_ntz(F.col("date").cast("string")).alias("start"), F.expr("array(array(array(0D, 0D), array(1D, 1D), array(0D, 1D), array(0D, 0D)))").alias("footprint"))


_S = f"""SELECT k.burst_id, k.swath, k.pol, DATE '2024-01-01' + CAST(12 * (y // {_LINES}) AS INT) AS date, y % {_LINES} AS y, x, i + k.a AS i, q * k.f AS q
FROM ({_R}), (VALUES {', '.join(f"(CAST({b} AS BIGINT), '{s}', '{p}', CAST({a} AS DOUBLE), CAST({f} AS DOUBLE))" for b, s, p, a, f in IMAGES)}) k(burst_id, swath, pol, a, f)"""
_B = "burst_id, swath, pol"
_P = f"""s AS ({_S}), p AS (SELECT a.burst_id, a.swath, a.pol, a.date AS prm_date, b.date AS sec_date, a.y, a.x, a.i * b.i + a.q * b.q AS re, a.q * b.i - a.i * b.q AS im, a.i * a.i + a.q * a.q AS p1, b.i * b.i + b.q * b.q AS p2
FROM s a JOIN s b ON a.burst_id = b.burst_id AND a.swath = b.swath AND a.pol = b.pol AND b.date = a.date + 12 AND a.y = b.y AND a.x = b.x)"""
_ONE = ", ".join(f"sum({c}) OVER (PARTITION BY {_B}, prm_date, y ORDER BY x RANGE BETWEEN 4 PRECEDING AND 5 FOLLOWING) AS {c}" for c in ("re", "im", "p1", "p2"))
_TWO = ", ".join(f"sum({c}) OVER (PARTITION BY {_B}, prm_date, x ORDER BY y RANGE BETWEEN 0 PRECEDING AND 1 FOLLOWING) / 20.0 AS {c}" for c in ("re", "im", "p1", "p2"))
_COH = f"""h AS (SELECT {_B}, prm_date, sec_date, y, x, {_ONE} FROM p), v AS (SELECT {_B}, prm_date, sec_date, y, x, {_TWO} FROM h),
c AS (SELECT {_B}, prm_date, sec_date, y, x, sqrt(pow(re / sqrt(p1 * p2 + 1e-12), 2) + pow(im / sqrt(p1 * p2 + 1e-12), 2)) AS coh FROM v)"""

_COH_ONCE = _COH.replace("c AS (", "c AS MATERIALIZED (")


def _job(images: DataFrame | None = None, **more):
    """A job over the extent that `more` names, or else over the images' own, from the first date to the last."""
    if images is not None:
        first, last = images.agg(F.min("date").cast("string"), F.max("date").cast("string")).first()
        more["temporal_extent"] = [first or "2024-01-01", last or "2024-01-01"]
    box = {"west": 0, "south": 0, "east": 1, "north": 1}
    return job({"spatial_extent": box, "polarization": ["vv", "vh"], "temporal_baseline": 12} | more)


@query(f"WITH {_P}, {_COH} SELECT {_B}, prm_date, sec_date, y, x, round(coh, 6) AS coh FROM c")
def product_coherence(spark, sf_dir):
    images = stack(spark, sf_dir)
    return rounded(workflows.sar_coherence(acquisitions(images), images, _job(images), every_burst=True), "coh")


@query(f"""WITH {_P}, {_COH}, l AS (SELECT {_B}, prm_date, sec_date, y, x // 4 AS x, atan2(avg(im), avg(re)) AS phase FROM p GROUP BY ALL), k AS (SELECT {_B}, prm_date, sec_date, y, x // 4 AS x, avg(coh) AS coh FROM c GROUP BY ALL),
d AS (SELECT *, phase - lag(phase) OVER (PARTITION BY {_B}, prm_date, y ORDER BY x) AS s FROM l), w AS (SELECT * EXCLUDE (s), CASE WHEN s IS NULL THEN phase ELSE atan2(sin(s), cos(s)) END AS s FROM d),
u AS (SELECT *, sum(s) OVER (PARTITION BY {_B}, prm_date, y ORDER BY x ROWS UNBOUNDED PRECEDING) AS unw FROM w)
SELECT {_B}, prm_date, sec_date, y, x, round(phase, 5) + 0.0 AS phase, round(unw, 5) + 0.0 AS unw_phase, round(coh, 6) AS coh FROM u JOIN k USING ({_B}, prm_date, sec_date, y, x)""")
def product_interferogram(spark, sf_dir):
    images = stack(spark, sf_dir)
    out = workflows.sar_interferogram(acquisitions(images), images, _job(images), every_burst=True)
    return rounded(out, "coh").withColumns({c: F.round(c, 5) + F.lit(0.0) for c in ("phase", "unw_phase")})


_STEP = 0.004


def geometry(images: DataFrame) -> DataFrame:
    """Coordinates of the stack's samples: a sheared grid for each burst, side by side."""
    lon = 10 + 0.05 * (F.col("burst_id") - 7) + 0.01 * F.col("x") - 0.0003 * F.col("y")
    lat = 46 + 0.001 * F.col("y") + 0.0002 * F.col("x")
    return images.groupBy("burst_id", "swath", "y", "x").agg(F.lit(True)).select("burst_id", "swath", "y", "x", lon.alias("lon"), lat.alias("lat"))


@query(f"""WITH {_P}, {_COH_ONCE}, g AS (SELECT b.burst_id, n.r AS row, m.c AS col, (m.c + 0.5) * {_STEP} - 10 - 0.05 * (b.burst_id - 7) AS dx, (n.r + 0.5) * {_STEP} - 46 AS dy
FROM (VALUES (7), (8), (9)) b(burst_id), (SELECT unnest(range(11495, 11520)) AS r) n, (SELECT unnest(range(2490, 2615)) AS c) m),
f AS MATERIALIZED (SELECT burst_id, row, col, (0.001 * dx + 0.0003 * dy) / 1.006e-5 AS fx, (0.01 * dy - 0.0002 * dx) / 1.006e-5 AS fy FROM g),
w AS MATERIALIZED (SELECT burst_id, row, col, CAST(floor(fx) AS BIGINT) AS x, CAST(floor(fy) AS BIGINT) AS y, fx - floor(fx) AS u, fy - floor(fy) AS v FROM f)
SELECT c.burst_id, c.swath, c.pol, c.prm_date, c.sec_date, w.row, w.col, round((1 - u) * (1 - v) * c.coh + u * (1 - v) * k.coh + (1 - u) * v * l.coh + u * v * m.coh, 6) AS coh FROM w JOIN c ON c.burst_id = w.burst_id AND c.y = w.y AND c.x = w.x
JOIN c k ON k.burst_id = c.burst_id AND k.pol = c.pol AND k.prm_date = c.prm_date AND k.y = c.y AND k.x = c.x + 1
JOIN c l ON l.burst_id = c.burst_id AND l.pol = c.pol AND l.prm_date = c.prm_date AND l.y = c.y + 1 AND l.x = c.x
JOIN c m ON m.burst_id = c.burst_id AND m.pol = c.pol AND m.prm_date = c.prm_date AND m.y = c.y + 1 AND m.x = c.x + 1""")
def product_coherence_geocoded(spark, sf_dir):
    """Coherence on an aligned grid in degrees. The SQL turns the sheared grid back by its inverse matrix instead of solving quadrilaterals."""
    images = stack(spark, sf_dir)
    out = workflows.sar_coherence(acquisitions(images), images, _job(images), every_burst=True)
    return rounded(workflows.geocoded(out, geometry(images), _STEP, 4326), "coh")


def _turn(at: str, by: str, sign: int, source: str, group: str) -> str:
    """One direction of a discrete Fourier transform of 16 points, from index `by` to index `at`."""
    c, s = f"cos(pi() * k.n * {by} / 8)", f"{sign} * sin(pi() * k.n * {by} / 8)"
    return f"SELECT {group}, k.n AS {at}, sum(re * {c} - im * {s}) AS re, sum(re * {s} + im * {c}) AS im FROM {source}, k GROUP BY ALL"


_REFERENCE = "0.05 * x - 0.02 * y"
_IMAGE = f"{_B}, prm_date, sec_date"


@query(f"""WITH {_P}, {_COH_ONCE}, i AS (SELECT *, {_REFERENCE} AS ph FROM p), k AS (SELECT unnest(range(0, 16)) AS n),
l AS (SELECT {_IMAGE}, y, x // 4 AS x, avg(re * cos(ph) + im * sin(ph)) AS re, avg(im * cos(ph) - re * sin(ph)) AS im FROM i GROUP BY ALL),
g AS MATERIALIZED (SELECT *, dense_rank() OVER (ORDER BY {_IMAGE}) AS g FROM l),
t AS MATERIALIZED (SELECT g, y // 8 - a.n AS py, x // 8 - b.n AS px, y - 8 * (y // 8 - a.n) AS r, x - 8 * (x // 8 - b.n) AS c, y, x, re, im FROM g, k a, k b WHERE a.n < 2 AND b.n < 2),
f AS ({_turn("h", "c", -1, "t", "g, py, px, r")}), z AS MATERIALIZED ({_turn("w", "r", -1, "f", "g, py, px, h")}),
m AS MATERIALIZED (SELECT g, py, px, (h + a.n - 1 + 16) % 16 AS h, (w + b.n - 1 + 16) % 16 AS w, sum(sqrt(re * re + im * im)) / 9 AS size FROM z, k a, k b WHERE a.n < 3 AND b.n < 3 GROUP BY ALL),
e AS (SELECT g, py, px, h, w, re * sqrt(size / top) AS re, im * sqrt(size / top) AS im FROM z JOIN m USING (g, py, px, h, w) JOIN (SELECT g, py, px, max(size) AS top FROM m GROUP BY ALL) USING (g, py, px) WHERE top > 0),
u AS ({_turn("c", "h", 1, "e", "g, py, px, w")}), o AS ({_turn("r", "w", 1, "u", "g, py, px, c")}),
b AS (SELECT t.g, t.y, t.x, coalesce(o.re, 0) / 256 AS re, coalesce(o.im, 0) / 256 AS im, (1 - abs((r + 0.5) / 8 - 1)) * (1 - abs((c + 0.5) / 8 - 1)) AS q FROM t LEFT JOIN o USING (g, py, px, r, c)),
vv AS (SELECT g, y, x, atan2(sum(im * q) / sum(q), sum(re * q) / sum(q)) AS phase FROM b GROUP BY ALL), n AS (SELECT {_IMAGE}, y, x // 4 AS x, avg(coh) AS coh FROM c GROUP BY ALL)
SELECT {_IMAGE}, y, x, round(phase, 4) + 0.0 AS phase, round(coh, 6) AS coh, true AS wraps FROM vv JOIN g USING (g, y, x) JOIN n USING ({_IMAGE}, y, x)""")
def product_interferogram_chain(spark, sf_dir):
    """The whole chain: reference phase, multilooking, Goldstein's filter, coherence and unwrapping in two dimensions. wraps:
    whether the unwrapped phase wraps to the filtered one."""
    images = stack(spark, sf_dir)
    out = workflows.sar_interferogram(acquisitions(images), images, _job(images), every_burst=True, filtered=True, reference_phase=_REFERENCE, patch=16, tile=(32, 16))
    turns = (F.col("unw_phase") - F.col("phase")) / (2 * F.pi())
    wraps = F.abs(turns - F.round(turns)) < 1e-9
    return rounded(out, "coh").select(*workflows.KEY, "y", "x", (F.round("phase", 4) + F.lit(0.0)).alias("phase"), "coh", wraps.alias("wraps"))


@query(f"""WITH {_P}, l AS MATERIALIZED (SELECT {_IMAGE}, y, x // 4 AS x, atan2(avg(im), avg(re)) AS phase FROM p GROUP BY ALL),
g AS (SELECT b.burst_id, n.r AS row, m.c AS col, (m.c + 0.5) * {_STEP} - 10.015 - 0.05 * (b.burst_id - 7) AS dx, (n.r + 0.5) * {_STEP} - 46.0003 AS dy
FROM (VALUES (7), (8), (9)) b(burst_id), (SELECT unnest(range(11495, 11520)) AS r) n, (SELECT unnest(range(2490, 2615)) AS c) m),
f AS MATERIALIZED (SELECT burst_id, row, col, (0.001 * dx + 0.0003 * dy) / 4.024e-5 AS fx, (0.04 * dy - 0.0008 * dx) / 4.024e-5 AS fy FROM g),
w AS MATERIALIZED (SELECT burst_id, row, col, CAST(floor(fx) AS BIGINT) AS x, CAST(floor(fy) AS BIGINT) AS y, fx - floor(fx) AS u, fy - floor(fy) AS v FROM f),
ss AS (SELECT {", ".join("l." + c for c in _IMAGE.split(", "))}, row, col, count(*) AS n, sum(q * cos(phase)) AS re, sum(q * sin(phase)) AS im FROM (SELECT *, y + a AS gy, x + b AS gx, (CASE a WHEN 1 THEN v ELSE 1 - v END) * (CASE b WHEN 1 THEN u ELSE 1 - u END) AS q FROM w, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) k(a, b)) w
JOIN l ON l.burst_id = w.burst_id AND l.y = w.gy AND l.x = w.gx GROUP BY ALL)
SELECT {_IMAGE}, row, col, round(atan2(im, re), 4) + 0.0 AS phase FROM ss WHERE n = 4""")
def product_phase_geocoded(spark, sf_dir):
    """Multilooked phases on an aligned grid in degrees, interpolated on the circle."""
    images = stack(spark, sf_dir)
    whole = _job(images)
    out = workflows.sar_interferogram(acquisitions(images), images, whole, unwrap=False, every_burst=True).drop("coh")
    placed = workflows.geocoded(out, geometry(images), _STEP, 4326, (whole.n_rg_looks, whole.n_az_looks))
    return placed.withColumn("phase", F.round("phase", 4) + F.lit(0.0))


@query(f"""WITH s AS ({_S}), d AS (SELECT max(date) AS prm FROM s), f AS (SELECT min(date) AS first FROM s, d WHERE date <> prm)
SELECT {_B}, date, CASE WHEN date = prm THEN 'prm' WHEN date = first THEN 'sec_first' ELSE 'sec' END AS role, y, x, round(sqrt(i * i + q * q), 6) AS amplitude FROM s, d, f""")
def product_slc(spark, sf_dir):
    """All images; the last date is the primary."""
    images = stack(spark, sf_dir)
    whole = _job(images)
    out = workflows.sar_slc_preprocessing(acquisitions(images), images, _job(images, primary_date=whole.temporal_extent[1]), every_burst=True)
    return rounded(out.select("burst_id", "swath", "pol", "date", "role", "y", "x", "amplitude"), "amplitude")


_STORED = f"""WITH s AS ({_S}) SELECT burst_id || '_' || swath || '_' || pol || '_' || strftime(date, '%Y%m%d') || '.tif' AS file, band, y, x, round(CAST(CAST(value AS FLOAT) AS DOUBLE), 6) + 0.0 AS value
FROM (UNPIVOT s ON i, q INTO NAME band VALUE value)"""


def _stored(spark, sf_dir) -> str:
    """A folder that holds each image of the stack as a GeoTIFF, in tiles of 16 by 16 cells."""
    path = new_path(spark, "geotiff")
    name = F.concat_ws("_", F.col("burst_id").cast("string"), "swath", "pol", F.date_format("date", "yyyyMMdd"))
    cells = stack(spark, sf_dir).withColumn("file", F.concat(name, F.lit(".tif"))).unpivot(["file", "y", "x"], ["i", "q"], "band", "value")
    geotiff.write_geotiff(cells, path, ["i", "q"], (16, 16))
    return path


@query(_STORED)
def geotiff_round_trip(spark, sf_dir):
    """All images written as GeoTIFFs and read back."""
    return rounded(geotiff.read_geotiff(spark, _stored(spark, sf_dir)).filter("value IS NOT NULL"), "value")


@query(_STORED + " WHERE y BETWEEN 20 AND 40 AND x BETWEEN 5 AND 9 AND band = 'q'")
def geotiff_window(spark, sf_dir):
    """A window of one band of all images; of each file's sixteen tiles the two or so that meet it are read."""
    return rounded(geotiff.read_geotiff(spark, _stored(spark, sf_dir), (20, 5, 40, 9), ["q"]).filter("value IS NOT NULL"), "value")

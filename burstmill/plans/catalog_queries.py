"""Queries over the catalogue, pairs and metadata, with the SQL that gives the same rows.

The driver's tables stand in: events for the burst catalogue (value and the number in props for a position), orders
for the acquisitions of each customer's burst (o_totalprice for the perpendicular baseline).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from burstmill.functions import dates, names
from burstmill.operators import areas, bursts, pairs
from burstmill.sources import rasters, stac

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("abs_id"), F.col("user_id").alias("burst_id"), F.col("event_type").alias("swath"), F.col("ts").alias("start"), "value", "props")


def acquisitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("burst"), F.to_date("o_orderdate").alias("date"), (F.col("o_totalprice") / 1000).alias("perp"))


_ACQ = "SELECT o_orderkey AS k, o_custkey AS burst, CAST(o_orderdate AS DATE) AS date, o_totalprice / 1000 AS perp FROM orders"


@query("""SELECT event_id AS abs_id, user_id AS burst_id, event_type AS swath, ts AS start FROM events
WHERE ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts <= TIMESTAMP '2024-01-20 23:59:59' AND event_type = 'click' AND user_id = 17""")
def catalog_filter(spark, sf_dir):
    c = catalogue(spark, sf_dir).filter(F.col("swath") == "click")
    return bursts.matching(c, "2024-01-05", "2024-01-20", burst_id=17).select("abs_id", "burst_id", "swath", "start")


@query("""SELECT event_id AS abs_id, value AS lon, CAST(props->>'k' AS INT) AS lat FROM events
WHERE value + 5 >= 20 AND value - 5 <= 60 AND CAST(props->>'k' AS INT) + 2 >= 10 AND CAST(props->>'k' AS INT) - 2 <= 40""")
def catalog_bbox_intersects(spark, sf_dir):
    from burstmill.functions.geometry import boxes_meet

    lat = F.get_json_object("props", "$.k").cast("int")
    c = catalogue(spark, sf_dir).select("abs_id", F.col("value").alias("lon"), lat.alias("lat"))
    box = F.struct((F.col("lon") - 5).alias("west"), (F.col("lat") - 2).alias("south"), (F.col("lon") + 5).alias("east"), (F.col("lat") + 2).alias("north"))
    return c.withColumn("b", box).filter(boxes_meet(F.col("b"), 20, 10, 60, 40)).drop("b")


@query("""SELECT event_id AS abs_id, user_id AS burst_id, (SELECT min_by(event_type, event_id) FROM events WHERE user_id = (SELECT min(user_id) FROM events)) AS first_swath
FROM events WHERE user_id = (SELECT min(user_id) FROM events)""")
def lowest_burst_select(spark, sf_dir):
    found = bursts.lowest_burst(catalogue(spark, sf_dir))
    return found.crossJoin(F.broadcast(bursts.first_swath(found))).select("abs_id", "burst_id", "first_swath")


@query("SELECT event_id AS abs_id, ts AS start FROM events ORDER BY ts, event_id LIMIT 1000")
def catalog_top_guard(spark, sf_dir):
    return bursts.guarded(catalogue(spark, sf_dir), ["start", "abs_id"], fail=False).select("abs_id", "start")


@query(f"""WITH a AS ({_ACQ}) SELECT p.burst, p.date AS prm_date, q.date AS sec_date FROM a p JOIN a q ON p.burst = q.burst AND q.date = p.date + 12""")
def temporal_baseline_pairs(spark, sf_dir):
    return pairs.offset_pairs(acquisitions(spark, sf_dir), 12, by=("burst",))


@query("""WITH a AS (SELECT user_id AS burst, CAST(ts AS DATE) AS d, max_by('event/' || event_id, event_id) AS path FROM events GROUP BY 1, 2)
SELECT p.burst, p.d AS prm_date, q.d AS sec_date, p.path AS prm_path, q.path AS sec_path FROM a p JOIN a q ON p.burst = q.burst AND q.d = p.d + 12""")
def temporal_baseline_pairs_dedup(spark, sf_dir):
    c = catalogue(spark, sf_dir).withColumnRenamed("burst_id", "burst").withColumn("path", F.concat(F.lit("event/"), "abs_id"))
    return pairs.offset_pairs_of_paths(c, 12, "start", "path", "abs_id", ("burst",))


@query("""WITH a AS (SELECT DISTINCT user_id AS burst, CAST(ts AS DATE) AS d FROM events)
SELECT burst, d AS prm_date FROM a p WHERE NOT EXISTS (SELECT 1 FROM a q WHERE q.burst = p.burst AND q.d = p.d + 12)""")
def pair_missing_partner(spark, sf_dir):
    return pairs.unpaired(catalogue(spark, sf_dir).select(F.col("burst_id").alias("burst"), F.col("start").alias("date")), 12, by=("burst",))


@query("""WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_orderpriority = '1-URGENT' AND CAST(o_orderdate AS DATE) < DATE '1996-01-01'),
b AS (SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) AS s FROM lineitem)
SELECT l_orderkey, l_linenumber FROM b WHERE s IN (SELECT day FROM d) OR s + 1 IN (SELECT day FROM d)""")
def pair_date_semi_join(spark, sf_dir):
    o = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT' AND o_orderdate < '1996-01-01'")
    found = o.select(F.to_date("o_orderdate").alias("prm_date"), F.to_date("o_orderdate").alias("sec_date"))
    b = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_shipdate").alias("begin"), F.date_add(F.to_date("l_shipdate"), 1).alias("end"))
    return pairs.in_any_pair(b, found, "begin", "end").select("l_orderkey", "l_linenumber")


@query(f"""WITH a AS ({_ACQ}), p AS (SELECT p.burst, p.date AS prm_date FROM a p JOIN a q ON p.burst = q.burst AND q.date > p.date AND q.date <= p.date + 60)
SELECT burst, prm_date, count(*) AS n FROM p GROUP BY 1, 2 HAVING count(*) > 1""")
def pair_duplicate_primary(spark, sf_dir):
    found = pairs.small_baseline_pairs(acquisitions(spark, sf_dir), 60, 1e12, by=("burst",))
    return pairs.repeated_primaries(found, ("burst",))


@query(f"""WITH a AS ({_ACQ}), p AS (SELECT p.date AS x, q.date AS y FROM a p JOIN a q ON p.burst = q.burst AND q.date = p.date + 12)
SELECT min(least(x, y)) AS first_date, max(greatest(x, y)) AS last_date FROM p""")
def pair_extent(spark, sf_dir):
    return pairs.extent(temporal_baseline_pairs(spark, sf_dir))


@query(f"""WITH a AS ({_ACQ}) SELECT p.burst, p.date AS master_date, q.date AS slave_date, round(q.perp - p.perp, 6) AS perp_baseline, CAST(p.date - q.date AS INT) AS temp_baseline
FROM a p JOIN a q ON p.burst = q.burst""")
def all_pairs_baseline(spark, sf_dir):
    found = pairs.baselines(acquisitions(spark, sf_dir), ("burst",))
    return found.withColumn("perp_baseline", F.round("perp_baseline", 6))


@query(f"""WITH a AS ({_ACQ}) SELECT p.burst, p.date AS prm_date, q.date AS sec_date, round(q.perp - p.perp, 6) AS perp_baseline
FROM a p JOIN a q ON p.burst = q.burst AND q.date - p.date BETWEEN 1 AND 90 AND abs(q.perp - p.perp) <= 150""")
def sbas_pairs(spark, sf_dir):
    return pairs.small_baseline_pairs(acquisitions(spark, sf_dir), 90, 150, by=("burst",)).withColumn("perp_baseline", F.round("perp_baseline", 6))


@query(f"""WITH a AS ({_ACQ}) SELECT p.burst, p.date AS prm_date, q.date AS sec_date, round(q.perp - p.perp, 6) AS perp_baseline
FROM a p JOIN a q ON p.burst = q.burst AND abs(q.date - p.date) <= 90 AND abs(q.perp - p.perp) <= 150""")
def sbas_pairs_symmetric(spark, sf_dir):
    return pairs.small_baseline_pairs_symmetric(acquisitions(spark, sf_dir), 90, 150, by=("burst",)).withColumn("perp_baseline", F.round("perp_baseline", 6))


@query(f"""WITH a AS ({_ACQ}), r AS (SELECT burst, min_by(date, k) AS rd, min_by(perp, k) AS rp FROM a GROUP BY 1)
SELECT a.burst, rd AS prm_date, date AS sec_date, round(perp - rp, 6) AS perp_baseline FROM a JOIN r ON a.burst = r.burst WHERE rd <> date""")
def ps_pairs(spark, sf_dir):
    a = acquisitions(spark, sf_dir)
    reference = a.groupBy("burst").agg(F.min_by("date", "k").alias("ref_date"), F.min_by("perp", "k").alias("ref_perp"))
    return pairs.reference_pairs(a, reference, ("burst",)).withColumn("perp_baseline", F.round("perp_baseline", 6))


@query(f"""WITH a AS ({_ACQ}), s AS (SELECT p.burst, p.date AS md, round(sum(greatest(1 - abs(q.perp - p.perp) / 500, 0) * greatest(1 - abs(p.date - q.date) / 1500.0, 0)), 6) AS score
FROM a p JOIN a q ON p.burst = q.burst GROUP BY 1, 2), w AS (SELECT *, row_number() OVER (PARTITION BY burst ORDER BY score DESC, md) AS r FROM s)
SELECT burst, md AS ref_date, score FROM w WHERE r = 1""")
def optimal_reference(spark, sf_dir):
    return pairs.optimal_reference(acquisitions(spark, sf_dir), ("burst",), 500, 1500)


@query("""WITH d AS (SELECT DISTINCT CAST(ts AS DATE) AS d, event_type AS track FROM events)
SELECT CAST(year(d) AS INT) AS year, CAST(month(d) AS INT) AS month, CAST(day(d) AS INT) AS day, string_agg(track, ',' ORDER BY track) AS tracks, max(track) AS last_track FROM d GROUP BY 1, 2, 3""")
def acquisition_calendar(spark, sf_dir):
    days = bursts.calendar(catalogue(spark, sf_dir), "swath")
    return days.select("year", "month", "day", F.array_join("tracks", ",").alias("tracks"), F.element_at("tracks", -1).alias("last_track"))


@query("SELECT user_id AS burst_id, min_by(event_type, event_id) AS track, min(event_id) AS first_id FROM events GROUP BY 1")
def track_burst_tree(spark, sf_dir):
    c = catalogue(spark, sf_dir).withColumnRenamed("swath", "track").withColumn("first_id", F.col("abs_id"))
    return bursts.first_per_label(c, "burst_id", "abs_id", "track", "first_id")


@query("SELECT event_id AS abs_id, CAST(user_id - min(user_id) OVER (PARTITION BY event_type, CAST(ts AS DATE)) + 1 AS BIGINT) AS split FROM events")
def tops_split_number(spark, sf_dir):
    c = catalogue(spark, sf_dir).withColumn("day", F.to_date("start"))
    return bursts.with_split_number(c, ["swath", "day"]).select("abs_id", "split")


@query("""SELECT event_id AS abs_id, ts AS start FROM events WHERE ts >= TIMESTAMP '2024-01-10 00:00:00' AND ts <= TIMESTAMP '2024-01-12 23:59:59'
UNION ALL SELECT event_id, ts FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-20'""")
def primary_outside_extent_union(spark, sf_dir):
    c = catalogue(spark, sf_dir).select("abs_id", "start")
    return bursts.with_outside_primary(bursts.matching(c, "2024-01-10", "2024-01-12"), c, "2024-01-20", "2024-01-10", "2024-01-12")


@query("""WITH a AS (SELECT event_id AS abs_id, CAST(ts AS DATE) AS date FROM events)
SELECT abs_id, date, CASE WHEN date = (SELECT max(date) FROM a) THEN 'prm' WHEN date = (SELECT min(date) FROM a WHERE date <> (SELECT max(date) FROM a)) THEN 'sec_first' ELSE 'sec' END AS role FROM a""")
def primary_secondary_split(spark, sf_dir):
    c = catalogue(spark, sf_dir).select("abs_id", F.to_date("start").alias("date"))
    primary = c.agg(F.max("date").cast("string").alias("d")).first()["d"]
    return bursts.primary_and_secondaries(c, primary or "1970-01-01") if primary else c.withColumn("role", F.lit(None).cast("string"))


_TAGS = """SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'i_IW' || (1 + event_id % 3) || '_VV_mst_' || strftime(ts, '%d%b%Y')
WHEN 1 THEN 'coh_IW2_VH_' || strftime(ts, '%d%b%Y') || '_' || strftime(ts + INTERVAL 12 DAY, '%d%b%Y') WHEN 2 THEN 'Unw_Phase_ifg_' || strftime(ts, '%d%b%Y')
WHEN 3 THEN 'q_IW1_HH_slv1_' || strftime(ts, '%d%b%Y') WHEN 4 THEN 'i_IW3_HV_mst' ELSE 'lat_band' END AS tag FROM events"""


@query(f"""WITH t AS ({_TAGS}), k AS (SELECT event_id, tag, string_split(tag, '_') AS w FROM t)
SELECT event_id, tag, CASE event_id % 6 WHEN 0 THEN w[1] || '_' || w[3] WHEN 1 THEN w[1] || '_' || w[3] WHEN 2 THEN w[1] || '_' || w[2] || '_' || w[3] WHEN 3 THEN w[1] || '_' || w[3] WHEN 4 THEN tag ELSE 'grid_' || w[1] END AS band FROM k""")
def band_name_normalise(spark, sf_dir):
    """The SQL says by hand what each kind of name becomes: a sub-swath goes with the date that ends the name, not without one."""
    e = table(spark, sf_dir, "events")
    d, later = dates.band_date(F.col("ts")), dates.band_date(F.col("ts") + F.expr("INTERVAL 12 DAYS"))
    kind = F.col("event_id") % 6
    tag = (
        F.when(kind == 0, F.concat(F.lit("i_IW"), (1 + F.col("event_id") % 3).cast("string"), F.lit("_VV_mst_"), d))
        .when(kind == 1, F.concat(F.lit("coh_IW2_VH_"), d, F.lit("_"), later))
        .when(kind == 2, F.concat(F.lit("Unw_Phase_ifg_"), d))
        .when(kind == 3, F.concat(F.lit("q_IW1_HH_slv1_"), d))
        .when(kind == 4, F.lit("i_IW3_HV_mst"))
        .otherwise("lat_band")
    )
    return e.select("event_id", tag.alias("tag")).withColumn("band", names.band_name(F.col("tag")))


@query("""WITH f AS (SELECT event_id, 'S1_coh_2images_' || strftime(ts, '%Y%m%dT%H%M%S') || '_' || strftime(ts + INTERVAL 12 DAY, '%Y%m%dT%H%M%S') || '.tif' AS file FROM events)
SELECT event_id, file, regexp_extract(file, '([0-9]{8}T[0-9]{6})_([0-9]{8}T[0-9]{6})', 1) AS date1, CAST(strptime(regexp_extract(file, '([0-9]{8}T[0-9]{6})_([0-9]{8}T[0-9]{6})', 2), '%Y%m%dT%H%M%S') AS DATE) AS date2 FROM f""")
def filename_dates(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    file = names.coherence_file(F.col("ts"), F.col("ts") + F.expr("INTERVAL 12 DAYS"))
    f = e.select("event_id", file.alias("file"))
    first, second = names.file_times(F.col("file"), "coherence")
    return f.select("event_id", "file", first.alias("date1"), F.to_date(dates.parse_date(second)).alias("date2"))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y%m%d') WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ')
ELSE strftime(o_orderdate, '%Y%m%dT%H%M%S') END AS txt, CAST(o_orderdate AS TIMESTAMP) AS parsed, strftime(o_orderdate, '%d%b%Y') AS band FROM orders""")
def parse_date_formats(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    shapes = ["yyyy-MM-dd", "yyyyMMdd", "yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyyMMdd'T'HHmmss"]
    txt = F.coalesce(*(F.when(F.col("o_orderkey") % 4 == k, F.date_format("o_orderdate", s)) for k, s in enumerate(shapes)))
    o = o.select("o_orderkey", txt.alias("txt"))
    return o.withColumn("parsed", dates.parse_date(F.col("txt"))).withColumn("band", dates.band_date(F.col("parsed")))


_FILES = """SELECT event_id AS ordinal, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS date1, strftime(ts + INTERVAL 12 DAY, '%Y-%m-%dT%H:%M:%SZ') AS date2, value AS west, CAST(props->>'k' AS INT) AS south, value + 2 AS east,
CAST(props->>'k' AS INT) + 1 AS north, event_type AS band, CASE WHEN user_id % 2 = 0 THEN 32632 ELSE 32633 END AS epsg, user_id FROM events"""


def _files(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    later = F.col("ts") + F.expr("INTERVAL 12 DAYS")
    epsg = F.when(F.col("user_id") % 2 == 0, 32632).otherwise(32633)
    return e.select(
        F.col("event_id").alias("ordinal"), dates.iso_z(F.col("ts")).alias("date1"), dates.iso_z(later).alias("date2"), F.col("value").alias("west"), k.alias("south"), (F.col("value") + 2).alias("east"), (k + 1).alias("north"),
        F.col("event_type").alias("band"), epsg.alias("epsg"), "user_id",
    )


@query(f"""WITH f AS ({_FILES}) SELECT min(least(date1, date2)) AS start, max(greatest(date1, date2)) AS "end", min(west) AS west, min(south) AS south, max(east) AS east, max(north) AS north FROM f""")
def stac_extent(spark, sf_dir):
    return stac.extent(_files(spark, sf_dir))


@query(f"""WITH f AS ({_FILES}) SELECT band, min(ordinal) AS first FROM f GROUP BY 1""")
def stac_bands(spark, sf_dir):
    return stac.bands_in_order(_files(spark, sf_dir))


@query(f"""WITH f AS ({_FILES}) SELECT count(DISTINCT epsg) AS n_crs, CASE WHEN count(DISTINCT epsg) = 1 THEN min(epsg) END AS epsg FROM f""")
def stac_crs_singleton(spark, sf_dir):
    return stac.single_crs(_files(spark, sf_dir))


@query("""WITH f AS (SELECT o_orderkey, 'S1_' || o_orderkey || '.tif' AS n, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS d1, strftime(o_orderdate + INTERVAL 12 DAY, '%Y-%m-%dT%H:%M:%SZ') AS d2, o_orderkey % 90 AS x, o_custkey % 45 AS y FROM orders)
SELECT o_orderkey, '{"type":"Feature","stac_version":"1.0.0","id":"' || n || '","geometry":{"type":"Polygon","coordinates":[[[' || x || ',' || y || '],[' || (x + 1) || ',' || y || '],[' || (x + 1) || ',' || (y + 1) || '],[' || x || ',' || (y + 1) || '],[' || x || ',' || y
|| ']]]},"bbox":[' || x || ',' || y || ',' || (x + 1) || ',' || (y + 1) || '],"properties":{"datetime":"' || d1 || '","sar:datetime_secondary":"' || d2 || '"},"links":[],"assets":{"' || n || '":{"href":"' || n || '"}}}' AS item FROM f""")
def stac_item_json(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    x, y = F.col("o_orderkey") % 90, F.col("o_custkey") % 45
    name = F.concat(F.lit("S1_"), F.col("o_orderkey").cast("string"), F.lit(".tif"))
    later = F.col("o_orderdate") + F.expr("INTERVAL 12 DAYS")
    return o.select("o_orderkey", stac.item(name, dates.iso_z(F.col("o_orderdate")), dates.iso_z(later), [x, y, x + 1, y + 1]).alias("item"))


def _documented(spark, sf_dir) -> DataFrame:
    """Files of whole-number boxes with one band each; an item holds four."""
    e = table(spark, sf_dir, "events")
    k, u = F.col("event_id"), F.col("user_id")
    return e.select(
        k.alias("ordinal"), F.concat(F.lit("S1_"), dates.file_time(F.col("ts")).substr(1, 8)).alias("day"), F.concat(F.lit("S1_"), F.floor(k / 4).cast("string")).alias("id"), F.concat(k.cast("string"), F.lit(".tif")).alias("file"),
        dates.iso_z(F.col("ts")).alias("date1"), dates.iso_z(F.col("ts") + F.expr("INTERVAL 12 DAYS")).alias("date2"), (k % 90).alias("west"), (u % 45).alias("south"), (k % 90 + 1).alias("east"), (u % 45 + 1).alias("north"),
        (300000 + 20 * (k % 1000)).alias("x0"), (5000000 + 20 * (u % 500)).alias("y0"), (302000 + 20 * (k % 1000)).alias("x1"), (5001000 + 20 * (u % 500)).alias("y1"),
        F.col("event_type").alias("band"), F.array("event_type").alias("bands"), F.array((100 + k % 7).cast("int"), F.lit(200)).alias("shape"), F.lit(32632).alias("epsg"),
    )


_DOCUMENTED = """SELECT event_id AS k, 'S1_' || (event_id // 4) AS id, strftime(ts, '%Y%m%d') AS day, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS d1, strftime(ts + INTERVAL 12 DAY, '%Y-%m-%dT%H:%M:%SZ') AS d2, event_id % 90 AS w, user_id % 45 AS s,
300000 + 20 * (event_id % 1000) AS x, 5000000 + 20 * (user_id % 500) AS y, event_type AS band FROM events"""


@query(f"""WITH f AS ({_DOCUMENTED}), g AS (SELECT id, arg_min(d1, k) AS d1, arg_max(d2, k) AS d2, arg_max(w, k) AS w, arg_max(s, k) AS s,
string_agg('"' || k || '.tif":{{"href":"./' || k || '.tif","eo:bands":[{{"name":"' || band || '"}}],"proj:shape":[' || (100 + k % 7) || ',200]}}', ',' ORDER BY k || '.tif') AS files FROM f GROUP BY 1)
SELECT id, '{{"type":"Feature","stac_version":"1.0.0","id":"' || id || '","geometry":{{"type":"Polygon","coordinates":[[[' || w || ',' || s || '],[' || (w + 1) || ',' || s || '],[' || (w + 1) || ',' || (s + 1) || '],[' || w || ',' || (s + 1) || '],[' || w || ',' || s
|| ']]]}},"bbox":[' || w || ',' || s || ',' || (w + 1) || ',' || (s + 1) || '],"properties":{{"datetime":"' || d1 || '","sar:datetime_secondary":"' || d2 || '"}},"links":[],"assets":{{' || files || '}}}}' AS item FROM g""")
def stac_item_documents(spark, sf_dir):
    return stac.item_documents(_documented(spark, sf_dir))


@query(f"""WITH f AS ({_DOCUMENTED}), b AS (SELECT band, min(k) AS first FROM f GROUP BY 1), l AS (SELECT DISTINCT day FROM f), x AS (SELECT min(d1) AS start, max(d2) AS stop, min(w) AS w, min(s) AS s, max(w) + 1 AS e, max(s) + 1 AS n, min(x) AS x0, max(x) + 2000 AS x1, min(y) AS y0, max(y) + 1000 AS y1 FROM f)
SELECT '{{"type":"Collection","stac_version":"1.0.0","id":"S1_collection","description":"Radar products by pair and date","license":"unknown","stac_extensions":["https://stac-extensions.github.io/datacube/v2.2.0/schema.json"],"cube:dimensions":{{"x":{{"axis":"x","type":"spatial","extent":['
|| x0 || ',' || x1 || '],"reference_system":32632}},"y":{{"axis":"y","type":"spatial","extent":[' || y0 || ',' || y1 || '],"reference_system":32632}},"t":{{"type":"temporal","extent":["' || start || '","' || stop || '"]}},"bands":{{"type":"bands","values":['
|| (SELECT string_agg('"' || band || '"', ',' ORDER BY first) FROM b) || ']}}}},"links":[' || (SELECT string_agg('{{"href":"./S1_' || day || '.json","rel":"item","type":"application/geo+json"}}', ',' ORDER BY day) FROM l)
|| '],"extent":{{"spatial":{{"bbox":[[' || w || ',' || s || ',' || e || ',' || n || ']]}},"temporal":{{"interval":[["' || start || '","' || stop || '"]]}}}},"proj:epsg":32632}}' AS value FROM x""")
def stac_collection_json(spark, sf_dir):
    """One item a day."""
    return stac.collection(_documented(spark, sf_dir).withColumn("id", F.col("day")), "S1_collection.json")


@query("""WITH e AS (SELECT event_id, event_id % 7 AS kind, 1 + event_id % 3 AS swath, CASE WHEN user_id % 2 = 0 THEN 'vv' ELSE 'vh' END AS pol FROM events)
SELECT event_id, CASE WHEN kind = 0 THEN event_id || '/manifest.safe' ELSE event_id || '/s1a-iw' || swath || '-slc-' || pol || '.xml' END AS key FROM e WHERE kind = 0 OR (swath = 2 AND pol = 'vv')""")
def metadata_files(spark, sf_dir):
    """The files of sub-swath IW2 in VV, and all manifests."""
    e = table(spark, sf_dir, "events")
    k = F.col("event_id").cast("string")
    own = F.concat(k, F.lit("/s1a-iw"), (1 + F.col("event_id") % 3).cast("string"), F.lit("-slc-"), F.when(F.col("user_id") % 2 == 0, "vv").otherwise("vh"), F.lit(".xml"))
    files = e.select("event_id", F.when(F.col("event_id") % 7 == 0, F.concat(k, F.lit("/manifest.safe"))).otherwise(own).alias("key"))
    return bursts.metadata_files(files, "IW2", "vv")


@query("""WITH d AS (SELECT DISTINCT CAST(ts AS DATE) AS date FROM events), p AS (SELECT min(date) AS prm FROM d)
SELECT date, CASE WHEN date = prm THEN 'prm_vv_i,prm_vv_q,prm_vh_i,prm_vh_q,prm_vh_grid_lat,prm_vh_grid_lon' ELSE 'sec_vv_i,sec_vv_q,sec_vh_i,sec_vh_q,prm_vh_grid_lat,prm_vh_grid_lon' END AS files FROM d, p""")
def slc_files_by_date(spark, sf_dir):
    """The first day is the primary; it alone has grids, in both polarizations."""
    days = table(spark, sf_dir, "events").select(F.to_date("ts").alias("date")).distinct()
    primary = str(days.agg(F.min("date")).first()[0])
    names_of = lambda role, bands: [f"{role}_{p}_{b}" for p in ("vv", "vh") for b in bands]
    listed = F.when(F.col("date") == primary, F.array(*map(F.lit, names_of("prm", ("i", "q", "grid_lat", "grid_lon"))))).otherwise(F.array(*map(F.lit, names_of("sec", ("i", "q")))))
    files = days.select("date", F.posexplode(listed).alias("ordinal", "file"))
    return rasters.files_by_date(files, primary, ["VV", "VH"]).withColumn("files", F.array_join("files", ","))


@query(f"""WITH t AS ({_TAGS}) SELECT event_id, CASE WHEN starts_with(tag, 'Phase') THEN 'wrapped' WHEN starts_with(tag, 'Unw') THEN 'unwrapped' WHEN starts_with(tag, 'coh') THEN 'coherence' WHEN starts_with(tag, 'elevation') THEN 'elevation' END AS kind FROM t""")
def band_routing(spark, sf_dir):
    return band_name_normalise(spark, sf_dir).select("event_id", names.band_kind(F.col("tag")).alias("kind"))


@query("""WITH d AS (SELECT DISTINCT CAST(ts AS DATE) AS d FROM events), p AS (SELECT a.d AS x, b.d AS y FROM d a JOIN d b ON b.d = a.d + 12)
SELECT '{"InSAR_pairs":[' || coalesce(string_agg('["' || x || '","' || y || '"]', ',' ORDER BY x), '') || '],"sub_swath_id":"IW2"}' AS value FROM p""")
def pair_document(spark, sf_dir):
    from burstmill.plans.workflows import pair_document as document

    # days first: the pairs of a document are those of its dates, not of each image
    c = catalogue(spark, sf_dir).select(F.to_date("start").alias("start")).distinct()
    return document(pairs.offset_pairs(c, 12, "start").distinct(), "IW2")


@query("""WITH f AS (SELECT event_id, value AS west, value + 0.625 AS east, CAST(props->>'k' AS INT) AS south, CAST(props->>'k' AS INT) + 0.375 AS north FROM events),
a AS (SELECT p_partkey, p_size * 2 - 5.0 AS ax, p_partkey % 101 - 0.25 AS ay, p_size * 2 - 2.0 AS bx, p_partkey % 101 + 0.5 AS by_, p_size * 2 - 4.5 AS cx, p_partkey % 101 + 2.75 AS cy FROM part),
e AS (SELECT p_partkey, unnest([[ax, ay, bx, by_], [bx, by_, cx, cy], [cx, cy, ax, ay]]) AS t FROM a),
n AS (SELECT event_id, f.west, f.east, f.south, f.north, a.* FROM f JOIN a ON f.west <= greatest(ax, bx, cx) AND f.east >= least(ax, bx, cx) AND f.south <= greatest(ay, by_, cy) AND f.north >= least(ay, by_, cy)),
s AS (SELECT event_id, p_partkey, bool_and((t[3] - t[1]) * (y - t[2]) - (t[4] - t[2]) * (x - t[1]) < 0) OVER (PARTITION BY event_id, p_partkey, k) AS beyond
FROM (SELECT n.event_id, n.p_partkey, e.t, [e.t[1], e.t[3]] AS k, unnest([west, east, east, west]) AS x, unnest([south, south, north, north]) AS y FROM n JOIN e ON e.p_partkey = n.p_partkey))
SELECT event_id, p_partkey FROM s GROUP BY 1, 2 HAVING NOT bool_or(beyond)""")
def areas_meet_footprints(spark, sf_dir):
    """Triangles against the catalogue's footprints, with steps that doubles hold exactly. The SQL uses that both are convex: they meet unless a side of one parts them."""
    ring = lambda *points: F.array(*(F.array(x.cast("double"), y.cast("double")) for x, y in (*points, points[0])))
    x, y = F.col("value"), F.get_json_object("props", "$.k").cast("int")
    footprints = catalogue(spark, sf_dir).select("abs_id", ring((x, y), (x + 0.625, y), (x + 0.625, y + 0.375), (x, y + 0.375)).alias("ring"))
    u, v = F.col("p_size") * 2, F.col("p_partkey") % 101
    wanted = table(spark, sf_dir, "part").select("p_partkey", ring((u - 5, v - 0.25), (u - 2, v + 0.5), (u - 4.5, v + 2.75)).alias("ring"))
    return areas.meeting(footprints, wanted).select(F.col("a.abs_id").alias("event_id"), "b.p_partkey")


@query("""SELECT l_orderkey % 500 AS product, l_partkey AS burst, l_shipdate AS start, l_linenumber AS k FROM lineitem WHERE l_orderkey % 500 = 123""")
def catalog_by_product(spark, sf_dir):
    """The bursts of one product in the order of their start, whatever else they are."""
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 500).cast("string").alias("product"), F.col("l_partkey").alias("burst"), F.col("l_shipdate").alias("start"), F.col("l_linenumber").alias("k"))
    return bursts.of_product(rows, "123").select(F.col("product").cast("long").alias("product"), "burst", "start", "k")


@query("""WITH d AS (SELECT DISTINCT CAST(ts AS DATE) AS d FROM events), p AS (SELECT a.d AS x, b.d AS y FROM d a JOIN d b ON b.d = a.d + 12)
SELECT '{"burst_id": 7, "sub_swath": "iw2", "temporal_baseline": 12, "InSAR_pairs":[' || coalesce(string_agg('["' || x || '","' || y || '"]', ',' ORDER BY x), '') || '],"sub_swath_id":"IW2"}' AS value FROM p""")
def pair_document_of_job(spark, sf_dir):
    """The document of a job with the pairs found for it: its own keys stay as they were given."""
    from burstmill.plans.workflows import pair_document as document

    given = {"burst_id": 7, "sub_swath": "iw2", "temporal_baseline": 12}
    c = catalogue(spark, sf_dir).select(F.to_date("start").alias("start")).distinct()
    return document(pairs.offset_pairs(c, given["temporal_baseline"], "start").distinct(), "IW2", given)


@query("""WITH d AS (SELECT DISTINCT CAST(ts AS DATE) AS d, event_type AS track FROM events), m AS (SELECT year(d) AS y, month(d) AS m, day(d) AS day, max(track) AS track FROM d GROUP BY 1, 2, 3)
SELECT CAST(y AS INT) AS year, CAST(m AS INT) AS month, string_agg(day || '=' || track, ',' ORDER BY day) AS days FROM m GROUP BY 1, 2""")
def calendar_month_maps(spark, sf_dir):
    m = bursts.month_maps(bursts.calendar(catalogue(spark, sf_dir), "swath"))
    return m.select("year", "month", F.array_join(F.transform(F.map_entries("last_track_of"), lambda e: F.concat(e["key"].cast("string"), F.lit("="), e["value"])), ",").alias("days"))


@query("SELECT user_id % 3 AS grp, bool_and(event_type = 'click') AS all_finished FROM events WHERE ts > TIMESTAMP '2024-01-29 00:00:00' GROUP BY 1")
def jobs_finished(spark, sf_dir):
    from burstmill.sources.catalog import jobs_after

    jobs = table(spark, sf_dir, "events").select((F.col("user_id") % 3).alias("grp"), F.col("ts").alias("created"), F.when(F.col("event_type") == "click", "finished").otherwise("running").alias("status"))
    return jobs_after(jobs, "2024-01-29 00:00:00").groupBy("grp").agg(F.bool_and(F.col("status") == "finished").alias("all_finished"))

import base64
import datetime as dt
import json

import numpy as np
import pytest
from burstmill.plans import workflows
from burstmill.sources import catalog, parameters, rasters, stac
from burstmill.streaming import pairs as stream
from pyspark.sql import functions as F


def test_job_rules():
    j = parameters.job({"burst_id": 1, "polarization": "vv", "coherence_window_rg": 5, "n_rg_looks": 2, "n_az_looks": 3, "primary_date": None, "burst_id_DISABLED": 7})
    assert j.polarization == ["VV"] and (j.coherence_window_rg, j.coherence_window_az) == (10, 2) and (j.n_rg_looks, j.n_az_looks) == (2, 3)
    assert parameters.job({"burst_id": 1, "master_date": "2024-01-01", "InSAR_pairs": ["a", "b"]}).InSAR_pairs == [["a", "b"]]
    assert parameters.job({"burst_id": 1}, polarization=["VV", "VH"]).polarization == ["VV", "VH"]
    for wrong in ({"burst_id": 1, "polarization": "HH"}, {"polarization": "VV"}, {"burst_id": 1, "sub_swath": "IW9"}):
        with pytest.raises(ValueError):
            parameters.job(wrong)


def test_job_from_base64_and_file(tmp_path, spark):
    doc = {"burst_id": 249435, "polarization": ["vv", "vh"], "temporal_extent": ["2024-08-09", "2024-09-02"]}
    text = base64.b64encode(json.dumps(doc).encode()).decode()
    (tmp_path / "job.json").write_text(json.dumps(doc))
    assert parameters.read_job(text) == parameters.read_job(str(tmp_path / "job.json"))
    one = base64.b64encode(b'{"burst_id": 5, "polarization": "vv"}').decode()
    rows = spark.createDataFrame([(text,), (one,)], "t string").select(parameters.document(F.col("t")).alias("d")).select("d.burst_id", "d.polarization").collect()
    assert [tuple(r) for r in rows] == [(249435, ["vv", "vh"]), (5, ["vv"])]


def world(spark):
    """Four acquisitions of burst 10, 12 days apart, on a grid of 12 x 8 samples."""
    days = [dt.date(2024, 1, 1) + dt.timedelta(12 * k) for k in range(4)]
    rows = [(k, 10, "IW2", pol, 95, f"P{k}", "/p", dt.datetime.combine(d, dt.time(5))) for k, d in enumerate(days) for pol in ("VV", "VH")]
    cat = spark.createDataFrame(rows, "abs_id long, burst_id long, swath string, pol string, track int, product string, path string, start timestamp_ntz")
    cat = cat.withColumn("footprint", F.expr("array(array(array(10D,46D), array(11D,46D), array(11D,47D), array(10D,47D), array(10D,46D)))"))
    rng = np.random.default_rng(8)
    cells = [(10, "IW2", pol, d, y, x, *(float(v) for v in rng.normal(size=2))) for d in days for pol in ("VV", "VH") for y in range(8) for x in range(12)]
    return cat, spark.createDataFrame(cells, rasters.SLC), days


def test_products(spark, tmp_path):
    cat, slc, days = world(spark)
    vv = slc.filter("pol = 'VV'")
    job = parameters.job({"burst_id": 10, "polarization": "vv", "temporal_extent": ["2024-01-01", "2024-02-28"], "temporal_baseline": 12, "coherence_window_rg": 3, "coherence_window_az": 3})
    coh = workflows.sar_coherence(cat, vv, job)
    assert coh.count() == 3 * 96 and coh.filter("coh < 0 OR coh > 1.000001").isEmpty()
    path = f"file://{tmp_path}/coh"
    todo = workflows.job_pairs(cat, job)
    assert rasters.pairs_to_do(todo, path).count() == 3
    rasters.write_product(coh.filter(F.col("prm_date") == days[0]), path)
    assert sorted(r.prm_date for r in rasters.pairs_to_do(todo, path).collect()) == days[1:3]
    own = parameters.job({"burst_id": 10, "InSAR_pairs": [["2024-01-01", "20240113"]], "temporal_extent": ["2024-01-01", "2024-02-28"]})
    ifg = workflows.sar_interferogram(cat, vv, own)
    assert ifg.columns == [*workflows.BURST, "prm_date", "sec_date", "y", "x", "phase", "unw_phase", "coh"] and ifg.count() == 8 * 3
    doc = json.loads(workflows.pair_document(todo, "IW2").first()["value"])
    assert doc["InSAR_pairs"][0] == ["2024-01-01", "2024-01-13"] and doc["sub_swath_id"] == "IW2"
    given = {"burst_id": 10, "sub_swath": "iw2", "temporal_extent": ["2024-01-01", "2024-02-28"], "note": "é", "InSAR_pairs": []}
    kept = json.loads(workflows.pair_document(todo, "IW2", given).first()["value"])
    assert kept == {**given, "InSAR_pairs": doc["InSAR_pairs"], "sub_swath_id": "IW2"}  # as given: nothing dropped, no defaults
    twice = parameters.job({"burst_id": 10, "InSAR_pairs": [["2024-01-01", "2024-01-13"], ["20240101", "2024-1-13"]]})
    with pytest.raises(ValueError, match="twice"):
        workflows.sar_coherence(cat, vv, twice)
    assert workflows.sar_interferogram(cat, vv, twice).count() == 8 * 3


def test_preprocessing_with_primary_outside(spark):
    cat, slc, days = world(spark)
    job = parameters.job({"burst_id": 10, "polarization": ["VV", "VH"], "temporal_extent": ["2024-01-01", "2024-01-20"], "primary_date": str(days[3])})
    out = workflows.sar_slc_preprocessing(cat, slc, job)
    assert {(r.pol, r.date, r.role) for r in out.select("pol", "date", "role").distinct().collect()} == {(p, d, r) for p in ("VV", "VH") for d, r in ((days[0], "sec_first"), (days[1], "sec"), (days[3], "prm"))}
    assert workflows.ALIASES["insar_preprocessing_v02"] is workflows.sar_slc_preprocessing


def test_midnight_end(spark):
    cat, slc, _ = world(spark)
    job = parameters.job({"burst_id": 10, "temporal_extent": ["2024-01-01", "2024-01-13T00:00:00"], "temporal_baseline": 12})
    with pytest.raises(ValueError, match="very beginning of that day"):
        workflows.sar_coherence(cat, slc, job)


def test_spatial_extent_and_swath(spark):
    cat, _, _ = world(spark)
    more = cat.withColumn("burst_id", F.lit(5).cast("long")).withColumn("swath", F.lit("IW3"))
    j = parameters.job({"spatial_extent": {"west": 10.9, "east": 12, "south": 46.5, "north": 46.6}, "temporal_extent": ["2024-01-01", "2024-02-28"]})
    found = workflows.select_bursts(cat.unionByName(more), j)
    assert {(r.burst_id, r.swath) for r in found.collect()} == {(5, "IW3")}


def test_catalogue_answers(spark, tmp_path):
    doc = {"value": [{"AbsoluteBurstId": 1, "BurstId": 2, "SwathIdentifier": "IW1", "PolarisationChannels": "VV", "RelativeOrbitNumber": 3, "ParentProductName": "P", "S3Path": "/s", "BeginningDateTime": "2024-01-01T05:00:00.123456Z", "EndingDateTime": "2024-01-01T05:00:03Z", "ContentDate": {"Start": "2024-01-01T05:00:00.000Z"}, "GeoFootprint": {"coordinates": [[[1.0, 2.0]]]}}]}
    (tmp_path / "a.json").write_text(json.dumps(doc))
    r = catalog.read_answers(spark, str(tmp_path / "a.json")).first()
    assert (r.abs_id, r.burst_id, r.start, r.begin) == (1, 2, dt.datetime(2024, 1, 1, 5), dt.datetime(2024, 1, 1, 5, 0, 0, 123000))
    layer = {"type": "FeatureCollection", "features": [{"properties": {"burst_id": 9, "subswath_name": "IW2", "orbit_pass": "ASCENDING"}, "geometry": {"type": "MultiPolygon", "coordinates": [[[[1.0, 2.0, 0.0]]]]}}]}
    (tmp_path / "b.geojson").write_text(json.dumps(layer))
    b = catalog.read_burst_map(spark, str(tmp_path / "b.geojson")).first()
    assert (b.burst_id, b.orbit_pass, b.polygons) == (9, "ASCENDING", [[[[1.0, 2.0, 0.0]]]])


def test_stac(spark, tmp_path):
    rows = [(0, "i1", "a.tif", "2024-01-01", "2024-01-13", 1.0, 2.0, 3.0, 4.0, "coh", 32632), (1, "i1", "b.tif", "2024-01-05", "2024-01-25", 0.0, 2.0, 3.0, 5.0, "phase", 32632), (2, None, "c.tif", None, None, 1.0, 2.0, 3.0, 4.0, "coh", 32632)]
    files = spark.createDataFrame(rows, "ordinal long, id string, file string, date1 string, date2 string, west double, south double, east double, north double, band string, epsg int")
    c = json.loads(stac.collection(files, "S1_collection.json").first()["value"])
    assert c["extent"] == {"spatial": {"bbox": [[0.0, 2.0, 3.0, 5.0]]}, "temporal": {"interval": [["2024-01-01", "2024-01-25"]]}} and c["proj:epsg"] == 32632
    assert json.loads(stac.merged([files, files], "collection.json").first()["value"])["extent"] == c["extent"]
    with pytest.raises(ValueError):
        stac.collection(files, "x.json")
    (i,) = stac.items_of(files).collect()
    assert (i.id, i.date1, i.date2, i.files) == ("i1", "2024-01-01", "2024-01-25", ["a.tif", "b.tif"])
    item = files.limit(1).select(stac.item(F.col("file"), F.col("date1"), F.col("date2"), [F.col(k) for k in ("west", "south", "east", "north")]).alias("v")).first()["v"]
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "item.json").write_text(item)
    (a,) = stac.assets(spark, str(tmp_path)).collect()
    assert (a.id, a.asset, a.href) == ("a.tif", "a.tif", "a.tif")
    assert [(r.band, r["first"]) for r in stac.bands_in_order(files).orderBy("first").collect()] == [("coh", 0), ("phase", 1)]


def test_stream_of_pairs(spark, tmp_path):
    source = str(tmp_path / "in")
    t = [dt.datetime(2024, 1, d, 5) for d in (1, 2, 13, 14, 25)]
    spark.createDataFrame([(1, x) for x in t], "burst long, start timestamp").write.parquet(source)
    arrivals = spark.readStream.schema("burst long, start timestamp").parquet(source)
    q = stream.offset_pairs_stream(arrivals, 12, by=("burst",)).writeStream.format("memory").queryName("stream_pairs").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    found = sorted((r.prm_time.day, r.sec_time.day) for r in spark.table("stream_pairs").collect())
    assert found == [(1, 13), (2, 14), (13, 25)]
    first = stream.new_days(arrivals.withColumn("track", F.lit(1))).writeStream.format("memory").queryName("stream_days").option("checkpointLocation", str(tmp_path / "d")).trigger(availableNow=True).start()
    first.awaitTermination(60)
    assert spark.table("stream_days").count() == 5


def test_other_bursts_change_nothing(spark):
    """A second burst, sub-swath and polarization of the same dates in both tables leave the first one's cells as they are."""
    cat, slc, days = world(spark)
    more_cat = cat.union(cat.selectExpr("abs_id + 100", "11L", "'IW1'", "pol", "track", "product", "path", "start", "footprint"))
    more = slc.union(slc.selectExpr("11L", "'IW1'", "pol", "date", "y", "x", "CAST(i + 3 AS float)", "CAST(q * 2 AS float)"))
    job = parameters.job({"burst_id": 10, "polarization": "vv", "temporal_extent": ["2024-01-01", "2024-02-28"], "temporal_baseline": 12, "primary_date": str(days[1])})
    both = parameters.job({"spatial_extent": {"west": 10, "south": 46, "east": 11, "north": 47}, "polarization": ["vv", "vh"], "temporal_extent": ["2024-01-01", "2024-02-28"], "temporal_baseline": 12, "primary_date": str(days[1])})
    for product in (workflows.sar_coherence, workflows.sar_interferogram, workflows.sar_slc_preprocessing):
        rows = lambda df: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())
        alone = rows(product(cat, slc.filter("pol = 'VV'"), job))
        assert rows(product(more_cat, more, job)) == alone and alone
        every = product(more_cat, more, both, every_burst=True)
        assert rows(every.filter("burst_id = 10 AND pol = 'VV'")) == alone and every.select("burst_id", "pol").distinct().count() == 4


def test_filtered_interferogram(spark):
    """Goldstein's filter runs pair by pair, and a reference phase is taken off."""
    cat, slc, days = world(spark)
    job = parameters.job({"burst_id": 10, "polarization": "vv", "temporal_extent": ["2024-01-01", "2024-02-28"], "temporal_baseline": 12, "n_rg_looks": 1, "n_az_looks": 1})
    plain = workflows.sar_interferogram(cat, slc, job, unwrap=False)
    own = plain.filter(F.col("prm_date") == days[0]).select("y", "x", F.col("phase").alias("p"))
    turned = workflows.sar_interferogram(cat, slc, job, unwrap=False, reference_phase="0.25").filter(F.col("prm_date") == days[0]).join(own, ["y", "x"])
    assert turned.filter(F.abs(F.sin((F.col("p") - F.col("phase") - 0.25) / 2)) > 1e-6).isEmpty() and turned.count() == 96
    filtered = workflows.sar_interferogram(cat, slc, job, unwrap=False, filtered=True)
    assert filtered.groupBy("prm_date").count().count() == 3 and filtered.count() == plain.count()


def test_geocoded_products(spark):
    """Each burst, polarization and pair lies on the grid by itself; the geometry takes the looks of the product."""
    cat, slc, _ = world(spark)
    job = parameters.job({"burst_id": 10, "polarization": "vv", "temporal_extent": ["2024-01-01", "2024-02-28"], "temporal_baseline": 12, "n_rg_looks": 2, "n_az_looks": 1})
    places = slc.select("burst_id", "swath", "y", "x", (11 + F.col("x") * 0.001).alias("lon"), (46 + F.col("y") * 0.001).alias("lat")).distinct()
    out = workflows.geocoded(workflows.sar_interferogram(cat, slc, job), places, 20.0, looks=(2, 1))
    assert out.columns == ["burst_id", "swath", "pol", "prm_date", "sec_date", "row", "col", "phase", "unw_phase", "coh"]
    counts = out.groupBy("prm_date").count().collect()
    assert len(counts) == 3 and len({r["count"] for r in counts}) == 1
    box = out.agg(F.min("row"), F.max("row"), F.min("col"), F.max("col"), F.min("coh"), F.max("coh")).first()
    assert 5_090_000 < box[0] * 20 < box[1] * 20 < 5_110_000 and 640_000 < box[2] * 20 < box[3] * 20 < 660_000 and 0 <= box[4] <= box[5] <= 1 + 1e-9


def test_lists_by_date(spark):
    rows = [("2024-01-01", 0, "prm_vv_i"), ("2024-01-01", 1, "prm_vv_grid_lat"), ("2024-01-13", 0, "sec_vv_i")]
    files = spark.createDataFrame(rows, "date string, ordinal int, file string").withColumn("date", F.to_date("date"))
    with pytest.raises(ValueError, match="two grid files"):
        rasters.files_by_date(files, "2024-01-01", ["VV"])
    whole = files.union(spark.sql("SELECT DATE '2024-01-01', 2, 'prm_vv_grid_lon'"))
    found = {str(r.date): r.files for r in rasters.files_by_date(whole, "2024-01-01", ["VV"]).collect()}
    assert found == {"2024-01-01": ["prm_vv_i", "prm_vv_grid_lat", "prm_vv_grid_lon"], "2024-01-13": ["sec_vv_i", "prm_vv_grid_lat", "prm_vv_grid_lon"]}

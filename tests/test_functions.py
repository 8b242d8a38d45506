import math

import pytest
from burstmill.functions import dates, geometry, names, phasors
from burstmill.sources import rasters
from pyspark.sql import functions as F


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(k) for k, c in columns.items())).first()


@pytest.mark.parametrize(
    ("text", "iso"),
    [("2025-11-26", "2025-11-26 00:00:00"), ("20251126", "2025-11-26 00:00:00"), ("2025-1-26", "2025-01-26 00:00:00"), ("2025-01-1", "2025-01-01 00:00:00"), ("2024-08-09T00:00:00Z", "2024-08-09 00:00:00"), ("20240809T170739", "2024-08-09 17:07:39"), ("2024-08-09T17:07:39.123Z", "2024-08-09 17:07:39.123")],
)
def test_parse_date(spark, text, iso):
    assert one(spark, d=dates.parse_date(F.lit(text)).cast("string")).d == iso


def test_parse_date_fails_and_null(spark):
    assert one(spark, d=dates.parse_date(F.lit(None).cast("string"))).d is None
    assert one(spark, d=dates.try_parse_date(F.lit("soon"))).d is None
    with pytest.raises(Exception, match="not a date: soon"):
        spark.range(1).select(dates.parse_date(F.concat(F.lit("soon"), F.lit("")))).collect()


def test_days_ends(spark):
    r = one(spark, a=dates.start_of(F.lit("2024-01-01")), b=dates.end_of(F.lit("2024-01-01")), c=dates.end_of(F.lit("2024-01-01T00:00:00Z")))
    assert (r.a, r.b, r.c) == ("2024-01-01T00:00:00Z", "2024-01-01T23:59:59Z", "2024-01-01T00:00:00Z")


def test_path_dates(spark):
    path = F.lit("/data/S1A_SLC_20240809T170739_249435_IW2_VV/measurement.tiff")
    r = one(spark, t=dates.folder_time(path), d=dates.folder_date(path).cast("string"), p=dates.product_date(F.lit("S1A_IW_SLC__1SDV_20240809T170739_x")).cast("string"), b=dates.band_date(dates.folder_date(path)))
    assert (r.t, r.d, r.p, r.b) == ("20240809T170739", "2024-08-09", "2024-08-09", "09Aug2024")


@pytest.mark.parametrize(
    ("tag", "band"),
    [("coh_IW2_VV_09Aug2024_21Aug2024", "coh_VV"), ("i_IW2_VV_mst_09Aug2024", "i_VV"), ("Unw_Phase_ifg_09Aug2024_21Aug2024", "Unw_Phase_ifg"), ("lat_band", "grid_lat"), ("elevation", "elevation")],
)
def test_band_names(spark, tag, band):
    assert one(spark, b=names.band_name(F.lit(tag))).b == band


def test_names(spark):
    a, b = F.lit("2024-08-09 17:07:39").cast("timestamp_ntz"), F.lit("2024-08-21 17:07:39").cast("timestamp_ntz")
    file = names.coherence_file(a, b)
    first, second = names.file_times(file, "coherence")
    slc, none = names.file_times(names.slc_file("prm", a, F.lit("VV"), F.lit("i")), "slc")
    r = one(spark, f=file, a=first, b=second, s=slc, n=none, i=names.interferogram_file(a, b), slug=names.slugify(F.lit(" A b/C! ")), q=names.quoted(F.lit("a b+c")), j=names.last_json(F.lit('log {"x": 1}\n{"y": 2}')), d=names.described_band(F.lit("b12"), F.lit("coh")))
    assert r.f == "S1_coh_2images_20240809T170739_20240821T170739.tif" and (r.a, r.b, r.s, r.n) == ("20240809T170739", "20240821T170739", "20240809T170739", None)
    assert r.i.startswith("phase_coh_") and (r.slug, r.q, r.j, r.d) == ("a_b_c", "a%20b%2Bc", '{"y": 2}', "coh")


def test_geometry(spark):
    ring = F.expr("array(array(0D,0D), array(4D,0D), array(4D,4D), array(0D,4D), array(0D,0D))")
    box = geometry.box_of(ring)
    r = one(
        spark, a=geometry.inside(ring, F.lit(1.0), F.lit(3.0)), b=geometry.inside(ring, F.lit(5.0), F.lit(3.0)), touch=geometry.boxes_meet(box, 4, 4, 9, 9), apart=geometry.boxes_meet(box, 4.1, 0, 9, 9),
        w=geometry.wkt_points(F.lit("POINT(11.5 -46.25)")), flip=geometry.flipped(ring)[1], poly=geometry.box_wkt(F.lit(1), F.lit(2), F.lit(3), F.lit(4)),
    )
    assert r.a and not r.b and r.touch and not r.apart and r.w == [[11.5, -46.25]] and r.flip == [0.0, 4.0]
    assert r.poly == "POLYGON((1 2,3 2,3 4,1 4,1 2))"


def test_utm(spark):
    """On the central meridian easting is 500 km, and a metre of northing is 0.9996 of one along the meridian arc."""
    east, north = geometry.utm(F.lit(9.0), F.lit(45.0), 32)
    e2, n2 = geometry.utm(F.lit(10.0), F.lit(46.0), 32)
    r = one(spark, e=east, n=north, e2=e2, n2=n2)
    assert r.e == pytest.approx(500_000, abs=1e-6) and r.n == pytest.approx(0.9996 * 4_984_944.378, abs=0.01)
    assert r.e2 == pytest.approx(577_441.9, abs=60) and r.n2 == pytest.approx(5_094_600, abs=400)


def test_phasors(spark):
    lit = lambda *v: [F.lit(float(x)) for x in v]
    p = phasors.parts(*lit(1, 2, 3, 4))
    self_coherence = phasors.coherence(*phasors.parts(*lit(3, 4, 3, 4)).values())
    r = one(spark, **p, c=self_coherence, a=phasors.amplitude(*lit(3, 4)), d=phasors.decibel(F.lit(10.0)), z=phasors.decibel(F.lit(0.0)), ph=phasors.phase(*lit(0, 1)), w=phasors.wrapped(F.lit(3 * math.pi / 2)), n=phasors.no_nan(F.lit(float("nan"))))
    assert (r.re, r.im, r.p1, r.p2) == (11, 2, 5, 25) and r.c == pytest.approx(1) and (r.a, r.d, r.z, r.n) == (5, 10, None, None)
    assert r.ph == pytest.approx(math.pi / 2) and r.w == pytest.approx(-math.pi / 2)


def test_raster_metadata(spark):
    r = one(
        spark, b=rasters.band_names(F.lit("<X><BAND_NAME>i_VV</BAND_NAME><BAND_NAME>q_VV</BAND_NAME></X>")), old=rasters.projected_shape(F.array(F.lit(1), F.lit(2)), F.lit("2024-01-01").cast("date")),
        new=rasters.projected_shape(F.array(F.lit(1), F.lit(2)), F.lit("2024-06-01").cast("date")), info=rasters.raster_info(F.lit('{"size": [5, 7], "stac": {"proj:epsg": 32632}}')),
    )
    assert r.b == ["i_VV", "q_VV"] and r.old == [2, 1] and r.new == [1, 2] and r.info.size == [5, 7] and r.info.stac["proj:epsg"] == 32632


@pytest.mark.parametrize(
    ("other", "meet"),
    [
        ([(1, 1), (2, 1), (2, 2), (1, 1)], True),  # inside
        ([(-9, -9), (9, -9), (9, 9), (-9, 9), (-9, -9)], True),  # around
        ([(3, -1), (3, 5), (3.5, 2), (3, -1)], True),  # across, with no corner inside
        ([(4, 4), (5, 4), (5, 5), (4, 4)], True),  # touches a corner
        ([(4, 1), (6, 1), (6, 3), (4, 1)], True),  # touches an edge
        ([(5, 3), (5, 5), (3.2, 5), (5, 3)], False),  # boxes overlap, areas do not
        ([(5, 5), (6, 5), (6, 6), (5, 5)], False),
        ([(1, 1), (2, 2)], False),  # no area
    ],
)
def test_rings_meet(spark, other, meet):
    ring = F.array(*(F.array(F.lit(float(x)), F.lit(float(y))) for x, y in other))
    box = geometry.box_ring(0, 0, 4, 4)
    assert tuple(one(spark, a=geometry.rings_meet(box, ring), b=geometry.rings_meet(ring, box))) == (meet, meet)


def test_projected(spark):
    lon, lat = F.lit(11.0), F.lit(46.0)
    north, south = geometry.projected(lon, lat, 4326, 32632), geometry.projected(lon, -lat, 4326, 32732)
    r = one(spark, e=north[0], n=north[1], f=south[0], s=south[1])
    assert r.e == pytest.approx(r.f) and r.s == pytest.approx(10_000_000 - r.n)
    assert geometry.projected(lon, lat, 32632, 32632) == (lon, lat)
    with pytest.raises(ValueError, match="no rule"):
        geometry.projected(lon, lat, 32633, 32632)
    assert [geometry.utm_zone(x) for x in (-180, 11, 12, 179.9)] == [1, 32, 33, 60]

"""Planar geometry on rings of [lon, lat] pairs and boxes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def box_of(ring: Column) -> Column:
    """struct(west, south, east, north) of a ring."""
    xs, ys = F.transform(ring, lambda p: p[0]), F.transform(ring, lambda p: p[1])
    return F.struct(F.array_min(xs).alias("west"), F.array_min(ys).alias("south"), F.array_max(xs).alias("east"), F.array_max(ys).alias("north"))


def boxes_meet(a: Column, west: float, south: float, east: float, north: float) -> Column:
    """Whether box a touches or overlaps the given one."""
    return (a["west"] <= east) & (a["east"] >= west) & (a["south"] <= north) & (a["north"] >= south)


def inside(ring: Column, x: Column, y: Column) -> Column:
    """Ray casting: whether (x, y) lies inside the closed ring (planar, not geodesic)."""
    n = F.size(ring)

    def crossing(i: Column) -> Column:
        ax, ay = F.get(ring, i)[0], F.get(ring, i)[1]
        bx, by = F.get(ring, i + 1)[0], F.get(ring, i + 1)[1]
        return ((ay > y) != (by > y)) & (x < ax + F.try_divide((bx - ax) * (y - ay), by - ay))

    hits = F.filter(F.sequence(F.lit(0), n - 2), lambda i: F.coalesce(crossing(i), F.lit(False)))
    return (n > 3) & (F.size(hits) % 2 == 1)


def edges(ring: Column) -> Column:
    """The sides of a closed ring with their boxes, array<struct<px, py, qx, qy, west, east, south, north>>."""

    def side(p: Column, q: Column) -> Column:
        ends = (p[0].alias("px"), p[1].alias("py"), q[0].alias("qx"), q[1].alias("qy"))
        return F.struct(*ends, F.least(p[0], q[0]).alias("west"), F.greatest(p[0], q[0]).alias("east"), F.least(p[1], q[1]).alias("south"), F.greatest(p[1], q[1]).alias("north"))

    n = F.greatest(F.size(ring) - 1, F.lit(0))
    return F.zip_with(F.slice(ring, F.lit(1), n), F.slice(ring, F.lit(2), n), side)


def _edges_meet(s: Column, t: Column) -> Column:
    """Whether two edges share a point: their boxes meet, and each one's ends lie on both sides of the other."""
    side = lambda a, b, end: F.signum((a["qx"] - a["px"]) * (b[f"{end}y"] - a["py"]) - (a["qy"] - a["py"]) * (b[f"{end}x"] - a["px"]))
    parted = lambda a, b: side(a, b, "p") * side(a, b, "q") <= 0
    # boxes first: they cost less and part most edges
    over = (s["west"] <= t["east"]) & (s["east"] >= t["west"]) & (s["south"] <= t["north"]) & (s["north"] >= t["south"])
    return over & parted(s, t) & parted(t, s)


def _starts_inside(a: Column, b: Column) -> Column:
    """inside() for the first point of the ring with edges a and the ring with edges b."""
    x, y = F.get(a, F.lit(0))["px"], F.get(a, F.lit(0))["py"]
    crossing = lambda s: ((s["py"] > y) != (s["qy"] > y)) & (x < s["px"] + F.try_divide((s["qx"] - s["px"]) * (y - s["py"]), s["qy"] - s["py"]))
    return F.size(F.filter(b, lambda s: F.coalesce(crossing(s), F.lit(False)))) % 2 == 1


def outlines_meet(a: Column, b: Column) -> Column:
    """rings_meet() for the edges() of both rings; joins make these once for each ring, not for each pair."""
    return F.exists(a, lambda s: F.exists(b, lambda t: _edges_meet(s, t))) | _starts_inside(a, b) | _starts_inside(b, a)


def rings_meet(a: Column, b: Column) -> Column:
    """Whether the areas of two closed rings touch or overlap (planar); false for rings of fewer than four points."""
    return F.coalesce((F.size(a) > 3) & (F.size(b) > 3) & outlines_meet(edges(a), edges(b)), F.lit(False))


def box_ring(west: float, south: float, east: float, north: float) -> Column:
    """A box as a closed ring."""
    return F.array(*(F.array(F.lit(float(x)), F.lit(float(y))) for x, y in ((west, south), (east, south), (east, north), (west, north), (west, south))))


def flipped(ring: Column) -> Column:
    """[lon, lat] to [lat, lon]."""
    return F.transform(ring, lambda p: F.array(p[1], p[0]))


def wkt_points(wkt: Column) -> Column:
    """The coordinate pairs of a POINT or POLYGON text."""
    pairs = F.regexp_extract_all(wkt, F.lit(r"(-?[\d.]+\s+-?[\d.]+)"), F.lit(1))
    return F.transform(pairs, lambda p: F.transform(F.split(p, r"\s+"), lambda v: v.cast("double")))


def box_wkt(west: Column, south: Column, east: Column, north: Column) -> Column:
    """A closed polygon of five points."""
    return F.format_string("POLYGON((%s %s,%s %s,%s %s,%s %s,%s %s))", west, south, east, south, east, north, west, north, west, south)


# WGS84 ellipsoid and the scale of UTM.
_A, _F, _K0 = 6378137.0, 1 / 298.257223563, 0.9996


def utm_zone(lon: float) -> int:
    return int((lon + 180) // 6) % 60 + 1


def _zone_of(epsg: int) -> tuple[int, bool] | None:
    """(zone, south) of a UTM system of WGS84 (326 and the zone in the north, 327 in the south), None for degrees (4326)."""
    if epsg == 4326:
        return None
    if epsg // 100 not in (326, 327) or not 1 <= epsg % 100 <= 60:
        raise ValueError(f"no rule for EPSG {epsg}")
    return epsg % 100, epsg // 100 == 327


def projected(x: Column, y: Column, epsg: int, target: int) -> tuple[Column, Column]:
    """(x, y) in the target's reference system: as they are where both agree, else from degrees to a UTM zone. From a UTM zone,
    with_projected() goes by way of columns, as one expression would grow too large."""
    source, aim = _zone_of(epsg), _zone_of(target)
    if epsg == target:
        return x, y
    if source is not None or aim is None:
        raise ValueError(f"no rule from EPSG {epsg} to {target} in one expression")
    return utm(x, y, *aim)


def with_projected(rows: DataFrame, x: Column, y: Column, epsg: int, target: int, names: tuple[str, str]) -> DataFrame:
    """rows and the target's coordinates of (x, y) as columns `names`, between degrees (4326) and any UTM zones of WGS84."""
    source, aim = _zone_of(epsg), _zone_of(target)
    keep = [c for c in rows.columns if c not in names]
    at = rows.withColumns({"_px": x, "_py": y})
    if epsg != target and source is not None:
        at = _with_degrees(at, *source)
    if epsg != target and aim is not None:
        # phi's conformal counterpart first: the series uses it many times
        e = 2 * math.sqrt(_F / (2 - _F)) / (1 + _F / (2 - _F))
        at = at.withColumns({"_s": F.sin(F.radians("_py")), "_lam": F.radians(F.col("_px") - (aim[0] * 6 - 183))})
        at = at.withColumn("_t", F.sinh(F.atanh("_s") - e * F.atanh(e * F.col("_s"))))
        at = at.withColumns({"_xi": F.atan2(F.col("_t"), F.cos("_lam")), "_eta": F.atanh(F.sin("_lam") / F.sqrt(1 + F.col("_t") * F.col("_t")))})
        east, north = _series(F.col("_xi"), F.col("_eta"), aim[1])
        at = at.withColumns({"_px": east, "_py": north})
    return at.select(*keep, F.col("_px").alias(names[0]), F.col("_py").alias(names[1]))


def utm(lon: Column, lat: Column, zone: int, south: bool = False) -> tuple[Column, Column]:
    """Easting and northing in a UTM zone by the transverse Mercator series to the fourth order of n."""
    n = _F / (2 - _F)
    e = 2 * math.sqrt(n) / (1 + n)
    phi, lam = F.radians(lat), F.radians(lon - (zone * 6 - 183))
    s = F.sin(phi)
    t = F.sinh(F.atanh(s) - e * F.atanh(e * s))
    return _series(F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t)), south)


def _series(xi: Column, eta: Column, south: bool) -> tuple[Column, Column]:
    n = _F / (2 - _F)
    radius = _A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    east, north = eta, xi
    for j, a in enumerate(alpha, 1):
        east = east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return 500_000 + _K0 * radius * east, (10_000_000 if south else 0) + _K0 * radius * north


def _with_degrees(rows: DataFrame, zone: int, south: bool) -> DataFrame:
    """rows with _px and _py of a UTM zone as longitude and latitude: the inverse of utm(), to the third order of n (a millimetre)."""
    n = _F / (2 - _F)
    radius = _A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    beta = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480)
    delta = (2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15)
    at = rows.withColumns({"_xi": (F.col("_py") - (10_000_000 if south else 0)) / (_K0 * radius), "_eta": (F.col("_px") - 500_000) / (_K0 * radius)})
    up, across, chi = F.col("_xi"), F.col("_eta"), F.col("_chi")
    for j, b in enumerate(beta, 1):
        up = up - b * F.sin(2 * j * F.col("_xi")) * F.cosh(2 * j * F.col("_eta"))
        across = across - b * F.cos(2 * j * F.col("_xi")) * F.sinh(2 * j * F.col("_eta"))
    at = at.withColumns({"_up": up, "_across": across})
    at = at.withColumn("_chi", F.asin(F.sin("_up") / F.cosh("_across")))
    lat = sum((d * F.sin(2 * j * chi) for j, d in enumerate(delta, 1)), chi)
    return at.withColumns({"_px": zone * 6 - 183 + F.degrees(F.atan2(F.sinh("_across"), F.cos("_up"))), "_py": F.degrees(lat)})

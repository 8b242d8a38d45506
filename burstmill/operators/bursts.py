"""Selections over the burst catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAGE = 1000


def matching(bursts: DataFrame, start: str | None = None, end: str | None = None, **equal: object) -> DataFrame:
    """Bursts that start within start..end, both inclusive, and equal what is given; None asks for nothing.

    Texts are compared in upper case. A date alone as end means up to 23:59:59.000 of that day.
    """
    if start is not None:
        bursts = bursts.filter(F.col("start") >= F.lit(start if "T" in start else f"{start}T00:00:00").cast("timestamp_ntz"))
    if end is not None:
        bursts = bursts.filter(F.col("start") <= F.lit(end if "T" in end else f"{end}T23:59:59").cast("timestamp_ntz"))
    for column, value in equal.items():
        if value is not None:
            bursts = bursts.filter(F.col(column) == (F.lit(value.upper()) if isinstance(value, str) else F.lit(value)))
    return bursts


def of_product(bursts: DataFrame, product: str, start: str = "start") -> DataFrame:
    """The bursts that come from a product, by their start; its name may end in .SAFE or not."""
    return bursts.filter(F.regexp_replace("product", r"\.SAFE$", "") == F.lit(product.removesuffix(".SAFE"))).orderBy(start)


def guarded(rows: DataFrame, order: list[str], page: int = PAGE, fail: bool = True) -> DataFrame:
    """The first page in a total order. A full page is an error, as rows may be missing; with fail=False it is cut silently."""
    found = rows.orderBy(*order).limit(page)
    if fail and found.count() >= page:
        raise ValueError(f"{page} rows or more: narrow the search")
    return found


def lowest_burst(bursts: DataFrame, burst: str = "burst_id") -> DataFrame:
    """The rows of the smallest burst id, whatever their sub-swath."""
    least = bursts.agg(F.min(burst).alias("least_id"))
    return bursts.join(F.broadcast(least), F.col(burst) == F.col("least_id")).drop("least_id")


def first_swath(bursts: DataFrame, order: str = "abs_id", swath: str = "swath") -> DataFrame:
    return bursts.agg(F.min_by(swath, order).alias("first_swath"))


def first_per_label(bursts: DataFrame, label: str, ordinal: str, *columns: str) -> DataFrame:
    """The first occurrence of each label over all tracks."""
    first = F.min_by(F.struct(*columns), ordinal).alias("x")
    return bursts.groupBy(label).agg(first).select(label, *(f"x.{c}" for c in columns))


def calendar(bursts: DataFrame, track: str = "track", start: str = "start") -> DataFrame:
    """(year, month, day, tracks): the distinct tracks that acquire on each day, in order."""
    d = F.to_date(F.col(start))
    rows = bursts.select(F.year(d).alias("year"), F.month(d).alias("month"), F.day(d).alias("day"), F.col(track).alias("track")).distinct()
    return rows.groupBy("year", "month", "day").agg(F.sort_array(F.collect_set("track")).alias("tracks"))


def month_maps(days: DataFrame) -> DataFrame:
    """(year, month, last_track_of): day to its last track, one map for each month."""
    pair = F.struct("day", F.element_at("tracks", -1).alias("track"))
    return days.groupBy("year", "month").agg(F.map_from_entries(F.sort_array(F.collect_list(pair))).alias("last_track_of"))


def with_split_number(bursts: DataFrame, product: list[str], burst: str = "burst_id", name: str = "split") -> DataFrame:
    """bursts and a number: 1 for the smallest burst of a product, swath and polarization, and so on.

    The smallest ones are aggregated first, so that no product's rows meet in one task.
    """
    least = bursts.groupBy(*product).agg(F.min(burst).alias("_least"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in product]
    joined = bursts.join(least.withColumnsRenamed({c: f"_{c}" for c in product}), same)
    return joined.withColumn(name, F.col(burst) - F.col("_least") + 1).drop("_least", *(f"_{c}" for c in product))


def with_outside_primary(inside: DataFrame, catalogue: DataFrame, primary: str, start: str, end: str) -> DataFrame:
    """inside, and if the primary date lies before start or after end, the catalogue's rows of that day as well."""
    if start <= primary <= end:
        return inside
    return inside.unionByName(catalogue.filter(F.to_date("start") == F.lit(primary).cast("date")))


def primary_and_secondaries(rows: DataFrame, primary: str, date: str = "date", by: tuple[str, ...] = ()) -> DataFrame:
    """rows with role: prm, sec_first (the earliest secondary, of each `by`) or sec. One primary must exist."""
    d = F.to_date(F.col(date))
    if rows.filter(d == F.lit(primary).cast("date")).isEmpty():
        raise ValueError(f"no acquisition on the primary date {primary}")
    first = rows.filter(d != F.lit(primary).cast("date")).groupBy(*by).agg(F.min(d).alias("first_sec"))
    role = F.when(d == F.lit(primary).cast("date"), "prm").when(d == F.col("first_sec"), "sec_first").otherwise("sec")
    # without `by` there is one row to join
    joined = rows.join(first, list(by), "left") if by else rows.crossJoin(F.broadcast(first))
    return joined.withColumn("role", role).drop("first_sec")


def covering(bursts: DataFrame, lon: float, lat: float, footprint: str = "footprint") -> DataFrame:
    """Bursts whose footprint holds a point: an odd number of its rings does, so that holes are left out."""
    from burstmill.functions.geometry import inside

    rings = F.filter(F.col(footprint), lambda ring: inside(ring, F.lit(lon), F.lit(lat)))
    return bursts.filter(F.size(rings) % 2 == 1)


def metadata_products(bursts: DataFrame, swath: str, burst_id: int) -> DataFrame:
    """The products whose metadata a burst's baselines need: one row each, by first occurrence in id order."""
    own = bursts.filter((F.lower("swath") == swath.lower()) & (F.col("burst_id") == burst_id))
    return own.groupBy("product").agg(F.min("abs_id").alias("ord"), F.min_by("path", "abs_id").alias("path"))


def metadata_files(files: DataFrame, swath: str, pol: str, key: str = "key") -> DataFrame:
    """The files of a product that belong to the sub-swath and polarization, and its manifest."""
    k = F.col(key)
    return files.filter((k.contains(swath.lower()) & k.contains(pol)) | k.contains("manifest.safe"))


def merged(*found: DataFrame) -> DataFrame:
    """Everything that the searches found, repeats included; none of them changes."""
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out


def track_centres(bursts: DataFrame, track: str = "track") -> DataFrame:
    """(track, lat, lon): the middle of the extremes of each track's footprints."""
    from burstmill.functions.geometry import box_of

    b = bursts.select(F.col(track).alias("track"), box_of(F.col("footprint")[0]).alias("b"))
    mid = lambda lo, hi: (F.min(lo) + F.max(hi)) / 2
    return b.groupBy("track").agg(mid("b.south", "b.north").alias("lat"), mid("b.west", "b.east").alias("lon"))

"""Rasters as Parquet tables, and the metadata that comes with raster files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLC = "burst_id bigint, swath string, pol string, date date, y bigint, x bigint, i float, q float"


def read_slc(spark: SparkSession, path: str) -> DataFrame:
    """Complex samples, in folders by burst and date: both prune."""
    return spark.read.schema(SLC).parquet(path)


def write_slc(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").partitionBy("burst_id", "date").parquet(path)


_FOLDERS = ("burst_id", "swath", "pol", "prm_date", "sec_date")


def write_product(rows: DataFrame, path: str) -> None:
    """A product of pairs, in folders by burst, polarization and pair (as far as rows has them); float32 values."""
    kept = rows.select(*(F.col(c).cast("float") if t == "double" else F.col(c) for c, t in rows.dtypes))
    folders = [c for c in _FOLDERS if c in rows.columns]
    kept.repartition(*folders).write.mode("append").partitionBy(*folders).parquet(path)


def pairs_to_do(pairs: DataFrame, path: str) -> DataFrame:
    """Pairs that have no folder below path yet."""
    spark = pairs.sparkSession
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return pairs
    kinds = dict(pairs.dtypes)
    done = spark.read.parquet(path)
    keys = [c for c in _FOLDERS if c in kinds and c in done.columns]
    return pairs.join(done.select(*(F.col(c).cast(kinds[c]).alias(c) for c in keys)).distinct(), keys, "left_anti")


def files_by_date(files: DataFrame, primary: str, polarizations: list[str]) -> DataFrame:
    """(date, files) from (date, ordinal, file): the files of each date in order, latitude and longitude grids at every date.

    Of several polarizations the first one's grids of the primary date are left out. What grids the primary has left, two
    files, are added after the other dates' own. A date's list is bounded by its polarizations and bands.
    """
    day = F.lit(primary).cast("date")
    if len(polarizations) > 1:
        files = files.filter(~((F.col("date") == day) & F.col("file").contains(f"_{polarizations[0].lower()}_grid_")))
    grids = [r.file for r in files.filter((F.col("date") == day) & F.col("file").contains("_grid_")).orderBy("ordinal").limit(3).collect()]
    if len(grids) != 2:
        raise ValueError(f"the primary date {primary} must have two grid files, found {grids}")
    own = files.groupBy("date").agg(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "file"))), lambda f: f["file"]).alias("files"))
    return own.withColumn("files", F.when(F.col("date") == day, F.col("files")).otherwise(F.concat("files", F.array(*map(F.lit, grids)))))


def write_bands(cube: DataFrame, bands: list[str], keys: list[str], path: str) -> None:
    """One folder for each band."""
    cube.unpivot(keys, bands, "band", "value").write.mode("append").partitionBy("band").parquet(path)


def band_names(xml: Column) -> Column:
    """The BAND_NAME elements of a raster's metadata text, in the order of the BAND_INDEX beside them, which is a number.

    Names without an index come last, in document order.
    """
    blocks = F.regexp_extract_all(xml, F.lit(r"(?s)<Spectral_Band_Info>(.*?)</Spectral_Band_Info>"), F.lit(1))
    blocks = F.when(F.size(blocks) > 0, blocks).otherwise(F.regexp_extract_all(xml, F.lit(r"(<BAND_NAME>.*?</BAND_NAME>)"), F.lit(1)))
    index = lambda b: F.coalesce(F.nullif(F.regexp_extract(b, r"<BAND_INDEX>\s*(\d+)\s*<", 1), F.lit("")).cast("int"), F.lit(2**31 - 1))
    each = F.transform(blocks, lambda b, i: F.struct(index(b).alias("index"), i.alias("place"), F.regexp_extract(b, "<BAND_NAME>(.*?)</BAND_NAME>", 1).alias("name")))
    return F.transform(F.array_sort(each), lambda b: b["name"])


def raster_info(text: Column) -> Column:
    """size, EPSG code, corner coordinates and band descriptions from a raster's JSON metadata."""
    return F.from_json(
        text,
        "size array<int>, stac struct<`proj:epsg`:int,`proj:shape`:array<int>>, cornerCoordinates struct<upperLeft:array<double>,lowerRight:array<double>>, "
        "wgs84Extent struct<coordinates:array<array<array<double>>>>, bands array<struct<band:int,description:string,noDataValue:string>>",
    )


def projected_shape(shape: Column, version: Column) -> Column:
    """Rows first: versions before 2024-03-03 wrote columns first."""
    return F.when(version < F.lit("2024-03-03").cast("date"), F.reverse(shape)).otherwise(shape)

"""STAC items and collections as tables, written as JSON text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The version and the extension that the documents name.
VERSION = "1.0.0"
DATACUBE = "https://stac-extensions.github.io/datacube/v2.2.0/schema.json"
_BOX = ("west", "south", "east", "north")
ITEM = "id string, type string, links array<struct<rel:string,href:string>>, assets map<string,struct<href:string,type:string>>"


def extent(files: DataFrame) -> DataFrame:
    """One row: the time extent over both dates and the box over all files (date1, date2, west, south, east, north)."""
    found = files.agg(
        F.min(F.least("date1", "date2")).alias("start"),
        F.max(F.greatest("date1", "date2")).alias("end"),
        F.min("west").alias("west"),
        F.min("south").alias("south"),
        F.max("east").alias("east"),
        F.max("north").alias("north"),
    )
    fine = F.col("west").isNull() | ((F.col("west") <= F.col("east")) & (F.col("south") <= F.col("north")))
    return found.filter(F.assert_true(fine, F.lit("a box with its ends exchanged")).isNull())


def bands_in_order(bands: DataFrame) -> DataFrame:
    """(band, first): the distinct bands by where they are first seen (ordinal)."""
    return bands.groupBy("band").agg(F.min("ordinal").alias("first"))


def single_crs(files: DataFrame) -> DataFrame:
    """(n_crs, epsg): the EPSG code if all files agree, else null."""
    return files.agg(F.count_distinct("epsg").alias("n_crs"), F.when(F.count_distinct("epsg") == 1, F.min("epsg")).alias("epsg"))


def item(name: Column, date1: Column, date2: Column, box: list[Column], assets: Column | None = None) -> Column:
    """The JSON text of an item; the files' own dates are date1 of the first and date2 of the last. assets: a map by file
    name, or else the item's name is its only file."""
    assets = F.map_from_arrays(F.array(name), F.array(F.struct(name.alias("href")))) if assets is None else assets
    west, south, east, north = box
    ring = F.array(F.array(F.array(west, south), F.array(east, south), F.array(east, north), F.array(west, north), F.array(west, south)))
    return F.to_json(
        F.struct(
            F.lit("Feature").alias("type"),
            F.lit(VERSION).alias("stac_version"),
            name.alias("id"),
            F.struct(F.lit("Polygon").alias("type"), ring.alias("coordinates")).alias("geometry"),
            F.array(*box).alias("bbox"),
            F.struct(date1.alias("datetime"), date2.alias("sar:datetime_secondary")).alias("properties"),
            F.array().cast("array<struct<rel:string,href:string>>").alias("links"),
            assets.alias("assets"),
        )
    )


def items_of(files: DataFrame) -> DataFrame:
    """(id, date1, date2, files) of each item: files of one pair; files whose name holds no date are left out."""
    named = files.filter(F.col("id").isNotNull())
    first, last = F.min_by("date1", "ordinal"), F.max_by("date2", "ordinal")
    return named.groupBy("id").agg(first.alias("date1"), last.alias("date2"), F.sort_array(F.collect_list("file")).alias("files"))


def item_documents(files: DataFrame) -> DataFrame:
    """(id, item): the JSON text of each item, with an asset for each of its files: href, the names of its bands and its shape.

    files: ordinal, id, file, date1, date2, west, south, east, north, bands (names) and shape (rows, columns). Box and
    outline are those of the item's last file; an item's files are those of one pair or date, of distinct names.
    """
    asset = F.struct(F.concat(F.lit("./"), "file").alias("href"), F.transform("bands", lambda b: F.struct(b.alias("name"))).alias("eo:bands"), F.col("shape").alias("proj:shape"))
    last = F.max_by(F.struct("date2", *_BOX), "ordinal").alias("last")
    found = files.filter(F.col("id").isNotNull()).groupBy("id").agg(F.min_by("date1", "ordinal").alias("date1"), last, F.sort_array(F.collect_list(F.struct("file", asset.alias("asset")))).alias("assets"))
    return found.select("id", item(F.col("id"), F.col("date1"), F.col("last.date2"), [F.col(f"last.{k}") for k in _BOX], F.map_from_entries("assets")).alias("item"))


def collection(files: DataFrame, name: str) -> DataFrame:
    """One row, the collection's JSON text; name must end in collection.json.

    It links the items (id) that the files make, names the bands (band) in the order of their first sight, and gives the
    axes the extents of the files' own boxes (x0, y0, x1, y1, if there are such columns) where all have one reference
    system. Items and bands of a job are few; both are distinct values and aggregated before they meet in the one row.
    """
    if not name.endswith("collection.json"):
        raise ValueError("the file name must end in collection.json")
    has = set(files.columns)
    blank = F.lit(None)
    own = [c if c in has else blank.cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")]
    native = files.select(*own).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    ids = files.select(F.col("id") if "id" in has else blank.cast("string").alias("id")).filter("id IS NOT NULL").distinct().agg(F.sort_array(F.collect_list("id")).alias("ids"))
    bands = bands_in_order(files).agg(F.transform(F.sort_array(F.collect_list(F.struct("first", "band"))), lambda b: b["band"]).alias("bands")) if "band" in has else files.agg(F.lit(None).cast("array<string>").alias("bands"))
    e, crs = extent(files), single_crs(files)

    def axis(a: str) -> Column:
        span = F.when(F.col("epsg").isNotNull() & F.col(f"{a}0").isNotNull(), F.array(f"{a}0", f"{a}1"))
        return F.struct(F.lit(a).alias("axis"), F.lit("spatial").alias("type"), span.alias("extent"), F.col("epsg").alias("reference_system")).alias(a)

    # all five have one row
    return e.crossJoin(crs).crossJoin(native).crossJoin(ids).crossJoin(bands).select(
        F.to_json(
            F.struct(
                F.lit("Collection").alias("type"),
                F.lit(VERSION).alias("stac_version"),
                F.lit(name.removesuffix(".json")).alias("id"),
                F.lit("Radar products by pair and date").alias("description"),
                F.lit("unknown").alias("license"),
                F.array(F.lit(DATACUBE)).alias("stac_extensions"),
                F.struct(
                    axis("x"),
                    axis("y"),
                    F.struct(F.lit("temporal").alias("type"), F.array("start", "end").alias("extent")).alias("t"),
                    F.struct(F.lit("bands").alias("type"), F.col("bands").alias("values")).alias("bands"),
                ).alias("cube:dimensions"),
                F.transform("ids", lambda i: F.struct(F.concat(F.lit("./"), i, F.lit(".json")).alias("href"), F.lit("item").alias("rel"), F.lit("application/geo+json").alias("type"))).alias("links"),
                F.struct(F.struct(F.array(F.array("west", "south", "east", "north")).alias("bbox")).alias("spatial"), F.struct(F.array(F.array("start", "end")).alias("interval")).alias("temporal")).alias("extent"),
                F.col("epsg").alias("proj:epsg"),
            )
        ).alias("value")
    )


def merged(parts: list[DataFrame], name: str) -> DataFrame:
    """The collection of the files of several directories."""
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return collection(out, name)


def assets(spark: SparkSession, root: str) -> DataFrame:
    """(path, asset, href) of all items below a folder."""
    rows = spark.read.schema(ITEM).option("multiLine", True).option("recursiveFileLookup", True).json(root)
    return rows.filter("type = 'Feature'").select("id", F.explode("assets").alias("asset", "a")).select("id", "asset", "a.href")


def canonical(items: DataFrame) -> DataFrame:
    """Items with a canonical link."""
    return items.filter(F.exists("links", lambda x: x["rel"] == "canonical"))

"""The burst catalogue and the vector layers around it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A burst acquisition of one polarization.
SCHEMA = (
    "abs_id bigint, burst_id bigint, swath string, pol string, track int, product string, path string, "
    "start timestamp_ntz, begin timestamp_ntz, end timestamp_ntz, footprint array<array<array<double>>>"
)
#: The records of a catalogue's JSON answer.
RECORDS = (
    "value array<struct<AbsoluteBurstId:bigint,BurstId:bigint,SwathIdentifier:string,PolarisationChannels:string,RelativeOrbitNumber:int,"
    "ParentProductName:string,S3Path:string,BeginningDateTime:string,EndingDateTime:string,ContentDate:struct<Start:string>,"
    "GeoFootprint:struct<coordinates:array<array<array<double>>>>>>"
)


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """A catalogue table; filters on it reach the Parquet scan."""
    return spark.read.schema(SCHEMA).parquet(path)


def read_answers(spark: SparkSession, path: str) -> DataFrame:
    """Saved JSON answers of a catalogue service as a catalogue table."""
    r = spark.read.schema(RECORDS).option("multiLine", True).json(path).select(F.explode("value").alias("r"))
    time = lambda c: F.to_timestamp_ntz(F.regexp_replace(F.substring(c, 1, 23), "Z$", ""))
    return r.select(
        F.col("r.AbsoluteBurstId").alias("abs_id"),
        F.col("r.BurstId").alias("burst_id"),
        F.col("r.SwathIdentifier").alias("swath"),
        F.col("r.PolarisationChannels").alias("pol"),
        F.col("r.RelativeOrbitNumber").alias("track"),
        F.col("r.ParentProductName").alias("product"),
        F.col("r.S3Path").alias("path"),
        time(F.col("r.ContentDate.Start")).alias("start"),
        time(F.col("r.BeginningDateTime")).alias("begin"),
        time(F.col("r.EndingDateTime")).alias("end"),
        F.col("r.GeoFootprint.coordinates").alias("footprint"),
    )


def read_burst_map(spark: SparkSession, path: str) -> DataFrame:
    """The features of a GeoJSON file: their properties and the rings of their polygons."""
    properties = "struct<OGC_FID:bigint,burst_id:bigint,subswath_name:string,relative_orbit_number:int,time_from_anx_sec:double,orbit_pass:string>"
    schema = f"features array<struct<properties:{properties},geometry:struct<type:string,coordinates:array<array<array<array<double>>>>>>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("features").alias("f"))
    return rows.select("f.properties.*", F.col("f.geometry.coordinates").alias("polygons"))


def jobs_after(jobs: DataFrame, created: str) -> DataFrame:
    """Rows of a job log (id, created, status) that were created after a time."""
    return jobs.filter(F.col("created") > F.lit(created))


def all_finished(jobs: DataFrame) -> DataFrame:
    return jobs.agg(F.bool_and(F.col("status") == "finished").alias("all_finished"))

"""What every job needs from the cluster: the shared folder, tables that cut lineage, and this package on the workers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: A side with at most this many rows, counted beforehand, may be broadcast.
BROADCAST_ROWS = 20_000
_shipped: set[str] = set()
_own_dir: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir, or in local mode a temporary folder if that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        root = _own_dir.setdefault(app, "file://" + tempfile.mkdtemp(prefix="burstmill-"))
    return f"{root.rstrip('/')}/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read back: later stages start from files that no lost executor takes along."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._burstmill_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table made by materialize() that no plan reads any more."""
    path = getattr(df, "_burstmill_path", None)
    if path:
        spark = df.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def maybe_broadcast(df: DataFrame, limit: int = BROADCAST_ROWS, least: DataFrame | None = None) -> DataFrame:
    """df with a broadcast hint if it has at most limit rows; beyond that the planner joins by shuffles.

    least: a table with no more rows than df, which costs less to count; if it is beyond the limit, df isn't made to be counted.
    """
    if least is not None and least.select(F.lit(1)).offset(limit).take(1):  # reads no more partitions than that takes
        return df
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def ship_package(spark: SparkSession) -> None:
    """Put this package on the Python workers (once for each application)."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="burstmill-zip-"), "burstmill_worker.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(top):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(top)))
    spark.sparkContext.addPyFile(target)
    _shipped.add(app)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have, whatever case it is compared in."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def with_field(schema: StructType, name: str, ddl: str) -> StructType:
    """schema and one more field, of the type that the DDL text names."""
    return StructType([*schema.fields, StructField(name, StructType.fromDDL(f"x {ddl}")[0].dataType)])

import os
from types import SimpleNamespace

import pytest
from burstmill import shared
from pyspark.sql import functions as F


def session(setting, master):
    conf = SimpleNamespace(get=lambda key, default=None: setting)
    return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(applicationId="app-1", master=master, getConf=lambda: conf))


def test_the_folder_is_the_cluster_s_own():
    assert shared.shared_dir(session("hdfs://n/shared/", "yarn")) == "hdfs://n/shared/app-1"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_dir(session(None, "yarn"))


def test_tables(spark):
    t = shared.materialize(spark.range(5), "five")
    folder = shared.shared_dir(spark).removeprefix("file://")
    assert t.count() == 5 and any(n.startswith("five-") for n in os.listdir(folder))
    shared.discard(t)
    assert not any(n.startswith("five-") for n in os.listdir(folder))


def test_empty_table_keeps_its_schema(spark):
    t = shared.materialize(spark.range(0).selectExpr("id", "array(id) AS a"), "none")
    assert t.columns == ["id", "a"] and t.collect() == []


def test_broadcast_only_below_the_limit(spark):
    hint = lambda df: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()
    assert hint(shared.maybe_broadcast(spark.range(10), 10)) and not hint(shared.maybe_broadcast(spark.range(11), 10))


@pytest.mark.parametrize(("columns", "name"), [(["a"], "b"), (["A"], "a_"), (["a", "a_"], "a__")])
def test_fresh_names(spark, columns, name):
    df = spark.range(1).select(*(F.lit(1).alias(c) for c in columns))
    assert shared.fresh(df, name.rstrip("_")) == name


def test_added_field(spark):
    s = shared.with_field(spark.range(1).schema, "x", "struct<a:int,b:array<string>>")
    assert s["x"].dataType.simpleString() == "struct<a:int,b:array<string>>"

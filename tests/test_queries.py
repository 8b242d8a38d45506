"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import duckdb
import pytest
from burstmill.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def sorted_rows(rows, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(r[k] for k in order) for r in rows), key=str)


@pytest.mark.parametrize("name", registry.ORACLES)
def test_oracle(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    found = duck.execute(registry.ORACLES[name])
    columns = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(columns)
    assert sorted_rows(df.collect(), df.columns) == sorted_rows(found.fetchall(), columns)


@pytest.mark.parametrize("name", ["sbas_pairs", "temporal_baseline_pairs", "pair_date_semi_join", "coherence_boxcar"])
def test_no_products_of_tables(spark, name):
    plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("name", sorted(registry.QUERIES.keys() - registry.ORACLES.keys()))
def test_rows(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0

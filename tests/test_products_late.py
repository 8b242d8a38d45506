"""The products over images after the job's former end, 2034-01-01."""

import duckdb
import pytest
from burstmill.plans import registry
from test_queries import SF, sorted_rows


@pytest.mark.parametrize("name", ["product_coherence", "product_interferogram"])
def test_late_images_are_paired(spark, tmp_path, name):
    late = spark.read.parquet(f"{SF}/embeddings.parquet").filter("vec_id < 200").selectExpr("vec_id + 15150 AS vec_id", "* EXCEPT (vec_id)")
    late.coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    df = registry.QUERIES[name](spark, str(tmp_path))
    found = duck.execute(registry.ORACLES[name])
    columns = [c[0] for c in found.description]
    rows = df.collect()
    assert len({r.prm_date for r in rows}) == 3
    assert sorted_rows(rows, df.columns) == sorted_rows(found.fetchall(), columns)

"""geocode_grid far down a long raster, where a sum of doubles and a decimal can lie in different cells."""

import duckdb
from burstmill.plans import registry


def test_cells_of_far_lines(spark, tmp_path):
    lines = [0, 50, 34_299, 34_300, 34_550, 119_000, 4_102_550]
    step = list(range(30_000, 45_000, 50)) + list(range(3_000_000, 3_030_000, 50))
    rows = [(y, [float(k % 7) for k in range(64)], 1) for y in {*lines, *step}]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    sql = duck.execute(f"SELECT row, col, amplitude, n FROM ({registry.ORACLES['geocode_grid']})").fetchall()
    found = registry.QUERIES["geocode_grid"](spark, str(tmp_path)).select("row", "col", "amplitude", "n").collect()
    assert sorted(map(tuple, found)) == sorted(sql)
    assert 1605 in {r["row"] for r in found}  # line 34,300

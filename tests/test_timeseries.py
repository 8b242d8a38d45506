import datetime as dt

import numpy as np
import pytest
from burstmill.operators import kernels, timeseries
from pyspark.sql import functions as F

DAYS = [dt.date(2023, 1, 1) + dt.timedelta(12 * k) for k in range(20)]


def test_known_step_velocity_and_height_come_back(spark):
    r = np.random.default_rng(1)
    perp = r.normal(0, 80, 20)
    rows = [(p, d, 3.0 * (d - dt.date(2000, 1, 1)).days / 365.25 * p + (5.0 if d >= dt.date(2023, 5, 1) else 0.0) + 0.02 * p * float(perp[k]) + 1, float(perp[k])) for p in (1, 2) for k, d in enumerate(DAYS)]
    rows += [(1, DAYS[0], None, 3.0), (1, DAYS[0], float("nan"), 3.0), (3, DAYS[0], 1.0, 2.0)]
    df = spark.createDataFrame(rows, "pixel long, date date, value double, perp double")
    found = {v["pixel"]: v for v in timeseries.velocity(df, "value", ("pixel",), steps=["2023-05-01"], baseline="perp").collect()}
    for p in (1, 2):
        assert found[p]["n"] == 20 and [found[p][c] for c in ("offset", "velocity", "step_1", "height")] == pytest.approx([1, 3 * p, 5, 0.02 * p], abs=1e-5)
        assert found[p]["rms"] < 1e-4
    assert found[3]["n"] == 1 and found[3]["velocity"] is None and found[3]["rms"] is None


def test_a_ramp_is_taken_off_around_a_deforming_area(spark):
    rows = [(d, y, x, 2 + 0.3 * y - 0.1 * x * (k + 1) + (50.0 if y < 3 and x < 3 else 0)) for k, d in enumerate(DAYS[:2]) for y in range(15) for x in range(12)]
    df = spark.createDataFrame(rows, "date date, y long, x long, value double")
    for v in timeseries.deramped(df, "value").collect():
        assert v["value"] == pytest.approx(50 if v["y"] < 3 and v["x"] < 3 else 0, abs=1e-6)
    masked = timeseries.deramped(df, "value", mask=F.col("y") >= 3, rounds=1)
    assert masked.columns == df.columns and masked.filter("y >= 3").agg(F.max(F.abs("value"))).first()[0] < 1e-6
    assert timeseries.deramped(df.filter("y = 0"), "value").count() == 24  # no plane: as they are


def test_network_choice(spark):
    pairs = [(0, 1, 0.2), (1, 2, 0.9), (0, 2, 0.3), (2, 3, 0.1), (1, 3, 0.1), (3, 4, None), (3, 4, None)]
    rows = [(b, DAYS[i], DAYS[j], c) for b in (7, 8) for i, j, c in pairs]
    found = timeseries.chosen_pairs(spark.createDataFrame(rows, "burst_id long, prm_date date, sec_date date, coh double"), "coh", 0.3).collect()
    kept = sorted((DAYS.index(v["prm_date"]), DAYS.index(v["sec_date"]), v["kept"]) for v in found if v["burst_id"] == 8 and v["in_tree"])
    assert len(found) == 14 and kept == [(0, 2, True), (1, 2, True), (1, 3, True), (3, 4, True)]
    assert all(v["kept"] == (v["in_tree"] or (v["coh"] or 0) >= 0.3) for v in found)


def test_temporal_coherence(spark):
    r = np.random.default_rng(2)
    d = np.r_[0, r.normal(0, 2, 9)]
    pairs = [(p, DAYS[i], DAYS[j], float(d[j] - d[i] + (r.uniform(-3, 3) if p == 2 else 0))) for p in (1, 2) for i in range(10) for j in range(i + 1, min(10, i + 4))]
    df = spark.createDataFrame(pairs, "pixel long, prm_date date, sec_date date, phase double")
    series = kernels.invert_network(df, ["pixel"])
    found = {v["pixel"]: v["temporal_coherence"] for v in timeseries.temporal_coherence(df, series, ("pixel",)).collect()}
    assert found[1] == pytest.approx(1) and found[2] < 0.9
    at = {(v["pixel"], v["date"]): v["displacement"] for v in series.collect()}
    z = np.mean([np.exp(1j * (f - at[p, b] + at[p, a])) for p, a, b, f in pairs if p == 2])
    assert found[2] == pytest.approx(abs(z))


def test_empty(spark):
    df = spark.createDataFrame([], "pixel long, date date, value double")
    assert timeseries.velocity(df, "value", ("pixel",)).count() == 0

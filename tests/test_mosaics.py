import pytest
from burstmill.operators import mosaics

BURSTS = "swath string, burst_id long, start double, lines long"


def lines(spark, bursts):
    rows = [(s, b, y, x, 1000.0 * b + y) for s, b, _, n in bursts for y in range(n) for x in range(2)]
    return spark.createDataFrame(rows, "swath string, burst_id long, y long, x long, v double")


def test_each_line_once_seams_in_the_middle(spark):
    bursts = [("IW1", 1, 10.0, 10), ("IW1", 2, 11.6, 10), ("IW1", 3, 13.0, 10), ("IW2", 1, 10.4, 5), ("IW2", 7, 12.0, 5)]
    found = mosaics.deburst(lines(spark, bursts), spark.createDataFrame(bursts, BURSTS), 0.2, ("swath",)).filter("x = 0").collect()
    one = {r["y"]: r["v"] for r in found if r["swath"] == "IW1"}
    # lines 8..17 overlap 0..9 in two, 15..24 overlap 8..17 in three
    assert sorted(one) == list(range(25)) and len([r for r in found if r["swath"] == "IW1"]) == 25
    assert one[8] == 1008 and one[9] == 2001 and one[15] == 2007 and one[16] == 3001
    two = {r["y"]: r["v"] for r in found if r["swath"] == "IW2"}
    assert two == {**{y: 1000.0 + y for y in range(5)}, **{8 + y: 7000.0 + y for y in range(5)}}  # a gap of three lines


def test_nested_equal_and_unknown_bursts(spark):
    bursts = [("a", 1, 0.0, 10), ("a", 2, 2.0, 3), ("a", 3, 2.0, 3), ("b", 5, 0.0, 4)]
    samples = lines(spark, bursts[:3] + [("a", 9, 0.0, 2), (None, 1, 0.0, 2)])
    found = mosaics.deburst(samples, spark.createDataFrame(bursts, BURSTS), 1.0, ("swath",)).filter("x = 0")
    assert sorted((r["burst_id"], r["y"]) for r in found.collect()) == [(1, y) for y in range(10)]
    assert found.filter("burst_id = 9 OR swath = 'b'").count() == 0


def test_sub_swaths_side_by_side(spark):
    swaths = spark.createDataFrame([("IW1", 0.0, 5.0, 6), ("IW2", -1.0, 9.0, 6)], "swath string, start double, near double, samples long")
    samples = spark.createDataFrame([(s, y, x, float(x)) for s in ("IW1", "IW2") for y in range(2) for x in range(6)], "swath string, y long, x long, v double")
    found = mosaics.merged(samples, swaths, 0.5, 1.0, ()).collect()
    # samples 4 and 5 of IW1 are samples 0 and 1 of IW2; IW2 begins two lines earlier
    assert sorted((r["y"], r["x"], r["swath"]) for r in found) == sorted([(y + 2, x, "IW1") for y in range(2) for x in range(5)] + [(y, x, "IW2") for y in range(2) for x in range(5, 10)])


def test_empty_tables(spark):
    none = spark.createDataFrame([], BURSTS)
    assert mosaics.deburst(spark.createDataFrame([], "swath string, burst_id long, y long, x long, v double"), none, 1.0, ("swath",)).count() == 0


@pytest.mark.parametrize("overlap", range(0, 7))
def test_any_overlap(spark, overlap):
    bursts = [("s", k, float(k * (8 - overlap)), 8) for k in range(4)]
    found = mosaics.deburst(lines(spark, bursts), spark.createDataFrame(bursts, BURSTS), 1.0, ("swath",)).filter("x = 1").collect()
    assert sorted(r["y"] for r in found) == list(range(3 * (8 - overlap) + 8))

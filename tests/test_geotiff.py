import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from burstmill.sources import geotiff

CELLS = "file string, band string, y long, x long, value double"


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    """Two images of 70 x 40 cells in two bands, by 16 x 32 tiles; (folder, values by file)."""
    path = "file://" + str(tmp_path_factory.mktemp("tiff") / "out")
    values = {f: np.random.default_rng(k).normal(size=(2, 70, 40)).astype("f4") for k, f in enumerate(["a.tif", "deep/b.tif"])}
    values["a.tif"][0, 16:32, 0:32] = np.nan  # a tile without cells
    rows = [(f, "iq"[b], y, x, float(v[b, y, x])) for f, v in values.items() for b in range(2) for y in range(70) for x in range(40) if not np.isnan(v[b, y, x])]
    spurious = [(None, "i", 0, 0, 9.0), ("a.tif", "other", 0, 0, 9.0), ("a.tif", None, 0, 0, 9.0), ("a.tif", "q", None, 0, 9.0), ("a.tif", "q", -1, 0, 9.0), ("a.tif", "q", 3, 3, -99.0), ("a.tif", "q", 3, 3, None)]
    geotiff.write_geotiff(spark.createDataFrame(rows + spurious, CELLS), path, ["q", "i"], (16, 32), 32632, (500000.0, 5200000.0), (20.0, 10.0))
    return path, values


def as_dict(df):
    return {(r["file"], r["band"], r["y"], r["x"]): r["value"] for r in df.collect()}


def wanted(values, window=(0, 0, 69, 39), bands="iq"):
    return {
        (f, b, y, x): None if np.isnan(v["iq".index(b), y, x]) else float(v["iq".index(b), y, x])
        for f, v in values.items() for b in bands for y in range(window[0], window[2] + 1) for x in range(window[1], window[3] + 1)
    }


def test_round_trip(spark, written):
    path, values = written
    found = geotiff.read_geotiff(spark, path)
    assert as_dict(found) == wanted(values) and found.count() == 2 * 2 * 70 * 40
    assert as_dict(geotiff.read_geotiff(spark, path + "/a.tif")) == wanted({"a.tif": values["a.tif"]})


def test_headers_names_in_the_order_of_their_index(spark, written):
    heads = {r["file"]: r for r in geotiff.read_headers(spark, written[0]).collect()}
    assert sorted(heads) == ["a.tif", "deep/b.tif"]
    h = heads["a.tif"]
    assert (h["width"], h["height"], h["tile_height"], h["tile_width"], h["bands"], h["epsg"]) == (40, 70, 16, 32, ["q", "i"], 32632)
    assert h["scale"] == [20.0, 10.0, 0.0] and h["tie_point"][3:5] == [500000.0, 5200000.0]
    text = "<x><Spectral_Band_Info><BAND_INDEX>10</BAND_INDEX><BAND_NAME>k</BAND_NAME></Spectral_Band_Info><Spectral_Band_Info><BAND_INDEX>2</BAND_INDEX><BAND_NAME>c</BAND_NAME></Spectral_Band_Info></x>"
    assert geotiff.names_of(text, 11) == [f"band_{n}" for n in (1, 2)] + ["c"] + [f"band_{n}" for n in range(4, 11)] + ["k"]
    assert geotiff.names_of(None, 2) == ["band_1", "band_2"]


def test_window_reads_its_tiles_alone(spark, written, tmp_path):
    """All bytes of other tiles are damaged; the window's come back all the same, and the rest does not."""
    path, values = written
    raw = bytearray(open(path.removeprefix("file://") + "/a.tif", "rb").read())
    head = geotiff.Header(pa.BufferReader(bytes(raw)), "a.tif")
    window = (20, 33, 40, 38)
    chosen = head.tiles(window, {"i"})
    assert [t[2:] for t in chosen] == [(16, 32, [1]), (32, 32, [1])] and len(head.offsets) == 20
    for at, n in set(zip(head.offsets, head.lengths)) - {t[:2] for t in chosen}:
        raw[at : at + n] = b"\xff" * n
    (tmp_path / "a.tif").write_bytes(raw)
    mine = {"a.tif": values["a.tif"]}
    assert as_dict(geotiff.read_geotiff(spark, f"file://{tmp_path}", window, ["i"])) == wanted(mine, window, "i")
    with pytest.raises(Exception, match="decompress"):
        geotiff.read_geotiff(spark, f"file://{tmp_path}").collect()
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        found = geotiff.read_geotiff(spark, f"file://{tmp_path}").filter("y BETWEEN 20 AND 40 AND x > 32 AND x < 39 AND band = 'i'")
        assert as_dict(found) == wanted(mine, window, "i")
        assert geotiff.read_geotiff(spark, path).filter("file = 'deep/b.tif' AND y = 69").count() == 80
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "false")


def test_parts_cover_each_tile_once(written):
    raw = open(written[0].removeprefix("file://") + "/deep/b.tif", "rb").read()
    head = geotiff.Header(pa.BufferReader(raw), "b")
    whole = (0, 0, geotiff.FOREVER, geotiff.FOREVER)
    assert sorted(t for k in range(7) for t in head.tiles(whole, None, k, 7)) == head.tiles(whole, None)


def test_large_files_are_dealt_and_small_ones_share(written, monkeypatch):
    reader = geotiff.Reader({"path": written[0]})
    assert [[p[1:] for p in share.pieces] for share in reader.partitions()] == [[(0, 1), (0, 1)]]
    monkeypatch.setattr(geotiff, "STRETCH", 9000)
    monkeypatch.setattr(geotiff, "OPENING", 10)
    pieces = [p for share in reader.partitions() for p in share.pieces]
    assert len(pieces) > 4 and sorted({(f.rpartition("/")[2], n) for f, _, n in pieces}) == [(f, sum(p[0].endswith(f) for p in pieces)) for f in ("a.tif", "b.tif")]
    rows = [b.num_rows for f, k, n in pieces for b in reader.read(geotiff._Share([(f, k, n)]))]
    assert sum(rows) == 2 * 2 * 70 * 40


def classic(order, image, chunky, deflated, tags=()):
    """A classic TIFF in strips of two rows, made by hand from (bands, rows, columns) of 16-bit integers."""
    n, high, wide = image.shape
    planes = [np.moveaxis(image, 0, 2)] if chunky else [image[k][:, :, None] for k in range(n)]
    strips = [np.ascontiguousarray(p[r : r + 2]).astype(f"{order}i2").tobytes() for p in planes for r in range(0, high, 2)]
    strips = [zlib.compress(s) if deflated else s for s in strips]
    body, offsets = b"", []
    for s in strips:
        offsets.append(8 + len(body))
        body += s
    entries = [(256, "H", [wide]), (257, "H", [high]), (258, "H", [16] * n), (259, "H", [8 if deflated else 1]), (273, "I", offsets), (277, "H", [n]), (278, "H", [2]), (279, "I", [len(s) for s in strips]), (284, "H", [1 if chunky else 2]), (339, "H", [2] * n), *tags]
    at, block, behind = 8 + len(body) + 2 + 12 * len(entries) + 4, b"", b""
    for tag, code, values in sorted(entries):
        data = values if code == "s" else struct.pack(f"{order}{len(values)}{code}", *values)
        block += struct.pack(f"{order}HHI", tag, {"s": 2, "H": 3, "I": 4}[code], len(values))
        block += data.ljust(4, b"\0") if len(data) <= 4 else struct.pack(f"{order}I", at + len(behind))
        behind += b"" if len(data) <= 4 else data
    magic = {"<": b"II", ">": b"MM"}[order] + struct.pack(f"{order}HI", 42, 8 + len(body))
    return magic + body + struct.pack(f"{order}H", len(entries)) + block + b"\0\0\0\0" + behind


@pytest.mark.parametrize("order", "<>")
@pytest.mark.parametrize("chunky", [True, False])
@pytest.mark.parametrize("deflated", [True, False])
def test_classic_strips(spark, tmp_path, order, chunky, deflated):
    image = np.arange(2 * 5 * 3).reshape(2, 5, 3) - 9
    (tmp_path / "c.TIFF").write_bytes(classic(order, image, chunky, deflated, [(42113, "s", b"-4\0")]))
    found = as_dict(geotiff.read_geotiff(spark, f"file://{tmp_path}"))
    assert found == {("c.TIFF", f"band_{b + 1}", y, x): None if image[b, y, x] == -4 else float(image[b, y, x]) for b in range(2) for y in range(5) for x in range(3)}


def test_what_is_not_read_is_named(spark, tmp_path):
    (tmp_path / "text.tif").write_bytes(b"no raster at all")
    with pytest.raises(Exception, match="text.tif is no TIFF file"):
        geotiff.read_geotiff(spark, f"file://{tmp_path}").collect()
    with pytest.raises(ValueError, match="predictor 2"):
        geotiff.Header(pa.BufferReader(classic("<", np.zeros((1, 2, 2), int), True, False, [(317, "H", [2])])), "p.tif")


def test_empty_tables_and_folders(spark, tmp_path):
    path = f"file://{tmp_path}/none"
    geotiff.write_geotiff(spark.createDataFrame([], CELLS), path, ["i"])
    assert geotiff.read_geotiff(spark, path).count() == 0
    with pytest.raises(ValueError, match="multiples of 16"):
        geotiff.write_geotiff(spark.createDataFrame([], CELLS), path, ["i"], (10, 16))

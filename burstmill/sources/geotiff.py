"""GeoTIFF files as a data source of Spark, read by tiles and written by tiles.

Reading: `spark.read.format("geotiff")` gives (file, band, y, x, value), a row for each cell and band, no data as null. A
large file is split into stretches of its tiles by its size, small files share a task; a task reads the file's header, then
only those of its tiles that meet the window and the bands that were asked for, tiles that lie behind each other in one read. Window and bands are
options (`window`: first row, first column, last row, last column; `bands`: names, one a line); with
spark.sql.python.filterPushdown.enabled, filters on y, x, band and file find their way there too. Headers are never
gathered: the driver lists files, as it does for Spark's own formats.

Writing: cells are sorted by file, band and tile in Spark, and tiles are packed as the rows stream past, one at a time. What
is compressed then goes to one task for each file, which appends tile after tile and the directory behind them; a file
has its final name only when the job commits, and what tasks have left is deleted when it aborts. Files are BigTIFF in the
byte order of Intel, one plane for each band, float32, deflated. A tile without cells takes no bytes; a cell without a row is
no data. Of rows that share a cell the largest value stays. Rows with null file, band, y or x, outside the bands that
are named, or with negative places are left out. An empty table writes no file.

What is read: classic TIFF and BigTIFF, both byte orders, tiles or strips, chunky or planar, deflated or not, integers and
floats without a predictor; anything else raises an error that names the file and what it holds.
"""

from __future__ import annotations

import re
import struct
import uuid
import xml.etree.ElementTree as ET
import zlib
from collections.abc import Iterator
from xml.sax.saxutils import escape

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from burstmill.shared import discard, materialize, ship_package

CELLS = "file string, band string, y bigint, x bigint, value double"
#: Bytes that one task reads: a part of a large file, or small files together, each of which counts OPENING bytes more.
STRETCH = 64 << 20
OPENING = 1 << 20
#: Bytes of the first read of a header; most directories end before.
HEAD = 64 << 10
#: Largest read of tiles that lie behind each other.
READ = 8 << 20
TILE = 256
FOREVER = 1 << 62

# Fixed values of the TIFF 6, BigTIFF and GeoTIFF standards: tags, and sizes and struct codes of types.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES, PLANAR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284
PREDICTOR, TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_BYTES, SAMPLE_FORMAT = 317, 322, 323, 324, 325, 339
PIXEL_SCALE, TIE_POINT, GEO_KEYS, NO_DATA, BAND_XML = 33550, 33922, 34735, 42113, 65000
TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
KINDS = {1: "u", 2: "i", 3: "f"}
DEFLATE = (8, 32946)
#: Keys of the GeoTIFF directory: model type (1 projected, 2 geographic), raster type (cells as areas), codes of the reference system.
MODEL_TYPE, RASTER_TYPE, GEOGRAPHIC_CODE, PROJECTED_CODE = 1024, 1025, 2048, 3072


def names_of(text: str | None, count: int) -> list[str]:
    """The band names of a metadata text, by their numbered indexes; names that it lacks are band_1 and so on."""
    named: dict[int, str] = {}
    if text:
        for place, block in enumerate(ET.fromstring(text).iter("Spectral_Band_Info")):
            named[int(block.findtext("BAND_INDEX", str(place)))] = block.findtext("BAND_NAME", "")
    return [named.get(k) or f"band_{k + 1}" for k in range(count)]


class Header:
    """What the first directory of a file says. f: the open file."""

    def __init__(self, f, name: str):
        self.name = name
        head = f.read_at(HEAD, 0)
        self.order = {b"II": "<", b"MM": ">"}.get(head[:2])
        version = struct.unpack(f"{self.order}H", head[2:4])[0] if self.order else 0
        if version not in (42, 43):
            raise ValueError(f"{name} is no TIFF file")
        big = version == 43
        word, count, entry = ("Q", "Q", 20) if big else ("I", "H", 12)

        def at(place: int, n: int) -> bytes:
            return head[place : place + n] if place + n <= len(head) else f.read_at(n, place)

        (place,) = struct.unpack(f"{self.order}{word}", at(8 if big else 4, struct.calcsize(word)))
        width = struct.calcsize(f"={count}")
        (entries,) = struct.unpack(f"{self.order}{count}", at(place, width))
        block = at(place + width, entries * entry)
        self.tags: dict[int, tuple | str] = {}
        for k in range(entries):
            tag, kind, n = struct.unpack(f"{self.order}HH{word}", block[k * entry : k * entry + 4 + struct.calcsize(word)])
            if kind not in TYPES:
                continue
            size, raw = n * struct.calcsize(f"={TYPES[kind]}"), block[k * entry + 4 + struct.calcsize(word) : (k + 1) * entry]
            raw = raw[:size] if size <= len(raw) else at(struct.unpack(f"{self.order}{word}", raw)[0], size)
            self.tags[tag] = raw.split(b"\0")[0].decode("utf-8", "replace") if kind == 2 else struct.unpack(f"{self.order}{n}{TYPES[kind]}", raw)
        one = lambda tag, default: self.tags.get(tag, (default,))[0]
        self.width, self.height, self.bands = one(WIDTH, 0), one(HEIGHT, 0), one(SAMPLES, 1)
        self.planar = one(PLANAR, 1) == 2
        tiled = TILE_OFFSETS in self.tags
        self.tile = (one(TILE_LENGTH, 0), one(TILE_WIDTH, 0)) if tiled else (min(one(ROWS_PER_STRIP, self.height), self.height), self.width)
        self.padded = tiled
        self.offsets = self.tags[TILE_OFFSETS if tiled else STRIP_OFFSETS]
        self.lengths = self.tags[TILE_BYTES if tiled else STRIP_BYTES]
        compression, kind, bits = one(COMPRESSION, 1), one(SAMPLE_FORMAT, 1), set(self.tags.get(BITS, (1,)))
        if compression not in (1, *DEFLATE) or one(PREDICTOR, 1) != 1 or kind not in KINDS or len(bits) != 1 or not bits <= {8, 16, 32, 64}:
            raise ValueError(f"{name} has compression {compression}, predictor {one(PREDICTOR, 1)}, sample format {kind} and {sorted(bits)} bits, which are not read")
        self.deflated = compression != 1
        self.dtype = np.dtype(f"{self.order}{KINDS[kind]}{bits.pop() // 8}")
        self.names = names_of(self.tags.get(BAND_XML), self.bands)
        text = self.tags.get(NO_DATA, "").strip()
        self.no_data = float(text) if text else None

    def epsg(self) -> int | None:
        keys = self.tags.get(GEO_KEYS, ())
        found = {keys[k]: keys[k + 3] for k in range(4, len(keys), 4)}
        return found.get(PROJECTED_CODE, found.get(GEOGRAPHIC_CODE))

    def tiles(self, window: tuple[int, int, int, int], bands: set[str] | None, part: int = 0, parts: int = 1) -> list[tuple[int, int, int, int, list[int]]]:
        """(offset, length, top, left, bands) of the tiles of a part that meet window and bands, by offset; one without bytes has offset 0."""
        high, wide = self.tile
        down, across = -(-self.height // high), -(-self.width // wide)
        wanted = [k for k, n in enumerate(self.names) if bands is None or n in bands]
        rows = range(max(window[0], 0) // high, min(window[2], self.height - 1) // high + 1)
        columns = range(max(window[1], 0) // wide, min(window[3], self.width - 1) // wide + 1)
        found = []
        for group in [[k] for k in wanted] if self.planar else [wanted] * bool(wanted):
            for r in rows:
                for c in columns:
                    k = r * across + c + (group[0] * down * across if self.planar else 0)
                    if k * parts // len(self.offsets) == part:
                        found.append((self.offsets[k], self.lengths[k], r * high, c * wide, group))
        return sorted(found)

    def cells(self, raw: bytes, top: int, left: int) -> np.ndarray:
        """A tile as (rows, columns, samples), cut to the image; without bytes: no data throughout."""
        high, wide = self.tile
        rows, columns, samples = min(high, self.height - top), min(wide, self.width - left), 1 if self.planar else self.bands
        if not raw:
            return np.full((rows, columns, samples), np.nan)
        data = np.frombuffer(zlib.decompress(raw) if self.deflated else raw, self.dtype)
        return data.reshape(high if self.padded else rows, wide, samples)[:rows, :columns].astype(float)


def _files(path: str) -> list[tuple[str, int]]:
    store, folder = fs.FileSystem.from_uri(path)
    top = store.get_file_info(folder)
    if top.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    infos = [top] if top.is_file else store.get_file_info(fs.FileSelector(folder, recursive=True))
    hidden = lambda p: any(part.startswith(("_", ".")) for part in p[len(folder) :].split("/"))
    return sorted((i.path, i.size) for i in infos if i.is_file and re.search(r"\.tiff?$", i.path, re.I) and not hidden(i.path))


class _Share(InputPartition):
    def __init__(self, pieces: list[tuple[str, int, int]]):
        #: (file, part, parts)
        self.pieces = pieces


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.window = tuple(int(n) for n in options["window"].split(",")) if options.get("window") else (0, 0, FOREVER, FOREVER)
        self.bands = set(options["bands"].split("\n")) if options.get("bands") else None
        self.names: set[str] | None = None

    def partitions(self) -> list[InputPartition]:
        store, folder = fs.FileSystem.from_uri(self.path)
        shares, room = [], 0
        for file, size in _files(self.path):
            if self.names is None or _name(folder, file) in self.names:
                parts = max(1, -(-size // STRETCH))
                for k in range(parts):
                    if room < size // parts + OPENING:
                        shares.append([])
                        room = STRETCH + OPENING
                    shares[-1].append((file, k, parts))
                    room -= size // parts + OPENING
        return [_Share(pieces) for pieces in shares or [[]]]

    def read(self, partition: _Share) -> Iterator[pa.RecordBatch]:
        for file, part, parts in partition.pieces:
            yield from self._read(file, part, parts)

    def _read(self, file: str, part: int, parts: int) -> Iterator[pa.RecordBatch]:
        store, folder = fs.FileSystem.from_uri(self.path)
        first, left, last, right = self.window
        name = _name(folder, file)
        with store.open_input_file(file) as f:
            head = Header(f, name)
            todo = head.tiles(self.window, self.bands, part, parts)
            start = 0
            while start < len(todo):
                begin, stop = todo[start][0], start + 1
                end = begin + todo[start][1]
                while stop < len(todo) and todo[stop][0] == end and todo[stop][0] + todo[stop][1] - begin <= READ:
                    end, stop = todo[stop][0] + todo[stop][1], stop + 1
                data = f.read_at(end - begin, begin) if end > begin else b""
                for at, length, y0, x0, bands in todo[start:stop]:
                    tile = head.cells(data[at - begin : at - begin + length], y0, x0)
                    ys, xs = np.arange(y0, y0 + tile.shape[0]), np.arange(x0, x0 + tile.shape[1])
                    ry, rx = (ys >= first) & (ys <= last), (xs >= left) & (xs <= right)
                    for k in bands:
                        values = tile[:, :, 0 if head.planar else k][np.ix_(ry, rx)]
                        gone = np.isnan(values) | (values == head.no_data if head.no_data is not None else False)
                        y, x = np.repeat(ys[ry], rx.sum()), np.tile(xs[rx], ry.sum())
                        names = [pa.array([t]).take(pa.array(np.zeros(len(y), np.int64))) for t in (name, head.names[k])]
                        yield pa.RecordBatch.from_arrays([*names, pa.array(y), pa.array(x), pa.array(values.ravel(), mask=gone.ravel())], names=["file", "band", "y", "x", "value"])
                start = stop


class PushingReader(Reader):
    """Takes filters on y, x, band and file; Spark applies them once more, to what is left of the tiles at the edge."""

    def pushFilters(self, filters):
        bounds = list(self.window)
        for f in filters:
            column = f.attribute if hasattr(f, "attribute") else ()
            if column in (("y",), ("x",)):
                k = 0 if column == ("y",) else 1
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    bounds[k] = max(bounds[k], f.value + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    bounds[k + 2] = min(bounds[k + 2], f.value - isinstance(f, LessThan))
            elif column in (("band",), ("file",)) and isinstance(f, (EqualTo, In)):
                which = "bands" if column == ("band",) else "names"
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                have = getattr(self, which)
                setattr(self, which, values if have is None else have & values)
            yield f
        self.window = tuple(bounds)


def _name(folder: str, file: str) -> str:
    """A file's place below the folder; the file's own name if it was asked for alone."""
    return file[len(folder) :].strip("/") or file.rpartition("/")[2]


class Written(WriterCommitMessage):
    def __init__(self, files: list[tuple[str, str]]):
        self.files = files


class Writer(DataSourceArrowWriter):
    """Takes packed tiles (file, tile, width, height, stored, data), those of a file together and in order; stored: bytes of all the file's tiles."""

    def __init__(self, options: dict):
        self.path, self.bands = options["path"], options["bands"].split("\n")
        self.tile = tuple(int(n) for n in options["tile"].split(","))
        self.epsg, self.origin, self.step = (options.get(k) for k in ("epsg", "origin", "step"))
        self.run = uuid.uuid4().hex

    def _directory(self, width: int, height: int, offsets: np.ndarray, lengths: np.ndarray, end: int) -> bytes:
        n = len(self.bands)
        xml = "".join(f"<Spectral_Band_Info><BAND_INDEX>{k}</BAND_INDEX><BAND_NAME>{escape(b)}</BAND_NAME></Spectral_Band_Info>" for k, b in enumerate(self.bands))
        tags = {
            WIDTH: ("I", (width,)), HEIGHT: ("I", (height,)), BITS: ("H", (32,) * n), COMPRESSION: ("H", (DEFLATE[0],)), PHOTOMETRIC: ("H", (1,)), SAMPLES: ("H", (n,)), PLANAR: ("H", (2,)),
            TILE_WIDTH: ("I", (self.tile[1],)), TILE_LENGTH: ("I", (self.tile[0],)), TILE_OFFSETS: ("Q", offsets), TILE_BYTES: ("Q", lengths), SAMPLE_FORMAT: ("H", (3,) * n),
            NO_DATA: ("s", b"nan\0"), BAND_XML: ("s", f"<Image_Interpretation>{xml}</Image_Interpretation>".encode() + b"\0"),
        }
        if self.origin and self.step:
            (left, top), (dx, dy) = ([float(v) for v in text.split(",")] for text in (self.origin, self.step))
            tags[PIXEL_SCALE], tags[TIE_POINT] = ("d", (dx, dy, 0.0)), ("d", (0.0, 0.0, 0.0, left, top, 0.0))
        if self.epsg:
            code = int(self.epsg)
            degrees = 4000 <= code < 5000
            keys = [(MODEL_TYPE, 2 if degrees else 1), (RASTER_TYPE, 1), (GEOGRAPHIC_CODE if degrees else PROJECTED_CODE, code)]
            tags[GEO_KEYS] = ("H", (1, 1, 0, len(keys), *(v for key, value in keys for v in (key, 0, 1, value))))
        codes = {code: kind for kind, code in reversed(TYPES.items())}
        at, entries, behind = end + 8 + 20 * len(tags) + 8, b"", b""
        for tag, (code, values) in sorted(tags.items()):
            raw = values if code == "s" else np.asarray(values).astype(f"<{np.dtype(code).str[1:]}").tobytes()
            entries += struct.pack("<HHQ", tag, codes[code], len(values))
            entries += raw.ljust(8, b"\0") if len(raw) <= 8 else struct.pack("<Q", at + len(behind))
            behind += b"" if len(raw) <= 8 else raw + b"\0" * (-len(raw) % 8)
        return struct.pack("<Q", len(tags)) + entries + struct.pack("<Q", 0) + behind

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        store, folder = fs.FileSystem.from_uri(self.path)
        done, out, name = [], None, None

        def close():
            out.write(b"\0" * (-at % 8))
            out.write(self._directory(width, height, offsets, lengths, at + -at % 8))
            out.close()

        for b in batches:
            for file, tile, wide, high, stored, data in zip(*(b.column(c).to_pylist() for c in ("file", "tile", "width", "height", "stored", "data"))):
                if file != name:
                    if out is not None:
                        close()
                    name, width, height, at = file, wide, high, 16
                    tiles = len(self.bands) * -(-high // self.tile[0]) * -(-wide // self.tile[1])
                    offsets, lengths = np.zeros(tiles, np.uint64), np.zeros(tiles, np.uint64)
                    temporary = f"{folder}/_temporary-{self.run}/{uuid.uuid4().hex}"
                    store.create_dir(temporary.rpartition("/")[0], recursive=True)
                    out = store.open_output_stream(temporary, compression=None)
                    out.write(struct.pack("<2sHHHQ", b"II", 43, 8, 0, 16 + stored + -stored % 8))
                    done.append((temporary, f"{folder}/{file}"))
                out.write(data)
                offsets[tile], lengths[tile] = at, len(data)
                at += len(data)
        if out is not None:
            close()
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        store, folder = fs.FileSystem.from_uri(self.path)
        store.create_dir(folder, recursive=True)
        for temporary, final in (pair for m in messages if m for pair in m.files):
            store.create_dir(final.rpartition("/")[0], recursive=True)
            store.move(temporary, final)
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        store, folder = fs.FileSystem.from_uri(self.path)
        if store.get_file_info(f"{folder}/_temporary-{self.run}").type == fs.FileType.Directory:
            store.delete_dir(f"{folder}/_temporary-{self.run}")


class GeoTiff(DataSource):
    @classmethod
    def name(cls) -> str:
        return "geotiff"

    def schema(self) -> str:
        return CELLS

    def reader(self, schema) -> DataSourceReader:
        return (PushingReader if self.options.get("pushing") == "true" else Reader)(dict(self.options))

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(dict(self.options))


def _registered(spark: SparkSession) -> None:
    ship_package(spark)
    spark.dataSource.register(GeoTiff)


def read_geotiff(spark: SparkSession, path: str, window: tuple[int, int, int, int] | None = None, bands: list[str] | None = None) -> DataFrame:
    """(file, band, y, x, value) of the files below path, a file by its place there.

    window: first row, first column, last row and last column; bands: their names."""
    _registered(spark)
    read = spark.read.format("geotiff").option("pushing", spark.conf.get("spark.sql.python.filterPushdown.enabled", "false"))
    if window:
        read = read.option("window", ",".join(map(str, window)))
    if bands:
        read = read.option("bands", "\n".join(bands))
    return read.load(path)


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """(file, width, height, tile_height, tile_width, bands, epsg, scale, tie_point) of the files below path, in tasks of a few files."""
    ship_package(spark)
    listed = spark.createDataFrame([(f,) for f, _ in _files(path)], "file string")
    schema = "file string, width bigint, height bigint, tile_height bigint, tile_width bigint, bands array<string>, epsg int, scale array<double>, tie_point array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = fs.FileSystem.from_uri(path)
        names = [c.split()[0] for c in schema.split(", ")]
        kinds = [pa.string(), *[pa.int64()] * 4, pa.list_(pa.string()), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64())]
        for b in batches:
            rows = []
            for file in b.column(0).to_pylist():
                with store.open_input_file(file) as f:
                    h = Header(f, _name(folder, file))
                rows.append((h.name, h.width, h.height, *h.tile, h.names, h.epsg(), h.tags.get(PIXEL_SCALE), h.tags.get(TIE_POINT)))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)

    return listed.mapInArrow(run, schema)


def _packed(cells: DataFrame, bands: list[str], tile: tuple[int, int]) -> DataFrame:
    """Tiles (file, plane, down, across, bottom, right, data) of cells (file, band, y, x, value), packed while sorted rows stream past."""
    high, wide = tile
    place = F.array_position(F.array(*map(F.lit, bands)), F.col("band")) - 1
    down, across = F.floor(F.col("y") / high), F.floor(F.col("x") / wide)
    rows = cells.filter("file IS NOT NULL AND y >= 0 AND x >= 0").select("file", place.alias("plane"), down.alias("down"), across.alias("across"), (F.col("y") % high).alias("r"), (F.col("x") % wide).alias("c"), F.col("value").cast("float").alias("value"))
    keys = ["file", "plane", "down", "across"]
    rows = rows.filter("plane >= 0").repartition(*keys).sortWithinPartitions(*keys)
    schema = "file string, plane bigint, down bigint, across bigint, bottom bigint, right bigint, data binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, cell, reach = None, None, (0, 0)

        def packed() -> pa.RecordBatch:
            row = (*now, now[2] * high + reach[0], now[3] * wide + reach[1], zlib.compress(cell.tobytes(), 6))
            kinds = [pa.string(), *[pa.int64()] * 5, pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds)], names=[*keys, "bottom", "right", "data"])

        for b in batches:
            if not b.num_rows:
                continue
            change = np.zeros(b.num_rows, bool)
            for k in range(4):
                column = b.column(k)
                change[1:] |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
            r, c, value = (b.column(k).to_numpy(zero_copy_only=False) for k in (4, 5, 6))
            cuts = [0, *np.flatnonzero(change), b.num_rows]
            for s, e in zip(cuts, cuts[1:]):
                key = tuple(b.column(k)[s].as_py() for k in range(4))
                if key != now:
                    if now is not None:
                        yield packed()
                    now, cell, reach = key, np.full((high, wide), np.nan, "<f4"), (0, 0)
                np.fmax.at(cell, (r[s:e], c[s:e]), value[s:e])
                reach = (max(reach[0], int(r[s:e].max())), max(reach[1], int(c[s:e].max())))
        if now is not None:
            yield packed()

    return rows.mapInArrow(run, schema)


def write_geotiff(cells: DataFrame, path: str, bands: list[str], tile: tuple[int, int] = (TILE, TILE), epsg: int | None = None, origin: tuple[float, float] | None = None, step: tuple[float, float] | None = None) -> None:
    """Write cells (file, band, y, x, value) as one GeoTIFF for each value of `file`, its place below path; all files have the named bands in this order.

    tile: rows and columns of a tile, multiples of 16. origin: x and y of the outer corner of cell (0, 0); step: width and height of a cell.
    """
    if tile[0] % 16 or tile[1] % 16 or not bands or len(set(bands)) != len(bands):
        raise ValueError("tiles have multiples of 16 rows and columns; bands have names of their own")
    spark = cells.sparkSession
    _registered(spark)
    packed = materialize(_packed(cells, bands, tile), "geotiff-tiles")
    sizes = packed.groupBy("file").agg((F.max("right") + 1).alias("width"), (F.max("bottom") + 1).alias("height"), F.sum(F.octet_length("data")).alias("stored"))
    plane = F.ceil(F.col("height") / tile[0]) * F.ceil(F.col("width") / tile[1])
    number = F.col("plane") * plane + F.col("down") * F.ceil(F.col("width") / tile[1]) + F.col("across")
    rows = packed.join(sizes, "file").select("file", number.alias("tile"), "width", "height", "stored", "data")
    out = rows.repartition("file").sortWithinPartitions("file", "tile").write.format("geotiff").mode("append").option("bands", "\n".join(bands)).option("tile", f"{tile[0]},{tile[1]}")
    for name, value in (("epsg", epsg), ("origin", origin), ("step", step)):
        if value is not None:
            out = out.option(name, value if name == "epsg" else ",".join(map(repr, value)))
    out.save(path)
    discard(packed)

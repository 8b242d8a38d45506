"""WARC archives, index first.

Writing: each task writes archives of gzip members, one for each record, and yields a row for each with file, offset,
length, URL and digest; these rows are the index, written before anything is read. Reading: the chosen index rows are
dealt by file and stretch of file, sorted, and neighbouring byte ranges are fetched in one read.

Of records with equal payloads of at least REVISIT_BYTES bytes the one with the largest id is a response and the
others are revisits of it; rows that share the largest id are all responses, and so is a row with a null id if all
ids of its group are null. A null payload is empty, a null URL leaves its header out. Line breaks in a URL are written as
%0D and %0A. An empty table gives an empty index. A lost executor's task writes a new file; files that no index row
names are left over from such tasks.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burstmill.llm.texts import decoded
from burstmill.shared import materialize, maybe_broadcast, new_path, ship_package

REVISIT_BYTES = 1000
#: An archive is closed when it has this size.
FILE_BYTES = 512 << 20
#: Records of one stretch of a file are read by one task; reads bridge gaps and end at these sizes.
STRETCH = 32 << 20
MAX_TASKS = 100_000
GAP = 64 << 10
READ = 8 << 20
LEVEL = 4
DATE = "1970-01-01T00:00:00Z"
# Fixed values of the WARC 1.1 standard.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX = "page_id bigint, url string, digest string, record_type string, file string, offset bigint, length bigint"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record: an HTTP response with the payload, or a revisit with its header alone. digest: hexadecimal SHA-1."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = [
        VERSION,
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'none' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        *([] if url is None else ["WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A")]),
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        *([] if refers_to is None else [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """The fields of one record; a response's payload is checked against its digest."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines)
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    size = int(http.decode().rpartition("Content-Length: ")[2])
    kind = fields["WARC-Type"]
    if version != VERSION or kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    number = lambda name: None if (x := fields.get(name, "none")[10:-1]) in ("", "none") else int(x)
    return {
        "page_id": number("WARC-Record-ID"),
        "url": fields.get("WARC-Target-URI"),
        "payload_bytes": size,
        "payload_digest": digest,
        "record_type": kind,
        "refers_to": number("WARC-Refers-To"),
        "payload": payload if kind == "response" else None,
    }


def write_archives(pages: DataFrame, path: str | None = None, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write a record for every row below path (a new folder in the shared one, if not given); returns the index."""
    spark = pages.sparkSession
    ship_package(spark)
    path = path or new_path(spark, "warc")
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("binary").alias("url"), payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    long = rows.filter(F.octet_length("payload") >= REVISIT_BYTES)
    first = long.groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", "first")
    first = maybe_broadcast(materialize(first, "warc-repeated"))
    refers = F.when((F.octet_length("payload") >= REVISIT_BYTES) & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    rows = rows.join(first, "digest", "left").select("page_id", "url", "payload", "digest", refers.alias("refers_to"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = fs.FileSystem.from_uri(path)
        out, file, at, index = None, "", 0, []

        def closed() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*index), kinds)], names=names)

        names = ["page_id", "url", "digest", "record_type", "file", "offset", "length"]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
        for b in batches:
            for k in range(b.num_rows):
                number, link, body, digest, refers_to = (c[k].as_py() for c in b.columns)
                link = None if link is None else decoded(link)
                if out is None:
                    store.create_dir(folder, recursive=True)
                    file, at, index = f"pages-{uuid.uuid4().hex}.warc.gz", 0, []
                    out = store.open_output_stream(f"{folder}/{file}", compression=None)
                z = zlib.compressobj(LEVEL, wbits=31)
                member = z.compress(record(number, link, body, digest, refers_to)) + z.flush()
                out.write(member)
                index.append((number, link, digest, "response" if refers_to is None else "revisit", f"{path}/{file}", at, len(member)))
                at += len(member)
                if at >= FILE_BYTES:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()

    return materialize(rows.mapInArrow(write, INDEX), "warc-index")


_FIELDS = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def read_records(index: DataFrame, payloads: bool = True) -> DataFrame:
    """The records that the index rows name, and with payloads their payload (null for revisits)."""
    ship_package(index.sparkSession)
    stretch = F.floor(F.col("offset") / STRETCH)
    # by the archives' bytes: the index, which is what the shuffle sees, is a small part of them
    tasks = min(MAX_TASKS, -(-(index.agg(F.sum("length")).first()[0] or 1) // STRETCH))
    chosen = index.select("file", "offset", "length").repartition(tasks, "file", stretch).sortWithinPartitions("file", "offset")
    schema = _FIELDS + (", payload binary" if payloads else "")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = list(zip(*(c.to_pylist() for c in b.columns)))
            start = 0
            while start < len(rows):
                file, first, length = rows[start]
                end, stop = first + length, start + 1
                while stop < len(rows) and rows[stop][0] == file and rows[stop][1] - end <= GAP and rows[stop][1] + rows[stop][2] - first <= READ:
                    end, stop = max(end, rows[stop][1] + rows[stop][2]), stop + 1
                store, name = fs.FileSystem.from_uri(file)
                with store.open_input_file(name) as f:
                    data = f.read_at(end - first, first)
                found = [parse(zlib.decompress(data[at - first : at - first + n], wbits=31)) for _, at, n in rows[start:stop]]
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
                names = [*(x.split()[0] for x in _FIELDS.split(", ")), "payload"][: 6 + payloads]
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in found], t) for n, t in zip(names, kinds)], names=names)
                start = stop

    return chosen.mapInArrow(read, schema)

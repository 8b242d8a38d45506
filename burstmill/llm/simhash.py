"""Near-duplicates by SimHash, with Golay-code fuzzy hashing for the search.

Texts have A-Z lower-cased and are cut into words (runs of bytes other than space and U+0009 to U+000D). Every 3-word
shingle, repeats included, is hashed with XXH64, seed 42; a fingerprint bit is 1 if over half the hashes have it set.
Two fingerprints are linked if at most 2 of their 64 bits differ; components of links are the groups of near-copies.

The search for links works on distinct fingerprints. A fingerprint is cut into segments of 22, 21 and 21 bits. If two
fingerprints differ in at most 2 bits, then for one of the ordered pairs (1,2), (2,3), (3,1) of segments the first is
equal in both and the second differs in at most 1 bit: of the three segments one is free of errors, and going round
from it one meets a segment with at most 1. The second segment is hashed by the perfect [23,12,7] Golay code: the code
words that decode it and its 1-bit neighbours are one or six, and two words at distance 1 have one in common. So a key
is the first segment with a codeword index of the second. Keys that few fingerprints share are joined and the pairs
verified. Where more than MAX_BUCKET share a key, pairs would grow with the square; there each fingerprint is dealt to
its own value and its 64 one-bit neighbours instead. Fingerprints that meet at such a value differ in at most 2 bits,
and any that do meet at one, so linking each to the smallest there loses no link's component.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burstmill.operators.components import connected_components
from burstmill.llm.texts import pieces, text_of
from burstmill.shared import fresh, materialize, ship_package, with_field

SHINGLE = 3
MAX_DISTANCE = 2
SEED = 42
#: Fingerprints that share a key are paired up to this number; more of them meet at one-bit neighbours.
MAX_BUCKET = 16
#: Shingles whose bits are counted at once.
_BLOCK = 65_536

#: Fixed value: generator polynomial of the [23,12,7] Golay code, x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GOLAY_POLYNOMIAL = 0b101011100011
#: Bit positions where each segment of a fingerprint starts, and bits that it has.
SEGMENTS = ((0, 22), (22, 21), (43, 21))


def fingerprint(text: str | None) -> int:
    """The text's fingerprint as an unsigned integer; 0 for null and for texts without a word."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        shingles, n = iter([b" ".join(words)]), 1
    else:
        shingles, n = map(b" ".join, zip(words, words[1:], words[2:])), len(words) - SHINGLE + 1
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for k in range(0, n, _BLOCK):
        bits = np.unpackbits(hashes[k : k + _BLOCK].view(np.uint8), bitorder="little").reshape(-1, 64)
        ones += bits.sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def with_fingerprint(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs' kept columns (all, if not given) and the fingerprint, a bigint with the same 64 bits, as the last column.

    Bytes that are not UTF-8 count as U+FFFD."""
    ship_package(docs.sparkSession)
    keep = docs.columns if keep is None else keep
    name, at = fresh(docs, "fingerprint"), fresh(docs, "text_read")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            found = np.array([fingerprint(text_of(x)) for x in b.column(b.num_columns - 1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(found)], names=[*b.schema.names[:-1], name])

    return docs.select(*keep, F.col(text).alias(at)).mapInArrow(run, with_field(docs.select(*keep).schema, name, "bigint"))


def _remainder(values: np.ndarray) -> np.ndarray:
    """Syndromes: remainders of 23-bit words, as polynomials over GF(2), by the generator."""
    values = values.copy()
    for bit in range(22, 10, -1):
        values ^= (values >> bit & 1) * (GOLAY_POLYNOMIAL << bit - 11)
    return values


def _decoder() -> tuple[np.ndarray, np.ndarray]:
    """The error pattern of up to 3 bits for each of the 2048 syndromes, and the syndromes of single bits."""
    single = 1 << np.arange(23, dtype=np.int64)
    patterns = np.unique((np.r_[0, single][:, None, None] | np.r_[0, single][None, :, None] | np.r_[0, single][None, None, :]).ravel())
    errors = np.zeros(2048, np.int64)
    errors[_remainder(patterns)] = patterns
    return errors, _remainder(single)


def golay_keys(segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The codeword index of each 23-bit word, and those of the word and its 23 one-bit neighbours (n x 24)."""
    errors, single = _decoder()
    syndrome = _remainder(segment)
    own = (segment ^ errors[syndrome]) >> 11
    flips = 1 << np.arange(23, dtype=np.int64)
    near = (segment[:, None] ^ flips ^ errors[syndrome[:, None] ^ single]) >> 11
    return own, np.column_stack([own, near])


def fuzzy_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position in prints, key, whether the key comes from the fingerprint's own segment) of all keys."""
    cut = [(prints >> np.uint64(at) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    rows, keys, owns = [], [], []
    for k in range(3):
        own, near = golay_keys(cut[(k + 1) % 3])
        near = np.sort(near, 1)
        new = np.column_stack([np.ones(len(near), bool), near[:, 1:] != near[:, :-1]])
        row, col = np.nonzero(new)
        rows.append(row)
        keys.append((np.int64(k) << 34) | cut[k][row] << 12 | near[row, col])
        owns.append(near[row, col] == own[row])
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(owns)


def _dealt(prints: DataFrame) -> DataFrame:
    """(key, f, own) of each distinct fingerprint f."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = b.column(0).to_numpy()
            row, key, own = fuzzy_keys(f.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(f[row]), pa.array(own)], names=["key", "f", "own"])

    return prints.select("f").mapInArrow(run, "key bigint, f bigint, own boolean")


def links(prints: DataFrame) -> DataFrame:
    """(a, b), a < b, over distinct fingerprints `f`: links whose components are those of all pairs at most 2 bits apart."""
    ship_package(prints.sparkSession)
    dealt = materialize(_dealt(prints), "simhash-keys")
    counts = dealt.groupBy("key").agg(F.count("*").alias("n"), F.count_if("own").alias("owns")).filter("n > 1 and owns > 0")
    shared = materialize(counts, "simhash-shared")
    met = materialize(dealt.join(shared.select("key", "n"), "key"), "simhash-met")
    few, many = met.filter(F.col("n") <= MAX_BUCKET), met.filter(F.col("n") > MAX_BUCKET)
    # at most MAX_BUCKET rows share a key here, so the lists are short and the pairs a bounded multiple of the rows
    lists = few.groupBy("key").agg(F.collect_list("f").alias("fs"), F.collect_list(F.when(F.col("own"), F.col("f"))).alias("owns"))
    pairs = lists.select(F.explode("owns").alias("x"), "fs").select("x", F.explode("fs").alias("y")).filter("x <> y and bit_count(x ^ y) <= 2")
    bits = F.array(F.lit(0).cast("long"), *(F.lit(1 << k if k < 63 else -(1 << 63)).cast("long") for k in range(64)))
    value = many.select("f").distinct().select("f", F.explode(F.transform(bits, lambda bit: F.col("f").bitwiseXOR(bit))).alias("v"))
    stars = materialize(value.groupBy("v").agg(F.min("f").alias("x"), F.max("f").alias("y")).filter("x < y"), "simhash-stars")
    at = value.join(stars.select("v", "x"), "v").select("x", F.col("f").alias("y")).filter("x < y")
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).unionByName(at.select(F.col("x").alias("a"), F.col("y").alias("b"))).distinct()


def classes(marked: DataFrame, print_col: str, key: str) -> DataFrame:
    """(f, component_id): for each distinct fingerprint the smallest key that links lead to (null if all are null)."""
    prints = materialize(marked.groupBy(F.col(print_col).alias("f")).agg(F.min(key).alias("least")), "simhash-prints")
    root = connected_components(links(prints))
    merged = prints.join(root.withColumnRenamed("node", "f"), "f", "left").withColumn("root", F.coalesce("root", "f"))
    merged = materialize(merged, "simhash-roots")
    least = merged.groupBy("root").agg(F.min("least").alias("component_id"))
    return merged.select("f", "root").join(least, "root").select("f", "root", "component_id")


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, fingerprint as 16 hex digits, component_id) for every row, repeated rows included."""
    marked = with_fingerprint(docs, text, [key])
    name = marked.columns[-1]
    marked = materialize(marked, "simhash-marked")
    found = classes(marked, name, key)
    hexed = F.lower(F.lpad(F.hex(F.col(name)), 16, "0"))
    return marked.join(found.withColumnRenamed("f", name), name).select(key, hexed.alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs with one row of each group of near-copies: the one with the smallest key.

    Rows with a null key count as larger than any other; of several rows that share the smallest key one stays.
    """
    columns = docs.columns
    row = fresh(docs, "row_number")
    marked = with_fingerprint(docs, text).withColumn(row, F.monotonically_increasing_id())
    marked = materialize(marked, "simhash-docs")  # from here on the row numbers stand
    name = marked.columns[-2]
    found = classes(marked, name, key).select(F.col("f").alias(name), "root")
    narrow = marked.select(F.col(key).alias("k"), F.col(row).alias("r"), name).join(found, name)
    first = F.min(F.struct(F.col("k").isNull().alias("last"), F.col("k").alias("k"), F.col("r").alias("r")))
    groups = narrow.groupBy("root").agg(first.alias("best"), F.count("*").alias("n")).filter("n > 1").select("root", F.col("best.r").alias("best"))
    # written first, so that the join below has plain shuffles on both sides and adaptive execution can split a large group
    groups = materialize(groups, "simhash-groups")
    copies = materialize(narrow.join(groups, "root").filter("r <> best").select(F.col("r").alias(row)), "simhash-copies")
    return marked.join(copies, row, "left_anti").select(*columns)

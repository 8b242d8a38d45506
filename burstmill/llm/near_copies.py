"""Near copies by 5-word shingles: texts whose sets of shingles have a Jaccard similarity of 0.8 or more are linked.

Words are those of simhash. A text of fewer than 5 words has one shingle, all its words; a text without words (null
too) has one empty shingle. Groups are the components of links. Texts with the same words are one node.

At 0.8 two SimHash fingerprints differ in some 10 of 64 bits, far beyond what Golay keys reach, so candidates come from
three sources: Golay keys (fingerprints at most 2 bits apart), equal fingerprints, and BANDS min-wise hashes of ROWS rows
each, which miss a pair of similarity 0.8 with probability (1 - 0.8^4)^20 = 3e-5. Candidates are verified by their sets.

Of the nodes that share a key, those whose shingles are mostly in no other node are left out, which no near copy is. The
rest are all compared, but pairs are not written out where more than MAX_BUCKET do. Such a bucket is
first compared with REPS of its members, in the first bands alone. What then lies in one component needs no more
comparison; in a bucket of several components the members outside the largest are compared with all others. This goes in
blocks of bounded size, whose counts of common shingles are matrix products, and a block passes on a link from each
node to the smallest one that it leads to, not its pairs. So no link between components is lost, and the work grows with
the square of a group only where its members share keys and are no near copies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burstmill.llm import simhash
from burstmill.llm.texts import pieces, text_of
from burstmill.operators.components import connected_components
from burstmill.shared import fresh, materialize, ship_package, with_field

SHINGLE = 5
BANDS, ROWS = 20, 4
MAX_BUCKET = 16
REPS = 4
#: Bands whose crowded buckets are compared with REPS of their members.
STAR_BANDS = 4
#: Nodes and shingles that one side of a block has, on average, at most.
BLOCK_NODES, BLOCK_SHINGLES = 2048, 1_000_000
SEED = 42
#: Shingles that are mixed at once; shingles that are columns of a dense product at once.
_BLOCK = 512
_COLUMNS = 512
#: Rows of a block whose shares are compared at once.
_ROWS = 256
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Each product of a hash and a factor gives two 32-bit hashes.
_FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * ROWS // 2, np.uint64) * np.uint64(2) + np.uint64(1)


def _words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()


def shingles(words: list[bytes]) -> np.ndarray:
    """Hashes of the distinct shingles, sorted."""
    if len(words) < SHINGLE:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    w = np.fromiter((xxhash.xxh64_intdigest(x, SEED) for x in words), np.uint64, len(words))
    n = len(w) - SHINGLE + 1
    h = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        h = (h ^ w[k : k + n]) * _ODD
        h ^= h >> np.uint64(29)
    return np.unique(h)


def band_keys(found: np.ndarray) -> np.ndarray:
    """One key for each band, of ROWS smallest hashes each."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint32).max, np.uint32)
    for s in range(0, len(found), _BLOCK):
        least = np.minimum(least, (found[s : s + _BLOCK, None] * _FACTORS).view(np.uint32).min(0))
    key = np.zeros(BANDS, np.uint64)
    for row in least.reshape(BANDS, ROWS).T.astype(np.uint64):
        key = (key ^ row) * _ODD
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def _marked(docs: DataFrame, text: str) -> tuple[DataFrame, str, str, str, str]:
    """docs with fingerprint, digest of the words, band keys and a row number; and the names of these columns."""
    found = simhash.with_fingerprint(docs, text)
    print_ = found.columns[-1]
    same, bands, row = fresh(found, "same_words"), fresh(found, "bands"), fresh(found, "row_number")
    at = found.columns.index(text)
    schema = with_field(with_field(found.schema, same, "string"), bands, "array<bigint>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            digests, keys = [], []
            for x in b.column(at):  # the words of one text at a time: those of a batch take much more memory than its texts
                words = _words(text_of(x))
                digests.append(xxhash.xxh3_128_hexdigest(b" ".join(words)))
                keys.append(band_keys(shingles(words)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(digests, pa.string()), pa.array(keys, pa.list_(pa.int64()))], names=[*b.schema.names, same, bands])

    return found.mapInArrow(run, schema).withColumn(row, F.monotonically_increasing_id()), print_, same, bands, row


def buckets(nodes: DataFrame) -> DataFrame:
    """(band, key, node, n) of the nodes (node, f, bands) that share a key with others, n nodes in all."""
    keys = nodes.select("node", F.posexplode(F.concat(F.array("f"), "bands")).alias("band", "key"))
    counts = keys.groupBy("band", "key").agg(F.count("*").alias("n")).filter("n > 1")
    return keys.join(materialize(counts, "near-copies-buckets"), ["band", "key"])


def golay_pairs(nodes: DataFrame) -> DataFrame:
    """(x, y): nodes whose fingerprints lie within the reach of Golay keys, one node for each fingerprint."""
    prints = nodes.groupBy("f").agg(F.min("node").alias("node"))
    near = simhash.links(prints.select("f"))
    of = lambda side: prints.select(F.col("f").alias(side), F.col("node").alias("x" if side == "a" else "y"))
    return near.join(of("a"), "a").join(of("b"), "b").select("x", "y")


def partnered(sets: DataFrame) -> DataFrame:
    """(node): those that can have a near copy among the nodes of sets.

    Of a near copy's shingles four fifths are in its partner, so no more than one fifth may be in no other node. Shingles
    are told apart by half of their hash; two that fall together count as shared, which keeps a node and loses none.
    """
    each = sets.select("node", F.explode("found").alias("x")).select("node", F.shiftright("x", 32).cast("int").alias("x"))
    alone = each.groupBy("x").agg(F.count("*").alias("n"), F.min("node").alias("node")).filter("n = 1").groupBy("node").agg(F.count("*").alias("alone"))
    return sets.select("node", F.size("found").alias("n")).join(alone, "node", "left").filter(5 * F.coalesce("alone", F.lit(0)) <= F.col("n")).select("node")


def sets_of(wanted: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, found): the shingles of the wanted nodes; texts: (node, text)."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            found = pa.array([shingles(_words(text_of(x))).view(np.int64) for x in b.column(1)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), found], names=["node", "found"])

    return texts.join(wanted, "node").select("node", "text").mapInArrow(sets, "node bigint, found array<bigint>")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            good = []
            for x, y in zip(b.column(2), b.column(3)):
                x, y = x.values.to_numpy(), y.values.to_numpy()
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(5 * both >= 4 * (len(x) + len(y) - both))
            yield b.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    one, two = (sets.select(F.col("node").alias(k), F.col("found").alias(k + "_set")) for k in ("a", "b"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "a_set", "b_set").mapInArrow(keep, "a bigint, b bigint")


def _common(one: tuple[np.ndarray, np.ndarray], two: tuple[np.ndarray, np.ndarray], shape: tuple[int, int]) -> np.ndarray:
    """How many shingles each row of one side shares with each of the other; sides: (row, shingle) of all shingles."""
    shared = np.intersect1d(one[1], two[1])
    out = np.zeros(shape, np.float32)
    sides = []
    for row, what in (one, two):
        at = np.searchsorted(shared, what)
        met = shared[np.minimum(at, len(shared) - 1)] == what if len(shared) else np.zeros(len(what), bool)
        row, at = row[met], at[met]
        order = np.argsort(at, kind="stable")
        sides.append((row[order], at[order]))
    for s in range(0, len(shared), _COLUMNS):
        dense = []
        for (row, at), n in zip(sides, shape):
            cut = slice(np.searchsorted(at, s), np.searchsorted(at, s + _COLUMNS))
            part = np.zeros((n, min(_COLUMNS, len(shared) - s)), np.float32)
            part[row[cut], at[cut] - s] = 1
            dense.append(part)
        out += dense[0] @ dense[1].T
    return out


def _linked_in_block(rows: pa.Table) -> pa.Table:
    """(a, b): links from each node to the smallest one that links lead to, between the two sides of a block."""
    nothing = pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
    sides = []
    for k in (0, 1):
        part = rows.filter(pa.array(rows["side"].to_numpy() == k))
        if not part.num_rows:
            return nothing
        found = part["found"].combine_chunks()
        sizes = np.diff(found.offsets.to_numpy())
        sides.append((part["node"].to_numpy(), sizes, (np.repeat(np.arange(len(sizes)), sizes), found.values.to_numpy()[found.offsets[0].as_py() : found.offsets[-1].as_py()])))
    (u, nu, one), (v, nv, two) = sides
    both = _common(one, two, (len(u), len(v)))
    cuts = [slice(s, s + _ROWS) for s in range(0, len(u), _ROWS)]
    near = [5 * both[c] >= 4 * (nu[c, None] + nv[None, :] - both[c]) for c in cuts]
    del both
    least_u, least_v = u.copy(), v.copy()
    far = np.iinfo(np.int64).max
    while True:
        new_v = least_v
        for c, x in zip(cuts, near):
            new_v = np.minimum(new_v, np.where(x, least_u[c, None], far).min(0))
        new_u = np.concatenate([np.minimum(least_u[c], np.where(x, new_v[None, :], far).min(1)) for c, x in zip(cuts, near)])
        if (new_u == least_u).all() and (new_v == least_v).all():
            break
        least_u, least_v = new_u, new_v
    a, b = np.concatenate([u, v]), np.concatenate([least_u, least_v])
    return pa.table({"a": a[a != b], "b": b[a != b]})


def block_links(members: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): links between the members (band, key, node, size, chosen) of a bucket that are chosen and all of it."""
    counted = members.groupBy("band", "key").agg(F.count_if("chosen").alias("n0"), F.sum(F.when(F.col("chosen"), F.col("size"))).alias("s0"), F.count("*").alias("n1"), F.sum("size").alias("s1"))
    parts = lambda k: F.greatest(F.ceil(F.col(f"n{k}") / BLOCK_NODES), F.ceil(F.col(f"s{k}") / BLOCK_SHINGLES)).alias(f"p{k}")
    counted = materialize(counted.filter("n0 > 0").select("band", "key", parts(0), parts(1)), "near-copies-parts")
    dealt = members.join(counted, ["band", "key"])
    mine = lambda k: F.pmod(F.xxhash64(F.lit(SEED), "node"), F.col(f"p{k}"))
    other = lambda k: F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"p{k}") - 1))
    one = dealt.filter("chosen").select("band", "key", "node", F.lit(0).alias("side"), mine(0).alias("block0"), other(1).alias("block1"))
    two = dealt.select("band", "key", "node", F.lit(1).alias("side"), mine(1).alias("block1"), other(0).alias("block0"))
    rows = one.unionByName(two).join(sets, "node").select("band", "key", "block0", "block1", "side", "node", "found")
    return rows.groupBy("band", "key", "block0", "block1").applyInArrow(_linked_in_block, "a bigint, b bigint").distinct()


def groups_of(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, root) of all nodes (node, f, bands, size) that are linked to others; size: the number of words."""
    golay = materialize(golay_pairs(nodes), "near-copies-golay")
    wanted = buckets(nodes).select("node").union(golay.select(F.explode(F.array("x", "y")))).distinct()
    sets = materialize(sets_of(wanted, texts), "near-copies-sets")
    known = materialize(partnered(sets), "near-copies-partnered")
    met = materialize(buckets(nodes.join(known, "node", "left_semi")), "near-copies-met")
    # at most MAX_BUCKET nodes share a key here
    lists = met.filter(F.col("n") <= MAX_BUCKET).groupBy("band", "key").agg(F.collect_list("node").alias("all"))
    few = lists.select(F.explode("all").alias("x"), "all").select("x", F.explode("all").alias("y"))
    pairs = few.union(golay).filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    crowded = materialize(met.filter(F.col("n") > MAX_BUCKET).join(nodes.select("node", "size"), "node"), "near-copies-crowded")
    star = crowded.filter(F.col("band") <= STAR_BANDS)
    # the members with the smallest hashes, one of each of REPS parts of all hashes
    h = F.xxhash64(F.lit(SEED), "node", "key")
    first = F.array(*(F.min(F.when(F.pmod(h, F.lit(REPS)) == k, F.struct(h.alias("h"), "node")))["node"] for k in range(REPS)))
    reps = materialize(star.groupBy("band", "key").agg(first.alias("reps")), "near-copies-reps")
    star = star.join(reps, ["band", "key"]).withColumn("chosen", F.array_contains("reps", F.col("node")))
    links = materialize(verified(pairs, sets).union(block_links(star, sets)), "near-copies-links")
    root = materialize(connected_components(links), "near-copies-root")
    at = materialize(crowded.join(root, "node", "left").withColumn("root", F.coalesce("root", "node")), "near-copies-at")
    counts = at.groupBy("band", "key", "root").agg(F.count("*").alias("held"))
    largest = counts.groupBy("band", "key").agg(F.max(F.struct("held", "root"))["root"].alias("largest"), F.count("*").alias("roots")).filter("roots > 1")
    rest = at.join(materialize(largest, "near-copies-open"), ["band", "key"]).withColumn("chosen", F.col("root") != F.col("largest"))
    more = materialize(block_links(rest, sets), "near-copies-more")
    return root if more.isEmpty() else connected_components(links.union(more))


def deduplicate(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs with one row of each group of near copies: the one with the smallest key.

    Rows with a null key count as larger than any other; of several rows that share the smallest key one stays.
    """
    ship_package(docs.sparkSession)
    marked, print_, same, bands, row = _marked(docs, text)
    marked = materialize(marked, "near-copies-docs")  # from here on the row numbers stand
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)) + 1
    nodes = marked.groupBy(F.col(same).alias("same")).agg(F.min(row).alias("node"), F.min(print_).alias("f"), F.min(bands).alias("bands"), F.max(size).alias("size"))
    nodes = materialize(nodes, "near-copies-nodes")
    root = groups_of(nodes, marked.select(F.col(row).alias("node"), F.col(text).alias("text")))
    found = nodes.select("same", "node").join(root, "node", "left").select("same", F.coalesce("root", "node").alias("root"))
    narrow = marked.select(F.col(key).alias("k"), F.col(row).alias("r"), F.col(same).alias("same")).join(materialize(found, "near-copies-roots"), "same")
    first = F.min(F.struct(F.col("k").isNull().alias("last"), F.col("k").alias("k"), F.col("r").alias("r")))
    groups = narrow.groupBy("root").agg(first.alias("best"), F.count("*").alias("n")).filter("n > 1").select("root", F.col("best.r").alias("best"))
    # written first, so that the join below has plain shuffles on both sides and adaptive execution can split a large group
    groups = materialize(groups, "near-copies-groups")
    copies = materialize(narrow.join(groups, "root").filter("r <> best").select(F.col("r").alias(row)), "near-copies-copies")
    return marked.join(copies, row, "left_anti").select(*docs.columns)

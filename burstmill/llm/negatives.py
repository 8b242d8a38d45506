"""Hard negatives by distributed radix selection on integer scores.

A window is an anchor, a range of scores and a number k; wanted are the k rows of highest score in the range, of the anchor's
label or of any other one. Rows and anchors meet in blocks: anchors in blocks of `ANCHORS`, rows in slices, and a cell is a
block and a slice. A cell's rows are dealt and sorted so that anchors come first and rows stream past them, by products of
integer matrices. With u = the range's upper end minus the score:

1. For each digit of u, from the highest, every cell counts its rows by that digit within each window's current interval;
   the sums over the cells tell in which digit the k-th row lies, and that digit is the next interval. A cell sends no
   digit behind the one in which it has k rows of its own, as the k-th of all can't lie there.
2. The last digit gives the k-th row's u exactly. One more pass gathers rows up to it, of each cell the first k alone; ties
   at the limit go to smaller ids.

So nothing but k digits or k rows leaves a cell for each window, whatever the number of rows that tie.

A row takes part if neither id, label nor vector is null and no component is null, NaN or infinite. Components become
floor(scale * x) in double precision, shorter vectors end in zeros, an empty one is zero. Scores must fit in 62 bits, else
an error is raised. Products are exact: in single or double precision where the largest norm proves it, else in integers.
Rows that repeat an id are rows of their own, but for an anchor no row of its own id counts; anchors that repeat an id
with equal label and vector are one. Labels are compared as text. Tables without rows or anchors give no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from burstmill.shared import discard, materialize, ship_package

#: Anchors of a block, rows of a slice, bits of a digit, and anchors that are multiplied at a time.
ANCHORS, SLICE, DIGIT, STRIP = 1 << 15, 1 << 17, 10, 128


def prepared(rows: DataFrame, scale: float = 256, id: str = "vec_id", label: str = "label", vector: str = "embedding", anchor: Column | None = None) -> tuple[DataFrame, int]:
    """(id, label, vector, is_anchor, pos) of the rows that take part, written, and a bound of all scores' magnitude."""
    v = F.col(vector).cast("array<double>")
    used = rows.select(F.col(id).cast("long").alias("id"), F.col(label).cast("string").alias("label"), v.alias("v"), (F.lit(False) if anchor is None else F.coalesce(anchor, F.lit(False))).alias("is_anchor"))
    used = used.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull()).filter(F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False)))
    scaled = used.withColumn("v", F.transform("v", lambda x: x * F.lit(float(scale))))
    largest, width, norm = scaled.agg(
        F.max(F.array_max(F.transform("v", F.abs))), F.max(F.size("v")), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + (F.abs(x) + 1) * (F.abs(x) + 1)))
    ).first()
    if norm is not None and norm >= 2**62:
        raise ValueError("scores don't fit in 62 bits")
    kind = "smallint" if (largest or 0) < 2**15 - 2 else "int" if largest < 2**31 - 2 else "bigint"
    whole = F.transform("v", lambda x: F.floor(x))
    padded = F.concat(whole, F.array_repeat(F.lit(0).cast("long"), F.lit(width or 0) - F.size("v")))
    out = scaled.select("id", "label", padded.cast(f"array<{kind}>").alias("vector"), "is_anchor", F.monotonically_increasing_id().alias("pos"))
    return materialize(out, "integer-vectors"), int(norm or 0)


class _Block:
    """The anchors of a cell and what their windows have found so far.

    A window's finds are sorted by its number, then by value (a digit, or u), then by id. limit is the value behind which
    nothing counts any more.
    """

    def __init__(self, table: pa.Table, same: bool, bound: int, gather: bool, shift: int):
        self.same, self.gather, self.shift = same, gather, shift
        dims = table["vector"].combine_chunks()
        n = table.num_rows
        # every product and all sums of them lie within the bound, so a float with that many digits is exact
        self.kind = np.float32 if bound < 1 << 22 else np.float64 if bound < 1 << 51 else np.int64
        self.a = dims.flatten().to_numpy(zero_copy_only=False).astype(self.kind).reshape(n, -1)
        self.own = table["id"].to_numpy()
        self.names = pc.unique(table["label"].combine_chunks())
        self.label = pc.index_in(table["label"].combine_chunks(), self.names).to_numpy(zero_copy_only=False)
        each = table["windows"].combine_chunks()
        sizes = pc.list_value_length(each).to_numpy()
        flat = each.flatten()
        self.anchor = np.repeat(np.arange(n), sizes)
        self.first = np.r_[0, np.cumsum(sizes)]
        self.key = np.repeat(table["key"].to_numpy(), sizes)
        self.w, self.top, self.begin, self.end = (flat.field(f).to_numpy(zero_copy_only=False) for f in ("w", "top", "begin", "end"))
        self.need = flat.field("need").to_numpy(zero_copy_only=False)
        self.limit = self.end.copy()  # the last u that counts
        self.found = np.zeros((3, 0), np.int64)  # window, value, id or count

    def add(self, rows: pa.Table) -> None:
        c = rows["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(self.kind).reshape(rows.num_rows, -1)
        ids = rows["id"].to_numpy()
        code = pc.fill_null(pc.index_in(rows["label"].combine_chunks(), self.names), -1).to_numpy(zero_copy_only=False)
        new = []
        for s in range(0, len(self.own), STRIP):
            e = min(s + STRIP, len(self.own))
            scores = c @ self.a[s:e].T
            alike = code[:, None] == self.label[None, s:e]
            wanted = (alike if self.same else ~alike) & (ids[:, None] != self.own[None, s:e])
            w0, w1 = self.first[s], self.first[e]
            if w0 == w1:
                continue
            at = self.anchor[w0:w1] - s
            # u = top - score lies between begin and limit
            high, low = self.top[w0:w1] - self.begin[w0:w1], self.top[w0:w1] - self.limit[w0:w1]
            of = scores[:, at]
            hit = (of <= high.astype(self.kind)) & (of >= low.astype(self.kind)) & wanted[:, at]
            r, w = np.nonzero(hit)
            if len(r):
                u = self.top[w0 + w] - of[r, w].astype(np.int64)
                new.append(np.stack([w0 + w, u if self.gather else (u - self.begin[w0 + w]) >> self.shift, ids[r] if self.gather else np.ones(len(r), np.int64)]))
        if new:
            self._merge(np.concatenate([self.found, *new], 1))

    def _merge(self, all: np.ndarray) -> None:
        if self.gather:
            all = all[:, np.lexsort((all[2], all[1], all[0]))]
            weight = np.ones(all.shape[1], np.int64)
        else:
            all = all[:, np.lexsort((all[1], all[0]))]
            first = np.flatnonzero(np.r_[True, (np.diff(all[0]) != 0) | (np.diff(all[1]) != 0)])
            weight = np.add.reduceat(all[2], first)
            all = np.stack([all[0, first], all[1, first], weight])
        # rows before each one in its window
        before = np.cumsum(weight) - weight
        start = np.flatnonzero(np.r_[True, np.diff(all[0]) != 0])
        before -= np.repeat(before[start], np.diff(np.r_[start, all.shape[1]]))
        keep = before < self.need[all[0]]
        closes = keep & (before + weight >= self.need[all[0]])
        w, v = all[0, closes], all[1, closes]
        self.limit[w] = np.minimum(self.limit[w], v if self.gather else self.begin[w] + ((v + 1) << self.shift) - 1)
        self.found = all[:, keep]

    def out(self, names: list[str]) -> pa.RecordBatch:
        w, value, last = self.found
        return pa.RecordBatch.from_arrays([pa.array(self.key[w]), pa.array(self.w[w], pa.int32()), pa.array(value), pa.array(last)], names=names)


def _pass(rows: DataFrame, anchors: DataFrame, blocks: int, slices: int, same: bool, bound: int, shift: int | None) -> DataFrame:
    """One pass over all cells: (key, w, digit, n), or (key, w, u, id) without a shift. anchors: (key, block, id, label, vector, windows)."""
    kind = anchors.schema["windows"].dataType.simpleString()
    numbers = lambda n: F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))
    near = anchors.select("block", F.explode(numbers(slices)).alias("slice"), F.lit(0).alias("side"), "key", "id", "label", "vector", "windows")
    slice_of = F.pmod(F.xxhash64("pos"), F.lit(slices)).alias("slice")
    far = rows.select(F.explode(numbers(blocks)).alias("block"), slice_of, F.lit(1).alias("side"), F.lit(None).cast("long").alias("key"), "id", "label", "vector", F.lit(None).cast(kind).alias("windows"))
    cells = near.unionByName(far).repartition("block", "slice").sortWithinPartitions("block", "slice", "side")
    names = ["key", "w", "u", "id"] if shift is None else ["key", "w", "digit", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from burstmill.llm.negatives import _Block

        cell, waiting, block = None, [], None

        def close() -> Iterator[pa.RecordBatch]:
            if block is not None and block.found.shape[1]:
                yield block.out(names)

        for b in batches:
            t = pa.Table.from_batches([b])
            key = np.stack([t[c].to_numpy() for c in ("block", "slice", "side")])
            edge = np.r_[0, np.flatnonzero((np.diff(key) != 0).any(0)) + 1, t.num_rows]
            for a, e in zip(edge[:-1].tolist(), edge[1:].tolist()):
                if a == e:
                    continue
                if cell != tuple(key[:2, a]):
                    yield from close()
                    cell, waiting, block = tuple(key[:2, a]), [], None
                part = t.slice(a, e - a)
                if key[2, a] == 0:
                    waiting.append(part)
                    continue
                if block is None and waiting:
                    block, waiting = _Block(pa.concat_tables(waiting), same, bound, shift is None, shift or 0), []
                if block is not None:
                    block.add(part)
        yield from close()

    return cells.mapInArrow(run, ", ".join(f"{n} {'int' if n == 'w' else 'bigint'}" for n in names))


def select(rows: DataFrame, anchors: DataFrame, windows: DataFrame, n_rows: int, blocks: int, same: bool, k: int, bound: int) -> DataFrame:
    """(key, w, rank, id, score): the first k rows of each window (key, w, low, high) of scores, of the anchor's label if same
    is set, else of other labels. anchors: (key, block, id, label, vector)."""
    spark = rows.sparkSession
    widest = windows.agg(F.max(F.col("high") - F.col("low"))).first()[0]
    digits = -(-max(1, int(widest or 0).bit_length()) // DIGIT)
    slices = max(-(-n_rows // SLICE), -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // blocks))

    def scan(state: DataFrame, shift: int | None) -> DataFrame:
        lists = state.groupBy("key").agg(F.collect_list(F.struct("w", "top", "begin", "end", "need")).alias("windows"))
        return _pass(rows, anchors.join(lists, "key"), blocks, slices, same, bound, shift)

    # the k-th row's u lies between begin and end, and need rows are missing before begin; with need 0 there are fewer than k
    zero = F.lit(0).cast("long")
    state = windows.filter("high >= low").select("key", "w", F.col("high").alias("top"), zero.alias("begin"), (F.col("high") - F.col("low")).alias("end"), F.lit(k).cast("long").alias("need"))
    for shift in reversed(range(0, digits * DIGIT, DIGIT)):
        sums = scan(state.filter("need > 0"), shift).groupBy("key", "w", "digit").agg(F.sum("n").alias("n"))
        upto = sums.withColumn("upto", F.sum("n").over(Window.partitionBy("key", "w").orderBy("digit"))).join(state.select("key", "w", "need"), ["key", "w"])
        hit = upto.filter("upto >= need AND upto - n < need").select("key", "w", "digit", (F.col("need") - F.col("upto") + F.col("n")).alias("left"))
        begin = F.col("begin") + F.col("digit") * F.lit(1 << shift)
        narrowed = state.join(hit, ["key", "w"], "left").select(
            "key", "w", "top", F.coalesce(begin, "begin").alias("begin"), F.least("end", F.coalesce(begin + F.lit((1 << shift) - 1), "end")).alias("end"), F.coalesce("left", zero).alias("need")
        )
        before, state = state, materialize(narrowed, "selection")
        discard(before)
    last = state.select("key", "w", "top", zero.alias("begin"), "end", F.lit(k).cast("long").alias("need"))
    rank = F.row_number().over(Window.partitionBy("key", "w").orderBy("u", "id"))
    first = scan(last, None).withColumn("rank", rank).filter(F.col("rank") <= k)
    return first.join(windows.select("key", "w", "high"), ["key", "w"]).select("key", "w", "rank", "id", (F.col("high") - F.col("u")).alias("score"))


def mine(rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95, scale: float = 256, id: str = "vec_id", label: str = "label", vector: str = "embedding") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor (a condition on the rows)
    and each of its nearest `positives` rows of its own label, the first `negatives` rows of other labels whose score lies
    between least and most percent of the positive's."""
    ship_package(rows.sparkSession)
    used, bound = prepared(rows, scale, id, label, vector, anchor)
    n_rows = used.count()
    once = materialize(used.filter("is_anchor").groupBy("id", "label", "vector").agg(F.min("pos").alias("key")), "anchors")
    blocks = max(1, -(-once.count() // ANCHORS))
    anchors = once.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks)))
    every = anchors.select("key", F.lit(0).alias("w"), F.lit(-bound).cast("long").alias("low"), F.lit(bound).cast("long").alias("high"))
    near = materialize(select(used, anchors, every, n_rows, blocks, True, positives, bound).withColumn("w", F.col("rank")), "positives")
    # the whole numbers s with least * p <= 100 * s <= most * p
    times = lambda f: f"cast({f} * cast(score as decimal(19,0)) as decimal(25,0)) / 100"
    ranges = near.select("key", "w", F.expr(f"-floor({times(-least)})").cast("long").alias("low"), F.expr(f"floor({times(most)})").cast("long").alias("high"))
    ranges = materialize(ranges.filter("low <= high"), "ranges")
    found = select(used, anchors, ranges, n_rows, blocks, False, negatives, bound).withColumnsRenamed({"id": "negative_id", "score": "negative_score"})
    pairs = near.select("key", "w", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    names = anchors.select("key", F.col("id").alias("anchor_id"))
    return found.join(pairs, ["key", "w"]).join(names, "key").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")

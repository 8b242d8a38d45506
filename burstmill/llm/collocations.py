"""Phrase collocations by pivot partitioning (after Miliaraki, Berberich, Gemulla and Zoupanos, "Mind the gap", 2013).

Texts are lower-cased (A-Z only), cut into pieces at `.,;:!?` and line ends and those into words at blanks and tabs. All
is done for each language by itself; a null language is `und`, a null text is empty, bytes that are not UTF-8 become U+FFFD.

1. Words are counted.
2. Words are ordered from rare to frequent. The order must be known wherever a text is read, yet the list of words grows
   with the corpus; so counts are summed in `BUCKETS` hashed buckets, a table of fixed size that is broadcast, and a
   word's place is its bucket's sum, ties by its bytes. A bucket never counts a word too low, so words below the least
   count that it proves rare are blanked; for others it is a total order, whatever words share a bucket.
3. Each occurrence of a word, the pivot, becomes a fragment: itself and at most `longest - 1` words on either side, as far
   as all of them are more frequent than the pivot (to the right also as frequent, so that a phrase that holds its
   rarest word twice belongs to the first one). Fragments of one word are dropped. Fragments of a pivot are routed
   together; a pivot with many is dealt to several parts by its fragments' digests.
4. Each part counts the phrases that hold its pivot and drops rare ones, if it is the pivot's only part. Sums over the
   parts of a pivot are exact, as no phrase has two pivots.
5. Phrases meet the counts of their two sides in equi-joins, and the longer phrases that hold them.

A phrase's score at a cut is floor(1000000 * a * a / (l * r)), in decimals wide enough for counts below 10^14; its score is
that of its lowest cut, ties to the shortest first side. Of equal scores the more frequent phrase ranks first, then the
smaller bytes. Repeated rows count as often as they stand there. Tables without a phrase give no row.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from burstmill.llm.texts import decoded
from burstmill.shared import materialize, ship_package

UNDETERMINED = "und"
#: Hashed buckets of word counts, and the sum at which a bucket stops counting.
BUCKETS, MOST = 1 << 22, (1 << 32) - 1
#: Words that a task takes at once, at BYTES bytes each, and occurrences that one part of a pivot takes.
HELD, BYTES, PART = 1_000_000, 6, 1 << 20
#: Stretches in which phrases are ranked first, so that no task ranks a whole language.
STRETCHES = 64

_BREAK, _PIVOT = b"\xff", b"\xfe"  # bytes that UTF-8 lacks
_LOWER = bytes(b + 32 if 65 <= b <= 90 else 255 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b for b in range(256))


def _binary(ends: np.ndarray, data: np.ndarray | pa.Buffer) -> pa.BinaryArray:
    """Values that lie one after the other in data; ends holds where the first begins and where each ends."""
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])


def coded(texts: list[bytes | None]) -> tuple[np.ndarray, pa.BinaryArray]:
    """The words of the texts in order, with a break wherever a piece ends, as places in the list of distinct ones."""
    raw = _BREAK.join([*(decoded(x).encode("utf-8", "replace") for x in texts), b""]).translate(_LOWER)
    data = np.frombuffer(raw, np.uint8)
    held, alone = data != 32, data == _BREAK[0]
    first = held.copy()
    first[1:] &= ~held[:-1] | alone[:-1] | alone[1:]
    data = data[held]
    found = _binary(np.append(np.flatnonzero(first[held]), len(data)), data).dictionary_encode()
    return found.indices.to_numpy(), found.dictionary


def _read(docs: DataFrame, text: str, lang: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(UNDETERMINED)).alias("lang"), F.col(text).cast("binary").alias("text"))


def held_texts(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[str, list[bytes | None]]]:
    """(lang, texts) for stretches of a task's rows (lang, text) whose texts have few more than `most` bytes."""
    held: dict[str, list[bytes | None]] = {}
    size = 0
    for b in batches:
        for lang, raw in zip(b.column(0).to_pylist(), b.column(1)):
            text = raw.as_py()
            held.setdefault(lang, []).append(text)
            size += len(text or b"") + 1
            if size > most:
                yield from held.items()
                held, size = {}, 0
    yield from held.items()


def word_counts(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, phrase, f): how often each word occurs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, texts in held_texts(batches, 2 * HELD * BYTES):
            ids, names = coded(texts)
            f = pa.array(np.bincount(ids, minlength=len(names)))
            found = pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang, pa.string()), len(names)), names, f], names=["lang", "phrase", "f"])
            yield found.filter(pc.not_equal(names, pa.scalar(_BREAK, pa.binary())))

    parts = _read(docs, text, lang).mapInArrow(count, "lang string, phrase binary, f bigint")
    return parts.groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def bucket_sums(counts: DataFrame) -> np.ndarray:
    """The sum of counts in each bucket, up to MOST: a table of fixed size."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for b in batches:
            at = [zlib.crc32(w, zlib.crc32(x.encode() + b"\0")) % BUCKETS for x, w in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            np.add.at(total, at, b.column(2).to_numpy())
        at = np.flatnonzero(total)
        for k in range(0, len(at), 100_000):
            part = at[k : k + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(total[part])], names=["bucket", "f"])

    sums = counts.select("lang", "phrase", "f").mapInArrow(add, "bucket int, f bigint").groupBy("bucket").agg(F.least(F.sum("f"), F.lit(MOST)).alias("f")).toArrow()
    out = np.zeros(BUCKETS, np.uint32)
    out[sums["bucket"].to_numpy()] = sums["f"].to_numpy().astype(np.uint32)
    return out


class Vocabulary(dict):
    """Numbers for the words of one language that a task has met; number 0 is the break."""

    def __init__(self, lang: str, sums: np.ndarray):
        super().__init__({_BREAK: 0})
        self.lang, self.sums = zlib.crc32(lang.encode() + b"\0"), sums
        self.names, self.counts = [_BREAK], [0]

    def __missing__(self, word: bytes) -> int:
        return int(self.learn([word])[0])

    def learn(self, words: list[bytes]) -> np.ndarray:
        """The numbers of distinct words."""
        new = [w for w in words if w not in self]
        self.update(zip(new, range(len(self.names), len(self.names) + len(new))))
        self.names += new
        self.counts += self.sums[np.array([zlib.crc32(w, self.lang) for w in new], np.int64) % len(self.sums)].tolist()
        return np.fromiter(map(self.__getitem__, words), np.int32, len(words))

    def places(self, least: int) -> np.ndarray:
        """The place of each word from rare to frequent, -1 for words that are rarer than least."""
        table = pa.table({"f": pa.array(self.counts, pa.int64()), "w": pa.array(self.names, pa.binary())})
        order = pc.sort_indices(table, [("f", "ascending"), ("w", "ascending")]).to_numpy()
        out = np.empty(len(order), np.int32)
        out[order] = np.arange(len(order), dtype=np.int32)
        out[np.array(self.counts) < least] = -1
        return out


def fragments(ids: np.ndarray, vocabulary: Vocabulary, least: int, longest: int) -> tuple[np.ndarray, pa.BinaryArray]:
    """The pivots of a stretch of text and the fragments of each: a blank ends every word, a line end every fragment, and
    a mark stands in the pivot's own place."""
    place = vocabulary.places(least)[ids]
    n = len(ids)
    reach = {}
    for side in (-1, 1):
        far, go_on = np.zeros(n, np.int32), place >= 0
        for k in range(1, min(longest, n)):
            beside = np.full(n, -1, np.int32)
            if side < 0:
                beside[k:] = place[:-k]
                go_on &= beside > place
            else:
                beside[:-k] = place[k:]
                go_on &= beside >= place
            far += go_on
        reach[side] = far
    at = np.flatnonzero(reach[-1] + reach[1])
    at = at[np.argsort(ids[at], kind="stable")]
    size = reach[-1][at] + reach[1][at] + 2  # a line's words and its end
    ends = np.cumsum(size, dtype=np.int64)
    token = ids[np.minimum(np.repeat(at - reach[-1][at] - (ends - size), size) + np.arange(size.sum()), n - 1)]
    token[ends - 1] = len(vocabulary.names)
    token[ends - size + reach[-1][at]] = len(vocabulary.names) + 1
    names = pc.binary_join_element_wise(pa.array([*vocabulary.names, b"\n", _PIVOT], pa.binary()), b"", b" ")
    lines = names.take(pa.array(token))
    pivots = ids[at]
    first = np.flatnonzero(np.diff(pivots, prepend=-1))
    bounds = np.frombuffer(lines.buffers()[1], np.int32)[np.append((ends - size)[first], len(token))] if len(at) else np.zeros(1)
    return pivots[first], _binary(bounds, lines.buffers()[2] or b"")


def fragments_of(ids: np.ndarray, vocabulary: Vocabulary, least: int, longest: int) -> Iterator[tuple[int, bytes]]:
    """The same, one pivot after the other."""
    pivots, lines = fragments(ids, vocabulary, least, longest)
    yield from zip(pivots.tolist(), lines.to_pylist())


def tallied(rows: pa.Table, least: int, longest: int, begun: bool, ends: bool) -> list[pa.RecordBatch]:
    """(lang, phrase, f) of the phrases in rows (lang, pivot, parts, salt, lines), those of one part side by side.

    Phrases that occur fewer than `least` times are dropped if these rows are all that there is of their pivot; the
    first part may have begun in earlier rows, and the last one ends here or not.
    """
    rows = rows.combine_chunks()
    lang, pivot, lines = (rows[c].chunk(0) for c in ("lang", "pivot", "lines"))
    keys = [lang.dictionary_encode().indices.to_numpy(), pivot.dictionary_encode().indices.to_numpy(), rows["parts"].to_numpy(), rows["salt"].to_numpy()]
    new = np.r_[True, np.any([k[1:] != k[:-1] for k in keys], axis=0)]
    first = np.flatnonzero(new)
    whole = keys[2][first] == 1
    if begun:
        whole[0] = False
    if not ends:
        whole[-1] = False
    starts = np.frombuffer(lines.buffers()[1], np.int32)[lines.offset : lines.offset + len(lines) + 1]
    data = np.frombuffer(lines.buffers()[2], np.uint8)[starts[0] : starts[-1]]
    blank = data == 32
    stops = np.flatnonzero(blank)
    tokens = _binary(np.r_[0, stops - np.arange(len(stops))], data[~blank])
    coding = pa.concat_arrays([tokens, pivot.take(pa.array(first)), pa.array([b"\n", _PIVOT], pa.binary())]).dictionary_encode()
    codes, names = coding.indices.to_numpy(), coding.dictionary
    of_part, end, mark = codes[len(tokens) : -2], codes[-2], codes[-1]
    codes = codes[: len(tokens)]
    at, last = np.flatnonzero(codes == mark), np.flatnonzero(codes == end)
    head = np.r_[0, last[:-1] + 1]
    part = np.repeat(np.cumsum(new) - 1, np.diff(np.searchsorted(stops[last], starts - starts[0])))
    out = []
    for a in range(1 - longest, 1):
        for b in range(max(1, a + 2), a + longest + 1):
            here = np.flatnonzero((at + a >= head) & (at + b <= last))
            which, *beside, f = distinct([(part[here], len(first)), *((codes[at[here] + k], len(names)) for k in range(a, b) if k)])
            some = np.flatnonzero((f >= least) | ~whole[which])
            which, beside = which[some], [x[some] for x in beside]
            beside.insert(-a, of_part[which])
            phrase = pc.binary_join_element_wise(*(names.take(pa.array(x)) for x in beside), b" ")
            out.append(pa.RecordBatch.from_arrays([lang.take(pa.array(first[which])), phrase, pa.array(f[some])], names=["lang", "phrase", "f"]))
    return pa.Table.from_batches(out).combine_chunks().to_batches()


def distinct(columns: list[tuple[np.ndarray, int]]) -> list[np.ndarray]:
    """The distinct rows of columns of whole numbers below the bound beside each, and how often each row occurs."""
    (key, size), *more = columns
    key, parts = key.astype(np.int64), []
    for x, bound in more:
        if size * bound >= 1 << 63:
            values, key = np.unique(key, return_inverse=True)
            size = len(values)
            parts.append(values)
        else:
            parts.append(None)
        key, size = key * bound + x, size * bound
    key = np.sort(key)
    first = np.flatnonzero(np.diff(key, prepend=-1))
    f, key = np.diff(np.append(first, len(key))), key[first]
    out = [f]
    for (_, bound), values in zip(reversed(more), reversed(parts)):
        out.append(key % bound)
        key = key // bound if values is None else values[key // bound]
    return [key, *reversed(out)]


def phrase_counts(docs: DataFrame, sums: np.ndarray, least: int, longest: int, part: int = PART, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, phrase, f): phrases of 2 to longest words that occur at least `least` times."""
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(sums)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, texts in held_texts(batches, HELD * BYTES):
            v = Vocabulary(lang, shared.value)
            ids, names = coded(texts)
            pivots, lines = fragments(v.learn(names.to_pylist())[ids], v, least, longest)
            parts = 1 + np.array(v.counts, np.int64)[pivots] // part
            salt = np.zeros(len(parts), np.int64)
            for k in np.flatnonzero(parts > 1).tolist():
                salt[k] = zlib.crc32(lines[k].as_buffer()) % parts[k]
            columns = [pa.repeat(pa.scalar(lang, pa.string()), len(parts)), pa.array(v.names, pa.binary()).take(pa.array(pivots)), pa.array(parts), pa.array(salt), lines]
            rows = pa.RecordBatch.from_arrays(columns, names=["lang", "pivot", "parts", "salt", "lines"])
            for k in range(0, len(parts), 10_000):
                yield rows.slice(k, 10_000)

    def mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key, size = None, 0
        names = ["lang", "pivot", "parts", "salt"]
        for b in batches:
            if not b.num_rows:
                continue
            if size > HELD * BYTES:
                following = b.slice(0, 1).select(names).to_pylist()
                begins, ending = held[0].slice(0, 1).select(names).to_pylist(), held[-1].slice(held[-1].num_rows - 1).select(names).to_pylist()
                yield from tallied(pa.Table.from_batches(held), least, longest, begins == key, ending != following)
                key, held, size = ending, [], 0
            held.append(b)
            size += b.column(4).nbytes
        if held:
            yield from tallied(pa.Table.from_batches(held), least, longest, held[0].slice(0, 1).select(names).to_pylist() == key, True)

    routed = _read(docs, text, lang).mapInArrow(route, "lang string, pivot binary, parts bigint, salt bigint, lines binary")
    dealt = routed.repartition("lang", "pivot", "salt").sortWithinPartitions("lang", "pivot", "parts", "salt")
    parts = dealt.mapInArrow(mine, "lang string, phrase binary, f bigint")
    return parts.groupBy("lang", "phrase").agg(F.sum("f").alias("f")).filter(F.col("f") >= least)


def scored(grams: DataFrame, longest: int) -> DataFrame:
    """(lang, phrase, words, a, l, r, score) of every phrase of grams (lang, phrase, words, f), which also holds its sides."""
    phrases = grams.filter("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"))
    cuts = phrases.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    sides = cuts.withColumns({"left": F.expr("substring_index(phrase, ' ', cut)"), "right": F.expr("substring_index(phrase, ' ', cut - words)")})
    for name, count in (("left", "l"), ("right", "r")):
        sides = sides.join(grams.select("lang", F.col("phrase").alias(name), F.col("f").alias(count)), ["lang", name])
    score = F.expr("1000000BD * cast(a as decimal(14,0)) * cast(a as decimal(14,0)) div (cast(l as decimal(14,0)) * cast(r as decimal(14,0)))")
    best = sides.groupBy("lang", "phrase").agg(F.first("words").alias("words"), F.first("a").alias("a"), F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("b"))
    return best.select("lang", "phrase", "words", "a", "b.l", "b.r", "b.score")


def collocations(docs: DataFrame, least: int = 10, longest: int = 3, absorbed: int = 50, top: int = 2000, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first `top` phrases of 2 to longest words.

    Phrases that occur fewer than `least` times don't count, nor those inside a longer one that occurs at least
    `absorbed` percent as often, whether that one itself counts or not.
    """
    spark = docs.sparkSession
    ship_package(spark)
    counts = materialize(word_counts(docs, text, lang), "words")
    total = counts.groupBy("lang").agg(F.sum("f").alias("n"))
    # parts of a pivot: large ones, but as many as keep all tasks busy
    every = counts.agg(F.sum("f")).first()[0] or 0
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    part = max(1 << 12, min(PART, every // (4 * tasks)))
    found = phrase_counts(docs, bucket_sums(counts), least, longest, part, text, lang)
    grams = counts.filter(F.col("f") >= least).unionByName(found).withColumn("phrase", F.col("phrase").cast("string"))
    grams = materialize(grams.withColumn("words", F.size(F.split("phrase", " ")).cast("int")), "phrases")
    phrases = scored(grams, longest)
    longer = grams.filter("words > 2").withColumn("_parts", F.split("phrase", " "))
    spans = [(a, k) for k in range(2, longest) for a in range(1, longest - k + 2)]
    inner = [F.when((F.col("words") > k) & (F.col("words") >= a + k - 1), F.array_join(F.slice("_parts", a, k), " ")) for a, k in spans]
    if inner:
        held = longer.select("lang", "f", F.explode(F.array_distinct(F.array(*inner))).alias("phrase")).filter("phrase IS NOT NULL")
        cover = held.groupBy("lang", "phrase").agg(F.max("f").alias("_cover"))
        phrases = phrases.join(cover, ["lang", "phrase"], "left").filter(F.coalesce(100 * F.col("_cover") < absorbed * F.col("a"), F.lit(True)))
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    for by in (["lang", F.pmod(F.xxhash64("phrase"), F.lit(STRETCHES))], ["lang"]):
        phrases = phrases.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*best)).cast("long")).filter(F.col("rank") <= top)
    return phrases.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

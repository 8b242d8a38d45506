"""Quality rules by distribution divergence.

Each document gets counts (words, symbols, repeated lines and windows), a histogram of character classes, and counts of
the common words of every labelled language. These words are learned from the corpus: a language's common words are
those that make at least LEAST_SHARE of the words of all documents with its label. Tasks keep bounded counts that lose
no such word, and their candidates are then counted exactly. Every label has a character reference, and one of its
common words if it has any (languages that write no spaces have none) and at least LEAST_REFERENCE words in all.

The histograms summed over all documents of a language make a first reference; summed over those that it keeps, they
make the final one. A document is rejected if even the nearest reference is too far away in Jensen-Shannon distance.
Common words judge only texts that speak one of the languages: whose words are common words of it at least LEAST_FLUENCY
times as often as those of its reference. Any other text may be of a language that no document is labelled with, or of
another script; it is judged by its characters alone, with small letters of all scripts as one class and without spaces.
Texts whose nearest character reference has no reference of words are not judged by words either. Texts below
the length guards are not judged by that histogram. Digits are left out of the character histogram: numbers and
identifiers are no junk.

Words are runs of bytes other than space and U+0009 to U+000D. Null texts count as empty, bytes that are not UTF-8 as
U+FFFD. An empty table gives an
empty result. Without any labelled document there is no reference, and only the base rules decide. References grow with
the number of labels, not with documents.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator, Mapping
from functools import cache
from types import MappingProxyType

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burstmill.llm.texts import decoded, pieces
from burstmill.shared import fresh, materialize, ship_package, with_field

#: Share of a language's words that a common word has.
LEAST_SHARE = 0.01
#: Words that a task keeps counts of for each language; what it drops makes less than 2 / HELD of the task's words.
HELD = 20_000
#: Largest Jensen-Shannon distances (base 2, 0 to 1) to the nearest reference.
MAX_CHAR_DISTANCE = 0.15
MAX_WORD_DISTANCE = 0.24
#: Words that a language's reference is the sum of at least; with fewer its texts are judged by characters alone.
LEAST_REFERENCE = 5_000
#: A text speaks a language if the share of its common words among the text's words is at least this part of the reference's.
LEAST_FLUENCY = 0.5
#: Characters and words from which on the histograms are judged.
MIN_CHARS = 200
MIN_WORDS = 100
MIN_BASE_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: From this number of words on, repeated windows are found by sorting instead of hashing.
SORTED_FROM = 200_000
#: Numbers of a dense block of documents x common words at most.
_BLOCK = 4_000_000

SYMBOLS = "#*$%&|<>"
CLASSES = ("lower", "upper", "digit", "space", "mark", "symbol", "bracket", "control", "cased_beyond_ascii", "caseless")
_JUDGED = [k for k, c in enumerate(CLASSES) if c != "digit"]
#: How classes are judged whatever the script: letters in one class but for A to Z, spaces and digits left out.
_ANY_SCRIPT = np.zeros((len(CLASSES), 6))
for _at, _names in enumerate((("lower", "cased_beyond_ascii", "caseless"), ("upper",), ("mark",), ("symbol",), ("bracket",), ("control",))):
    _ANY_SCRIPT[[CLASSES.index(c) for c in _names], _at] = 1
_EDGE_MARKS = b".,;:!?\"()"


def _class_of(c: str) -> int:
    """The character's class by its Unicode category; space is what words are cut at."""
    if c in " \t\n\r\x0b\x0c":
        return 3
    kind = unicodedata.category(c)
    if kind in ("Ps", "Pe", "Pi", "Pf") or c in "/\\":
        return 6 if c.isascii() else 4
    if c.isascii():
        return {"Ll": 0, "Lu": 1, "Nd": 2, "Cc": 7}.get(kind, 4 if c in ".,;:!?'\"-" else 5)
    if kind in ("Ll", "Lu", "Lt"):
        return 8
    return {"L": 9, "M": 9, "N": 2, "P": 4, "Z": 4, "S": 5, "C": 7}[kind[0]]


@cache
def _classes_of_points() -> np.ndarray:
    return np.array([_class_of(chr(c)) for c in range(0x110000)], np.uint8)


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a 5-word window which the text holds twice or more."""
    n = len(words) - 4
    if n < 2:
        return 0
    if len(words) < SORTED_FROM:
        windows = list(zip(words, words[1:], words[2:], words[3:], words[4:]))
        if len(set(windows)) == n:
            return 0
        seen = Counter(windows)
        twice = np.fromiter((seen[w] > 1 for w in windows), bool, n)
    else:
        ids: dict[bytes, int] = {}
        one = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
        two = np.unique(one[:-1] * len(ids) + one[1:], return_inverse=True)[1]
        four = np.unique(two[:-2] * (two.max() + 1) + two[2:], return_inverse=True)[1]
        five, counts = np.unique(four[:-1] * len(ids) + one[4:], return_inverse=True, return_counts=True)[1:]
        twice = counts[five] > 1
    covered = np.zeros(len(words), bool)
    for k in range(5):
        covered[k : k + n] |= twice
    return int(covered.sum())


def tokens(text: str) -> list[bytes]:
    """Lower-case words without marks at their ends, as common words are compared."""
    return text.lower().encode("utf-8", "surrogatepass").translate(None, _EDGE_MARKS).split()


def describe(text: str | None, common: Mapping[bytes, int] = MappingProxyType({})) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_chars, class counts, {common word's number: count})."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()] if b"\n" in raw else []
    points = np.frombuffer(raw, np.uint8) if len(raw) == len(text) else np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    classes = np.bincount(_classes_of_points()[points], minlength=len(CLASSES))
    found: Counter[int] = Counter()
    for w, n in Counter(tokens(text)).items():
        if w in common:
            found[common[w]] = n
    return (len(words), len(text) - int(classes[3]), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words), len(text), classes, found)


def common_words(docs: DataFrame, text: str, lang: str) -> dict[str, list[str]]:
    """For each label the words (with a letter) that make LEAST_SHARE of its words or more, and some that come close to it.

    A task's counts may lose words of a share below 2 / HELD. It passes on those of at least a quarter of LEAST_SHARE;
    what it withholds of a common word is less than that, so of the sums those of three quarters hold all common words.
    So the driver gets at most 4 / (3 LEAST_SHARE) words for each label.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}
        totals: Counter[str] = Counter()
        for b in pieces(batches):
            for x, k in zip(b.column(0), b.column(1).to_pylist()):
                found = tokens(decoded(x.as_py()))
                totals[k] += len(found)
                own = held.setdefault(k, Counter())
                own.update(found)
                if len(own) > HELD:
                    less = sorted(own.values())[-HELD // 2]
                    held[k] = Counter({w: n - less for w, n in own.items() if n > less})
        rows = [(k, None, n) for k, n in totals.items()]
        rows += [(k, w.decode("utf-8", "replace"), n) for k, own in held.items() for w, n in own.items() if n >= totals[k] * LEAST_SHARE / 4]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64()))], names=["lang", "word", "n"])

    labelled = docs.filter(F.col(lang).isNotNull()).select(F.col(text).cast("binary").alias("t"), F.col(lang).cast("string").alias("k"))
    sums = labelled.mapInArrow(count, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    sums = materialize(sums, "quality-words")
    totals = sums.filter("word IS NULL").select("lang", F.col("n").alias("total"))
    rows = sums.filter(F.col("word").rlike(r"\p{L}")).join(totals, "lang").filter(F.col("n") >= F.col("total") * (0.75 * LEAST_SHARE)).select("lang", "word").collect()
    found = {r["lang"]: [] for r in totals.select("lang").collect()}
    for r in rows:
        found[r["lang"]].append(r["word"])
    return {k: sorted(words) for k, words in found.items()}


_INTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_chars")
_FEATURES = "struct<" + ",".join(f"{n}:bigint" for n in _INTS) + ",classes:array<bigint>,words:array<struct<word:int,n:int>>>"
_WORDS = pa.list_(pa.struct([("word", pa.int32()), ("n", pa.int32())]))
_ARROW = pa.struct([*((n, pa.int64()) for n in _INTS), ("classes", pa.list_(pa.int64())), ("words", _WORDS)])


def with_features(docs: DataFrame, text: str, keep: list[str], name: str, vocabulary: list[str]) -> DataFrame:
    """The kept columns and, as struct `name`, what describe() finds in the whole text; words by number in the vocabulary."""
    at = fresh(docs, "text_read")
    table = docs.select(*keep, F.col(text).cast("binary").alias(at))
    schema = with_field(docs.select(*keep).schema, name, _FEATURES)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = {w.encode("utf-8", "surrogatepass"): i for i, w in enumerate(shared.value)}
        for batch in pieces(batches):
            rows = [describe(decoded(x.as_py()), common) for x in batch.column(batch.num_columns - 1)]
            columns = [pa.array([r[k] for r in rows], pa.int64()) for k in range(6)]
            flat = np.concatenate([r[6] for r in rows]) if rows else np.zeros(0, np.int64)
            columns.append(pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * len(CLASSES)), pa.array(flat, pa.int64())))
            ends = np.cumsum([0, *(len(r[7]) for r in rows)], dtype=np.int32)
            pairs = [pa.array([x for r in rows for x in side(r[7])], pa.int32()) for side in (dict.keys, dict.values)]
            columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(pairs, names=["word", "n"])))
            made = pa.StructArray.from_arrays(columns, fields=list(_ARROW))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], made], names=[*batch.schema.names[:-1], name])

    return table.mapInArrow(run, schema)


Reference = tuple[np.ndarray, np.ndarray, np.ndarray]


def references(described: DataFrame, lang: str, name: str, numbers: dict[str, list[int]]) -> dict[str, Reference]:
    """For each label (class counts, numbers of its common words, their counts and that of all other words), summed over
    all its documents. A task passes on one row for each label and class or common word of it."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = len(CLASSES) + 1
        sums: dict[str, np.ndarray] = {}
        place = {k: {i: width + j for j, i in enumerate(own)} for k, own in numbers.items()}
        for b in batches:
            n_words, classes, words = b.column(1).to_numpy(), b.column(2), b.column(3)
            flat = classes.flatten().to_numpy().reshape(-1, len(CLASSES))
            at, which, n = words.offsets.to_numpy(), *(words.values.field(k).to_numpy() for k in (0, 1))
            for i, k in enumerate(b.column(0).to_pylist()):
                if k not in sums:
                    sums[k] = np.zeros(width + len(numbers.get(k, ())), np.int64)
                own, mine = sums[k], place.get(k, {})
                own[: len(CLASSES)] += flat[i]
                own[len(CLASSES)] += n_words[i]
                for w, c in zip(which[at[i] : at[i + 1]].tolist(), n[at[i] : at[i + 1]].tolist()):
                    if w in mine:
                        own[mine[w]] += c
        rows = [(k, j, int(x)) for k, own in sums.items() for j, x in enumerate(own)]
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.string(), pa.int32(), pa.int64()))], names=["lang", "place", "n"])

    f = F.col(name)
    labelled = described.filter(F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias("k"), f["n_words"].alias("n"), f["classes"].alias("c"), f["words"].alias("w"))
    found: dict[str, Reference] = {}
    width = len(CLASSES) + 1
    sums = {k: np.zeros(width + len(own)) for k, own in numbers.items()}
    for r in labelled.mapInArrow(add, "lang string, place int, n bigint").groupBy("lang", "place").agg(F.sum("n").alias("n")).collect():
        sums[r["lang"]][r["place"]] = r["n"]
    for k, own in sums.items():
        if own[: len(CLASSES)].sum():
            heard = slice(0, None if own[width - 1] >= LEAST_REFERENCE else 0)
            words = own[width:][heard]
            found[k] = (own[: len(CLASSES)], np.array(numbers[k][heard], int), np.append(words, max(0.0, own[width - 1] - words.sum())))
    return found


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance, base 2, of each row of p (counts) to q (counts)."""
    p = p / np.maximum(p.sum(1, keepdims=True), 1)
    q = (q / max(q.sum(), 1))[None, :]
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        a = np.where(p > 0, p * np.log2(p / m), 0).sum(1)
        b = np.where(q > 0, q * np.log2(q / m), 0).sum(1)
    return np.sqrt(np.clip((a + b) / 2, 0, 1))


_VERDICT = "struct<base_failed:boolean,kept:boolean,char_distance:double,word_distance:double>"


def judge(described: DataFrame, refs: dict[str, Reference], name: str, verdict: str, keep: list[str], words: int) -> DataFrame:
    """The kept columns and the struct `verdict`; distances are null where a guard or a missing reference rules them out.

    words: the number of words in the vocabulary.
    """
    order = [refs[k] for k in sorted(refs)]
    spoken = np.array([len(r[1]) > 0 for r in order])
    f = F.col(name)
    table = described.select(*keep, *(f[n].alias(f"_{n}") for n in _INTS), f["classes"].alias("_classes"), f["words"].alias("_words"))
    schema = with_field(described.select(*keep).schema, verdict, _VERDICT)
    n_keep = len(keep)
    shared = described.sparkSession.sparkContext.broadcast(order)

    def far_from(order: list[Reference], n_words: np.ndarray, classes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Distances of characters and words to the nearest reference (2 x documents)."""
        far = np.full((2, len(n_words)), np.nan)
        if not order:
            return far
        by_chars = np.array([distance(classes[:, _JUDGED], r[0][_JUDGED]) for r in order])
        far[0] = by_chars.min(0)
        fluent = np.zeros(len(n_words), bool)
        for _, own, ref in filter(lambda r: len(r[1]), order):
            known = counts[:, own].sum(1)
            far[1] = np.fmin(far[1], distance(np.column_stack([counts[:, own], np.maximum(n_words - known, 0)]), ref))
            fluent |= known * ref.sum() >= LEAST_FLUENCY * n_words * ref[:-1].sum()
        far[1][~(spoken[by_chars.argmin(0)] & fluent)] = np.nan
        any_script = np.array([distance(classes @ _ANY_SCRIPT, r[0] @ _ANY_SCRIPT) for r in order]).min(0)
        far[0] = np.where(fluent, far[0], np.fmin(far[0], any_script))
        return far

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, _BLOCK // max(1, words))
        for batch in pieces(batches):
            n_words, repeats, n_chars = (batch.column(n_keep + k).to_numpy(zero_copy_only=False) for k in (0, 4, 5))
            classes = batch.column(n_keep + 6).flatten().to_numpy().reshape(-1, len(CLASSES)).astype(float)
            listed = batch.column(n_keep + 7)
            at, which, n = listed.offsets.to_numpy(), *(listed.values.field(k).to_numpy() for k in (0, 1))
            base = (n_words < MIN_BASE_WORDS) | (100 * repeats > MAX_REPEAT_PERCENT * n_words)
            far = np.full((2, len(base)), np.nan)
            for s in range(0, len(base), step):
                e = min(len(base), s + step)
                counts = np.zeros((e - s, words))
                inner = slice(at[s], at[e])
                counts[np.repeat(np.arange(e - s), np.diff(at[s : e + 1])), which[inner]] = n[inner]
                far[:, s:e] = far_from(shared.value, n_words[s:e], classes[s:e], counts)
            far[0][n_chars < MIN_CHARS] = np.nan
            far[1][n_words < MIN_WORDS] = np.nan
            kept = ~base & ~(far[0] > MAX_CHAR_DISTANCE) & ~(far[1] > MAX_WORD_DISTANCE)
            made = pa.StructArray.from_arrays(
                [pa.array(base), pa.array(kept), *(pa.array(x, pa.float64(), from_pandas=True) for x in far)],
                names=["base_failed", "kept", "char_distance", "word_distance"],
            )
            yield pa.RecordBatch.from_arrays([*batch.columns[:n_keep], made], names=[*batch.schema.names[:n_keep], verdict])

    return table.mapInArrow(run, schema)


def quality(docs: DataFrame, text: str = "text", lang: str = "lang", keep: list[str] | None = None) -> DataFrame:
    """docs' kept columns (all, if not given) with structs of features and of the verdict, as the last two columns.

    The features are written once to the shared folder: the references need them all before the first verdict.
    """
    ship_package(docs.sparkSession)
    keep = docs.columns if keep is None else keep
    name, verdict, lang_at = fresh(docs, "features"), fresh(docs, "verdict"), fresh(docs, "lang_read")
    words = common_words(docs, text, lang)
    vocabulary = sorted({w for own in words.values() for w in own})
    at = {w: i for i, w in enumerate(vocabulary)}
    numbers = {k: [at[w] for w in own] for k, own in words.items()}
    described = materialize(with_features(docs.withColumn(lang_at, F.col(lang)), text, [*keep, lang_at], name, vocabulary), "quality")
    first = judge(described, references(described, lang_at, name, numbers), name, verdict, [lang_at, name], len(vocabulary))
    refs = references(first.filter(F.col(verdict)["kept"]), lang_at, name, numbers)
    return judge(described, refs, name, verdict, [*keep, name], len(vocabulary))

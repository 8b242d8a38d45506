"""Language identification with a blended-spectrum presence kernel.

Texts are lower-cased; what is no letter is a gap. The kernel of two texts is the number of distinct 1-, 2- and 3-grams
they share, divided by the geometric mean of their own numbers. N-grams of any script are hashed to CODE_BITS bits (two
of them may fall together: for 50,000 n-grams one unseen n-gram in 80 is taken for a known one). Nyström landmarks, drawn
in equal numbers for each language, turn the kernel into features. An n-gram that no landmark has is shared with none, but
counts in its text's own number, so that a few known words in a text of another script make no language. One-versus-rest ridge regression on the features gives a score for each language. Documents are
scored in batches: presence matrix times landmark matrix times weights.

The model is fitted on a bounded sample of the rows that may be used: for each of their languages the SAMPLE_PER_LANGUAGE
rows with the smallest hash of id and text (fewer, if all would be more than SAMPLE_ROWS, but at least LEAST_PER_LANGUAGE).
Every label is learned; rows that are equal in id and text count once. Whole texts are read in fitting and scoring. Null
texts and texts without a letter get `und` and score 0; bytes that are not UTF-8 count as gaps. Without any row to learn from every document is `und`. An empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from burstmill.llm.texts import decoded, pieces
from burstmill.shared import fresh, ship_package, with_field

SAMPLE_PER_LANGUAGE = 256
SAMPLE_ROWS = 2048
LEAST_PER_LANGUAGE = 8
MARGIN = 16
#: Landmarks of all languages together; one for each language, if there are more languages.
LANDMARKS = 128
CODE_BITS = 22
RIDGE = 1e-3
UNDETERMINED = "und"

#: Odd factors of the hash, one for each place of an n-gram.
_FACTORS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)
_MIX = 0x27D4EB2F
#: Characters and rows of a scoring batch at most (a longer text is a batch of its own).
_BATCH_CHARS = 262_144
_BATCH_ROWS = 64


@dataclass
class Model:
    languages: list[str]
    grams: np.ndarray  # codes of the n-grams that are features, sorted
    landmarks: np.ndarray  # presence of each feature in each landmark, features x landmarks, scaled by the landmark's norm
    weights: np.ndarray  # landmarks x languages
    bias: np.ndarray


@cache
def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def _points(text: str) -> np.ndarray:
    """Code points plus 1 of the lower-cased letters, 0 for anything else."""
    found = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(_letters()[found], found + np.uint32(1), np.uint32(0))


def _codes(a: np.ndarray) -> list[np.ndarray]:
    """Codes of the 1-, 2- and 3-grams that start at each point of a, the last two points left out."""
    first, second, third = (a[k : len(a) - 2 + k] * np.uint32(f) for k, f in enumerate(_FACTORS))
    two = first ^ (second + np.uint32(1))
    return [(h * np.uint32(_MIX)) >> np.uint32(32 - CODE_BITS) for h in (first, two ^ (two >> np.uint32(15)), (two ^ (third + np.uint32(2))) * np.uint32(_FACTORS[0]) ^ two >> np.uint32(13))]


def text_codes(text: str) -> np.ndarray:
    """The text's distinct n-grams, with a gap before and after it, as codes."""
    gap = np.zeros(2, np.uint32)
    return np.unique(np.concatenate(_codes(np.concatenate([gap, _points(text), gap])))).astype(np.int32)


def sample(docs: DataFrame, text: str, lang: str, key: str, usable: Column) -> DataFrame:
    """(lang, h, text) of the bounded fitting sample.

    One pass counts the usable rows of each language, one finds their smallest hashes and shuffles only candidates for
    them, one reads the texts that belong to them. Where so many rows repeat that too few candidates are found, the
    language is searched once more among all its rows.
    """
    rows = docs.filter(usable & F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}"))
    rows = rows.select(F.col(lang).alias("lang"), F.xxhash64(F.col(key), F.col(text)).alias("h"), F.col(text).alias("text"))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    most = min(SAMPLE_PER_LANGUAGE, max(LEAST_PER_LANGUAGE, SAMPLE_ROWS // max(1, len(counts))))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    # hashes are uniform: those below this bound are some MARGIN times as many as wanted, however many rows there are
    bounds = {k: min((1 << 63) - 1, -(1 << 63) + (MARGIN * most << 64) // n) for k, n in counts.items()}
    found: dict[str, list[int]] = {}
    while bounds:
        few = docs.sparkSession.createDataFrame(list(bounds.items()), "lang string, bound bigint")  # a row for each label
        near = rows.select("lang", "h").join(F.broadcast(few), "lang").filter("h <= bound").select("lang", "h").distinct()
        drawn: dict[str, list[int]] = {}
        for r in near.withColumn("rank", rank).filter(F.col("rank") <= most).collect():
            drawn.setdefault(r["lang"], []).append(r["h"])
        found |= drawn
        bounds = {k: (1 << 63) - 1 for k, b in bounds.items() if b < (1 << 63) - 1 and len(drawn.get(k, ())) < most}
    keys = docs.sparkSession.createDataFrame([(k, h) for k, hs in found.items() for h in hs], "lang string, h bigint")
    return rows.join(F.broadcast(keys), ["lang", "h"]).dropDuplicates(["lang", "h"])


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", usable: Column | None = None) -> Model | None:
    """The model from docs' labelled rows for which `usable` holds; None if there are none."""
    ship_package(docs.sparkSession)

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = pa.array([text_codes(decoded(x.as_py())) for x in b.column(2)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*b.columns[:2], found], names=["lang", "h", "grams"])

    drawn = sample(docs, text, lang, key, F.lit(True) if usable is None else usable).withColumn("text", F.col("text").cast("binary")).mapInArrow(grams, "lang string, h bigint, grams array<int>").toArrow()
    if not drawn.num_rows:
        return None
    drawn = drawn.sort_by([("lang", "ascending"), ("h", "ascending")])
    labels = drawn["lang"].to_pylist()
    ranks = [i - labels.index(k) + 1 for i, k in enumerate(labels)]
    return _train([x.values.to_numpy() for x in drawn["grams"]], labels, ranks)


def _train(coded: list[np.ndarray], labels: list[str], ranks: list[int]) -> Model:
    languages = sorted(set(labels))
    each = max(1, LANDMARKS // len(languages))
    marks = [i for i, r in enumerate(ranks) if r <= each]
    chosen = np.unique(np.concatenate([coded[i] for i in marks]))

    def present(i: int) -> np.ndarray:
        row = np.zeros(len(chosen), np.float32)
        row[np.searchsorted(chosen, np.intersect1d(coded[i], chosen, assume_unique=True))] = 1
        return row

    land = np.array([present(i) for i in marks])
    land /= np.sqrt(np.maximum(land.sum(1, keepdims=True), 1))
    kernel = np.empty((len(coded), len(marks)))
    for i in range(len(coded)):
        row = present(i)
        kernel[i] = land @ row / np.sqrt(len(coded[i]))
    values, vectors = np.linalg.eigh(land.astype(float) @ land.T.astype(float))
    good = values > 1e-8 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    x = kernel @ root
    y = np.where(np.array(labels)[:, None] == np.array(languages)[None, :], 1.0, -1.0)
    share = 1 / np.array([labels.count(k) for k in labels])  # each language weighs as much as any other
    share /= share.sum()
    mx, my = share @ x, share @ y
    w = np.linalg.solve((x - mx).T @ ((x - mx) * share[:, None]) + RIDGE * np.eye(x.shape[1]), (x - mx).T @ ((y - my) * share[:, None]))
    return Model(languages, chosen, np.ascontiguousarray(land.T), (root @ w).astype(np.float32), (my - mx @ w).astype(np.float32))


def _batches(texts: list[str]) -> Iterator[list[str]]:
    start, chars = 0, 0
    for i, t in enumerate(texts):
        if i > start and (chars + len(t) > _BATCH_CHARS or i - start >= _BATCH_ROWS):
            yield texts[start:i]
            start, chars = i, 0
        chars += len(t)
    if start < len(texts):
        yield texts[start:]


class Scorer:
    """A model with its look-up tables, made once for each partition."""

    def __init__(self, model: Model):
        self.m = model
        self.at = np.full(1 << CODE_BITS, -1, np.int32)
        self.at[model.grams] = np.arange(len(model.grams))

    def presence(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """One row for each text: 1 where it holds the n-gram; and each text's number of distinct n-grams, known or not."""
        points = [_points(t) for t in texts]
        gap = np.zeros(2, np.uint32)
        parts = [gap]
        for p in points:
            parts += [p, gap]
        a = np.concatenate(parts)
        # an n-gram belongs to the text in which it starts, or whose gap before it starts there
        owner = np.repeat(np.arange(len(texts)), [len(p) + 2 for p in points])
        row = owner * len(self.m.grams)
        out = np.zeros(len(texts) * len(self.m.grams), np.float32)
        other = []
        for codes in _codes(a):
            feature = self.at[codes]
            seen = feature >= 0
            out[row[seen] + feature[seen]] = 1
            other.append(owner[~seen] << CODE_BITS | codes[~seen])
        out = out.reshape(len(texts), -1)
        unknown = np.bincount(np.unique(np.concatenate(other)) >> CODE_BITS, minlength=len(texts))
        return out, out.sum(1) + unknown

    def scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Regression values (texts x languages), and the share of each text's n-grams that a landmark has."""
        x, n = self.presence(texts)
        kernel = (x @ self.m.landmarks) / np.sqrt(n)[:, None].astype(np.float32)
        return kernel @ self.m.weights + self.m.bias, x.sum(1) / n


def predict(docs: DataFrame, model: Model | None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs' kept columns (all, if not given) and a struct of lang_pred and score as the last column.

    The score is the best language's regression value (targets -1 and 1) brought to 0..1, times the share of the text's
    distinct n-grams that any landmark has.
    """
    keep = docs.columns if keep is None else keep
    name, at, letter = fresh(docs, "language"), fresh(docs, "text_read"), fresh(docs, "has_letter")
    table = docs.select(*keep, F.col(text).cast("binary").alias(at), F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias(letter))
    schema = with_field(docs.select(*keep).schema, name, "struct<lang_pred:string,score:double>")
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    n_keep = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        scorer = None if m is None else Scorer(m)
        for b in pieces(batches):
            langs, scores = [UNDETERMINED] * b.num_rows, np.zeros(b.num_rows)
            usable = np.flatnonzero(b.column(n_keep + 1).to_numpy(zero_copy_only=False)) if scorer else []
            done = 0
            for part in _batches([decoded(b.column(n_keep)[int(i)].as_py()) for i in usable]):
                f, known = scorer.scores(part)
                for i, k, v, share in zip(usable[done : done + len(part)], f.argmax(1), f.max(1), known):
                    langs[i], scores[i] = m.languages[k], min(1.0, max(0.0, (float(v) + 1) / 2)) * float(share)
                done += len(part)
            made = pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores)], names=["lang_pred", "score"])
            yield pa.RecordBatch.from_arrays([*b.columns[:n_keep], made], names=[*b.schema.names[:n_keep], name])

    return table.mapInArrow(run, schema)


def held_out(key: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves 1 when divided by 3; false for a null id."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))

"""Packing documents into sequences of bounded length by dynamic programming over window cuts.

The documents of a partition are one stream of tokens in the table's order, each document followed by an end token. The
stream is cut into windows, one for each sequence, at ends of documents, ends of sentences and, inside sentences longer
than a window and at the end of a partition, anywhere. A plan's cost is the sum over its windows of

* the padding, `window` minus the window's length, or none if that length is a power of two,
* a penalty for where it ends: nothing after a document, `SENTENCE` after a sentence, `INSIDE` elsewhere,
* `SEQUENCE` for the window itself, so that a plan of many tiny windows doesn't pay.

With p(j) the j-th place for a cut, the least cost up to it is

    f(j) = penalty(j) + SEQUENCE + min(window - p(j) + min over i of (f(i) + p(i)), min over powers of two of f(i))

where i runs over places at most a window before j: the inner minimum slides along with j and is the head of a monotone
queue; the other one looks at no more than twelve places. So the work is linear in the number of places.

A block of `BLOCK` tokens or more is planned at a time; its last window is left open and goes on in the next block, so that
only a partition's end may be padded. No row moves between partitions: nothing is shuffled and no key can be hot. With
`order`, the table is range-sorted by these columns first.

Null and empty texts are an end token alone; bytes that are not UTF-8 become U+FFFD. A very long text is tokenized in
slices that end at white space. Repeated rows are documents of their own. An empty table gives no pieces. The result's
own columns lie in one struct, named so that it clashes with no column of the table.
"""

from __future__ import annotations

import json
import os
import re
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burstmill.llm.byte_bpe import latin_pattern
from burstmill.llm.texts import decoded
from burstmill.shared import fresh, ship_package, with_field

SENTENCE, INSIDE, SEQUENCE = 8, 96, 32
#: Tokens that are planned together.
BLOCK = 1 << 20
#: Distance of cuts inside a sentence that is longer than a window.
STEP = 64
#: Entries of one generation of a memo (there are two), and characters of an entry.
MEMO, MEMO_CHARS = 300_000, 48
#: Characters after which a long text is cut at the next white space.
SLICE = 1 << 20

#: Among these characters the classes of both pattern engines agree and nothing is left to normalize but case and space.
_LATIN = re.compile("[\t\n\r -~¡-ɏ]*")
_SPACE = re.compile("[\t\n\r ]")
_SENTENCE_END = re.compile("[.!?…。！？][\"')\\]}»”’]*$")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if it is printable, else one from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class Encoder(dict):
    """Ids of texts by a file of the `tokenizers` library; the dict is the younger generation of a memo.

    A file whose rules are: NFC, one space for white space, lower case; matches of one pattern that holds no white space;
    bytes; BPE, is handled match by match through the memo, as its ids of a text are those of its matches. Texts with characters
    beyond `_LATIN` or with the string of a special token, and all other files, go to the library as a whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        self.special = [t["content"] for t in rules["added_tokens"]]
        self.pattern = self._pattern(rules)
        letters = byte_letters()
        self.letters = {b: c for b, c in enumerate(letters)}
        of = {c: b for b, c in enumerate(letters)}
        size = self.library.get_vocab_size(with_added_tokens=True)
        self.ends, self.digits = np.zeros(size, bool), np.zeros(size, bool)
        suffix = rules["model"].get("end_of_word_suffix") or ""
        for token, i in rules["model"]["vocab"].items():
            ends = token.endswith(suffix)
            bare = token.removesuffix(suffix) if suffix else token
            text = bytes(of[c] for c in bare).decode("utf-8", "replace") if all(c in of for c in bare) else bare
            self.ends[i] = ends and bool(_SENTENCE_END.search(text))
            self.digits[i] = text[:1].isdigit()
        self.old: dict[str, bytes] = {}

    @staticmethod
    def _pattern(rules: dict) -> Callable | None:
        normal, cut, model = (rules.get(k) or {} for k in ("normalizer", "pre_tokenizer", "model"))
        kinds = [n.get("type") for n in normal.get("normalizers", [])]
        steps = cut.get("pretokenizers", [])
        known = kinds == ["NFC", "Replace", "Lowercase"] and [s.get("type") for s in steps] == ["Split", "ByteLevel"] and model.get("type") == "BPE"
        known = known and steps[0]["behavior"] == "Removed" and steps[0]["invert"] and not steps[1]["add_prefix_space"] and not steps[1]["use_regex"]
        found = latin_pattern(steps[0]["pattern"]["Regex"]) if known and rules.get("post_processor") is None else None
        return found.findall if found else None

    def __missing__(self, piece: str) -> bytes:
        """The ids of a match of the pattern, as little-endian unsigned 32-bit integers."""
        found = self.old.get(piece)
        if found is None:
            raw = piece.encode("utf-8", "replace").decode("latin-1").translate(self.letters)
            found = b"".join([t.id.to_bytes(4, "little") for t in self.library.model.tokenize(raw)])
            if len(piece) > MEMO_CHARS:
                return found
        if len(self) >= MEMO:
            self.old = self.copy()
            self.clear()
        self[piece] = found
        return found

    def encode(self, text: str) -> bytes:
        out, at = [], 0
        while at < len(text):
            end = len(text)
            if end - at > SLICE:
                space = _SPACE.search(text, at + SLICE)
                end = space.end() if space else end
            part = text[at:end] if at or end < len(text) else text
            at = end
            small = part.lower()
            if self.pattern and _LATIN.fullmatch(small) and not any(s in part for s in self.special):
                out.extend(map(self.__getitem__, self.pattern(small)))
            else:
                out.append(np.array(self.library.encode(part, add_special_tokens=False).ids, "<u4").tobytes())
        return b"".join(out)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a file; it lives as long as the worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def plan(places: np.ndarray, penalties: np.ndarray, window: int) -> tuple[list[int], int]:
    """(chosen places, cost): the cheapest windows from places[0] to places[-1], as indexes of where each ends.

    places: increasing, at most a window apart. Among equal costs the longer window wins, then that of a power of two's length.
    """
    n = len(places)
    # from each place, the places a power of two before it
    back, to = [], []
    for m in range(window.bit_length()):
        if 1 << m <= window:
            wanted = places - (1 << m)
            at = np.searchsorted(places, wanted)
            hit = np.flatnonzero(places[np.minimum(at, n - 1)] == wanted)
            back.append(at[hit])
            to.append(hit)
    back, to = np.concatenate(back), np.concatenate(to)
    order = np.argsort(to, kind="stable")
    back, first = back[order].tolist(), np.searchsorted(to[order], np.arange(n + 1)).tolist()
    p, pen = places.tolist(), penalties.tolist()
    cost, source = [0] * n, [0] * n
    queue: deque[tuple[int, int, int]] = deque([(p[0], p[0], 0)])  # (cost + place, place, index), costs increasing
    for j in range(1, n):
        here = p[j]
        while queue[0][1] < here - window:
            queue.popleft()
        head = queue[0]
        best, chosen = head[0] + window - here, head[2]
        for k in range(first[j], first[j + 1]):
            i = back[k]
            if cost[i] < best:
                best, chosen = cost[i], i
        best += pen[j] + SEQUENCE
        cost[j], source[j] = best, chosen
        value = best + here
        while queue and queue[-1][0] > value:
            queue.pop()
        queue.append((value, here, j))
    ends, j = [], n - 1
    while j:
        ends.append(j)
        j = source[j]
    return ends[::-1], cost[-1]


def cut_places(ids: np.ndarray, doc_ends: np.ndarray, sentence_ends: np.ndarray, digits: np.ndarray, window: int, last: bool) -> tuple[np.ndarray, np.ndarray]:
    """(places, penalties) for a stream of ids whose documents end at doc_ends (exclusive); last: nothing follows."""
    n = len(ids)
    ends = sentence_ends[ids]
    ends[:-1] &= ~digits[ids[1:]]  # a number goes on
    penalty = np.full(n + 1, -1, np.int32)
    penalty[1:][ends] = SENTENCE
    if last:
        tail = penalty[max(1, n - window) :]
        tail[tail < 0] = INSIDE
    penalty[0] = penalty[n] = 0
    penalty[doc_ends] = 0
    places = np.flatnonzero(penalty >= 0)
    wide = np.flatnonzero(np.diff(places) > window)
    if len(wide):
        more = np.concatenate([np.arange(places[k] + STEP, places[k + 1], STEP) for k in wide])
        penalty[more] = INSIDE
        places = np.flatnonzero(penalty >= 0)
    return places, penalty[places]


class _Stream:
    """The open documents of a partition, and the sequences made of them."""

    def __init__(self, enc: Encoder, window: int):
        self.enc, self.window, self.sequence = enc, window, TaskContext.get().partitionId() << 40
        self.rows: list[tuple[pa.RecordBatch, int]] = []
        self.ids: list[np.ndarray] = []
        self.done = 0  # tokens of the first open document that already lie in a sequence
        self.tokens = 0

    def add(self, batch: pa.RecordBatch, row: int, ids: np.ndarray) -> None:
        self.rows.append((batch, row))
        self.ids.append(ids)
        self.tokens += len(ids)

    def pieces(self, last: bool) -> pa.Table | None:
        """The pieces of all windows, but for the last one unless nothing follows."""
        if not self.rows:
            return None
        lengths = np.array([len(x) for x in self.ids])
        ids = np.concatenate(self.ids)[self.done :]
        starts = np.r_[0, np.cumsum(lengths)] - self.done  # of documents in the stream; the first may lie before it
        places, penalties = cut_places(ids, starts[1:], self.enc.ends, self.enc.digits, self.window, last)
        cuts = places[[0, *plan(places, penalties, self.window)[0]]]
        if not last:
            if len(cuts) < 3:
                return None
            cuts = cuts[:-1]
        stop = cuts[-1]
        edges = np.union1d(cuts, np.clip(starts[(starts > 0) & (starts < stop)], 0, stop))
        lo, hi = edges[:-1], edges[1:]
        doc = np.searchsorted(starts, lo, "right") - 1
        window = np.searchsorted(cuts, lo, "right") - 1
        made = {
            "start": lo - starts[doc],
            "length": hi - lo,
            "doc_tokens": lengths[doc],
            "sequence_id": self.sequence + window,
            "offset": lo - cuts[window],
        }
        raw = ids.astype("<u4")
        columns = {k: pa.array(v.astype(np.int64)) for k, v in made.items()} | {"ids": pa.array([raw[a:b].tobytes() for a, b in zip(lo.tolist(), hi.tolist())], pa.binary())}
        out = self._rows(doc).append_column("", pa.StructArray.from_arrays(list(columns.values()), names=list(columns)))
        self.sequence += len(cuts) - 1
        keep = int(np.searchsorted(starts, stop, "right")) - 1
        self.done = int(stop - starts[keep]) if keep < len(self.rows) else 0
        self.rows, self.ids = self.rows[keep:], self.ids[keep:]
        self.tokens = sum(map(len, self.ids)) - self.done
        return out

    def _rows(self, docs: np.ndarray) -> pa.Table:
        tables, at = [], 0
        while at < len(docs):
            batch = self.rows[docs[at]][0]
            end = at
            while end < len(docs) and self.rows[docs[end]][0] is batch:
                end += 1
            tables.append(pa.Table.from_batches([batch]).take(pa.array([self.rows[d][1] for d in docs[at:end].tolist()])))
            at = end
        return pa.concat_tables(tables)


def pack(docs: DataFrame, path: str, end: int, text: str = "text", keep: list[str] | None = None, window: int = 2048, order: list[str] | None = None) -> DataFrame:
    """One row for each piece of a document: docs' kept columns (all, if not given) and, as the last column, a struct of
    start, length, doc_tokens (with the end token), sequence_id, offset in the sequence, and ids as little-endian unsigned
    32-bit integers. path leads to the tokenizer's file on the driver; Spark ships it."""
    ship_package(docs.sparkSession)
    docs.sparkSession.sparkContext.addFile(path)
    file = os.path.basename(path)
    keep = docs.columns if keep is None else keep
    name, at = fresh(docs, "piece"), fresh(docs, "text_read")
    if order:
        docs = docs.repartitionByRange(*order).sortWithinPartitions(*order)
    fields = "struct<start:bigint,length:bigint,doc_tokens:bigint,sequence_id:bigint,offset:bigint,ids:binary>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from burstmill.llm.packing import _Stream, encoder as of_worker  # the module's own memo, not a copy of this closure

        enc = of_worker(SparkFiles.get(file))
        stream, close = _Stream(enc, window), np.array([end], "<u4").tobytes()

        def out(table: pa.Table | None) -> Iterator[pa.RecordBatch]:
            if table is not None:
                yield from table.rename_columns([*table.column_names[:-1], name]).to_batches(max_chunksize=10_000)

        for b in batches:
            kept = pa.RecordBatch.from_arrays(b.columns[:-1], names=b.schema.names[:-1])
            for i, raw in enumerate(b.column(b.num_columns - 1)):
                stream.add(kept, i, np.frombuffer(enc.encode(decoded(raw.as_py())) + close, "<u4"))
                if stream.tokens >= BLOCK:
                    yield from out(stream.pieces(False))
        yield from out(stream.pieces(True))

    return docs.select(*keep, F.col(text).cast("binary").alias(at)).mapInArrow(run, with_field(docs.select(*keep).schema, name, fields))


def sequences(pieces: DataFrame, piece: str = "piece") -> DataFrame:
    """(sequence_id, ids): each sequence's ids in order, as bytes. A sequence is a group of at most a window of ids."""
    p = F.col(piece)
    parts = F.sort_array(F.collect_list(F.struct(p["offset"].alias("offset"), F.hex(p["ids"]).alias("ids"))))
    return pieces.groupBy(p["sequence_id"].alias("sequence_id")).agg(F.unhex(F.array_join(parts["ids"], "")).alias("ids"))

"""Byte-level BPE encoding and decoding in two tiers.

A text is cut into pre-tokens by a pattern. A minimal perfect hash over the vocabulary's byte strings resolves a
pre-token that is a token itself. Any other pre-token is merged: its bytes form a linked list, and a heap holds the
neighbouring pairs that are tokens, lowest rank first, leftmost first among equals. Results of both tiers stay in a
bounded memo on each worker, as natural text repeats its pre-tokens, and merged short ones that have left it in a table
of fixed size. Decoding concatenates the tokens' bytes.

Null texts count as empty: no ids. Special tokens are not looked for. An empty table gives an empty result. A lone
surrogate, which UTF-8 lacks, becomes a question mark.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
import unicodedata
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burstmill.llm.texts import pieces, text_of
from burstmill.shared import fresh, ship_package, with_field

#: Pre-tokens that one generation of the memo holds; there are two generations.
MEMO = 100_000
#: Characters of a pre-token that the memo holds at most, so that it is bounded in bytes too.
MEMO_CHARS = 64
#: Rows of the table of merged pre-tokens; a row has a key, the number of its ids' bytes and the ids.
SHELF = 1 << 19
_KEY, _IDS = 15, 16
_ROW = _KEY + 1 + _IDS
#: Keys for each bucket of the perfect hash, on average.
_BUCKET = 2


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file in the order of their ranks."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    out = [b""] * len(pairs)
    for token, rank in pairs:
        out[int(rank)] = base64.b64decode(token)
    return out


class PerfectHash:
    """A minimal perfect hash of n keys to n slots (hash and displace): buckets of several keys get a displacement that
    leads all to free slots, largest buckets first; a bucket of one key names one of the slots that are left."""

    def __init__(self, keys: list[bytes]):
        n = self.n = len(keys)
        self.buckets = max(1, n // _BUCKET)
        members: list[list[int]] = [[] for _ in range(self.buckets)]
        hashes = [xxhash.xxh3_64_intdigest(k) for k in keys]
        for i, h in enumerate(hashes):
            members[h % self.buckets].append(i)
        self.shift = [0] * self.buckets
        self.rank_at = [-1] * n
        for b in sorted(range(self.buckets), key=lambda b: -len(members[b])):
            if len(members[b]) < 2:
                break
            d = 0
            while True:
                slots = [self._slot(hashes[i], d) for i in members[b]]
                if all(self.rank_at[s] < 0 for s in slots) and len(set(slots)) == len(slots):
                    break
                d += 1
            self.shift[b] = d
            for s, i in zip(slots, members[b]):
                self.rank_at[s] = i
        free = iter([s for s in range(n) if self.rank_at[s] < 0])
        for b, only in enumerate(members):
            if len(only) == 1:
                s = next(free)
                self.shift[b], self.rank_at[s] = -s - 1, only[0]
        self.keys = keys

    def _slot(self, h: int, d: int) -> int:
        return ((h >> 20) + d * (h & 0xFFFFF) + d * d * 7) % self.n

    def rank(self, key: bytes, h: int | None = None) -> int:
        """The rank of the key, or -1 if it is not one; h is the key's hash, if known."""
        if not self.n:
            return -1
        if h is None:
            h = xxhash.xxh3_64_intdigest(key)
        d = self.shift[h % self.buckets]
        rank = self.rank_at[-d - 1 if d < 0 else self._slot(h, d)]
        return rank if self.keys[rank] == key else -1


#: Texts of these characters alone are cut by the standard library's engine, which is faster: among them its classes
#: and those of Unicode properties agree.
_LATIN = re.compile("[\t\n\r -~\u00a1-\u024f]*")


def latin_pattern(pattern: str) -> re.Pattern | None:
    """The pattern for texts that _LATIN matches, with \\p{L} and \\p{N} spelled out; None if it holds other properties."""
    for kind in "LN":
        members = [c for c in map(chr, range(0x250)) if unicodedata.category(c)[0] == kind]
        inner = "".join(map(re.escape, members))
        out, depth, i = "", 0, 0
        while i < len(pattern):
            if pattern.startswith(f"\\p{{{kind}}}", i):
                out += inner if depth else f"[{inner}]"
                i += 5
                continue
            step = 2 if pattern[i] == "\\" else 1
            depth += (pattern[i] == "[") - (pattern[i] == "]")
            out += pattern[i : i + step]
            i += step
        pattern = out
    try:
        return None if re.search(r"\\[pPXRKG]|\[\[|&&", pattern) else re.compile(pattern)
    except re.error:
        return None


class Encoder(dict):
    """Maps a pre-token to its ids as little-endian unsigned 32-bit integers; the dict is the younger memo generation."""

    def __init__(self, tokens: list[bytes], pattern: str):
        super().__init__()
        self.tokens, self.hash = tokens, PerfectHash(tokens)
        self.ranks = {t: i for i, t in enumerate(tokens)}  # of pairs, while merging
        self.ids = [i.to_bytes(4, "little") for i in range(len(tokens))]
        self.of_byte = [self.ids[self.ranks[x]] if (x := bytes([b])) in self.ranks else None for b in range(256)]
        self.of_two = [[0] * 256 for _ in range(256)]  # one more than the rank of two bytes, or 0 if they are no token
        for t, i in self.ranks.items():
            if len(t) == 2:
                self.of_two[t[0]][t[1]] = i + 1
        self.values = pa.array(tokens, pa.binary())
        self.rows, self.shelf = SHELF, bytearray(SHELF * _ROW)
        self.any_text = regex.compile(pattern).findall
        latin = latin_pattern(pattern)
        self.latin_text = latin.findall if latin else None
        self.old: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        found = self.old.get(piece)
        if found is None:
            raw = piece.encode("utf-8", "replace")
            h = xxhash.xxh3_64_intdigest(raw)
            rank = self.hash.rank(raw, h)
            found = self.shelved(raw, h) if rank < 0 else self.ids[rank]
            if len(piece) > MEMO_CHARS:
                return found
        if len(self) >= MEMO:
            self.old = self.copy()
            self.clear()
        self[piece] = found
        return found

    def shelved(self, raw: bytes, h: int) -> bytes:
        """The ids of raw, whose hash is h, from its row of the table or merged; what is new takes its row's place."""
        if len(raw) > _KEY or not raw[-1]:  # keys are filled up with zeros
            return self.merge(raw)
        shelf, key = self.shelf, raw.ljust(_KEY, b"\0")
        at = h % self.rows * _ROW
        if shelf.startswith(key, at):
            return bytes(shelf[at + _KEY + 1 : at + _KEY + 1 + shelf[at + _KEY]])
        found = self.merge(raw)
        if len(found) <= _IDS:
            shelf[at : at + _ROW] = b"%b%c%b" % (key, len(found), found.ljust(_IDS, b"\0"))
        return found

    def merge(self, raw: bytes) -> bytes:
        """The ids of raw. Bytes are linked by where each part ends and where the one before it starts; a heap entry
        packs rank, start and end of a pair, and one that no longer fits the links is passed over."""
        n, rank, of_two, ids = len(raw), self.ranks.get, self.of_two, self.ids
        wide = 6 if n < 64 else 20 if n < 1 << 20 else 40  # entries of short ones stay small numbers
        low, both, step = (1 << wide) - 1, 2 * wide, (1 << wide) + 1
        end, before = [*range(1, n + 1)], [*range(-1, n)]
        of_byte = self.of_byte
        parts = [of_byte[b] for b in raw]
        heap, place, a = [], 2, raw[0]
        for b in raw[1:]:
            if r := of_two[a][b]:
                heap.append((r << both) + place)
            a = b
            place += step
        heapify(heap)
        while heap:
            entry = heappop(heap)
            stop, i = entry & low, entry >> wide & low
            middle = end[i]
            if not 0 < middle < stop or end[middle] != stop:
                continue
            end[i], end[middle] = stop, 0
            parts[i], parts[middle] = ids[(entry >> both) - 1], b""
            if stop < n:
                before[stop] = i
                if (r := rank(raw[i : end[stop]])) is not None:
                    heappush(heap, (r + 1 << wide | i) << wide | end[stop])
            if i:
                h = before[i]
                if (r := rank(raw[h:stop])) is not None:
                    heappush(heap, (r + 1 << wide | h) << wide | stop)
        return b"".join(parts)

    def cut(self, text: str) -> list[str]:
        return self.latin_text(text) if self.latin_text and _LATIN.fullmatch(text) else self.any_text(text)

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self.cut(text)))

    def decode(self, ids: bytes) -> bytes:
        found = self.values.take(pa.array(np.frombuffer(ids, "<u4")))
        _, ends, data = found.buffers()
        return data[: np.frombuffer(ends, "<i4")[len(found)]].to_pybytes() if len(found) else b""


_encoders: dict[tuple, Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    """The worker's encoder for a rank file; it lives as long as the worker."""
    if (path, pattern) not in _encoders:
        _encoders[path, pattern] = Encoder(read_ranks(path), pattern)
    return _encoders[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", keep: list[str] | None = None, digests: bool = False) -> DataFrame:
    """docs' kept columns (all, if not given) and, as the last column, a struct of the encoding.

    It holds n_tokens and, unless digests is set, ids and decoded (the bytes that the ids decode to); with digests the
    SHA-256 of either, in lower-case hexadecimal digits. path leads to the rank file on the driver; Spark ships it.
    Bytes of a text that are not UTF-8 are encoded as U+FFFD.
    """
    ship_package(docs.sparkSession)
    docs.sparkSession.sparkContext.addFile(path)
    file = os.path.basename(path)
    keep = docs.columns if keep is None else keep
    name, at = fresh(docs, "encoding"), fresh(docs, "text_read")
    fields = "ids_sha256:string,decoded_sha256:string" if digests else "ids:array<int>,decoded:binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from burstmill.llm.byte_bpe import encoder as of_worker  # the module's own memo, not a copy of this closure

        e = of_worker(SparkFiles.get(file), pattern)
        for b in pieces(batches):
            counts, first, second = [], [], []
            for x in b.column(b.num_columns - 1):
                ids = e.encode(text_of(x))
                back = e.decode(ids)
                counts.append(len(ids) // 4)
                first.append(hashlib.sha256(ids).hexdigest() if digests else np.frombuffer(ids, "<i4"))
                second.append(hashlib.sha256(back).hexdigest() if digests else back)
            kinds = (pa.string(), pa.string()) if digests else (pa.list_(pa.int32()), pa.binary())
            made = pa.StructArray.from_arrays([pa.array(counts, pa.int64()), pa.array(first, kinds[0]), pa.array(second, kinds[1])], names=["n_tokens", *(f.split(":")[0] for f in fields.split(","))])
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], made], names=[*b.schema.names[:-1], name])

    return docs.select(*keep, F.col(text).alias(at)).mapInArrow(run, with_field(docs.select(*keep).schema, name, f"struct<n_tokens:bigint,{fields}>"))

"""Texts as the operators of this subpackage read them."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import pyarrow as pa

#: Rows that an operator works on at once. Spark's batches have 10,000, whose words, shingles or counts take many times their texts.
PIECE = 1000


def decoded(raw: bytes | None) -> str:
    """The text of a column cast to binary: null is empty, and bytes that are not UTF-8 become U+FFFD."""
    return raw.decode("utf-8", "replace") if raw else ""


def text_of(value: pa.StringScalar) -> str:
    """The same for a value of a string column, whose bytes nothing has checked."""
    raw = value.as_buffer()
    return decoded(raw.to_pybytes()) if raw else ""


def give_back() -> None:
    """Return memory that nothing uses to the system; Arrow and the C library keep it otherwise."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of at most PIECE rows; after the last one a worker, which outlives its task, keeps no unused memory."""
    for b in batches:
        for start in range(0, b.num_rows, PIECE):
            yield b.slice(start, PIECE)
        del b
    give_back()

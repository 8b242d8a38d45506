"""What the Python side of the pipeline's stages holds at once, and keeps between tasks."""

import sys
import tracemalloc

import numpy as np
import public_tokenizers as P
import pyarrow as pa
from burstmill.llm import byte_bpe, near_copies, texts


def test_memo_stays_small():
    """Both generations of the memo over many distinct pre-tokens."""
    e = byte_bpe.Encoder(byte_bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), P.PATTERN)
    e.merge = lambda raw: bytes(8) + raw[:0]  # ids don't matter here
    for i in range(650_000):
        e[f"word{i}"]
    held = sum(sys.getsizeof(d) + sum(sys.getsizeof(k) + sys.getsizeof(v) for k, v in d.items()) for d in (e, e.old))
    assert held < 40e6


def test_block_takes_little_memory():
    """A block of 2048 nodes a side, by pairs of near copies; far less than its pairs in 64 bits."""
    rng = np.random.default_rng(3)
    n = near_copies.BLOCK_NODES
    sets = rng.integers(0, 1 << 62, (n, 20))
    nodes, side = np.r_[np.arange(n) + n, np.arange(n)], np.repeat([0, 1], n)
    rows = pa.table({"side": side, "node": nodes, "found": pa.array([*map(np.sort, sets), *map(np.sort, sets)], pa.list_(pa.int64()))})
    tracemalloc.start()
    found = near_copies._linked_in_block(rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found.to_pydict() == {"a": list(range(n, 2 * n)), "b": list(range(n))}
    assert peak < 70e6


def test_pieces_keep_all_rows():
    batches = [pa.record_batch({"x": list(range(k, k + m))}) for k, m in ((0, 2500), (2500, 0), (2500, 1000), (3500, 1))]
    found = list(texts.pieces(iter(batches)))
    assert [b.num_rows for b in found] == [1000, 1000, 500, 1000, 1]
    assert [x for b in found for x in b.column(0).to_pylist()] == list(range(3501))

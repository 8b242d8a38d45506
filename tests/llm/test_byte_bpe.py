import functools
import hashlib
import random
import struct

import public_tokenizers as P
import pytest
import tiktoken
from burstmill.llm import byte_bpe as B
from hypothesis import given, settings
from hypothesis import strategies as st

PATH = P.path("byte_bpe_50k.tiktoken")


@functools.cache
def encoders():
    own = B.encoder(PATH, P.PATTERN)
    return own, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={t: i for i, t in enumerate(own.tokens)}, special_tokens={})


@pytest.fixture
def both():
    return encoders()


def ids_of(encoder, text):
    raw = encoder.encode(text)
    return list(struct.unpack(f"<{len(raw) // 4}I", raw))


def test_perfect_hash(both):
    own = both[0]
    assert sorted(own.hash.rank_at) == list(range(len(own.tokens)))
    assert [own.hash.rank(t) for t in own.tokens] == list(range(len(own.tokens)))
    assert own.hash.rank(b"no such token") == -1 and B.PerfectHash([]).rank(b"x") == -1


def test_random_texts(both):
    own, other = both
    random.seed(11)
    parts = ["ab", "the ", " \n", "\t", "é", "漢字", "😀", "1", "²", "½", "'s", "'LL", " ", "\x1c", "\x85", "ſ", "   ", "!!", "_", "́", "aaaaaaaa", "<|endoftext|>"]
    for _ in range(2000):
        text = "".join(random.choice(parts) for _ in range(random.randrange(25)))
        assert ids_of(own, text) == other.encode_ordinary(text), repr(text)
        assert own.decode(own.encode(text)) == text.encode()
    long = "x" * 70_000
    assert own.decode(own.encode(long)) == long.encode()


@settings(max_examples=400, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"])))
def test_any_text(text):
    own, other = encoders()
    assert ids_of(own, text) == other.encode_ordinary(text)
    assert own.decode(own.encode(text)) == text.encode()


def test_memo_turns_over(both, monkeypatch):
    monkeypatch.setattr(B, "MEMO", 5)
    own, text = B.Encoder(both[0].tokens, P.PATTERN), "one two three four five six seven eight nine zzyzx one two qqqq one"
    assert ids_of(own, text) == both[1].encode_ordinary(text) and len(own) <= 5


def test_documents(spark, both):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = B.encode(docs, PATH, P.PATTERN, digests=True).select("doc_id", "text", "encoding.*").collect()
    assert len(rows) == docs.count()
    for r in rows:
        ids = both[1].encode_ordinary(r.text)
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()


def test_odd_and_empty(odd_docs, no_docs):
    out = B.encode(odd_docs, PATH, P.PATTERN)
    assert out.columns[:-1] == odd_docs.columns
    for r in out.collect():
        e = r[out.columns[-1]]
        assert bytes(e.decoded) == (r.text or "").encode() and e.n_tokens == len(e.ids)
    assert B.encode(no_docs, PATH, P.PATTERN).collect() == []


def test_short_pre_tokens_are_merged_once(both, monkeypatch):
    """Also after they have left the memo, as long as nothing takes their row of the table."""
    monkeypatch.setattr(B, "MEMO", 5)
    own, text = B.Encoder(both[0].tokens, P.PATTERN), "zyzzx qqvv xkcdq wvwvx jjkq zzgw pqpqz xxyq " * 30
    merged, merge = [], own.merge
    own.merge = lambda raw: merged.append(raw) or merge(raw)
    assert ids_of(own, text) == both[1].encode_ordinary(text)
    kept = [raw for raw in merged if len(merge(raw)) <= 4 * 4]  # a row has room for four ids
    assert len(kept) == len(set(kept)) > 5


def test_rows_of_the_table_are_shared(both, monkeypatch):
    """Few rows, keys that differ in zeros at their end alone, and keys and ids that are too long for a row."""
    monkeypatch.setattr(B, "MEMO", 3)
    monkeypatch.setattr(B, "SHELF", 2)
    own = B.Encoder(both[0].tokens, P.PATTERN)
    random.seed(4)
    parts = ["zyzzx", " qqvv", "\0", "\0\0", "q\0", "\x01\0", "漢字", "éàü", " xkcdqzzgwpqpqz", " xkcdqzzgwpqpqzz", "zqzqzqzqzqzq", "x" * 62, "qz" * 32, "qz" * 31 + "q", " ", "12"]
    for _ in range(600):
        text = "".join(random.choices(parts, k=random.randrange(30)))
        assert ids_of(own, text) == both[1].encode_ordinary(text), repr(text)
        assert own.decode(own.encode(text)) == text.encode()

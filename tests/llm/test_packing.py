import json
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from burstmill.llm import packing
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def enc():
    return packing.Encoder(PATH)


def ids_of(raw):
    return np.frombuffer(raw, "<u4").tolist()


ODD = ["", "It's 3.14, isn't it?!  ÇA va…", "İstanbul Ⱥ ŉ", "ΣΑΣ 日本語。", "áb é", "<|endoftext|> x", "x y\x85z\x1cw", "​", "don'T WE'VE 12½ ²", "𝒳 🙂"]


@pytest.mark.parametrize("text", ODD)
def test_ids_of_odd_texts(enc, library, text):
    assert ids_of(enc.encode(text)) == library.encode(text, add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("aBcÉ'sd.,!?-_ \n\t0½ßŒ\x0b́Ω"), max_size=40))
def test_ids_as_the_library(enc, library, text):
    assert ids_of(enc.encode(text)) == library.encode(text, add_special_tokens=False).ids


def test_slices_of_a_long_text(enc, library, monkeypatch):
    text = "One two-three, four's. " * 50 + "x" * 300 + " Σ end"
    monkeypatch.setattr(packing, "SLICE", 37)
    assert ids_of(enc.encode(text)) == library.encode(text, add_special_tokens=False).ids


def cost_of(length, penalty, window):
    return (0 if length & (length - 1) == 0 else window - length) + penalty + packing.SEQUENCE


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 16), st.sampled_from([0, packing.SENTENCE, packing.INSIDE])), min_size=1, max_size=30))
def test_the_plan_is_the_cheapest(steps):
    window = 16
    places = np.cumsum([0] + [s for s, _ in steps])
    penalties = np.array([0] + [p for _, p in steps])
    best = [0] + [None] * len(steps)
    for j in range(1, len(places)):
        best[j] = min(best[i] + cost_of(int(places[j] - places[i]), int(penalties[j]), window) for i in range(j) if places[j] - places[i] <= window)
    ends, cost = packing.plan(places, penalties, window)
    assert cost == best[-1]
    cuts = [0, *ends]
    assert cuts[-1] == len(steps) and sum(cost_of(int(places[b] - places[a]), int(penalties[b]), window) for a, b in zip(cuts, cuts[1:])) == cost
    assert all(places[b] - places[a] <= window for a, b in zip(cuts, cuts[1:]))


def check(pieces, texts, library, window):
    """texts: by doc_id."""
    sequences = defaultdict(list)
    docs = defaultdict(list)
    for r in pieces:
        p = r["piece"]
        assert len(ids_of(p["ids"])) == p["length"] > 0
        docs[r["doc_id"]].append((p["start"], ids_of(p["ids"]), p["doc_tokens"]))
        sequences[p["sequence_id"]].append((p["offset"], p["length"]))
    for doc, text in texts.items():
        whole = [i for _, ids, _ in sorted(docs[doc]) for i in ids]
        assert whole == library.encode(text, add_special_tokens=False).ids + [1]
        assert all(n == len(whole) for _, _, n in docs[doc])
        assert [s for s, _, _ in sorted(docs[doc])] == np.cumsum([0] + [len(i) for _, i, _ in sorted(docs[doc])])[:-1].tolist()
    padded = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
        padded += 0 if at & (at - 1) == 0 else window - at
    return padded, sum(n for _, _, n in (d[0] for d in docs.values()))


def test_documents_of_the_table(spark, library, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK", 20_000)  # closures carry it to the workers
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    found = packing.pack(docs, PATH, 1, keep=["doc_id"]).collect()
    padded, total = check(found, texts, library, 2048)
    assert padded < 0.02 * total


def test_odd_rows(spark, library):
    rows = [(0, None, 1), (1, "", 2), (2, "Same text. Again.", 3), (2, "Same text. Again.", 3), (3, "word " * 9000, 4), (None, "no id", 5), (4, "ΣΑΣ ü", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, piece int").coalesce(1)
    found = packing.pack(docs, PATH, 1, window=256)
    assert found.columns == ["doc_id", "text", "piece", "piece_"]
    again = [{"doc_id": (r["doc_id"], r["piece"], n % 2 if r["doc_id"] == 2 else 0), "piece": r["piece_"]} for n, r in enumerate(found.orderBy("piece_.sequence_id", "piece_.offset").collect())]
    whole = {(None, 5, 0): "no id", (0, 1, 0): "", (1, 2, 0): "", (3, 4, 0): "word " * 9000, (4, 6, 0): "ΣΑΣ ü"}
    by_doc = defaultdict(list)
    for r in again:
        by_doc[r["doc_id"][:2]].append((r["piece"]["start"], ids_of(r["piece"]["ids"])))
    for (doc, tag, _), text in whole.items():
        assert [i for _, ids in sorted(by_doc[doc, tag]) for i in ids] == library.encode(text, add_special_tokens=False).ids + [1]
    twice = library.encode("Same text. Again.", add_special_tokens=False).ids + [1]
    assert sum(len(ids) for _, ids in by_doc[2, 3]) == 2 * len(twice)


def test_bytes_that_are_not_text(spark, library):
    docs = spark.sql("SELECT 1L AS doc_id, cast(X'61FF62' AS string) AS text")
    found = packing.pack(docs, PATH, 1, keep=["doc_id"]).first()["piece"]
    assert ids_of(found["ids"]) == library.encode("a�b", add_special_tokens=False).ids + [1]


def test_sequences_and_order(spark, library):
    docs = spark.createDataFrame([(k, f"Document {k}.") for k in (5, 3, 9, 1)], "doc_id long, text string").repartition(2)
    pieces = packing.pack(docs, PATH, 1, order=["doc_id"], window=8)
    joined = [i for r in packing.sequences(pieces).orderBy("sequence_id").collect() for i in ids_of(r["ids"])]
    assert joined == [i for k in (1, 3, 5, 9) for i in library.encode(f"Document {k}.", add_special_tokens=False).ids + [1]]


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), PATH, 1).count() == 0


def test_other_tokenizer_files_go_to_the_library(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    enc, library = packing.Encoder(path), Tokenizer.from_file(path)
    assert enc.pattern is None and ids_of(enc.encode("Some Text, here.")) == library.encode("Some Text, here.", add_special_tokens=False).ids
    assert json.load(open(path, encoding="utf-8"))["model"]["type"] == "BPE"

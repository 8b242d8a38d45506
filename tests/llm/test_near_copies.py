import itertools
import random

import corpus_pipeline as C
from burstmill.llm import near_copies as N

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def slow_kept(rows):
    """The smallest id of each component of pairs at 0.8 or more, by all pairs of shingle sets."""
    sets = {}
    for i, t in rows:
        w = (t or "").lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((top(a), top(b)))
            root[y] = x
    return {top(i) for i in sets}


def changed(rng, words, n):
    out = list(words)
    for k in rng.sample(range(len(out)), n):
        out[k] = f"new{rng.random()}"
    return out


def test_stage_finds_planted_near_copies(spark):
    """Copies with some words exchanged, most of them further than 2 bits apart; some too far to be copies; one large group."""
    rng = random.Random(5)
    texts = []
    for _ in range(60):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(60, 200))]
        texts += [base, changed(rng, base, 1), changed(rng, base, 2), changed(rng, base, 3), changed(rng, base, len(base) // 8)]
    base = [f"w{rng.randrange(5000)}" for _ in range(150)]
    texts += [changed(rng, base, 1) for _ in range(120)] + [["few", "words"], ["Few", "words"], ["few"], []]
    rng.shuffle(texts)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(1000, None), (1001, "few  words")]
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in rows], SCHEMA)
    found = {r.doc_id for r in C.near_duplicates(spark, docs, "").collect()}
    assert found == slow_kept(rows)


def test_stage_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = {r.doc_id for r in C.near_duplicates(spark, docs, "").collect()}
    assert found == slow_kept([(r.doc_id, r.text) for r in docs.collect()])


def test_odd_and_empty(spark, odd_docs, no_docs):
    assert N.deduplicate(no_docs).collect() == []
    found = N.deduplicate(odd_docs)
    assert found.columns == odd_docs.columns and sorted(r.doc_id for r in found.collect()) == [1, 2, 4, 5, 6, 8]


def families(rng):
    """A text and copies with one or two words exchanged, which are linked to the text and hardly to each other; a family
    that is linked throughout; texts that share a passage of half their length; blocks of few nodes."""
    hub = [f"h{rng.randrange(5000)}" for _ in range(60)]
    texts = [hub] + [changed(rng, hub, rng.choice([1, 1, 2])) for _ in range(150)]
    base = [f"b{rng.randrange(5000)}" for _ in range(120)]
    texts += [base] + [changed(rng, base, 1) for _ in range(100)]
    passage = [f"p{rng.randrange(5000)}" for _ in range(60)]
    texts += [passage + [f"q{rng.random()}" for _ in range(rng.randrange(5, 60))] for _ in range(150)]
    return texts


def test_crowded_buckets_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK_NODES", 40)
    monkeypatch.setattr(N, "_COLUMNS", 50)
    rng = random.Random(11)
    texts = families(rng)
    rng.shuffle(texts)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    found = {r.doc_id for r in N.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    slow = slow_kept(rows)
    assert found == slow and len(slow) < 400

import random

import numpy as np
import xxhash
from burstmill.llm import simhash as S
from burstmill.operators.components import connected_components


def slow_print(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate({9: 32, 10: 32, 11: 32, 12: 32, 13: 32}).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(pairs):
    """pairs: (key, fingerprint); the smallest key reachable over links of at most 2 bits, by brute force."""
    prints = sorted({f for _, f in pairs})
    root = {f: f for f in prints}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(prints):
        for b in prints[:i]:
            if (a ^ b).bit_count() <= 2:
                root[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for k, f in pairs:
        if k is not None:
            least[find(f)] = min(k, least.get(find(f), k))
    return {(k, f): least.get(find(f)) for k, f in pairs}


def test_golay_decodes_all_words_within_three_bits():
    errors, _ = S._decoder()
    assert len(np.unique(errors)) == 2048 and max(int(e).bit_count() for e in errors) == 3
    words = np.arange(0, 1 << 23, 4097, dtype=np.int64)
    own, near = S.golay_keys(words)
    distinct = [len(set(r)) for r in near.tolist()]
    assert set(distinct) == {1, 6} and 0.8 < np.mean(np.array(distinct) == 6) < 0.92
    for bit in range(23):
        other = S.golay_keys(words ^ (1 << bit))[0]
        assert all(o in set(r) for o, r in zip(other.tolist(), near.tolist()))


def test_keys_meet_within_two_bits():
    random.seed(1)
    for _ in range(300):
        a = random.getrandbits(64)
        b = a ^ (1 << random.randrange(64)) ^ (1 << random.randrange(64)) if random.random() < 0.9 else a ^ (1 << random.randrange(64))
        row, key, own = S.fuzzy_keys(np.array([a, b], np.uint64))
        assert set(key[(row == 0) & own]) & set(key[row == 1]) and set(key[row == 0]) & set(key[(row == 1) & own])


def test_links_by_brute_force_with_crowded_buckets(spark):
    """Random prints, and clusters far larger than MAX_BUCKET around some of them."""
    random.seed(7)
    prints = {random.getrandbits(64) for _ in range(300)}
    for centre in list(prints)[:4]:
        for _ in range(120):
            x = centre
            for _ in range(random.randrange(1, 5)):
                x ^= 1 << random.randrange(64)
            prints.add(x)
    prints |= {0, 1, 3, (1 << 64) - 1}
    signed = [(int(np.uint64(f).view(np.int64)),) for f in prints]
    rows = connected_components(S.links(spark.createDataFrame(signed, "f long"))).collect()
    found = {r.node & (1 << 64) - 1: r.root & (1 << 64) - 1 for r in rows}
    slow = slow_components([(f, f) for f in prints])
    groups = {}
    for f in prints:
        groups.setdefault(found.get(f, f), set()).add(f)
    expected = {}
    for f in prints:
        expected.setdefault(slow[f, f], set()).add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_documents_by_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    pairs = [(r.doc_id, slow_print(r.text)) for r in docs.collect()]
    slow = slow_components(pairs)
    rows = S.near_duplicates(docs).collect()
    assert len(rows) == len(pairs)
    for r in rows:
        f = dict(pairs)[r.doc_id]
        assert r.fingerprint == f"{f:016x}" and r.component_id == slow[r.doc_id, f]


def test_odd_and_empty(odd_docs, no_docs):
    rows = S.near_duplicates(odd_docs.select("doc_id", "text")).collect()
    slow = slow_components([(r.doc_id, int(r.fingerprint, 16)) for r in rows])
    assert len(rows) == odd_docs.count()
    assert all(r.component_id == slow[r.doc_id, int(r.fingerprint, 16)] for r in rows)
    by = {r.doc_id: r for r in rows}
    assert by[2].fingerprint == by[3].fingerprint == by[7].fingerprint == "0" * 16 and by[3].component_id == by[7].component_id == 2
    assert by[None].component_id == 5
    kept = S.deduplicate(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(ids) == sorted({r.component_id for r in rows})
    assert S.near_duplicates(no_docs).collect() == [] and S.deduplicate(no_docs).collect() == []

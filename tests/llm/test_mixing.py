import re

import pytest
from burstmill.llm import mixing as M

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow_targets(sizes):
    """Share by weight, cap, and share the excess again until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: M.WEIGHTS[i % 3] for i, s in enumerate(order)}
    target, left, open_ = dict.fromkeys(order, 0.0), M.BUDGET * sum(sizes.values()), set(order)
    while open_ and left > 1e-9:
        total = sum(weight[s] for s in open_)
        for s in open_:
            target[s] += left * weight[s] / total
        left = 0.0
        for s in list(open_):
            if target[s] > 2 * sizes[s]:
                left += target[s] - 2 * sizes[s]
                target[s] = 2.0 * sizes[s]
                open_.discard(s)
    return target


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 10, "c": 10, "d": 10}, {"a": 1, "b": 1000, "c": 5, None: 3}, {"x": 7}, {"a": 0, "b": 0}, {"a": 100, "b": 1, "c": 1, "d": 1, "e": 500, "f": 20}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    found = {r.source: r.target for r in M.targets(df).collect()}
    assert found == pytest.approx(slow_targets(sizes))


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r for r in docs.collect()}
    rows = M.mix(docs).collect()
    again = M.mix(docs.repartition(7)).collect()
    assert sorted(rows) == sorted(again) and len(rows) == len(texts)
    size = {k: len(WORD.findall(r.text)) for k, r in texts.items()}
    sources = {}
    for k, r in texts.items():
        sources[r.source] = sources.get(r.source, 0) + size[k]
    target = slow_targets(sources)
    taken = dict.fromkeys(sources, 0)
    for r in rows:
        s = texts[r.doc_id].source
        assert r.size == size[r.doc_id] and r.source_size == sources[s] and r.target == pytest.approx(target[s])
        assert r.taken in (0, r.size, 2 * r.size)
        assert r.taken >= int(target[s] // sources[s]) * r.size
        taken[s] += r.taken
    assert all(abs(taken[s] - target[s]) <= 0.01 * target[s] + 10 for s in sources)
    out = M.mixture(docs)
    assert out.columns == docs.columns
    times = {}
    for r in out.select("doc_id").collect():
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    assert all(times.get(r.doc_id, 0) * r.size == r.taken for r in rows if r.size)


def test_order_of_keys(spark):
    """Among whole selections those with smaller keys come first, save for the closing document."""
    docs = spark.createDataFrame([(i, "w " * (i % 7 + 1), "s" if i % 2 else "t") for i in range(400)], "doc_id long, text string, source string")
    units = M.sized(docs, "text", "source", "doc_id", None, "u").select("u.*")
    found = M.copies(units, M.plan(units)).collect()
    for s in "st":
        own = sorted((r.e, r.n) for r in found if r.source == s)
        most = max(n for _, n in own)
        first_out = next((i for i, (_, n) in enumerate(own) if n < most), len(own))
        assert sum(n == most for _, n in own[first_out:]) <= 1


def test_odd_and_empty(odd_docs, no_docs):
    rows = M.mix(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by = {r.doc_id: r for r in rows}
    assert by[2].taken == by[3].taken == 0 and all(r.taken <= 2 * r.size for r in rows)
    assert M.mixture(odd_docs).columns == odd_docs.columns
    M.mixture(odd_docs).collect()
    assert M.mix(no_docs).collect() == [] and M.mixture(no_docs).collect() == []


def test_null_ids_are_not_one_document(spark):
    """Rows without an id have keys of their own, so a source of them meets its target too."""
    docs = spark.range(400).selectExpr("CAST(NULL AS bigint) AS doc_id", "concat('some words and the number ', id) AS text", "if(id < 40, 'a', 'b') AS source")
    rows = M.mix(docs).collect()
    for size in {r.source_size for r in rows}:
        own = [r for r in rows if r.source_size == size]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 6

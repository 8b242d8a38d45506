import corpus_pipeline as C
import numpy as np
import public_tokenizers as P
import tiktoken
from burstmill.llm import byte_bpe, language_id, quality_rules
from test_mixing import slow_targets
from test_near_copies import slow_kept


def test_against_brute_force(spark):
    """Each stage on what the one before it kept, by plain Python."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept, stages = docs, {}
    for name, stage in C.STAGES:
        kept = stage(spark, kept, sf)
        stages[name] = kept.collect()
        assert name == C.STAGES[-1][0] or kept.columns == docs.columns
    quality, language, near, mixed, tokens = stages.values()
    rows = {r.doc_id: r for r in docs.collect()}
    described = {k: quality_rules.describe(r.text) for k, r in rows.items()}
    base_ok = {k for k, d in described.items() if d[0] >= 10 and 5 * d[4] <= d[0]}
    good = {r.doc_id for r in quality}
    assert good <= base_ok and len(good) > 0.8 * len(base_ok)
    spoken = {r.doc_id for r in language}
    assert spoken <= good and len(spoken) >= 0.99 * len(good)
    assert {r.doc_id for r in near} == slow_kept([(k, rows[k].text) for k in sorted(spoken)])
    size = {r.doc_id: described[r.doc_id][0] for r in near}
    sources, taken = {}, {}
    for r in near:
        sources[r.source] = sources.get(r.source, 0) + size[r.doc_id]
    for r in mixed:
        taken[r.source] = taken.get(r.source, 0) + size[r.doc_id]
    target = slow_targets(sources)
    assert all(abs(taken[s] - target[s]) <= max(size[r.doc_id] for r in near if r.source == s) for s in sources)
    own = byte_bpe.encoder(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    other = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={t: i for i, t in enumerate(own.tokens)}, special_tokens={})
    assert sorted((r.doc_id, r.n_tokens) for r in tokens) == sorted((r.doc_id, len(other.encode_ordinary(r.text))) for r in mixed)
    whole = C.run(spark, sf)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, tokens))


def test_odd_and_empty(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        kept = docs
        for name, stage in C.STAGES:
            alone = stage(spark, docs, "")
            kept = stage(spark, kept, "")
            assert name == C.STAGES[-1][0] or alone.columns == kept.columns == docs.columns
            alone.collect()
        kept.collect()


def test_clean_documents_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    found = language_id.predict(docs, language_id.fit(docs, usable=~language_id.held_out()), keep=["doc_id", "text"]).select("doc_id", "text", "language.*").collect()
    kept = np.mean([r.lang_pred != "und" and r.score >= C.MIN_LANGUAGE_SCORE for r in found if len(r.text.split()) >= quality_rules.MIN_BASE_WORDS])
    assert kept > 0.999

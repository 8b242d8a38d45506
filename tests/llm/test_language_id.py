import zlib

import numpy as np
from burstmill.llm import language_id as L
from burstmill.llm import queries


def kernel(a, b):
    grams = lambda t: {x[i : i + n] for x in [f"\0\0{t}\0\0"] for n in (1, 2, 3) for i in range(len(x) - n + 1)}
    x, y = grams(a), grams(b)
    return len(x & y) / np.sqrt(len(x) * len(y))


def test_scores_are_the_kernel_regression():
    """Every n-gram a feature and every text a landmark: the features' products are the kernel itself."""
    texts = ["der hund und die katze", "the dog and the cat", "el perro y el gato", "das haus ist alt", "the house is old"]
    labels = ["de", "en", "es", "de", "en"]
    model = L._train([L.text_codes(t) for t in texts], labels, [1, 1, 1, 2, 2])
    x, n = L.Scorer(model).presence(texts)
    assert (x.sum(1) == n).all()
    land = x / np.sqrt(x.sum(1, keepdims=True))
    slow = np.array([[kernel(a.replace(" ", "\0"), b.replace(" ", "\0")) for b in texts] for a in texts])
    assert np.allclose(land @ land.T, slow, atol=1e-6)
    assert [model.languages[k] for k in L.Scorer(model).scores(texts)[0].argmax(1)] == labels


def test_unknown_grams_count_in_the_norm():
    """The number of distinct n-grams is the text's own, with those that no landmark has, and texts of a batch keep apart."""
    known = ["the dog and the cat", "der hund und die katze"]
    model = L._train([L.text_codes(t) for t in known], ["en", "de"], [1, 1])
    texts = ["the dog", "ο σκύλος και η γάτα and the dog", "the dog", ""]
    x, n = L.Scorer(model).presence(texts)
    assert n.tolist() == [len(L.text_codes(t)) for t in texts]
    assert x.sum(1).tolist() == [len(np.intersect1d(L.text_codes(t), model.grams)) for t in texts]


def test_other_script_is_no_learned_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = L.fit(docs, usable=~L.held_out())
    greek = "και το να είναι στο με για που δεν τα σπίτι γάτα σκύλος νερό δέντρο σχολείο βιβλίο πόλη ποτάμι βουνό " * 6
    rows = spark.createDataFrame([(1, greek + "the end of that"), (2, "Обычный русский текст о погоде и людях")], "doc_id long, text string")
    assert all(r.score < 0.2 for r in L.predict(rows, model).select("language.*").collect())
    scores = [r.score for r in L.predict(docs, model, keep=["doc_id"]).select("language.*").collect()]
    assert np.mean(np.array(scores) >= 0.4) > 0.99


def test_bytes_that_are_not_utf8(spark):
    rows = spark.range(1).selectExpr("id AS doc_id", "cast(concat(cast('the cat sat on the mat ' AS binary), X'FF', cast(' and the dog' AS binary)) AS string) AS text", "'en' AS lang")
    found = L.predict(rows, L.fit(rows), keep=["doc_id"]).select("language.*").collect()
    assert found[0].lang_pred == "en"


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    found = queries.QUERIES["op2_language_id"](spark, sf)
    truth = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", "text")
    rows = found.join(truth, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == r.lang for r in held]) > 0.985
    assert all(0 <= r.score <= 1 for r in rows)


def test_odd_and_empty(odd_docs, no_docs, spark):
    model = L.fit(odd_docs)
    out = L.predict(odd_docs, model)
    name = out.columns[-1]
    assert out.columns[:-1] == odd_docs.columns
    rows = {r.doc_id: r[name] for r in out.collect()}
    assert all(rows[k].lang_pred == "und" and rows[k].score == 0 for k in (2, 3, 6, 7))
    assert rows[4].lang_pred == rows[9].lang_pred == "en" and rows[5].lang_pred == "fr"
    assert L.fit(no_docs) is None
    assert L.predict(no_docs, None).collect() == []
    assert {r.language.lang_pred for r in L.predict(spark.createDataFrame([(1, "abc")], "doc_id long, text string"), None).collect()} == {"und"}


SCHEMA = "doc_id long, text string, lang string"
WORDS = {"en": "the cat and dog sat on this mat with that house", "fr": "le chat et les chiens sont dans une maison avec des amis", "el": "ο σκύλος και η γάτα είναι στο σπίτι με τους φίλους"}


def spoken(rng, lang, n):
    words = WORDS[lang].split()
    return [" ".join(rng.choice(words, 12)) for _ in range(n)]


def test_held_out_labels_change_nothing(spark):
    """Whatever labels the held-out rows carry, the model and its predictions are the same."""
    rng = np.random.default_rng(2)
    rows = [(i, t, k) for i, (k, t) in enumerate((k, t) for k in ("en", "fr") for t in spoken(rng, k, 300))]
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    other = [(i, t, f"made up {i}" if held(i) else k) for i, t, k in rows]
    found = []
    for some in (rows, other):
        docs = spark.createDataFrame(some, SCHEMA)
        model = L.fit(docs, usable=~L.held_out())
        found.append((model.languages, sorted((r.doc_id, r.language) for r in L.predict(docs, model, keep=["doc_id"]).collect())))
    assert found[0] == found[1] and found[0][0] == ["en", "fr"]


def test_every_language_is_learned(spark, monkeypatch):
    """Distinct ids, null ids, one repeated id with different texts, and one row repeated over and over; more than 64 labels."""
    monkeypatch.setattr(L, "SAMPLE_PER_LANGUAGE", 16)
    rng = np.random.default_rng(3)
    rows = [(i, t, "en") for i, t in enumerate(spoken(rng, "en", 3000))]
    rows += [(None, t, "fr") for t in spoken(rng, "fr", 3000)]
    rows += [(5, "ο σκύλος και η γάτα", "el")] * 3000
    docs = spark.createDataFrame(rows, SCHEMA)
    model = L.fit(docs)
    assert model.languages == ["el", "en", "fr"]
    found = L.predict(docs, model)
    assert found.filter("lang <> language.lang_pred").count() < 10
    many = spark.createDataFrame([(i, " ".join(rng.choice(list(f"{k:03d}".translate(str.maketrans("0123456789", "abcdefghij")) + "xyz"), 30)), f"l{k:03d}") for i, k in enumerate(np.repeat(np.arange(150), 4).tolist())], SCHEMA)
    assert len(L.fit(many).languages) == 150

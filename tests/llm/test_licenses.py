import math
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from burstmill.llm import licenses as S
from burstmill.llm import queries
from pyspark.sql import functions as F

SCHEMA = "path string, text string"
MIT = "\n".join(S.TEMPLATES["MIT"])


def slow_best(passage, texts):
    """Cosine over all words, with frequencies counted over texts."""
    n = len(texts)
    seen = Counter(w for t in texts for w in set(S.words_of(t or "")))
    idf = lambda w: math.log((1 + n) / (1 + seen[w])) + 1 if w in S._AT and not S._VERSION.fullmatch(w) else math.log(1 + n) + 1
    vec = lambda t: {w: c * idf(w) for w, c in Counter(S.words_of(t)).items()}
    dot = lambda a, b: sum(x * b.get(w, 0) for w, x in a.items())
    p = vec(passage)
    return max((dot(p, q) / math.sqrt(dot(p, p) * dot(q, q)), k) for k, ts in S.TEMPLATES.items() for q in map(vec, ts))


def test_scores(spark):
    texts = ["some words\nReleased under the MIT License.\nmore", "nothing here", "This work is licensed under the GNU General Public License, version 3, or later.", None]
    rows = S.scan(spark.createDataFrame([(f"d/{i}", t) for i, t in enumerate(texts)], SCHEMA)).collect()
    by = {r.path: r for r in rows}
    assert by["d/0"].score == pytest.approx(slow_best("Released under the MIT License.", texts)[0]) == pytest.approx(1)
    score, name = slow_best(texts[2], texts)
    assert by["d/2"].score == pytest.approx(score) and by["d/2"].own_license == name == "GPL-3.0"
    assert by["d/1"].own_license is None and by["d/3"].score == 0


def test_inheritance(spark):
    rows = [("LICENSE", "Licensed under the Apache License, Version 2.0."), ("a/x.py", "code"), ("a/b/LICENSE.txt", MIT), ("a/b/c/y.py", "code"), ("a/b/z.py", "# Licensed under CC BY-NC 4.0.\ncode"), ("top.py", None), ("a/bc/w.py", ""), (None, "code")]
    found = {r.path: (r.license, r.inherited_from) for r in S.scan(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found["a/x.py"] == found["top.py"] == found["a/bc/w.py"] == found[None] == ("Apache-2.0", "LICENSE")
    assert found["a/b/c/y.py"] == ("MIT", "a/b/LICENSE.txt") and found["a/b/z.py"] == ("CC-BY-NC-4.0", None)
    assert found["a/b/LICENSE.txt"] == ("MIT", None)


def test_documents(spark):
    """Each document with one of the planted lines is found, and no other."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lines = {"GNU General Public License, version 3": "GPL-3.0", "CC BY-NC 4.0": "CC-BY-NC-4.0", "MIT License": "MIT", "Apache License, Version 2.0": "Apache-2.0"}
    rows = S.scan(docs.withColumn("path", F.col("doc_id").cast("string")), keep=["text"]).collect()
    for r in rows:
        expected = {v for k, v in lines.items() if k in r.text}
        assert (r.own_license in expected) if expected else r.own_license is None


def test_odd_and_empty(odd_docs, no_docs):
    with_path = odd_docs.withColumn("path", F.when(F.col("doc_id") != 3, F.concat_ws("/", "source", "doc_id"))).withColumn("own", F.lit(1)).withColumn("given", F.lit(1))
    assert S.scan(with_path, keep=["doc_id"]).count() == odd_docs.count()
    assert S.scan(no_docs.withColumn("path", F.col("source"))).collect() == []


def slow_inherited(rows):
    """{path: (license, from)} of rows (path, own license): the nearest directory at or above that has a license file."""
    out = {}
    for path, own in rows:
        out[path] = (own, None)
        parts = path.split("/")[:-1]
        for n in range(len(parts), -1, -1) if own is None else ():
            here = "/".join(parts[:n])
            given = sorted((p, k) for p, k in rows if k and p.rpartition("/")[0] == here and p.rpartition("/")[2].lower().partition(".")[0] in S.FILE_NAMES)
            if given:
                out[path] = (given[0][1], given[0][0])
                break
    return out


def test_query_inherits_as_brute_force_does(spark):
    found = queries.QUERIES["op8_license_scan"](spark, "/root/testdata/sf0.1").collect()
    slow = slow_inherited([(r.path, r.own_license) for r in found])
    assert all((r.license, r.inherited_from) == slow[r.path] for r in found)
    assert sum(r.inherited_from is not None for r in found) > 100 and len({r.path for r in found}) == len(found)


def test_whole_texts_and_ties(spark):
    texts = {name: "\n\n".join(S.TEMPLATES[name]) for name in ("MIT", "BSD-3-Clause", "ISC")}
    rows = [(f"{name}/LICENSE", f"Copyright (c) 2020 The Authors\n\n{t}") for name, t in texts.items()] + [("both/x", "Released under the MIT License.\nReleased under CC0 1.0.")]
    found = {r.path: r for r in S.scan(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(found[f"{name}/LICENSE"].own_license == name for name in texts)
    assert found["both/x"].score == 1 and found["both/x"].own_license == "CC0-1.0"


def test_every_template_finds_itself(spark):
    """Also under frequencies in which license words are common."""
    rows = [(f"{name}/{i}.txt", f"some words of a file\n\n{t}\n\nand some more") for name, ts in S.TEMPLATES.items() for i, t in enumerate(ts)]
    for more in ([], [(f"x/{i}", "this software is provided under the terms of the license " + w) for i, w in enumerate(S._VOCABULARY)]):
        found = S.scan(spark.createDataFrame(rows + more, SCHEMA)).filter("path LIKE '%.txt'").collect()
        assert len(found) == len(rows) and all((r.own_license, r.score) == (r.path.split("/")[0], 1) for r in found)


def test_titles_of_full_texts(spark):
    """A license file's title decides, whatever paragraphs of other licenses follow it; an unlisted one has no license."""
    borrowed = "\n\n".join(["Some terms that are nobody else's, about this and that and many other things. " * 40, S.TEMPLATES["BSD-3-Clause"][-1], S.TEMPLATES["LGPL-3.0"][0]])
    rows = [(f"{name}/COPYING", f"   {title}\n\n{borrowed}") for name, title in S.TITLES.items()] + [("other/LICENSE", f"The Unheard-of Terms\n\n{borrowed}")]
    found = {r.path: r.own_license for r in S.scan(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found == {**{f"{name}/COPYING": name for name in S.TITLES}, "other/LICENSE": None}


def test_public_full_texts(spark):
    """Texts as systems install them, where they do."""
    folder, names = Path("/usr/share/common-licenses"), {"Apache-2.0": "Apache-2.0", "Artistic": "Artistic-1.0", "CC0-1.0": "CC0-1.0", "GFDL-1.2": "GFDL-1.2", "GFDL-1.3": "GFDL-1.3", "GPL-1": "GPL-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2": "LGPL-2.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0"}
    rows = [(f"{n}/LICENSE", (folder / n).read_text()) for n in names if (folder / n).is_file()]
    if not rows:
        pytest.skip("no license texts on this machine")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("cast(doc_id AS string) AS path", "text")
    for more in (spark.createDataFrame([], SCHEMA), docs):
        found = {r.path: r.own_license for r in S.scan(spark.createDataFrame(rows, SCHEMA).union(more)).filter("path LIKE '%/LICENSE'").collect()}
        assert found == {f"{n}/LICENSE": names[n] for n in names if (folder / n).is_file()}


def test_words_that_are_needed():
    """No passage without one of them reaches the threshold: tried on parts of all templates."""
    m = S.Matcher(1000, np.arange(len(S._VOCABULARY)) % 990)
    for name, texts in S.TEMPLATES.items():
        for words in map(S.words_of, texts):
            kept = [w for w in words if w not in m.needed]
            assert not kept or -m.notices.best(kept)[0] < S.THRESHOLD

"""License scans: TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

Passages and templates are sparse TF-IDF vectors over lower-case words; document frequencies of the templates' words are
counted over all files. A word that no template has weighs as much as the rarest word, and so does a version number.
Cosines are rounded to nine digits; ties go to the smaller name.

A file's passages are its lines and paragraphs (lines up to an empty one). Its own license is that of the notice with the
largest cosine to any of them, if it reaches THRESHOLD. Passages without one of the words that every passage must have
for this are passed over: a cosine is at most the root of what the shared words make of the template's squared weights,
so one of any words whose rest makes less than THRESHOLD squared has to be there; the rarest are taken. The score is the
cosine of the license found, 0 without one.

A license file (by its name) is looked at as a whole, as full texts quote each other's paragraphs: first its title (its
first or its first two paragraphs) against the titles of full texts; then the whole file against each license's
notices joined; then its passages: statements of at most STATEMENT words, and longer ones where those of that license
make COVER of its words. Otherwise it has none.

Files without a license inherit from the nearest directory at or above their own that holds a license file with one
(several: the smallest path). Null texts and paths count as empty, bytes that are not UTF-8 as U+FFFD; a file without a
directory lies in the root. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burstmill.llm.texts import text_of
from burstmill.shared import fresh, materialize, maybe_broadcast, ship_package, with_field

THRESHOLD = 0.7
#: Names of license files, without what follows a dot, in lower case.
FILE_NAMES = ("license", "licence", "copying", "notice", "unlicense")
#: Cosine that a license file's title has to reach, and the share of its words that its notices have to make.
TITLE_THRESHOLD = 0.9
COVER = 0.5
#: Words of a passage at most that states a license by itself, as a line does; a longer one may be quoted.
STATEMENT = 20
_WORD = re.compile(r"[a-z0-9][a-z0-9.+-]*[a-z0-9+]|[a-z0-9]")
_VERSION = re.compile(r"v?\d+(\.\d+)*")
_BREAK = re.compile(r"\n\s*\n")

# Notices, headers and texts of public licenses, by SPDX name.
TEMPLATES = {
    "AGPL-3.0": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "BSD-3-Clause": [
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC0-1.0": ["Released under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "GPL-1.0": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 1, or (at your option) any later version."],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ],
    "LGPL-2.0": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Library General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "LGPL-2.1": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."],
    "LGPL-3.0": ["This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "MIT": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "MPL-1.1": ["The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.mozilla.org/MPL/"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "Unlicense": ["This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
}


# Titles of full license texts, by SPDX name.
TITLES = {
    "AGPL-3.0": "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
    "Apache-1.1": "The Apache Software License, Version 1.1",
    "Apache-2.0": "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
    "Artistic-1.0": "The \"Artistic License\"",
    "Artistic-2.0": "The Artistic License 2.0",
    "BSL-1.0": "Boost Software License - Version 1.0 - August 17th, 2003",
    "CC-BY-4.0": "Creative Commons Attribution 4.0 International Public License",
    "CC-BY-NC-4.0": "Creative Commons Attribution-NonCommercial 4.0 International Public License",
    "CC-BY-SA-4.0": "Creative Commons Attribution-ShareAlike 4.0 International Public License",
    "CC0-1.0": "Creative Commons Legal Code CC0 1.0 Universal",
    "EPL-1.0": "Eclipse Public License - v 1.0",
    "EPL-2.0": "Eclipse Public License - v 2.0",
    "GFDL-1.2": "GNU Free Documentation License Version 1.2, November 2002",
    "GFDL-1.3": "GNU Free Documentation License Version 1.3, 3 November 2008",
    "GPL-1.0": "GNU GENERAL PUBLIC LICENSE Version 1, February 1989",
    "GPL-2.0": "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    "GPL-3.0": "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "LGPL-2.0": "GNU LIBRARY GENERAL PUBLIC LICENSE Version 2, June 1991",
    "LGPL-2.1": "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
    "LGPL-3.0": "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "MPL-1.1": "MOZILLA PUBLIC LICENSE Version 1.1",
    "MPL-2.0": "Mozilla Public License Version 2.0",
}


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


_VOCABULARY = sorted({w for t in [*(x for texts in TEMPLATES.values() for x in texts), *TITLES.values()] for w in words_of(t)})
_AT = {w: i for i, w in enumerate(_VOCABULARY)}


def document_frequencies(files: DataFrame, text: str) -> tuple[int, np.ndarray]:
    """The number of files, and for each vocabulary word of how many files it is a word."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(len(_VOCABULARY), np.int64)
        for b in batches:
            for x in b.column(0):
                for w in _AT.keys() & set(words_of(text_of(x))):
                    seen[_AT[w]] += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(seen), dtype=np.int32)), pa.array(seen)], names=["word", "n"])

    counted = files.select(text).mapInArrow(count, "word int, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    out = np.zeros(len(_VOCABULARY), np.int64)
    for r in counted.collect():  # one row for each vocabulary word
        out[r["word"]] = r["n"]
    return files.count(), out


class Templates:
    """Texts with their names, as unit vectors behind an inverted index."""

    def __init__(self, texts: list[tuple[str, str]], weigh: Callable[[str], float]):
        self.weigh = weigh
        self.names = [name for name, _ in texts]
        self.vectors = [self._vector(words_of(t)) for _, t in texts]
        self.inverted: dict[str, list[tuple[int, float]]] = {}
        for k, vector in enumerate(self.vectors):
            for w, x in vector.items():
                self.inverted.setdefault(w, []).append((k, x))

    def _vector(self, words: list[str]) -> dict[str, float]:
        vector = {w: c * self.weigh(w) for w, c in Counter(words).items()}
        norm = math.sqrt(sum(x * x for x in vector.values()))
        return {w: x / norm for w, x in vector.items()}

    def needed(self, frequency: Callable[[str], int]) -> set[str]:
        """Words of which a passage has at least one if its cosine to any template reaches THRESHOLD."""
        out = set()
        for vector in self.vectors:
            rest = 1.0
            for w in sorted(vector, key=lambda w: (frequency(w), w)):
                if rest < THRESHOLD**2 - 1e-6:
                    break
                out.add(w)
                rest -= vector[w] ** 2
        return out

    def best(self, words: list[str]) -> tuple[float, str | None]:
        """The largest cosine and its name (of several the smallest)."""
        dots = [0.0] * len(self.names)
        for w, x in self._vector(words).items():
            for k, y in self.inverted.get(w, ()):
                dots[k] += x * y
        return min(((-round(d, 9), name) for d, name in zip(dots, self.names) if d > 0), key=lambda x: x, default=(0.0, None))


class Matcher:
    """Cosines of passages to all templates under one set of document frequencies."""

    def __init__(self, n_files: int, frequencies: np.ndarray):
        rare = math.log(1 + n_files) + 1
        idf = {w: math.log((1 + n_files) / (1 + int(f))) + 1 for w, f in zip(_VOCABULARY, frequencies)}
        weigh = lambda w: rare if w not in idf or _VERSION.fullmatch(w) else idf[w]
        self.notices = Templates([(name, t) for name in sorted(TEMPLATES) for t in TEMPLATES[name]], weigh)
        self.wholes = Templates([(name, "\n".join(TEMPLATES[name])) for name in sorted(TEMPLATES)], weigh)
        self.titles = Templates(sorted(TITLES.items()), weigh)
        self.needed = self.notices.needed(lambda w: int(frequencies[_AT[w]]))

    def scan(self, text: str, whole: bool) -> tuple[float, str | None]:
        """The cosine and name of the file's license; whole: the file is called like a license file."""
        words = words_of(text)
        if whole and words:
            found = self._title(text)
            if not found[1]:
                score, name = self.wholes.best(words)
                found = (-score, name) if -score >= THRESHOLD else (0.0, None)
            if found[1]:
                return found
        if self.needed.isdisjoint(words):
            return 0.0, None
        made: Counter[str] = Counter()
        found = []
        for block in _BREAK.split(text):
            if self.needed.isdisjoint(own := words_of(block)):
                continue
            covered: Counter[str] = Counter()
            for passage in {block, *block.split("\n")}:
                if not self.needed.isdisjoint(part := words_of(passage)):
                    score, name = self.notices.best(part)
                    if -score >= THRESHOLD:
                        found.append((score, name, len(part)))
                        covered[name] = max(covered[name], len(own) if passage == block else 0, min(len(own), covered[name] + len(part)))
            made.update(covered)
        if whole:
            found = [x for x in found if x[2] <= STATEMENT or made[x[1]] >= COVER * len(words)]
        score, name = min((x[:2] for x in found), default=(0.0, None))
        return -score, name

    def _title(self, text: str) -> tuple[float, str | None]:
        blocks = [x for x in _BREAK.split(text.strip(), 2)[:2] if words_of(x)]
        score, name = min((self.titles.best(words_of(" ".join(blocks[: k + 1]))) for k in range(len(blocks))), default=(0.0, None))
        return (-score, name) if -score >= TITLE_THRESHOLD else (0.0, None)


def own_licenses(files: DataFrame, path: str, text: str, keep: list[str]) -> DataFrame:
    """The kept columns and a struct of the file's own license and its score, as the last column."""
    ship_package(files.sparkSession)
    n, frequencies = document_frequencies(files, text)
    name = fresh(files, "own")
    table = files.select(*keep, F.col(path).alias(fresh(files, "path_read")), F.col(text).alias(fresh(files, "text_read")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Matcher(n, frequencies)
        for b in batches:
            licenses, scores = [], []
            for p, t in zip(b.column(len(keep)), b.column(len(keep) + 1)):
                base = text_of(p).rpartition("/")[2].lower().partition(".")[0]
                score, license_ = m.scan(text_of(t), base in FILE_NAMES)
                licenses.append(license_)
                scores.append(min(score, 1.0))
            made = pa.StructArray.from_arrays([pa.array(licenses, pa.string()), pa.array(scores, pa.float64())], names=["license", "score"])
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], made], names=[*b.schema.names[: len(keep)], name])

    return table.mapInArrow(run, with_field(files.select(*keep).schema, name, "struct<license:string,score:double>"))


def scan(files: DataFrame, path: str = "path", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(kept columns, path, own_license, score, license, inherited_from) for every file; inherited_from is a path."""
    keep = [path] if keep is None else [*keep, path]
    found = own_licenses(files, path, text, keep)
    own = F.col(found.columns[-1])
    place = F.coalesce(F.col(path), F.lit(""))
    found = materialize(found.select(*keep, own["license"].alias("own_license"), own["score"].alias("score"), F.regexp_extract(place, "^(.*)/[^/]*$", 1).alias("dir")), "license-own")
    base = F.lower(F.regexp_extract(F.col(path), r"([^/.]*)(\.[^/]*)?$", 1))
    given = found.filter(F.col("own_license").isNotNull() & base.isin(*FILE_NAMES))
    given = given.groupBy("dir").agg(F.min(F.struct(F.col(path).alias("from"), F.col("own_license").alias("license"))).alias("given"))
    steps = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(steps)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(steps, 1, n), "/").alias("up")))
    dirs = found.filter(F.col("own_license").isNull()).select("dir").distinct().select("dir", F.explode(above).alias("a")).select("dir", "a.depth", "a.up")
    nearest = dirs.join(maybe_broadcast(materialize(given, "license-dirs").withColumnRenamed("dir", "up")), "up")
    nearest = nearest.groupBy("dir").agg(F.max_by("given", "depth").alias("given"))
    out = found.join(maybe_broadcast(materialize(nearest, "license-near")), "dir", "left")
    license_ = F.coalesce("own_license", F.col("given.license"))
    return out.select(*keep, "own_license", "score", license_.alias("license"), F.when(F.col("own_license").isNull(), F.col("given.from")).alias("inherited_from"))

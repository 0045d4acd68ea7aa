"""Licence scan: TF-IDF cosine of a text's windows to licence templates, then inheritance by directory.

Templates are short notices, file headers and whole licence texts. The unit compared with a template is a
window over the words of the text, as long as the template, that starts at one of the template's words;
a text that ends earlier gives a shorter window. Line breaks, comment signs and punctuation are no words,
so wrapped headers, notices within a line and whole licence files are all found. A file's own licence is
that of the template nearest to one of its windows. A licence file covers its directory: its name says so,
or it begins or ends with a notice. A file without a licence of its own takes that of the nearest directory
above it that a licence file covers. Inheritance is worked out once for each directory, by a join of its
ancestors' paths, and given to the files by a join on their directory.

Texts are read once. A text is compared only with templates whose words it has by enough weight: the words of a
template that a text has bound the cosine of all its windows (Cauchy-Schwarz), so this changes no result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import written

_WARRANTY = (
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied "
    "warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. "
)
_BSD_TERMS = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of "
    "conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, "
    "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
    "distribution. "
)
_BSD_ENDORSEMENT = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
    "products derived from this software without specific prior written permission. "
)
_BSD_DISCLAIMER = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, '
    "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
    "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
    "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
    "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE "
    "OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)


def _gnu_header(name: str, version: str) -> str:
    return (
        "This program is free software: you can redistribute it and/or modify it under the terms of the "
        f"{name} as published by the Free Software Foundation, either version {version} of the License, "
        "or (at your option) any later version. "
    )


#: Notices, headers and licence texts that files commonly carry.
TEMPLATES = [
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", _gnu_header("GNU Affero General Public License", "3")),
    ("AGPL-3.0", "SPDX-License-Identifier: AGPL-3.0-or-later"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with '
        "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by "
        'applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, '
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language "
        "governing permissions and limitations under the License.",
    ),
    (
        "Apache-2.0",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, "
        "AND DISTRIBUTION 1. Definitions.",
    ),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-2-Clause", _BSD_TERMS + _BSD_DISCLAIMER),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("BSD-3-Clause", _BSD_TERMS + _BSD_ENDORSEMENT + _BSD_DISCLAIMER),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", _gnu_header("GNU General Public License", "2")),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-or-later"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", _gnu_header("GNU General Public License", "3")),
    ("GPL-3.0", _gnu_header("GNU General Public License", "3") + _WARRANTY + "See the GNU General Public License for more details."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("ISC", "SPDX-License-Identifier: ISC"),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", _gnu_header("GNU Lesser General Public License", "3")),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation the '
        "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright "
        "notice and this permission notice shall be included in all copies or substantial portions of the Software. THE "
        'SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE '
        "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
        "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
        "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
    ("Proprietary", "All rights reserved."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]

#: Fixed value: what stands beside other licences too, so it counts only where no other licence is found.
FALLBACK = "Proprietary"

#: Names of files that hold the licence of their directory.
LICENCE_NAMES = r"(?i)(?:^|/)(?:licen[cs]e|copying|unlicense)(?:\.[a-z]+)?$"

WORD = r"[A-Za-z]+|[0-9]+(?:\.[0-9]+)*"

#: A file begins or ends with a notice if at most so many words of its first or last line are outside it.
EDGE_WORDS = 12

#: Files of one directory are dealt to so many tasks.
SALTS = 8

_find_words = re.compile(WORD).findall


def _words(text: str) -> list[str]:
    """Words of a text; they are ASCII, so only A-Z are lower-cased."""
    return [w.lower() for w in _find_words(text)]


def _weights(templates: list[tuple[str, str]]) -> tuple[list[tuple[int, str, str, float]], dict[str, float], float]:
    """Rows (template, licence, word, weight of unit length), idf by word, idf of words in no template."""
    counts = [Counter(_words(text)) for _, text in templates]
    n = len(templates)
    df = Counter(w for c in counts for w in c)
    idf = {w: math.log((1 + n) / (1 + k)) + 1 for w, k in df.items()}
    rows = []
    for t, ((licence, _), c) in enumerate(zip(templates, counts)):
        norm = math.sqrt(sum((k * idf[w]) ** 2 for w, k in c.items()))
        rows += [(t, licence, w, k * idf[w] / norm) for w, k in sorted(c.items())]
    return rows, idf, math.log(1 + n) + 1


class Matcher:
    """Windows of a text against all templates."""

    def __init__(self, templates: list[tuple[str, str]], threshold: float):
        rows, self.idf, self.unseen = _weights(templates)
        self.threshold = threshold
        self.licences = [licence for licence, _ in templates]
        self.lengths = [len(_words(text)) for _, text in templates]
        self.number = {w: i for i, w in enumerate(self.idf)}
        self.value = np.array([*self.idf.values(), self.unseen])
        # one column more for words in no template
        self.weight = np.zeros((len(templates), len(self.value)))
        for t, _, w, x in rows:
            self.weight[t, self.number[w]] = x

    def within_reach(self, words: set[str]) -> np.ndarray:
        """Templates that a text with these words may be near to."""
        known = [self.number[w] for w in words if w in self.number]
        return np.nonzero(np.square(self.weight[:, known]).sum(axis=1) >= self.threshold**2 - 1e-6)[0]

    def best(self, text: str) -> tuple[str, float, bool] | None:
        """Licence of the nearest window, its cosine, and whether a notice is at an end of the text."""
        templates = self.within_reach({w.lower() for w in set(_find_words(text))})
        if not len(templates):
            return None
        lines = text.split("\n")
        filled = [i for i, line in enumerate(lines) if line.strip(" \t\n\v\f\r")]
        by_line = [_words(line) for line in lines]
        words = [w for line in by_line for w in line]
        line_of = np.repeat(np.arange(len(lines)), [len(line) for line in by_line])
        absent, n = len(self.idf), len(words)
        ids = np.fromiter((self.number.get(w, absent) for w in words), np.int64, n)
        squares = np.concatenate([[0.0], np.cumsum(self.value[ids] ** 2)])
        found, edge = [], False
        for t in templates:
            length = self.lengths[t]
            weights = self.weight[t][ids]
            starts = np.nonzero(weights)[0]
            ends = np.minimum(starts + length, n)
            sums = np.concatenate([[0.0], np.cumsum(weights * self.value[ids])])
            dots = sums[ends] - sums[starts]
            # repeated words only lengthen a window, so this is an upper bound of the cosine
            likely = dots >= (self.threshold - 1e-6) * np.sqrt(squares[ends] - squares[starts])
            for s, e, cosine in self._cosines(words, starts[likely], ends[likely], dots[likely]):
                if cosine < self.threshold:
                    continue
                found.append((self.licences[t] == FALLBACK, -cosine, -length, self.licences[t]))
                first = line_of[s] == filled[0] and s <= EDGE_WORDS
                edge = edge or bool(first or (line_of[e - 1] == filled[-1] and n - e <= EDGE_WORDS))
        if not found:
            return None
        _, cosine, _, licence = min(found)
        return licence, -cosine, edge

    def _cosines(self, words: list[str], starts: np.ndarray, ends: np.ndarray, dots: np.ndarray) -> Iterator[tuple[int, int, float]]:
        """Exact cosines of windows in order of their start; counts move along with the window."""
        counts: Counter[str] = Counter()
        low = high = 0
        square = 0.0
        for s, e, dot in zip(starts.tolist(), ends.tolist(), dots.tolist()):
            if s >= high:
                counts.clear()
                low, high, square = s, s, 0.0
            for w in words[high:e]:
                square += (2 * counts[w] + 1) * self.idf.get(w, self.unseen) ** 2
                counts[w] += 1
            for w in words[low:s]:
                counts[w] -= 1
                square -= (2 * counts[w] + 1) * self.idf.get(w, self.unseen) ** 2
            low, high = s, e
            yield s, e, round(dot / math.sqrt(square), 9)


def own_licences(files: DataFrame, templates: list[tuple[str, str]], threshold: float) -> DataFrame:
    """Licence of each file with a window near a template: (path, file, licence, cosine, covers).

    ``covers``: the file is named as a licence file, or its first or last line with a word has a notice with
    at most ``EDGE_WORDS`` words outside. Of several licences the nearest counts, of equally near ones (to
    nine digits) the one of the longer template, then the first by name; ``FALLBACK`` only where it stands alone.
    """
    matcher = Matcher(templates, threshold)
    kept = [f for f in files.schema.fields if f.name in ("path", "file")]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept) + ", licence string, cosine double, edge boolean"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            results = [matcher.best(text.as_py()) for text in batch["text"]]
            near = [r for r in results if r is not None]
            own = batch.select(["path", "file"]).filter(pa.array([r is not None for r in results], pa.bool_()))
            columns = [pa.array([r[k] for r in near], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*own.columns, *columns], ["path", "file", "licence", "cosine", "edge"])

    found = files.where("text IS NOT NULL").select("path", "file", "text").mapInArrow(scan, schema)
    # rows with one path and file are one file
    best = F.min(F.struct((F.col("licence") == FALLBACK).alias("f"), (-F.col("cosine")).alias("c"), "licence"))
    merged = found.groupBy("path", "file").agg(best.alias("best"), F.max("edge").alias("edge"))
    covers = F.col("edge") | F.coalesce(F.col("path").rlike(LICENCE_NAMES), F.lit(False))
    return merged.select("path", "file", F.col("best.licence").alias("licence"), (-F.col("best.c")).alias("cosine"), covers.alias("covers"))


def _parent(path: Column) -> Column:
    """Directory of a path; the top directory is the empty string."""
    return F.when(path.contains("/"), F.regexp_extract(path, "^(.*)/[^/]*$", 1)).otherwise("")


def _ancestors(directory: Column) -> Column:
    """The directory and all above it, down to the empty string."""
    names = F.split(directory, "/")
    upper = F.transform(F.sequence(F.lit(1), F.size(names)), lambda k: F.array_join(F.slice(names, 1, k), "/"))
    return F.array_union(F.array(F.lit("")), upper)


def license_scan(files: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = 0.8) -> DataFrame:
    """Licence of every file of (path, file, text): (file, path, licence, origin, from_directory).

    ``file`` identifies a file beside its path. ``origin`` is ``own``, ``inherited`` or ``none``. Of
    several licence files in a directory the nearest to its template counts, then the first licence by
    name. A file with a NULL path is in no directory; NULL and empty texts have no licence of their
    own; repeated rows give a row each with the same result. Other input columns are left out.
    """
    files = files.select(F.col("path").cast("string"), "file", F.col("text").cast("string"))
    own = written(own_licences(files, templates, threshold), "own-licences")
    covering = own.where("covers AND path IS NOT NULL").withColumn("directory", _parent(F.col("path")))
    best = F.min(F.struct((-F.col("cosine")).alias("c"), "licence"))
    covered = covering.groupBy("directory").agg(best.alias("best")).select("directory", F.col("best.licence").alias("licence"))

    narrow = files.select("path", "file", _parent(F.col("path")).alias("directory"))
    directories = narrow.where(F.col("path").isNotNull()).select("directory").distinct()
    ladder = directories.select("directory", F.explode(_ancestors(F.col("directory"))).alias("above"))
    nearest = ladder.join(covered.withColumnRenamed("directory", "above"), "above")
    pick = F.max_by(F.struct("licence", "above"), F.length("above"))
    inherited = nearest.groupBy("directory").agg(pick.alias("x")).select("directory", F.col("x.licence").alias("from_licence"), F.col("x.above").alias("from_directory"))

    mine = own.select(F.col("path").alias("own_path"), F.col("file").alias("own_file"), F.col("licence").alias("own_licence"))
    joined = narrow.join(mine, narrow["path"].eqNullSafe(mine["own_path"]) & narrow["file"].eqNullSafe(mine["own_file"]), "left")
    # a directory may hold a third of all files: its files are dealt to several tasks
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    joined = joined.withColumn("salt", F.pmod(F.xxhash64("file"), F.lit(SALTS)).cast("int"))
    joined = joined.join(inherited.withColumn("salt", salts), ["directory", "salt"], "left")
    inherits = F.col("own_licence").isNull() & F.col("from_licence").isNotNull() & F.col("path").isNotNull()
    return joined.select(
        "file",
        "path",
        F.when(F.col("own_licence").isNotNull(), F.col("own_licence")).when(inherits, F.col("from_licence")).alias("licence"),
        F.when(F.col("own_licence").isNotNull(), "own").when(inherits, "inherited").otherwise("none").alias("origin"),
        F.when(inherits, F.col("from_directory")).alias("from_directory"),
    )


def document_paths(docs: DataFrame) -> DataFrame:
    """``documents`` as files in directories of source, language and two remainders of the id, to a depth of id % 4."""
    names = F.array(F.col("source"), F.col("lang"), (F.col("doc_id") % 5).cast("string"), (F.col("doc_id") % 3).cast("string"))
    directory = F.array_join(F.slice(names, 1, (F.col("doc_id") % 4 + 1).cast("int")), "/")
    return docs.select(F.concat_ws("/", directory, F.col("doc_id").cast("string")).alias("path"), F.col("doc_id").alias("file"), "text")


def op7_license_scan(spark, folder: str) -> DataFrame:
    files = document_paths(spark.read.parquet(f"{folder}/documents.parquet"))
    return license_scan(files).withColumnRenamed("file", "doc_id")


def _sql() -> str:
    rows, idf, unseen = _weights(TEMPLATES)
    lengths = [len(_words(text)) for _, text in TEMPLATES]
    weights = ", ".join(f"({t}, '{licence}', '{w}', {x!r}::DOUBLE, {lengths[t]})" for t, licence, w, x in rows)
    known = ", ".join(f"('{w}', {x!r}::DOUBLE)" for w, x in sorted(idf.items()))
    names = LICENCE_NAMES.replace("(?i)", "")
    return rf"""
WITH tw(template, licence, word, weight, words) AS (VALUES {weights}),
kn(word, idf) AS (VALUES {known}),
f AS (
    SELECT doc_id, text, array_to_string(list_append(
        ([source, lang, (doc_id % 5)::VARCHAR, (doc_id % 3)::VARCHAR])[1:doc_id % 4 + 1], doc_id::VARCHAR), '/') AS path
    FROM documents
),
p AS (SELECT *, regexp_extract(path, '^(.*)/[^/]*$', 1) AS directory FROM f),
l AS (
    SELECT doc_id, i, line FROM (
        SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM f)
    WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
),
ends AS (SELECT doc_id, min(i) AS first, max(i) AS last FROM l GROUP BY 1),
lw AS (SELECT doc_id, i, [lower(x) for x in regexp_extract_all(line, '{WORD}')] AS words FROM l),
w AS (SELECT doc_id, i, unnest(words) AS word, generate_subscripts(words, 1) AS j FROM lw),
tok AS MATERIALIZED (
    SELECT *, sum(idf * idf) OVER (PARTITION BY doc_id ORDER BY pos) AS squares, count(*) OVER (PARTITION BY doc_id) AS n FROM (
        SELECT doc_id, i, word, coalesce(idf, {unseen!r}) AS idf, row_number() OVER (PARTITION BY doc_id ORDER BY i, j) AS pos
        FROM w LEFT JOIN kn USING (word)) AS t
),
win AS (
    SELECT doc_id, template, licence, words, i, pos, n, squares - idf * idf AS before, least(pos + words - 1, n) AS stop,
           sum(idf * weight) OVER (PARTITION BY doc_id, template ORDER BY pos RANGE BETWEEN CURRENT ROW AND words - 1 FOLLOWING) AS dot
    FROM tok JOIN tw USING (word)
),
likely AS MATERIALIZED (
    SELECT v.*, e.i AS stop_line FROM win v JOIN tok e ON e.doc_id = v.doc_id AND e.pos = v.stop
    WHERE dot >= 0.799 * sqrt(e.squares - before)
),
cnt AS (
    SELECT k.doc_id, k.template, k.pos, t.word, count(*) * any_value(t.idf) AS value
    FROM likely k JOIN tok t ON t.doc_id = k.doc_id AND t.pos BETWEEN k.pos AND k.stop GROUP BY ALL
),
norm AS (SELECT doc_id, template, pos, sqrt(sum(value * value)) AS norm FROM cnt GROUP BY ALL),
near AS (
    SELECT doc_id, licence, words, round(dot / norm, 9) AS cosine,
           i = first AND pos - 1 <= {EDGE_WORDS} OR stop_line = last AND n - stop <= {EDGE_WORDS} AS edge
    FROM likely JOIN norm USING (doc_id, template, pos) JOIN ends USING (doc_id)
),
own AS (
    SELECT doc_id, min(struct_pack(f := licence = '{FALLBACK}', c := -cosine, w := -words, licence := licence)) AS best, max(edge) AS edge
    FROM near WHERE cosine >= 0.8 GROUP BY doc_id
),
cov AS (
    SELECT directory, min(struct_pack(c := best.c, licence := best.licence)).licence AS licence
    FROM own JOIN p USING (doc_id) WHERE edge OR regexp_matches(path, '{names}', 'i') GROUP BY 1
),
inh AS (
    SELECT doc_id, max_by(struct_pack(l := cov.licence, d := cov.directory), length(cov.directory)) AS x
    FROM p JOIN cov ON cov.directory = '' OR p.directory = cov.directory OR starts_with(p.directory, cov.directory || '/')
    GROUP BY doc_id
)
SELECT doc_id, path,
       coalesce(own.best.licence, inh.x.l) AS licence,
       CASE WHEN own.best IS NOT NULL THEN 'own' WHEN inh.x IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
       CASE WHEN own.best IS NULL THEN inh.x.d END AS from_directory
FROM p LEFT JOIN own USING (doc_id) LEFT JOIN inh USING (doc_id)
"""


SQL = _sql()

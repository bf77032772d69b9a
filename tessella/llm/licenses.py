"""License scan: sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

A text is one sequence of words, so that line breaks, comment marks and indentation do not count. Headers are stretches
of words as long as a template, laid so that a word that hints at a license (license, copyright, public domain, ...)
falls where the template has such a word; the lines that hold a hint, and a whole text of a template's length, are
stretches too. Stretches and templates are sparse TF-IDF vectors over words and pairs of words. A licence file is a
text whose words are mostly a template's, or one named like a licence file that holds a header. A file without a
licence of its own takes that of the licence file in the nearest directory above it: directories, not files, are
expanded to their ancestors and joined with the directories that hold licence files.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm import kernel as K
from tessella.llm.store import BROADCAST_ROWS, scoped, stash

#: The license texts proper, and the notices by which files refer to longer ones.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. {}THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""
_GNU = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0} for more details. You should have received a copy of the GNU {0} along with this program."""
_GNU_SHORT = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} as published by the Free Software Foundation, either version {1} of the License."""
_GNU_TITLE = """GNU {0} Version {1} Copyright (C) {2} Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."""
_GPL, _LGPL, _AGPL = "General Public License", "Lesser General Public License", "Affero General Public License"
_UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""

#: Texts, notices and one-sentence grants of well-known licenses.
TEMPLATES = {
    "Apache-2.0": [_APACHE, "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.", "Licensed under the Apache License, Version 2.0.", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION", "SPDX-License-Identifier: Apache-2.0"],
    "MIT": [_MIT, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.", "Released under the MIT License.", "SPDX-License-Identifier: MIT"],
    "GPL-3.0": [_GNU.format(_GPL, 3), _GNU_SHORT.format(_GPL, 3), _GNU_TITLE.format(_GPL, "3, 29 June 2007", "2007"), "This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0"],
    "GPL-2.0": [_GNU.format(_GPL, 2), _GNU_SHORT.format(_GPL, 2), _GNU_TITLE.format(_GPL, "2, June 1991", "1989, 1991"), "This work is licensed under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-2.0"],
    "LGPL-3.0": [_GNU.format(_LGPL, 3), _GNU_TITLE.format(_LGPL, "3, 29 June 2007", "2007"), "This library is licensed under the GNU Lesser General Public License, version 3.", "SPDX-License-Identifier: LGPL-3.0"],
    "LGPL-2.1": [_GNU.format(_LGPL, "2.1"), _GNU_TITLE.format(_LGPL, "2.1, February 1999", "1991, 1999"), "SPDX-License-Identifier: LGPL-2.1"],
    "AGPL-3.0": [_GNU.format(_AGPL, 3), _GNU_TITLE.format(_AGPL, "3, 19 November 2007", "2007"), "This work is licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0"],
    "BSD-3-Clause": [_BSD.format(_BSD_NAMES), "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.", "Released under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause"],
    "BSD-2-Clause": [_BSD.format(""), "Released under the BSD 2-Clause License.", "SPDX-License-Identifier: BSD-2-Clause"],
    "MPL-2.0": [_MPL, "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "ISC": [_ISC, "Released under the ISC License.", "SPDX-License-Identifier: ISC"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0-1.0": ["This work is dedicated to the public domain under CC0 1.0.", "SPDX-License-Identifier: CC0-1.0"],
    "Unlicense": [_UNLICENSE, "This is free and unencumbered software released into the public domain.", "SPDX-License-Identifier: Unlicense"],
}

#: Cosine from which a stretch of words counts as a template's.
LEAST_COSINE = 0.8
#: Templates of so many words are whole texts or notices: where one is found, shorter ones within do not decide.
LONG = 30
_WORDS = re.compile(r"[A-Za-z0-9]+")
_HINT_WORD = re.compile(r".*(?:licen[sc]|copyright)|(?:redistribution|permission|domain)\Z")
_FILE_NAME = re.compile(r"(?:^|/)(?:un)?(?:licen[sc]e|copying)[^/]*\Z", re.IGNORECASE)
#: The same words for Arrow's linear-time matcher, which passes whole batches over.
_HINT = "licen[sc]|copyright|public domain|redistribution|permission"


def words_of(text: str) -> tuple[list[str], list[int]]:
    """ASCII words in lower case, and the place of each."""
    found = [(m.group().lower(), m.start()) for m in _WORDS.finditer(text)]
    return [w for w, _ in found], [at for _, at in found]


def hints_of(words: list[str]) -> list[int]:
    known: dict[str, bool] = {}
    return [i for i, w in enumerate(words) if (known[w] if w in known else known.setdefault(w, bool(_HINT_WORD.match(w))))]


class Templates:
    """Unit TF-IDF vectors of all templates; terms that no template has weigh as the rarest do."""

    def __init__(self, templates: dict[str, list[str]] = TEMPLATES):
        texts = [(name, words_of(t)[0]) for name, every in templates.items() for t in every]
        df = Counter(term for _, words in texts for term in self.terms(words))
        n = len(texts)
        self.idf = {t: math.log((1 + n) / (1 + d)) + 1 for t, d in df.items()}
        self.rare = math.log(1 + n) + 1
        #: (license, vector, number of words, places of hints)
        self.rows = [(name, self.unit(words), len(words), hints_of(words)) for name, words in texts]
        self.place = {t: i for i, t in enumerate(sorted(df))}
        self.squares = np.zeros((n, len(df) + 1), np.float32)  # the last column is that of all other terms
        for i, (_, row, _, _) in enumerate(self.rows):
            for t, x in row.items():
                self.squares[i, self.place[t]] = x * x

    @staticmethod
    def terms(words: list[str]) -> Counter:
        return Counter(words) + Counter(f"{a} {b}" for a, b in zip(words, words[1:]))

    def unit(self, words: list[str]) -> dict[str, float]:
        v = {t: (1 + math.log(c)) * self.idf.get(t, self.rare) for t, c in self.terms(words).items()}
        norm = math.sqrt(sum(x * x for x in v.values())) or 1.0
        return {t: x / norm for t, x in v.items()}

    def cosine(self, row: int, words: list[str]) -> float:
        v = self.unit(words)
        return sum(x * v.get(t, 0.0) for t, x in self.rows[row][1].items())


def _stretches(n_words: int, hints: np.ndarray, lines: np.ndarray, n: int, places: list[int]) -> np.ndarray:
    """(start, end) of the stretches that a template of n words, with hints at these places, is compared with."""
    mark = np.zeros(n_words, bool)
    for p in places:
        mark[np.maximum(hints - p, 0)] = True
    start = np.flatnonzero(mark)
    # Words put in (a year, a name) lengthen a text.
    out = [np.stack((start, np.minimum(start + length, n_words)), axis=1) for length in {n, n * 9 // 8}]
    if n_words <= 2 * n:
        out.append(np.array([[0, n_words]]))
    return np.concatenate([*out, lines])


def detect(text: str, templates: Templates, path: str | None = None) -> tuple[str | None, float, bool]:
    """(license or null, cosine, whether this is a licence file: by its name, or as nine tenths of it are a template)."""
    words, places = words_of(text)
    hints = np.array(hints_of(words), np.int64)
    if not len(hints):
        return None, 0.0, False
    breaks = np.searchsorted(places, [m.start() for m in re.finditer("\n", text)])
    edges = np.concatenate(([0], breaks, [len(words)]))
    line = np.unique(np.searchsorted(edges, hints, "right") - 1)
    lines = np.stack((edges[line], edges[line + 1]), axis=1)
    ids: dict[str, int] = {}
    ranges = K.Ranges(K.mix(np.array([ids.setdefault(w, len(ids)) for w in words], np.uint64) + np.uint64(1)))
    other = len(templates.place)
    one = np.array([templates.place.get(w, other) for w in words])
    two = np.array([templates.place.get(f"{a} {b}", other) for a, b in zip(words, words[1:])] + [other])
    found, spans = [], []
    for i, (name, _, n, of) in enumerate(templates.rows):
        at = _stretches(len(words), hints, lines, n, of)
        # By Cauchy's inequality no stretch is nearer than the template's own mass in the terms it holds.
        mass = np.concatenate(([0.0], np.cumsum(templates.squares[i][one] + templates.squares[i][two], dtype=np.float64)))
        at = at[mass[at[:, 1]] - mass[at[:, 0]] >= LEAST_COSINE**2 - 1e-6]
        known: dict[int, float] = {}  # stretches of the same words are compared once
        for (start, end), same in zip(at.tolist(), ranges.sums(at[:, 0], at[:, 1]).tolist(), strict=True):
            if same not in known:
                known[same] = templates.cosine(i, words[start:end])
            cosine = known[same]
            if cosine >= LEAST_COSINE:
                spans.append((start, end))
                found.append((n >= LONG, cosine, name))
    if not found:
        return None, 0.0, False
    _, cosine, name = max(found, key=lambda x: (x[0], round(x[1], 9), x[2]))
    seen, to = 0, 0
    for start, end in sorted(set(spans)):
        seen += max(0, end - max(start, to))
        to = max(to, end)
    return name, cosine, seen * 10 >= len(words) * 9 or bool(_FILE_NAME.search(path or ""))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    templates = Templates()
    for batch in batches:
        for lo in range(0, max(1, len(batch)), 512):
            part = batch.slice(lo, 512)
            name, cosine, whole = [None] * len(part), [0.0] * len(part), [False] * len(part)
            speaks = pc.fill_null(pc.match_substring_regex(part.column("text"), _HINT, ignore_case=True), False)
            for i in np.flatnonzero(speaks.to_numpy(zero_copy_only=False)).tolist():
                name[i], cosine[i], whole[i] = detect(part.column("text")[i].as_py(), templates, part.column("path")[i].as_py())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("path"), pa.array(name, pa.string()), pa.array(cosine, pa.float64()), pa.array(whole, pa.bool_())], names=["doc_id", "path", "own_license", "cosine", "is_license_file"])


def _directory(path):
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


@scoped("licenses")
def scan_licenses(docs: DataFrame, path: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: (doc_id, path, own_license, cosine, is_license_file, license, inherited_from).

    path is an expression over docs; parts stand between slashes. license is the file's own or else that of the nearest
    directory at or above it with a licence file (of several files there, the one whose license sorts first);
    inherited_from is that directory, "" for the root, null for an own license.

    Null or empty texts have no license of their own and inherit like others. A null path is a file beside the tree:
    it inherits nothing and passes nothing on. Null ids and repeated rows pass through. Other columns are not read.
    """
    text = docs.select(F.col(id_col).alias("doc_id"), path.alias("path"), F.col(text_col).alias("text"))
    kind = text.schema["doc_id"].dataType.simpleString()
    own = stash(text.mapInArrow(_scan, f"doc_id {kind}, path string, own_license string, cosine double, is_license_file boolean"), "licenses")
    own = own.withColumn("dir", _directory(F.col("path")))
    holders = own.filter("is_license_file and path is not null").groupBy("dir").agg(F.min("own_license").alias("given"))
    dirs = own.filter("own_license is null and path is not null").select("dir").distinct()
    # "a/b/c" is expanded to "a/b/c", "a/b", "a" and "": as many rows as it has parts, per directory and not per file.
    parts = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    near = dirs.select("dir", F.explode(F.array_distinct(above)).alias("up")).join(holders.withColumnRenamed("dir", "h"), F.col("up") == F.col("h"))
    near = near.groupBy("dir").agg(F.max_by(F.struct("up", "given"), F.length("up")).alias("from"))
    near = stash(near.select(F.col("dir").alias("d"), F.col("from.up").alias("up"), F.col("from.given").alias("given")), "nearest")
    side = F.broadcast(near) if near.count() <= BROADCAST_ROWS // 10 else near
    out = own.join(side, (F.col("dir") == F.col("d")) & F.col("own_license").isNull() & F.col("path").isNotNull(), "left")
    return out.select("doc_id", "path", "own_license", "cosine", "is_license_file", F.coalesce("own_license", "given").alias("license"), F.col("up").alias("inherited_from"))

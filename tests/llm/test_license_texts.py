"""Real license texts as files and as headers, against a plain comparison of every stretch, and inheritance by walking up."""

from __future__ import annotations

import math
import os
import re
import textwrap
from collections import Counter

import pyarrow.parquet as pq
import pytest

from tessella.llm import licenses as L
from tessella.llm.licenses import detect, scan_licenses

T = L.Templates()
BODIES = {
    "MIT": L._MIT, "BSD-2-Clause": L._BSD.format(""), "BSD-3-Clause": L._BSD.format(L._BSD_NAMES), "ISC": L._ISC, "Apache-2.0": L._APACHE,
    "GPL-2.0": L._GNU.format(L._GPL, 2), "GPL-3.0": L._GNU.format(L._GPL, 3), "LGPL-2.1": L._GNU.format(L._LGPL, "2.1"), "AGPL-3.0": L._GNU.format(L._AGPL, 3), "MPL-2.0": L._MPL,
}


@pytest.mark.parametrize("name", sorted(BODIES))
@pytest.mark.parametrize("mark, width", [("", 75), (" * ", 60), ("// ", 70), ("# ", 45)])
def test_headers_and_files(name, mark, width):
    wrapped = "\n".join(mark + x for x in textwrap.wrap(BODIES[name], width))
    assert detect(f"{mark}Copyright (c) 2020 A. Person. All rights reserved.\n{mark}\n{wrapped}\n\n" + "int main() { return 0; }\n" * 40, T)[::2] == (name, False)
    assert detect(f"Copyright (c) 2020 A. Person\n\n{wrapped}\n", T)[::2] == (name, True)
    assert detect("words before it " * 300 + BODIES[name] + " words behind it" * 300, T)[0] == name


@pytest.mark.parametrize("file, name", [("Apache-2.0", "Apache-2.0"), ("BSD", "BSD-3-Clause"), ("GPL-2", "GPL-2.0"), ("GPL-3", "GPL-3.0"), ("LGPL-2.1", "LGPL-2.1"), ("LGPL-3", "LGPL-3.0"), ("MPL-2.0", "MPL-2.0"), ("Artistic", None)])
def test_texts_of_the_system(file, name):
    path = f"/usr/share/common-licenses/{file}"
    if not os.path.exists(path):
        pytest.skip("this system has no such file")
    with open(path) as f:
        assert detect(f.read(), T, f"a/{file}/LICENSE")[::2] == (name, name is not None)


def plain(text):
    """The license by comparing every stretch of each template's length, every line and the text."""
    words = re.findall("[a-z0-9]+", text.lower())
    texts = [(name, re.findall("[a-z0-9]+", t.lower())) for name, every in L.TEMPLATES.items() for t in every]
    terms = lambda w: Counter(w) + Counter(map(" ".join, zip(w, w[1:])))
    df = Counter(t for _, w in texts for t in terms(w))
    n = len(texts)

    def vector(w):
        v = {t: (1 + math.log(c)) * (math.log((1 + n) / (1 + df[t])) + 1 if t in df else math.log(1 + n) + 1) for t, c in terms(w).items()}
        norm = math.sqrt(sum(x * x for x in v.values())) or 1
        return {t: x / norm for t, x in v.items()}

    best = None
    for name, w in texts:
        row = vector(w)
        parts = [words[i : i + m] for m in (len(w), len(w) * 9 // 8) for i in range(max(1, len(words) - m + 1))]
        parts += [re.findall("[a-z0-9]+", x.lower()) for x in text.split("\n")] + ([words] if len(words) <= 2 * len(w) else [])
        for part in parts:
            v = vector(part)
            cosine = sum(x * v.get(t, 0) for t, x in row.items())
            if cosine >= 0.8:
                best = max(best or (False, 0, ""), (len(w) >= 30, round(cosine, 9), name))
    return best[2] if best else None


def test_documents_match_a_plain_comparison():
    docs = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text"])["text"].to_pylist()
    some = [t for t in docs if t and len(t) < 2500 and re.search(L._HINT, t, re.I)][:12]
    some += ["The license of a driver.", "x Licensed under the Apache\nLicense, Version 2.0. y", BODIES["MPL-2.0"] + " and more", "permission is hereby denied " * 9, "SPDX-License-Identifier: MIT"]
    assert any(map(plain, some))
    for t in some:
        assert detect(t, T)[0] == plain(t), t


def test_inheritance_is_that_of_the_nearest_directory(spark):
    grant = {"MIT": "Released under the MIT License.", "ISC": "Released under the ISC License.", "Apache-2.0": "Licensed under the Apache License, Version 2.0."}
    files = {"LICENSE": "MIT", "a/LICENSE": "ISC", "a/b/COPYING": "Apache-2.0", "a/b/LICENSE": "MIT", "a/b/c/x.py": None, "a/d/y.py": None, "a/d/z.py": "MIT", "e/f/g/h.py": None, "ab/x": None}
    code = "\nprint(1)" * 40  # a file that only names a license passes nothing on
    rows = [(i, p, grant[n] + code * p.endswith(".py") if n else "print(1)", "x") for i, (p, n) in enumerate(files.items())]
    rows += [(4, "a/b/c/x.py", "print(1)", "x"), (None, "a/b/c/n", None, None), (90, None, None, None), (91, None, grant["MIT"], None)]
    got = scan_licenses(df := spark.createDataFrame(rows, "doc_id long, p string, text string, license string"), df["p"]).collect()
    assert len(got) == len(rows)
    holders: dict[str, str] = {}
    for p, n in files.items():
        if p.rpartition("/")[2] in ("LICENSE", "COPYING"):
            d = p.rpartition("/")[0]
            holders[d] = min(n, holders.get(d, n))
    for r in got:
        own = r.own_license
        assert own == (files.get(r.path) if r.path in files else "MIT" if r.doc_id == 91 else None)
        want = (own, None)
        if own is None and r.path is not None:
            d = r.path.rpartition("/")[0]
            while d not in holders:
                d = d.rpartition("/")[0]
            want = (holders[d], d)
        assert (r.license, r.inherited_from) == want, r

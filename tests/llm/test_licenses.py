"""Licenses whose text is wrapped, or stands within a long line."""

from __future__ import annotations

import textwrap

import pytest

from tessella.llm import licenses
from tessella.llm.licenses import detect, scan_licenses

MIT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish.'
LONG = [(n, t) for n, ts in licenses.TEMPLATES.items() for t in ts if len(t) > 60]


@pytest.mark.parametrize("width, mark", [(40, "# "), (60, " * "), (72, "")])
@pytest.mark.parametrize("name, text", LONG)
def test_wrapped_headers_are_found(name, text, width, mark):
    wrapped = "\n".join(mark + x for x in textwrap.wrap(text, width))
    assert detect(f"import os\n\n{wrapped}\n\nx = 1\n", licenses.Templates())[0] == name


@pytest.mark.parametrize("name, text", LONG)
def test_grants_within_long_lines_are_found(name, text):
    assert detect(f"{'some words about nothing ' * 40}{text} {'and more of the same kind ' * 40}", licenses.Templates())[0] == name


def test_wrapped_licence_files_pass_on(spark):
    rows = [(1, "a/LICENSE", "MIT License\n\nCopyright (c) 2020 A. Person\n\n" + textwrap.fill(MIT, 75)), (2, "a/b/x.py", "print(1)"), (3, "c/x.py", "The license of a driver, and the terms of it.\n" * 20)]
    df = spark.createDataFrame(rows, "doc_id long, p string, text string")
    assert {r.doc_id: (r.license, r.inherited_from) for r in scan_licenses(df, df["p"]).collect()} == {1: ("MIT", None), 2: ("MIT", "a"), 3: (None, None)}

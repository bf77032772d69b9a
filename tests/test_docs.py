"""Markdown, documentation and text functions on authored pages."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.operators import docs as D

LONG = "\n\n".join(f"Paragraph {i} " + "with quite some words in it " * 8 for i in range(6))
PAGE = f"# Title\n\nAn introduction that is long enough to be kept as a section of its own.\n\n## First\n\n{'Short text of the first section. ' * 3}\n\n```md\n## not a heading\n```\n\n### Deep\n\n{LONG}\n\n## Tiny\n\nno\n"


def test_sections():
    h2 = D.h2_sections(PAGE)
    assert [s[0] for s in h2] == ["Introduction", "First", "not a heading"]  # this one is not aware of fences
    smart = D.smart_sections(PAGE)
    heads = [s[0] for s in smart]
    assert heads[:3] == ["Introduction", "First", "First — Deep"] and set(heads[3:]) == {"First — Deep (cont.)"}
    assert all(50 <= len(s[1]) for s in smart) and "".join("".join(s[2].split()) for s in smart[2:]) == "".join(LONG.split())
    assert D.smart_sections("") == [] and D.h2_sections("## A\nshort") == []


def test_chunks_have_ids_of_their_own(spark):
    rows = D.chunk(spark.createDataFrame([("a.md", PAGE), ("b.md", None)], "file string, content string")).collect()
    assert len({r.id for r in rows}) == len(rows) == len(D.smart_sections(PAGE)) and {r.file for r in rows} == {"a.md"}


def test_greedy_batches(spark):
    df = spark.createDataFrame([("f", i, s) for i, s in enumerate([10, 15, 10, 40, 5, 25])], "k string, i int, s long")
    assert {r.i: r.batch for r in D.greedy_batches(df, "k", "i", "s", 30).collect()} == {0: 0, 1: 0, 2: 1, 3: 2, 4: 3, 5: 3}


def test_pack_sections(spark):
    df = spark.createDataFrame([("p", 0, 0, 50), ("p", 1, 5, 60), ("p", 2, 9, 70), ("p", 3, 1, 20), ("p", 4, 0, 1)], "package string, position int, score int, size int")
    assert sorted(r.position for r in D.pack_sections(df, 150).collect()) == [0, 2, 3]


@pytest.mark.parametrize("types, want", [([], [25, 25, 20, 15, 15]), (["Library"], [25, 40, 14, 11, 10]), (["Backend API", "ORM", "Frontend", "Monorepo", "Library"], [65, 40, 0, 0, 0])])
def test_weights(spark, types, want):
    df = spark.createDataFrame([(types,)], "t array<string>")
    w = D.weights(F.col("t"))
    got = [int(x) for x in df.select(*[F.lit(v).alias(k) for k, v in w.items()]).first()]
    assert got[:4] == want[:4] and got[4] == max(0, want[4])


def test_lint(spark):
    pages = [("index.md", "# I\n[a](01-a.md) [x](gone.md)"), ("01-a.md", "# A\n[b](nope.md)"), ("04-b.md", "text\n# B\n# C"), ("05-c.md", "```markdown\n# D\n```")]
    got = {(r.file, r.rule) for r in D.lint(spark.createDataFrame(pages, "file string, content string")).collect()}
    assert {("gone.md", "index-of-missing"), ("04-b.md", "not-in-index"), ("04-b.md", "many-h1"), ("04-b.md", "preamble"), ("04-b.md", "numbering-gap"), ("01-a.md", "broken-link"), ("05-c.md", "wrapped-in-fence"), ("05-c.md", "no-h1")} <= got
    assert not any(f == "index.md" for f, _ in got)


def test_module_pages(spark):
    files = [("core", "a.ts", 300), ("core", "b.ts", 200), ("core", "c.ts", 250), ("util", "HttpClient.ts", 400), ("util", "tiny.ts", 10)]
    got = [(r.path, r.whole) for r in D.module_pages(spark.createDataFrame(files, "module string, name string, loc int")).orderBy("path").collect()]
    assert got == [("05-Modules/01-core.md", True), ("05-Modules/02-http-client.md", False)]


@pytest.mark.parametrize("column, value, want", [
    (T.kebab, "HTTPServerName", "http-server-name"), (T.strip_order_prefix, "01-Guide", "Guide"), (T.concept, "02_Getting_Started", "getting-started"), (T.concept, "misc", None), (T.page_type, "docs/CLI/x.md", "reference"),
    (T.module_name, "src/core/a.ts", "core"), (T.module_name, "crate/src/main.rs", "crate"), (T.module_name, "src/main.rs", None), (T.module_name, "lib/utils/f.ts", "lib"), (T.module_name, "a/b.ts", None),
    (T.strip_date_suffix, "m-20250101", "m"), (T.provider, "acme/x", "acme"), (T.provider, "gpt-4", "openai"), (T.strip_code, 'a // b\n"c" /* d */ e', 'a \n""  e'),
    (T.strip_non_prose, "x\n```\ncode\n```\n`tick` <b>bold</b>\n| a | b |\n> quote\n---\ny", "x\n\ntick bold\n\ny"), (T.file_context, "src/a.test.ts", "test"), (T.file_context, "src/x/y.ts", "general"),
])
def test_scalars(spark, column, value, want):
    assert spark.createDataFrame([(value,)], "v string").select(column(F.col("v"))).first()[0] == want


def test_json_strings(spark):
    df = spark.createDataFrame([('["a", 1, null, "b"]',), ("nope",), (None,), ('{"a": 1}',)], "v string")
    assert [r[0] for r in df.select(T.json_strings(F.col("v"))).collect()] == [["a", "b"], [], [], []]


def test_signature_and_body(spark):
    code = "x\nexport function f(\n  a: number,\n) {\n  return a;\n}\n"
    df = spark.createDataFrame([(code,)], "c string")
    assert df.select(T.signature(F.col("c"), F.lit(2))).first()[0] == "export function f( a: number, ) {"
    assert df.select(T.body(F.col("c"), F.lit(5), F.lit(6))).first()[0] == "  return a;\n}"

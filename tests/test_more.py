"""Resolution beyond TypeScript, context for prompts, renumbering, sinks and the lock."""

from __future__ import annotations

import os

from pyspark.sql.types import _parse_datatype_string

from tessella.operators import graph as G
from tessella.operators import metrics as M
from tessella.operators import pages as P
from tessella.operators import project as J
from tessella.operators import render as D
from tessella.operators import rules as R
from tessella.sources import files as S
from tessella.sources import schemas


def test_other_imports(spark):
    files = spark.createDataFrame([(f,) for f in ("pkg/a.py", "pkg/sub/__init__.py", "pkg/sub/b.py", "src/top.py", "bin/lib.sh", "core/src/io.rs", "core/src/net/mod.rs", "app/src/main.rs")], "file string")
    of = lambda rows, lang, crates=None: {(r.file, r.source): r.target for r in G.resolve_other(spark.createDataFrame(rows, "file string, source string"), files, lang, crates).collect()}
    assert of([("pkg/sub/b.py", "..a"), ("pkg/a.py", "pkg.sub"), ("pkg/a.py", "top"), ("pkg/a.py", "os")], "python") == {("pkg/sub/b.py", "..a"): "pkg/a.py", ("pkg/a.py", "pkg.sub"): "pkg/sub/__init__.py", ("pkg/a.py", "top"): "src/top.py"}
    assert of([("bin/run.sh", "./lib.sh"), ("bin/run.sh", "bin/lib.sh")], "bash") == {("bin/run.sh", "./lib.sh"): "bin/lib.sh", ("bin/run.sh", "bin/lib.sh"): "bin/lib.sh"}
    crates = G.crate_map(spark.createDataFrame([("core", '[package]\nname = "my-core"\n'), ("x", "[workspace]\n")], "dir string, content string"))
    assert [(r.crate, r.src) for r in crates.collect()] == [("my_core", "core/src")]
    assert of([("app/src/main.rs", "my_core::io::Read"), ("app/src/main.rs", "my_core::net"), ("core/src/io.rs", "crate::net::x")], "rust", crates) == {("app/src/main.rs", "my_core::io::Read"): "core/src/io.rs", ("app/src/main.rs", "my_core::net"): "core/src/net/mod.rs", ("core/src/io.rs", "crate::net::x"): "core/src/net/mod.rs"}


def test_relevant_sections(spark):
    schema = "id string, file string, name string, summary string, nlp_vector array<double>, type string, source string"
    rows = [("1", "a.ts", "f", "", [1.0, 0.0], "function", ""), ("2", "d.md", "near", "x" * 100, [0.9, 0.1], "doc_section", "internal"), ("3", "d.md", "far", "y", [0.0, 1.0], "doc_section", "internal"), ("4", "e.md", "also", "z" * 300, [1.0, 0.0], "doc_section", "project")]
    got = P.relevant_sections(spark.createDataFrame(rows, schema), 1000).collect()
    assert {(r.file, r.source, r.name) for r in got} == {("a.ts", "internal", "near"), ("a.ts", "project", "also")}


def test_renumber(spark):
    df = spark.createDataFrame([("a/01-x.md",), ("a/04-y.md",), ("a/z.md",), ("b/10-w.md",)], "file string")
    assert {r.file: r.new_file for r in P.renumber(df).collect()} == {"a/01-x.md": "a/01-x.md", "a/04-y.md": "a/02-y.md", "a/z.md": "a/z.md", "b/10-w.md": "b/01-w.md"}


def test_small_ones(spark, tmp_path):
    df = spark.createDataFrame([("a.json", "WEAK", "UNDOCUMENTED"), ("b.ts", "WEAK", "PARTIAL")], "file string, tests string, documentation string")
    assert {r.file: r.tests for r in R.without_test_files(df, df.filter("file = 'b.ts'")).collect()} == {"a.json": "NONE", "b.ts": "WEAK"}
    assert {r.file: r.documentation for r in R.data_files_documented(df).collect()} == {"a.json": "DOCUMENTED", "b.ts": "PARTIAL"}
    t = spark.createDataFrame([("x" * 4000,), ("abcd",)], "text string")
    assert {r.kind: (r.units, r.tokens) for r in M.embed_tokens(t, t.limit(0)).collect()} == {"code": (2, 376), "text": (0, 0)}
    assert {r.model for r in J.active_models(spark.createDataFrame([({"a": "m", "b": "n", "c": "m"},)], "slots map<string,string>")).collect()} == {"m", "n"}
    tree = D.tree_rows(spark.createDataFrame([("src/b.ts",), ("src/a/c.ts",), ("README.md",)], "file string"))
    assert D.tree_text(tree) == "src/\n  a/\n    c.ts\n  b.ts\nREADME.md"
    assert schemas.example(_parse_datatype_string("a int, b array<struct<c:string>>, d boolean, e map<string,double>")) == {"a": 1, "b": [{"c": "c"}], "d": True, "e": {"key": 0.5}}
    lines = spark.createDataFrame([("f", 2, "two"), ("f", 1, "one"), ("g", 1, "x")], "file string, at int, line string")
    S.write_transcripts(lines, f"file://{tmp_path}/t")
    assert [r.value for r in spark.read.text(f"{tmp_path}/t/file=f").collect()] == ["one", "two"]


def test_prices_come_to_calls(spark, monkeypatch):
    prices = spark.createDataFrame([("m", 3.0, 15.0, 0.3, None), ("p/n", 1.0, 5.0, None, None), ("n", 2.0, 5.0, None, None)], "model string, input double, output double, cache_read double, cache_creation double")
    calls = spark.createDataFrame([(x, 1_000_000, 0, 1_000_000, 0) for x in ["m", "q/m-20250101", "p/n", "n", "z", None]], "model string, in_tokens long, out_tokens long, read_tokens long, creation_tokens long").repartition(7)
    want = {"m": 3.3, "q/m-20250101": 3.3, "p/n": 2.0, "n": 4.0, "z": 0.0, None: 0.0}
    few = M.price(calls, prices)
    assert {r.model: round(r.cost, 6) for r in few.collect()} == want and few.count() == 6
    assert few.columns == [*calls.columns, "cost"] and few.rdd.getNumPartitions() == 7
    monkeypatch.setattr(M, "PRICE_ROWS", 0)
    assert {r.model: round(r.cost, 6) for r in M.price(calls, prices).collect()} == want

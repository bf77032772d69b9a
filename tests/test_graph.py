"""Imports, resolution and the usage graph over a small source tree."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tessella.operators import graph as G
from tessella.sources.parse import parse_files, parse_text

TREE = {
    "src/a.ts": "import { used, other as o } from './b.js';\nimport type { Shape } from './types';\nimport def from '../lib';\nimport * as all from './c';\nimport x from 'react';\nexport function main() {\n  return used();\n}\n",
    "src/b.ts": "export function used() {\n  return helper();\n}\nexport function helper() {\n  // used in words only: lonely\n  return 'lonely';\n}\nexport const lonely = 1;\nexport function other() {}\nfunction hidden() { return helper(); }\n",
    "src/c.tsx": "export const One = 1;\nexport function useTwo() {}\n",
    "src/types.ts": "export interface Shape { a: string }\nexport type Dead = string;\n",
    "lib/index.ts": "export { One } from '../src/c';\nexport default 3;\n",
    "src/d.ts": "export * from './types';\nimport { missing } from './nowhere';\n",
}


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame(list(TREE.items()), "file string, content string").cache()


@pytest.fixture(scope="module")
def edges(files):
    exports = parse_files(files).filter("exported").select("file", "name").distinct()
    return G.edges(G.resolve(G.import_statements(files), files), exports).cache()


def test_edges(edges):
    got = {(r.symbol, r.source_file, r.importer, r.type_only) for r in edges.collect()}
    assert got == {
        ("used", "src/b.ts", "src/a.ts", False), ("other", "src/b.ts", "src/a.ts", False), ("Shape", "src/types.ts", "src/a.ts", True), ("default", "lib/index.ts", "src/a.ts", False),
        ("One", "src/c.tsx", "src/a.ts", False), ("useTwo", "src/c.tsx", "src/a.ts", False), ("One", "src/c.tsx", "lib/index.ts", False),
        ("Shape", "src/types.ts", "src/d.ts", False), ("Dead", "src/types.ts", "src/d.ts", False),
    }


def test_utility_cascade(files, edges):
    symbols = parse_files(files)
    exports = symbols.filter("exported").select("file", "name").distinct()
    intra = G.intra_file(symbols, files)
    assert {(r.symbol, r.referencer) for r in intra.filter("file = 'src/b.ts'").collect()} == {("helper", "used")}
    everything = G.intra_file(symbols, files, exported_only=False)
    assert ("helper", "hidden") in {(r.symbol, r.referencer) for r in everything.collect()}
    used = G.usage(edges)
    got = {(r.file, r.name): (r.value, r.detail.split()[0]) for r in G.utility(exports, used, G.transitive(intra, used)).collect()}
    assert got[("src/b.ts", "used")] == ("USED", "Runtime-imported") and got[("src/b.ts", "helper")] == ("USED", "Transitively")
    assert got[("src/b.ts", "lonely")] == ("DEAD", "Exported") and got[("src/types.ts", "Shape")] == ("USED", "Runtime-imported")
    assert {(r.file, r.name) for r in G.orphans(exports, edges).collect()} == {("src/a.ts", "main"), ("src/b.ts", "helper"), ("src/b.ts", "lonely")}


@pytest.mark.parametrize("broadcast", [0, 1000])
def test_utility_of_groups_is_that_of_the_product(spark, monkeypatch, broadcast):
    monkeypatch.setattr(G, "BROADCAST_ROWS", broadcast)
    monkeypatch.setattr(G, "ROWS_A_TASK", 10)
    names = spark.createDataFrame([(f"n{i}", i % 3) for i in range(12)] + [("n4", 1), (None, 2), ("lost", 9)], "name string, module int")
    files = spark.createDataFrame([(f"f{i}", i % 3) for i in range(9)] + [("f2", 2)], "file string, module int")
    used = G.usage(spark.createDataFrame([(f"n{i % 12}", f"f{i % 7}", f"o{i}", i % 2 == 0) for i in range(60)], "symbol string, source_file string, importer string, type_only boolean"))
    hops = spark.createDataFrame([("n3", "b"), ("n3", "a"), ("n4", "b")], "symbol string, referencer string")
    exports = names.join(files, "module")
    want = G.utility(exports.select("file", "name"), used, exports.distinct().join(hops, F.col("name") == F.col("symbol")).select("file", "symbol", "referencer"))
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, G.utility_of_groups(names, files, used, hops).collect())) == sorted(map(key, want.collect())) != []


def test_a_runtime_import_is_not_type_only_as_well(spark):
    e = spark.createDataFrame([("s", "f", "i", True), ("s", "f", "i", False), ("s", "f", "j", True)], "symbol string, source_file string, importer string, type_only boolean")
    r = G.usage(e).first()
    assert (r.importers, r.type_importers) == (["i"], ["j"])


@pytest.mark.parametrize("language, text, want", [
    ("typescript", "import 'side';\nconst a = require(\"b\");", {"side", "b"}), ("bash", "source ./lib.sh\n. other.sh\n", {"./lib.sh", "other.sh"}),
    ("python", "from a.b import c\nimport d.e\n", {"a.b", "d.e"}), ("rust", "use a::b;\npub use c::d;\n", {"a::b", "c::d"}),
    ("go", 'import "fmt"\nimport (\n  "os"\n  x "net/http"\n)\n', {"fmt", "os", "net/http"}), ("java", "import a.b.C;\nimport static d.E.f;\n", {"a.b.C", "d.E.f"}), ("csharp", "using System.Text;\n", {"System.Text"}),
])
def test_references(spark, language, text, want):
    df = spark.createDataFrame([("f", text)], "file string, content string")
    assert {r.source for r in G.references(df, language).collect()} == want


def test_rust_paths(spark):
    assert G.rust_use_tree("a::{b, c::{d, self}, e as f}") == ["a::b", "a::c::d", "a::c", "a::e"]
    assert G.rust_use_tree("x::y") == ["x::y"]
    paths = spark.createDataFrame([("core::io::read",), ("core::net",), ("gone::x",)], "path string")
    known = spark.createDataFrame([("core/io.rs",), ("core.rs",), ("core/net/mod.rs",)], "file string")
    assert {r.path: r.file for r in G.rust_modules(paths, known).collect()} == {"core::io::read": "core/io.rs", "core::net": "core/net/mod.rs"}


def test_normalize(spark):
    df = spark.createDataFrame([("a/./b/../c",), ("../x",), ("a//b/",)], "p string")
    assert [r[0] for r in df.select(G.normalize(F.col("p"))).collect()] == ["a/c", "x", "a/b"]


@pytest.mark.parametrize("file, text, want", [
    ("a.py", "X = 1\nclass A:\n    def m(self):\n        pass\n\ndef _f():\n    return 1\n", [("X", "constant", True, 1, 1), ("A", "class", True, 2, 4), ("m", "method", True, 3, 4), ("_f", "function", False, 6, 7)]),
    ("a.ts", "export const useX = () => {\n  return 1;\n};\nconst MAX = 3;\n", [("useX", "hook", True, 1, 3), ("MAX", "constant", False, 4, 4)]),
    ("a.go", "func Do() {\n}\nfunc (r *T) run() {\n}\ntype T struct {\n}\n", [("Do", "function", True, 1, 2), ("run", "method", False, 3, 4), ("T", "class", True, 5, 6)]),
    ("a.rs", "pub fn f() {\n}\nstruct S {\n}\n", [("f", "function", True, 1, 2), ("S", "class", False, 3, 4)]),
    ("a.sql", "CREATE TABLE IF NOT EXISTS t (x int);\ncreate or replace view v as select 1;", [("t", "class", True, 1, 1), ("v", "variable", True, 1, 1)]),
    ("a.yml", "top:\n  nested: 1\n", [("top", "variable", True, 1, 1), ("nested", "constant", True, 1, 1)]),
    ("a.json", '{"k": 1, "j": [2]}', [("k", "variable", True, 1, 1), ("j", "variable", True, 1, 1)]), ("b.json", "[1]", []), ("c.json", "{", []), ("d.py", "def (", []),
    ("Makefile", "build:\n\tx\ntest: build\n\ty\nVAR=1\n", [("build", "function", True, 1, 1), ("test", "function", True, 1, 1), ("VAR", "constant", True, 1, 1)]), ("Tiny", "a:\n", []),
])
def test_parse(file, text, want):
    assert parse_text(file, text)[2] == want


def test_the_verdict_is_made_before_the_product_of_names_and_files(spark):
    """Above the join with the files nothing is made of a detail, and only files of a name's module are looked through."""
    names = spark.createDataFrame([(f"n{i}", i % 2) for i in range(4)], "name string, module int")
    files = spark.createDataFrame([(f"f{i}", i % 2) for i in range(6)], "file string, module int")
    used = G.usage(spark.createDataFrame([("n0", f"f{i}", "o", False) for i in range(5)], "symbol string, source_file string, importer string, type_only boolean"))
    none = spark.createDataFrame([], "symbol string, referencer string")
    out = G.utility_of_groups(names, files, used, none, lambda d: F.substring_index(d, " ", 1)).select("file", "name", F.col("detail").alias("why"))
    want = [(f"f{i}", f"n{j}", "Runtime-imported" if j == 0 and i < 5 else "Exported") for i in range(6) for j in range(4) if i % 2 == j % 2]
    assert sorted(tuple(r) for r in out.collect()) == sorted(want)
    lines = out._jdf.queryExecution().optimizedPlan().toString().splitlines()
    depth = [len(x) - len(x.lstrip(" :+-")) for x in lines]
    cut = next(i for i, x in enumerate(lines) if "RepartitionByExpression" in x)
    above, least = [], depth[cut]
    for i in range(cut - 1, -1, -1):
        if depth[i] < least:
            above, least = [*above, lines[i]], depth[i]
    assert above and not [x for x in above if "substring_index" in x]

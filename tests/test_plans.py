"""Scanners, documentation plans, report texts, the incremental scan and resilience."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tessella.functions import scanners as N
from tessella.operators import pages as P
from tessella.operators import providers as V
from tessella.operators import render as D
from tessella.operators import report, rules
from tessella.operators import scan as S


@pytest.mark.parametrize("text, want", [
    ('x ```json\n{"a": 1}\n``` y', '{"a": 1}'), ("```ts\nlet a = {};\n```\n", "{}"), ("```\n[1, 2]\n```", "[1, 2]"), ('say {"s": "}"} then {', '{"s": "}"}'),
    ("{bad: {nested: 'x'}} rest", "{bad: {nested: 'x'}}"), ("none", None), (None, None), ("{open", None), ('[1, {"a": []}] {', '[1, {"a": []}]'),
])
def test_first_json(text, want):
    assert N.first_json(text) == want


def test_readme_sections():
    text = "intro\n# A\nbody a\n## B\n```\n# no\n```\n### C\nx\n## D\nlast\n"
    assert [(a, b) for a, b, _, _ in N.readme_sections(text)] == [(1, "A"), (2, "B"), (3, "C"), (2, "D")]
    assert N.section_of(text, "b") == "```\n# no\n```\n### C\nx" and N.section_of(text, "zz") is None
    assert N.user_instructions("## Tests  \nold\n## TESTS\nnew\n## Other\nx\n## Code Style!\ny", ["tests", "code_style"]) == {"tests": "new", "code_style": "y"}


def test_doc_comments():
    src = "/** first */\nfunction a() {}\n\n/**\n * Two\n * lines\n */\n@deco\nexport class B {}\n/* plain */\nfunction c() {}\n"
    assert N.doc_comment(src, 2) == "/** first */" and N.doc_comment(src, 9) == "/**\n* Two\n* lines\n*/"
    assert N.doc_comment(src, 11) is None and N.doc_comment(None, 3) is None
    assert N.is_self_descriptive("interface A {\n  name: string;\n  size?: number;\n}") and not N.is_self_descriptive("interface A {\n  x: string;\n}")


def test_refuted_bounds():
    src = "const A = [1, [2, 3], f(4, 5)];\nexport const BB: number[] = [\n  1,\n  2,\n  3,\n];\nconst C = [];\n"
    assert [N.array_size(src, n) for n in ("A", "BB", "C", "D")] == [3, 3, 0, None]
    assert N.refute_bounds("`A` and `BB` differ in size", src) == "A and BB have 3 elements each"
    assert N.refute_bounds("`A` and `C` differ", src) is None and N.refute_bounds(None, src) is None


def test_subcommands():
    text = "Usage: x\n\nCommands:\n  run [options]   Start\n  list|ls         Show all\n\nOptions:\n  help  no\n"
    assert N.subcommands(text) == [("run", "Start"), ("list", "Show all")]


def test_re_exports(spark):
    df = spark.createDataFrame([("i.ts", "export { a, b as c } from './x';\nexport { d };")], "file string, content string")
    assert {(r.name, r.source) for r in N.re_exports(df).collect()} == {("a", "./x"), ("c", "./x")}


def test_count_tokens(spark, tmp_path):
    import base64

    ranks = [bytes([i]) for i in range(256)] + [b"ab", b"abc"]
    (tmp_path / "v").write_text("".join(f"{base64.b64encode(t).decode()} {i}\n" for i, t in enumerate(ranks)))
    df = spark.createDataFrame([("abcab",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(N.count_tokens(F.col("t"), str(tmp_path / "v"))).collect()] == [2, 0, 0]


def test_scan_keeps_parses_and_drops(spark):
    h = lambda rows: spark.createDataFrame(rows, "file string, content string, hash string")
    one, counts = S.scan(h([("a.py", "def f(): pass", "1"), ("b.py", "X = 1", "1"), ("c.py", "", "1")]), None)
    assert {r.state: (r.n_files, r.n_symbols) for r in counts.collect()} == {"new": (3, 2)}
    two, counts = S.scan(h([("a.py", "ignored: the hash is the same", "1"), ("b.py", "X = 1\nY = 2", "2"), ("d.py", "Z = 1", "1")]), one)
    assert {r.state: (r.n_files, r.n_symbols) for r in counts.collect()} == {"cached": (1, 1), "modified": (1, 2), "new": (1, 1), "deleted": (1, 0)}
    assert {r.file: [s.name for s in r.symbols] for r in two.collect()} == {"a.py": ["f"], "b.py": ["X", "Y"], "d.py": ["Z"]}


@pytest.mark.parametrize("content, symbols, want", [
    ("export * from './a';\n\nexport { b } from './c';", [], "barrel-export"), ("a\nb", [("f", "function", True)], "trivial"), ("x\n" * 12, [("T", "type", True)], "type-only"),
    ("x\n" * 12, [("A", "constant", True), ("B", "constant", False)], "constants-only"), ("x\n" * 12, [("f", "function", False)], "internal"), ("x\n" * 12, [("f", "function", True)], "simple"), ("x\n" * 12, [("f", "function", True)] * 3, "complex"), ("", [], "trivial"),
])
def test_triage(spark, content, symbols, want):
    df = spark.createDataFrame([("f", content, symbols)], "file string, content string, symbols array<struct<name:string,kind:string,exported:boolean>>")
    assert S.triage(df).first().reason == want


def test_skip_reviews(spark):
    df = spark.createDataFrame([("f", "x\n" * 12, [("T", "type", True), ("U", "type", True)])], "file string, content string, symbols array<struct<name:string,kind:string,exported:boolean>>")
    use = spark.createDataFrame([("f", "T", "DEAD")], "file string, name string, value string")
    assert {r.name: (r.utility, r.tests, r.is_generated) for r in S.skip_reviews(S.triage(df), use).collect()} == {"T": ("DEAD", "-", True), "U": ("USED", "-", True)}


def test_implicated_dependency(spark):
    df = spark.createDataFrame([("needs Zod before react", ["react", "zod"]), ("none", ["a-b"])], "d string, deps array<string>")
    assert [r[0] for r in df.select(S.implicated_dependency(F.col("d"), F.col("deps"))).collect()] == ["zod", None]


def test_domain_gaps(spark):
    fn = [(i, "src/core/a.ts", f"f{i}", [1.0, 0.0] if i < 3 else [0.0, 1.0]) for i in range(4)] + [(9, "src/lone/x.ts", "g", [1.0, 0.0])]
    sec = [(100, "core.md", [1.0, 0.0]), (101, "core.md", [0.9487, 0.3162]), (102, "other.md", [-1.0, 0.0])]
    got = P.domain_gaps(spark.createDataFrame(fn, "id long, file string, name string, doc_vector array<double>"), spark.createDataFrame(sec, "id long, page string, vector array<double>"))
    d = got["domains"].collect()
    assert [(r.domain, r.page, r["class"]) for r in d] == [("core", "core.md", "COVERED")]
    assert {r.name: r.state for r in got["functions"].collect()} == {"f0": "covered", "f1": "covered", "f2": "covered", "f3": "missing"}
    assert P.coverage(got).first().function_share == 0.75
    concepts = spark.createDataFrame([("hot path", 7)], "concept string, n int")
    named = P.concept_gaps(concepts, spark.createDataFrame([("a.md", "the HOT-PATH"), ("b.md", "x")], "page string, content string"))
    assert named.first().page == "a.md"
    items = {r.page: [i.name for i in r["items"]] for r in P.gaps_per_page(got["functions"], named).collect()}
    assert items == {"core.md": ["f3"], "a.md": ["hot path"]}


def test_truncation_in_stages(spark):
    rows = [(b, "s" * 40, "d" * 40, "b" * 400, "i" * 400, ["e" * 40] * 10) for b in (1000, 200, 120, 100, 30)]
    for budget, *row in rows:
        r = P.truncate_context(spark.createDataFrame([tuple(row)], "signatures string, docs string, bodies string, internals string, exports array<string>"), budget).first()
        assert r.stage == {1000: 0, 200: 2, 120: 3}.get(budget, r.stage)
        used = sum(-(-len(x) // 4) for x in (r.signatures, r.docs, r.bodies, r.internals, "\n".join(r.exports)))
        assert used <= max(budget, 10 + 1)


def test_reports(spark):
    cols = "file string, name string, exported boolean, correction string, overengineering string, utility string, duplication string, tests string, documentation string, confidence int, detail string"
    rows = [(f"f{i:02}", "s", True, "ERROR" if i == 5 else "OK", "LEAN", "DEAD" if i % 2 else "USED", "UNIQUE", "GOOD", "DOCUMENTED", 90, "why") for i in range(24)]
    r = spark.createDataFrame(rows, cols)
    files = r.groupBy("file").agg(rules.verdict_merged().alias("verdict"), F.count_if(F.col("utility") == "DEAD").alias("n_findings"), F.max("confidence").alias("max_confidence"))
    page = D.index(r, files).first().markdown
    assert page.index("`f05` — CRITICAL") < page.index("`f01` — NEEDS_REFACTOR") < page.index("`f00` — CLEAN") and "| utility | 50 % |" in page
    assert {x.path for x in D.axis_shards(r).collect()} == {"utility/shard-1.md", "utility/shard-2.md", "correction/shard-1.md"}
    assert "f05" in D.message(r, files).first().text
    assert {(x.path, x.is_dir) for x in D.tree_rows(spark.createDataFrame([("a/b/c",), ("a/d",)], "file string")).collect()} == {("a", True), ("a/b", True), ("a/b/c", False), ("a/d", False)}
    bar = spark.range(1).select(report.health_bar(F.lit(70), F.lit(0.3)), D.ratio_bar(F.lit(1), F.lit(4), 8)).first()
    assert bar[0] == "███████░░░ red" and bar[1] == "##......"


def test_parse_detail_is_the_inverse_of_merging(spark):
    df = spark.createDataFrame([("[OK] fine | [DEAD] unused [x]",)], "d string")
    assert [tuple(x) for x in df.select(rules.parse_detail(F.col("d"))).first()[0]] == [("OK", "fine"), ("DEAD", "unused [x]")]


def test_breaker_and_retry():
    now = [0.0]
    b = V.Breaker(2, 10, lambda: now[0])
    b.record(False)
    assert b.allows()
    b.record(False)
    assert not b.allows()
    now[0] = 10
    assert b.allows()
    b.record(False)
    assert not b.allows()
    now[0] = 21
    b.record(True)
    assert b.allows() and b.count == 0
    tries, pauses = [], []

    def call():
        tries.append(1)
        if len(tries) < 3:
            raise OSError
        return "ok"

    assert V.retried(call, 3, 5, 6, pauses.append) == "ok" and pauses == [5, 6]
    with pytest.raises(OSError):
        V.retried(lambda: (_ for _ in ()).throw(OSError()), 2, sleep=lambda s: None)


class _Fails:
    """A provider that fails on multiples of a number and counts its calls in a folder."""

    def __init__(self, by, folder):
        self.by, self.folder = by, folder

    def evaluate(self, row):
        import uuid
        from pathlib import Path

        Path(self.folder, f"{row['id']}-{uuid.uuid4().hex}").touch()
        if row["id"] % self.by == 0:
            raise ValueError("down")
        return [{"id": row["id"], "value": f"by {self.by}"}]


def _providers(tmp_path, **by):
    from functools import partial

    for name in by:
        (tmp_path / name).mkdir()
    return {name: partial(_Fails, n, str(tmp_path / name)) for name, n in by.items()}


def test_failed_rows_go_to_the_next_provider(spark, tmp_path):
    rows = spark.range(60).withColumn("model", F.when(F.col("id") % 4 == 0, "x-1").otherwise("m-1"))
    router = V.Router({"x": ["dead", "third"], "x-none": [], "m-": ["third"]}, ["backup"])
    done = V.evaluate_routed(rows, router, _providers(tmp_path, dead=1, third=3, backup=15), "id long, value string", f"file://{tmp_path}/r", attempts=1)
    got = {r.id: (r.value, r.provider, r.error) for r in done.answers.collect()}
    assert len(got) == done.answers.count() == 60
    for i, (value, provider, error) in got.items():
        want = ("by 3", "third", None) if i % 3 else ("by 15", "backup", None) if i % 15 else (None, "backup", "ValueError: down")
        assert (value, provider, error) == want
    circuits = {(r["pass"], r.provider): (r.n_calls, r.n_failed, r.open) for r in done.circuits.collect()}
    assert circuits == {(0, "dead"): (15, 15, True), (0, "third"): (45, 15, False), (1, "third"): (15, 5, False), (1, "backup"): (15, 3, False), (2, "backup"): (5, 1, False)}
    assert len(list((tmp_path / "dead").iterdir())) == 15 and len(list((tmp_path / "third").iterdir())) == 60  # each call once


def test_an_open_circuit_is_not_asked_again(spark, tmp_path):
    rows = spark.range(20).withColumn("model", F.when(F.col("id") < 10, "a").otherwise("b"))
    router = V.Router({"a": ["dead"], "b": ["half", "dead", "last"]})
    done = V.evaluate_routed(rows, router, _providers(tmp_path, dead=1, half=2, last=100), "id long, value string", f"file://{tmp_path}/r", attempts=1, share=0.9)
    got = {r.id: (r.provider, r.error is None) for r in done.answers.collect()}
    assert {got[i] for i in range(10)} == {("dead", False)} and {got[i] for i in range(11, 20, 2)} == {("half", True)} and {got[i] for i in range(10, 20, 2)} == {("last", True)}
    assert len(list((tmp_path / "dead").iterdir())) == 10


def test_a_row_without_a_provider_fails_and_a_task_stops_calling(spark, tmp_path):
    rows = spark.range(12).withColumn("model", F.lit("q")).coalesce(1)
    none = V.evaluate_routed(rows, V.Router({"a": ["dead"]}), _providers(tmp_path, dead=1), "id long, value string", f"file://{tmp_path}/r", attempts=1)
    assert {r.error for r in none.answers.collect()} == {"NoProvider: none is left"} and none.answers.count() == 12
    router = V.Router({"q": ["broken"]})
    done = V.evaluate_routed(rows, router, _providers(tmp_path, broken=1), "id long, value string", f"file://{tmp_path}/s", attempts=1, breaker=V.Breaker)
    assert len(list((tmp_path / "broken").iterdir())) == 3 and done.answers.filter("error like 'CircuitOpen%'").count() == 9

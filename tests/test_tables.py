"""Sources, snapshots, the vector index, providers and streams."""

from __future__ import annotations

import datetime
import json

import pytest
from pyspark.sql import functions as F

from tessella.operators import incremental as I
from tessella.operators import index as X
from tessella.operators import metrics as M
from tessella.operators import project as P
from tessella.operators import providers as V
from tessella.operators import rules as R
from tessella.sources import files as S
from tessella.sources import versions
from tessella.streaming import watch as W


@pytest.mark.parametrize("glob, yes, no", [("src/**/*.ts", ["src/a.ts", "src/x/y/a.ts"], ["a.ts", "src/a.tsx"]), ("*.{md,txt}", ["a.md", "b.txt"], ["x/a.md", "a.mdx"]), ("a?c", ["abc"], ["ac", "a/c"])])
def test_globs(glob, yes, no):
    import re

    p = re.compile(S.glob_to_regex(glob))
    assert all(p.match(x) for x in yes) and not any(p.match(x) for x in no)


def test_collect_files(spark, tmp_path):
    for name in ("src/a.ts", "src/b.test.ts", "src/sub/c.ts", "node_modules/x.ts", "README.md"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(f"// {name}\n")
    got = S.collect_files(spark, str(tmp_path), ["**/*.ts"], ["node_modules/**", "**/*.test.ts"])
    assert sorted(r.file for r in got.select("file").collect()) == ["src/a.ts", "src/sub/c.ts"]
    tracked = spark.createDataFrame([("src/a.ts",)], "file string")
    assert [r.content for r in S.text_of(S.collect_files(spark, str(tmp_path), ["**/*.ts"], tracked=tracked)).collect()] == ["// src/a.ts\n"]
    assert S.tracked_files(spark, str(tmp_path)) is None
    assert [r.head for r in S.read_markdown(spark, str(tmp_path)).collect()] == ["// README.md\n"]


def test_reviews_are_checked_and_quarantined(spark, tmp_path):
    symbol = {"name": "f", "correction": "OK", "utility": "USED", "confidence": 80}
    good = {"file": "a.ts", "symbols": [symbol], "best_practices": {"rules": [{"rule_id": 40, "severity": "odd", "status": "FAIL"}]}}
    lines = [json.dumps(good), "{broken", json.dumps({"file": "b.ts", "symbols": [{**symbol, "utility": "MAYBE"}]}), json.dumps({"file": "c.ts", "symbols": [{**symbol, "utility": "-"}]})]
    (tmp_path / "r.json").write_text("\n".join(lines))
    ok, bad = S.read_reviews(spark, str(tmp_path))
    assert sorted(r.file for r in ok.collect()) == ["a.ts", "c.ts"] and bad.count() == 2
    rule = S.normalize_review(ok.filter("file = 'a.ts'")).first().best_practices.rules[0]
    assert (rule.rule_id, rule.severity) == (17, "MEDIUM")


def test_coverage(spark):
    df = spark.createDataFrame([("a", [(1, 2, 1), (2, 4, 0)], [1, 0], [[1, 0], [2]])], "file string, statements array<struct<start:int,end:int,hits:int>>, functions array<int>, branches array<array<int>>")
    r = S.coverage(df).first()
    assert (r.statements_total, r.statements_covered, r.functions_covered, r.branches_total, r.branches_covered, r.lines_total, r.lines_covered) == (2, 1, 1, 3, 2, 4, 2)


def test_snapshots_switch_as_a_whole(spark, tmp_path):
    root = f"file://{tmp_path}/s"
    assert versions.read_snapshot(spark, root) is None
    versions.write_snapshot(spark.range(3), root)
    versions.write_snapshot(versions.read_snapshot(spark, root).filter("id > 0"), root)
    assert versions.read_snapshot(spark, root).count() == 2


def test_inject_block_twice(spark):
    df = spark.createDataFrame([("# T\n",), ("a <!-- badge:start -->\nold\n<!-- badge:end --> b",)], "t string")
    put = lambda c: S.inject_block(c, F.lit("new"))
    one = [r[0] for r in df.select(put(F.col("t"))).collect()]
    assert one[1] == "a <!-- badge:start -->\nnew\n<!-- badge:end --> b" and one[0].count("new") == 1
    assert [r[0] for r in spark.createDataFrame([(x,) for x in one], "t string").select(put(F.col("t"))).collect()] == one


def test_output_names_do_not_collide(spark):
    df = spark.createDataFrame([("a/b.ts",), ("a-b.ts",), ("a/b.py",)], "p string")
    assert df.select(S.output_name(F.col("p"))).distinct().count() == 3


def test_index_upkeep(spark):
    row = lambda i, f, t="function", s="": (i, f, f"n{i}", "sum" if t == "function" else "", [1.0, 0.0], [0.0, 1.0], t, s)
    schema = "id string, file string, name string, summary string, vector array<float>, nlp_vector array<float>, type string, source string"
    a, b = "a" * 16, "b" * 16
    base = spark.createDataFrame([row(a, "f1"), row(b, "f2"), row("c" * 16, "d.md", "doc_section", "project")], schema).withColumn("last_indexed", F.lit("2025"))
    up = X.upsert(base, base.filter(F.col("id") == a).withColumn("name", F.lit("new")).unionAll(base.limit(1).withColumn("id", F.lit("bad id"))))
    assert {r.id: r.name for r in up.collect()} == {a: "new", b: f"n{b}", "c" * 16: "n" + "c" * 16}
    assert [r.file for r in X.indexed_files(base).orderBy("file").collect()] == ["f1", "f2"]
    assert X.delete_file(base, "f1").count() == 2 and X.delete_file(base, "d.md", "function").count() == 3
    s = X.stats(base).first()
    assert (s.n_cards, s.n_files, s.n_sections, s.n_summaries) == (2, 2, 1, 2)
    d = X.dimension_drift(base, 2, 3).first()
    assert (d.code_drift, d.nlp_drift) == (False, True)
    assert X.by_name(base, "NA").count() == 1 and X.sections(base, "project").count() == 1
    assert X.file_centroids(base).count() == 2
    assert X.delete_sections(base, spark.createDataFrame([("c" * 16,), (a,)], "id string")).count() == 2


def test_cards(spark):
    src = "function a() {\n  if (x) { b(); }\n}\nfunction b() {\n  return 1;\n}\n"
    symbols = spark.createDataFrame([("f", "a", "function", 1, 3), ("f", "b", "function", 4, 6), ("f", "C", "constant", 1, 1)], "file string, name string, kind string, line_start int, line_end int")
    got = {r.name: r for r in X.cards(symbols, spark.createDataFrame([("f", src)], "file string, content string")).collect()}
    assert got["a"].called == ["b"] and got["b"].called == [] and got["a"].complexity == 1 and len(got["a"].id) == 16 and set(got) == {"a", "b"}


class Flaky:
    def evaluate(self, row):
        if row["id"] == "x":
            raise ValueError("no")
        return [{"id": row["id"], "body_hash": row.get("body_hash"), "value": row["id"] * 2}]


def test_providers(spark):
    df = spark.createDataFrame([("a", "h"), ("x", "h"), ("b", "h")], "id string, body_hash string")
    got = {r.id: (r.value, r.error) for r in V.evaluate(df, Flaky, "id string, body_hash string, value string").collect()}
    assert got["a"] == ("aa", None) and got["x"][0] is None and "ValueError" in got["x"][1]
    cache = spark.createDataFrame([("a", "h", "old"), ("b", "stale", "old")], "id string, body_hash string, value string")
    assert {r.id: r.value for r in V.summarize(df, cache, Flaky).collect()} == {"a": "old", "b": "bb"}
    texts = spark.createDataFrame([("two words",), ("two words",), ("",), (None,)], "t string")
    vec = [tuple(r.v) for r in V.embed(texts, F.col("t"), "v", V.HashingEmbedder, 64).collect()]
    assert len(set(vec)) == 2 and sum(1 for v in vec if not any(v)) == 2


def test_fold_changes(spark):
    t = datetime.datetime(2025, 1, 1)
    later = t + datetime.timedelta(seconds=5)
    schema = "file string, hash string, action string, at timestamp"
    one = W.fold_changes(None, spark.createDataFrame([("a", "1", "add", t), ("a", "2", "change", later), ("b", "1", "add", t), ("b", None, "unlink", later)], schema))
    assert [(r.file, r.hash, r.status) for r in W.present(one).collect()] == [("a", "2", "PENDING")]
    done = W.advance(one, spark.createDataFrame([("a", None)], "file string, error string"))
    again = W.fold_changes(done, spark.createDataFrame([("a", "2", "change", later), ("c", "9", "add", later)], schema))
    assert {(r.file, r.status) for r in W.present(again).collect()} == {("a", "DONE"), ("c", "PENDING")}
    late = W.fold_changes(again, spark.createDataFrame([("a", None, "unlink", t), ("b", "0", "change", t), ("c", None, "unlink", later + datetime.timedelta(seconds=1))], schema))
    assert {(r.file, r.hash, r.status) for r in W.present(late).collect()} == {("a", "2", "DONE")}


def test_a_drained_stream_equals_the_batch(spark, tmp_path):
    t = datetime.datetime(2025, 1, 1)
    rows = [(f"f{i % 7}", str(i), "unlink" if i % 11 == 0 else "change", t + datetime.timedelta(seconds=i)) for i in range(60)]
    df = spark.createDataFrame(rows, "file string, hash string, action string, at timestamp")
    df.orderBy("at").coalesce(1).write.option("maxRecordsPerFile", 9).parquet(f"{tmp_path}/in")
    root = f"file://{tmp_path}/state"
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    W.watch(stream, root, root + "/cp").awaitTermination()
    key = lambda d: {(r.file, r.hash) for r in d.collect()}
    assert key(W.present(W.read_state(spark, root))) == key(W.present(W.fold_changes(None, df)))


def test_project(spark):
    deps = spark.createDataFrame([("next",), ("react",), ("express",)], "name string")
    found = P.detect_frameworks(deps)
    assert {r.id for r in found.collect()} == {"nextjs", "express"}
    assert P.project_types(found, ["CLI"]).first().types == ["Backend API", "CLI", "Frontend"]
    files = spark.createDataFrame([("a.ts", 1), ("b.PY", 2), ("Dockerfile", 3), ("x.unknown", 4), ("c.py", 5)], "p string, i int").select(P.classify_file(F.col("p")).alias("lang"), "i")
    assert {r.lang: r.pct for r in P.language_shares(files, "lang").collect()} == {"TypeScript": 25, "Python": 50, "Docker": 25}
    assert P.primary_language(files, "lang", "i").first().language == "Python"
    v = P.merge_dependencies(spark.createDataFrame([("a", "1"), ("b", "1")], "name string, version string"), spark.createDataFrame([("a", "2")], "name string, version string"))
    assert {r.name: r.version for r in v.collect()} == {"a": "2", "b": "1"}


def test_registry_and_runs(spark):
    reg = spark.createDataFrame([("s", None, "tests", "GOOD", "WEAK", 1)], "symbol string, dependency string, axis string, `from` string, `to` string, at int")
    new = spark.createDataFrame([("s", None, "tests", "GOOD", "NONE", 2), ("s", "d", "tests", "A", "B", 1)], reg.schema)
    assert {(r.dependency, r.to) for r in I.reclassify(reg, new).collect()} == {(None, "NONE"), ("d", "B")}
    assert I.migrate_registry(reg.unionAll(new)).count() == 2
    runs = spark.createDataFrame([("r1", "running", False), ("r2", "done", True), ("r3", "running", True), ("latest", "done", True)], "run_id string, status string, alive boolean")
    assert {r.run_id: r.status for r in I.repair(runs).collect()}["r1"] == "crashed"
    assert [I.resolve_latest(runs, p).first().run_id for p in ("r1", "gone", None)] == ["r1", "r3", "r3"]


def test_price_falls_back_by_rank(spark):
    calls = spark.createDataFrame([(m, 1_000_000, 0, 0, 0) for m in ("p/m-20250101", "m", "none")], "model string, in_tokens long, out_tokens long, read_tokens long, creation_tokens long")
    prices = spark.createDataFrame([("m", 2.0, 1.0, None, None), ("m-20250101", 3.0, 1.0, None, None)], "model string, input double, output double, cache_read double, cache_creation double")
    assert {r.model: r.cost for r in M.price(calls, prices).collect()} == {"p/m-20250101": 3.0, "m": 2.0, "none": 0.0}


def test_identical_actions_collapse(spark):
    rows = [("f", "tests", "hygiene", i, f"Add a test for s{i}", f"s{i}") for i in range(3)] + [("f", "tests", "hygiene", 9, "Rename s9", "s9")]
    got = {(r.n, r.description, r.target) for r in R.group_identical(spark.createDataFrame(rows, "file string, source string, category string, id int, description string, target string")).collect()}
    assert got == {(3, "Add a test for <symbol>", "s0, s1, s2"), (1, "Rename s9", "s9")}


def test_parity_of_coherence(spark):
    row = spark.createDataFrame([("DEAD", "-", "OK", "LEAN", "-", False, 1, 5, 90)], "utility string, tests string, correction string, overengineering string, documentation string, exported boolean, line_start int, line_end int, confidence int")
    a, b = R.coherence(row).first(), R.coherence(row, parity=True).first()
    assert (a.tests, a.documentation, a.confidence) == ("-", "-", 90) and (b.tests, b.documentation, b.confidence) == ("WEAK", "DOCUMENTED", 60)

"""The incremental index as one operation, the order in which it is committed, and the limit on provider calls."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tessella.operators import project as J
from tessella.operators import providers as V
from tessella.operators import refresh
from tessella.sources import files as S
from tessella.sources.versions import Table

CODE = "function {0}() {{\n  return {1}\n}}"


def sources(spark, **bodies):
    files = spark.createDataFrame([(f"{n}.ts", CODE.format(n, b)) for n, b in bodies.items()], "file string, content string")
    return files.select("file", F.regexp_extract("content", r"function (\w+)", 1).alias("name"), F.lit("function").alias("kind"), F.lit(1).alias("line_start"), F.lit(3).alias("line_end")), files


def embedder(run, seen):
    def embed(cards):
        seen.append(sorted(r.name for r in cards.collect()))
        none = F.lit(None).cast("array<float>")
        return cards.withColumns({"vector": F.array_repeat(F.lit(1.0).cast("float"), 2), "nlp_vector": none, "doc_vector": none, "summary": F.lit(run)})

    return embed


def test_runs_embed_what_changed_and_drop_what_is_gone(spark, tmp_path):
    root, seen = f"file://{tmp_path}/i", []
    refresh.commit(refresh.project(*refresh.committed(spark, root), *sources(spark, a="1", b="2", z="3"), embedder("one", seen), (2, 2)), root)
    refresh.commit(refresh.project(*refresh.committed(spark, root), *sources(spark, a="1", b="22", n="4"), embedder("two", seen), (2, 2)), root)
    index, cache = refresh.committed(spark, root)
    assert seen == [["a", "b", "z"], ["b", "n"]]
    assert {(r.name, r.summary) for r in index.collect()} == {("a", "one"), ("b", "two"), ("n", "two")}
    assert {r.id for r in cache.collect()} == {r.id for r in index.collect()}


def test_a_run_writes_what_changed_and_no_more(spark, tmp_path):
    root, seen = f"file://{tmp_path}/i", []
    many = {f"f{i}": str(i) for i in range(40)}
    refresh.commit(refresh.project(None, None, *sources(spark, **many), embedder("one", seen), (2, 2)), root)
    before = {p for p in tmp_path.rglob("*.parquet")}
    changed = {k: v for k, v in many.items() if k != "f7"} | {"f1": "other", "g": "9"}
    refresh.commit(refresh.project(*refresh.committed(spark, root), *sources(spark, **changed), embedder("two", seen), (2, 2)), root)
    new = [p for p in tmp_path.rglob("*.parquet") if p not in before]
    written = sum(spark.read.parquet(f"file://{p}").count() for p in new if "/index/" in str(p))
    index, cache = refresh.committed(spark, root)
    assert before <= set(tmp_path.rglob("*.parquet")) and written <= 5 and seen[1] == ["f1", "g"]
    assert {(r.name, r.summary) for r in index.collect()} == {(k, "two" if k in ("f1", "g") else "one") for k in changed}
    assert {r.id for r in cache.collect()} == {r.id for r in index.collect()}


def test_sections_of_changed_and_missing_documents_are_replaced(spark, tmp_path):
    root = f"file://{tmp_path}/s"
    page = lambda **xs: spark.createDataFrame([(f"{f}.md", f"## One\n\n{t * 30}\n\n## Two\n\n{t * 30}") for f, t in xs.items()], "file string, content string")
    embed = lambda parts: parts.withColumn("nlp_vector", F.array(F.lit(1.0).cast("float")))
    index = refresh.X.rows_of_sections(spark.createDataFrame([], "id string, file string, heading string, embed_text string, nlp_vector array<float>"), (1, 1), "docs")
    refresh.commit(refresh.sections(index, None, page(a="some words ", b="more words ", z="last words "), "docs", embed, (1, 1)), root)
    index, cache = refresh.committed(spark, root, "file")
    refresh.commit(refresh.sections(index, cache, page(a="some words ", b="other words ", n="new words "), "docs", embed, (1, 1)), root)
    index, cache = refresh.committed(spark, root, "file")
    assert sorted((r.file, r.name, "other" in r.summary) for r in index.collect()) == [("a.md", "One", False), ("a.md", "Two", False), ("b.md", "One", True), ("b.md", "Two", True), ("n.md", "One", False), ("n.md", "Two", False)]
    assert {r.file for r in cache.collect()} == {"a.md", "b.md", "n.md"}
    assert {i for r in cache.collect() for i in r.section_ids} == {r.id for r in index.collect()}


def test_a_run_that_stops_before_the_cache_embeds_again_and_loses_nothing(spark, tmp_path, monkeypatch):
    root, seen = f"file://{tmp_path}/i", []
    write = Table.write

    def stops(table, *change, **more):
        if table.root.endswith("/cache"):
            raise RuntimeError("stopped")
        return write(table, *change, **more)

    monkeypatch.setattr(Table, "write", stops)
    with pytest.raises(RuntimeError):
        refresh.commit(refresh.project(None, None, *sources(spark, a="1"), embedder("one", seen), (2, 2)), root)
    monkeypatch.undo()
    index, cache = refresh.committed(spark, root)
    assert cache is None and index.count() == 1
    refresh.commit(refresh.project(index, cache, *sources(spark, a="1"), embedder("two", seen), (2, 2)), root)
    assert seen == [["a"], ["a"]] and [(r.name, r.summary) for r in refresh.committed(spark, root)[0].collect()] == [("a", "two")]


def test_unchanged_documents_are_not_chunked_again(spark):
    page = lambda *xs: spark.createDataFrame([(f, f"## One\n\n{t * 30}\n\n## Two\n\n{t * 30}") for f, t in xs], "file string, content string")
    one, cache = refresh.chunked(page(("a", "some words "), ("b", "more words ")), None)
    marked = cache.withColumn("value", F.transform("value", lambda v: v.withField("heading", F.concat(F.lit("cached "), v["heading"]))))
    two, _ = refresh.chunked(page(("a", "some words "), ("b", "other words ")), marked)
    assert one.count() == 4
    assert {(r.file, r.heading) for r in two.collect()} == {("a", "cached One"), ("a", "cached Two"), ("b", "One"), ("b", "Two")}


class Counting:
    def evaluate(self, row):
        import os

        from pyspark import TaskContext

        return [{"id": row["id"], "task": f"{TaskContext.get().partitionId()}-{os.getpid()}"}]


@pytest.mark.parametrize("calls", [1, 3])
def test_no_more_calls_than_the_gate_lets_through(spark, calls):
    rows = spark.range(40).repartition(9)
    got = V.evaluate(rows, Counting, "id long, task string", calls=calls).collect()
    assert len(got) == 40 and len({r.task.split("-")[0] for r in got}) <= calls
    for bad in (0, 33):
        with pytest.raises(ValueError, match="1 to 32"):
            V.gate(rows, bad)


def test_call_log_round_trip(spark, tmp_path):
    path = str(tmp_path / "log")
    schema = S.schemas.LLM_CALL
    empty = spark.createDataFrame([], schema)
    one = spark.createDataFrame([tuple(None for _ in empty.columns)], schema)
    S.append_call_log(one.unionAll(one), path)
    S.append_call_log(one, path)
    assert S.read_call_log(spark, path).count() in (0, 3)


def test_globs_of_languages(spark):
    got = {r.glob for r in J.scan_globs(spark.createDataFrame([("Rust", 5), ("Go", 4)], "lang string, pct int")).collect()}
    assert got == {"src/**/*.rs"}


def test_reviews_are_written_side_by_side(spark, tmp_path):
    S.write_reviews(spark.createDataFrame([("f", 1)], "file string, n int"), spark.createDataFrame([("f", "# x")], "file string, markdown string"), f"{tmp_path}/r")
    assert spark.read.json(f"{tmp_path}/r/json").count() == 1 and spark.read.parquet(f"{tmp_path}/r/markdown").first().markdown == "# x"


def test_a_batch_of_calls_that_comes_twice_counts_once(spark, tmp_path, monkeypatch):
    from tessella.sources.versions import Log
    from tessella.streaming import calls as K

    names = [f.name for f in spark.createDataFrame([], S.schemas.LLM_CALL).schema]
    call = lambda n: tuple({"costUsd": 0.5, "inputTokens": 10, "outputTokens": n, "success": n % 2 == 0}.get(x) for x in names)
    for n in range(3):
        spark.createDataFrame([call(n)] * (n + 1), S.schemas.LLM_CALL).coalesce(1).write.mode("append").json(f"{tmp_path}/in/{n}")
    read = lambda: spark.readStream.schema(S.schemas.LLM_CALL).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).json(f"{tmp_path}/in")
    root, put, stopped = f"file://{tmp_path}/log", Log.put, []

    def dies(log, entry, after):  # once after the data and before its entry, once after the entry
        if entry.get("batch") == 1 and len(stopped) < 2:
            stopped.append(put(log, entry, after) if stopped else 0)
            raise RuntimeError("killed")
        return put(log, entry, after)

    monkeypatch.setattr(Log, "put", dies)
    for _ in range(2):
        with pytest.raises(Exception, match="killed"):
            K.record_calls(read(), root, f"{tmp_path}/cp").awaitTermination()
    K.record_calls(read(), root, f"{tmp_path}/cp").awaitTermination()
    assert K.recorded_calls(spark, root).count() == 6
    assert K.call_totals(spark, root) == {"calls": 6, "cost": 3.0, "tokens": 60 + 0 + 2 * 1 + 3 * 2, "failures": 2}

"""The pipeline, stage by stage, against plain versions of what each stage decides; and the registered queries."""

from __future__ import annotations

import os
import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest

import corpus_pipeline as P
from tests.llm.test_operators import brute_targets, edited, leak_words, prose, words

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    rng = random.Random(23)
    docs, labels = [(None, None), (1, ""), (2, None), (3, " "), (4, prose(rng, 9000, 10**5))], []
    bench = [(i, prose(rng, 25, 10**5)) for i in range(8)]
    for i in range(100, 1000):
        toxic = i % 10 == 0
        text = prose(rng, rng.randrange(20, 120), 10**5) + (" vile" if toxic else "")
        if i % 15 == 1:
            text = f"{text} {bench[i % 8][1]} tail"
        docs.append((i, text))
        if i % 3:
            labels.append((i, 1, int(toxic)))
        if i % 12 == 5:
            docs += [(10_000 + i, text), (20_000 + i, edited(rng, text, 0.005))]
    docs += [(500, docs[405][1]), docs[300], docs[300]]
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(d, t, "en", f"s{(d or 0) % 5}" if d != 4 else None, len(t or "")) for d, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def brute_groups(texts):
    """A number for each text, equal where links of similarity 0.75 reach."""
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if (w := words(t)) else frozenset() for t in texts]
    up = list(range(len(sets)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if 4 * (both := len(sets[i] & sets[j])) >= 3 * (len(sets[i]) + len(sets[j]) - both) and both:
                up[root(i)] = root(j)
    return [root(i) for i in range(len(sets))]


def pairs(df):
    return sorted(((r.doc_id, r.text) for r in df.select("doc_id", "text").collect()), key=str)


def test_stages_decide_as_plain_versions(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bench = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    names = [n for n, _ in P.STAGES]
    assert names == ["toxicity", "near_duplicates", "decontamination", "mixing", "sharding"]
    stage = dict(P.STAGES)

    clean = stage["toxicity"](spark, docs, sf).cache()
    assert clean.columns == docs.columns
    assert pairs(clean) == [(d, t) for d, t in pairs(docs) if "vile" not in words(t)]

    single = stage["near_duplicates"](spark, clean, sf).cache()
    before = pairs(clean)
    want = pairs(single)
    assert single.columns == docs.columns and len(set(want)) == len(want) and set(want) <= set(before)
    groups = defaultdict(set)
    for row, at in zip(before, brute_groups([t for _, t in before]), strict=True):
        groups[at if words(row[1]) else row].add(row)
    for group in groups.values():  # one row of each, of the smallest id; ids that repeat with other texts are told apart
        stays = [row for row in want if row in group]
        assert len(stays) == 1 and (stays[0][0] is None, stays[0][0]) == min(((d is None, d) for d, _ in group), key=str if any(d is None for d, _ in group) else None)
    assert len(groups) == len(want)

    windows = {tuple(w[i : i + 10]) for w in map(leak_words, bench) for i in range(len(w) - 9)}
    kept = stage["decontamination"](spark, single, sf).cache()
    assert pairs(kept) == [(d, t) for d, t in want if not any(tuple(w[i : i + 10]) in windows for w in [leak_words(t)] for i in range(len(w) - 9))]

    mixed = stage["mixing"](spark, kept, sf).cache()
    assert mixed.columns == docs.columns and set(pairs(mixed)) <= set(pairs(kept)) and max(Counter(pairs(mixed)).values()) <= 3
    sizes, taken = defaultdict(int), defaultdict(int)
    for df, into in ((kept, sizes), (mixed, taken)):
        for r in df.collect():
            into[r.source] += len(words(r.text))
    # the source None is one long document, which whole copies can't bring near any target
    assert all(abs(taken[s] - t) <= 0.01 * t + 5 for s, t in brute_targets(dict(sizes)).items() if s)

    dealt = stage["sharding"](spark, mixed, sf)
    assert dealt.columns == [*docs.columns, "shard", "slot"] and pairs(dealt) == pairs(mixed)
    by = defaultdict(list)
    for r in dealt.collect():
        by[r.shard].append(r.slot)
    counts = [len(by[s]) for s in range(40)]
    assert max(counts) - min(counts) <= 1 and all(sorted(v) == list(range(len(v))) for v in by.values())


def test_run_gives_the_same_twice(spark, sf):
    rows = lambda: sorted((str(r.doc_id), r.shard) for r in P.run(spark, sf).collect())
    one = rows()
    assert one and one == rows()


@pytest.mark.parametrize("name", ["mixing", "sharding", "decontamination", "near_duplicates", "toxicity"])
def test_stages_take_empty_input(spark, sf, name):
    nothing = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    assert dict(P.STAGES)[name](spark, nothing, sf).count() == 0


def test_queries_match_their_sql(spark):
    from tessella.llm import catalog

    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DATA}/{f}'")
    queries, oracles = catalog.queries(), catalog.oracle_sql()
    assert {n.split("_")[0] for n in queries if re.match(r"op\d", n)} == {f"op{i}" for i in range(1, 14)} and set(oracles) <= set(queries)
    for name, f in queries.items():
        df = f(spark, DATA)
        columns = sorted(df.columns)
        got = sorted((tuple(r) for r in df.select(*columns).collect()), key=str)
        assert got, name
        if name in oracles:
            want = con.execute(f"SELECT {', '.join(columns)} FROM ({oracles[name]})").fetchall()
            assert got == sorted(want, key=str), name


@pytest.mark.parametrize("name", ["toxicity", "near_duplicates", "decontamination", "mixing", "sharding"])
def test_stages_keep_columns_of_any_name(spark, sf, name):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    names = ["key", "size", "row", "n", "shard", "slot", "copies", "component", "spans", "items", "rate", "toxic", "uid", "__n", "text_hash"]
    wide = docs.selectExpr("*", *[f"concat('x', doc_id) AS `{c}`" for c in names])
    out = dict(P.STAGES)[name](spark, wide, sf)
    assert set(out.columns) == set(wide.columns) and len(out.columns) == len(wide.columns)
    kept = [c for c in names if name != "sharding" or c not in ("shard", "slot")]
    for r in out.collect():
        assert all(r[c] == (None if r.doc_id is None else f"x{r.doc_id}") for c in kept)


ORDINARY = """
import os, sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "3g").getOrCreate()
assert spark.conf.get("spark.checkpoint.dir", None) is None
import __spark_entry__ as e
from tessella.llm import store
for name in {names!r}:
    print("ROWS", name, e.queries()[name](spark, {data!r}).count(), flush=True)
base = store.shared_dir(spark)[len("file://"):]
print("LEFT", len(os.listdir(base)), base, flush=True)
"""


def test_queries_start_in_an_ordinary_session_and_leave_no_table(tmp_path):
    import subprocess
    import sys
    from pathlib import Path

    repo = str(Path(__file__).resolve().parents[2])
    import __spark_entry__ as e

    names = [q for q in e.queries() if re.match(r"op\d", q) or q == "pipeline"]
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path), "TMPDIR": str(tmp_path)}
    got = subprocess.run([sys.executable, "-c", ORDINARY.format(repo=repo, names=names, data=DATA)], env=env, capture_output=True, text=True, timeout=900)
    assert got.stdout.count("ROWS") == len(names) == 14, got.stderr[-3000:]
    left = next(x for x in got.stdout.splitlines() if x.startswith("LEFT")).split()
    assert int(left[1]) <= len(names)  # one result each, while the session lives
    assert not os.path.exists(left[2])

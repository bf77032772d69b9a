"""The prefix trie against one that is built turn by turn in memory."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest

from tessella.llm.prefixes import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth string, n string"


def brute(rows):
    convs: dict[int, list] = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            convs.setdefault(c, []).append(((turn is not None, turn or 0, role, digest), (role, text)))
    turns = {c: [x for _, x in sorted(xs)] for c, xs in convs.items()}
    nodes: dict[tuple, dict] = {}
    for c in sorted(turns):
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(c % 100 if c >= 0 else -(-c % 100))
        path = tuple(turns.get(base, [])[:h] + turns[c][h:])
        for d in range(len(path) + 1):
            nodes.setdefault(path[:d], {"members": [], "ends": []})["members"].append(c)
        nodes[path]["ends"].append(c)
    out = []
    for path, x in nodes.items():
        below = [(p, y) for p, y in nodes.items() if p[: len(path)] == path]
        children = [p for p, _ in below if len(p) == len(path) + 1]
        leaves = [p for p, _ in below if not any(len(q) == len(p) + 1 and q[: len(p)] == p for q, _ in below)]
        saved = sum((len(y["members"]) - 1) * len(p[-1][1]) for p, y in below if p)
        ends = hashlib.sha256(",".join(map(str, sorted(x["ends"]))).encode()).hexdigest()
        out.append((min(x["members"]), len(path), min(nodes[path[:-1]]["members"]) if path else None, len(x["members"]), len(children), len(leaves), saved, ends))
    return sorted(out, key=str)


def built(spark, rows):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(3)
    return sorted((tuple(r) for r in prefix_trie(df).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()), key=str)


def some_rows(seed):
    r = random.Random(seed)
    rows = []
    for c in [*range(0, 130), 200, 201, 305, 306, -5, -100, -104, 10**12]:
        for t in range(r.randrange(1, 8)):
            rows.append((c, r.choice([t, t, None]), r.choice(["user", "assistant", None]), r.choice(["a", "bb", "ccc", "é😀", None, ""])))
    return rows + [(None, 0, "user", "lost")] + rows[:40]


@pytest.fixture
def many_ranges(spark):
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    yield
    spark.conf.set(name, before)


@pytest.mark.parametrize("seed", [1, 2])
def test_nodes_are_those_of_a_plain_trie(spark, seed, many_ranges):
    rows = some_rows(seed)
    assert built(spark, rows) == brute(rows)


def test_a_conversation_longer_than_any_range(spark, many_ranges):
    rows = [(3, i, "user", f"t{i % 7}") for i in range(200)] + [(4, i, "user", f"t{i % 7}") for i in range(120)] + [(5, 0, "user", "t0")]
    assert built(spark, rows) == brute(rows)


def test_one_conversation_many_times(spark, many_ranges):
    rows = [(c, t, "user", f"same {t}") for c in range(1000, 1150) for t in range(6)] + [(c, 0, "user", f"x{c}") for c in range(30)]
    assert built(spark, rows) == brute(rows)


def test_empty_tables_and_conversations_without_turns(spark):
    assert built(spark, []) == []
    rows = [(c, 0, "user", "short") for c in range(301, 340)]  # their template is not there: who skips the first turn has none
    got = built(spark, rows)
    assert got == brute(rows)
    root = next(x for x in got if x[1] == 0)
    assert root[2] is None and root[3] == 39 and root[7] != hashlib.sha256(b"").hexdigest()


def test_equal_rows_in_one_turn_keep_their_number(spark, many_ranges):
    rows = [(7, 1, "user", "again")] * 60 + [(8, 1, "user", "again")] * 59
    assert built(spark, rows) == brute(rows)

"""Exact top-k against all scores."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from tessella.llm import topk
from tessella.llm.topk import exact_topk
from tessella.operators import similarity as S

SCHEMA = "vec_id long, embedding array<float>, score string, id string, number string"


def brute(rows, k=10):
    clip = lambda x: max(-(2**63), min(2**63 - 1, x))
    good = [(i, [clip(math.floor(float(x) * 1024)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out, seen = [], set()
    for q, v in good:
        if q % 100 or (q, tuple(v)) in seen:
            continue
        seen.add((q, tuple(v)))
        scores = sorted((-clip(sum(a * b for a, b in zip(v, w, strict=True))), i) for i, w in good if i != q and len(w) == len(v))
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def searched(spark, rows, k=10, **more):
    df = spark.createDataFrame([(i, v, "a", "b", "c") for i, v in rows], SCHEMA).repartition(3)
    return sorted(tuple(r) for r in exact_topk(df, df.filter("vec_id % 100 = 0"), k, **more).collect())


def f32(xs):
    return [float(np.float32(x)) for x in xs]


def vectors(n, dim=64, seed=3):
    r = random.Random(seed)
    return [(i, f32(r.gauss(0, 0.12) for _ in range(dim))) for i in range(n)]


@pytest.mark.parametrize("nodes", [1, 4, 7])
def test_same_as_all_scores(spark, nodes):
    rows = vectors(1200)
    assert searched(spark, rows, nodes=nodes) == brute(rows)


def test_ties_copies_and_odd_rows(spark):
    rows = vectors(420)
    same = rows[7][1]
    rows += [(1000 + i, same) for i in range(400)] + [(100, rows[100][1]), (5, rows[5][1])]
    rows += [(None, same), (2000, None), (2100, [*same[:-1], None]), (2200, [*same[:-1], float("nan")]), (2300, [*same[:-1], float("inf")]), (2400, same[:10]), (2401, same[:10]), (2500, [])]
    assert searched(spark, rows) == brute(rows)


def test_negative_scores_only(spark):
    rows = [(0, f32([1.0] * 8)), (100, f32([0.5] * 8))] + [(i, f32([-0.01 * i] * 8)) for i in range(1, 60)]
    assert searched(spark, rows) == brute(rows)


def test_huge_components(spark):
    rows = [(i, f32(((-1) ** (i * j) * 3.0**i * 1e3 for j in range(6)))) for i in range(0, 60)] + [(100, f32([1e30] * 6)), (200, f32([2.0] * 6))]
    assert searched(spark, rows) == brute(rows)


def test_fewer_rows_than_k_and_empty_tables(spark):
    rows = vectors(6)
    assert searched(spark, rows) == brute(rows) and len(searched(spark, rows)) == 5
    assert searched(spark, []) == []
    assert searched(spark, [(0, f32([1.0]))]) == []


def test_many_blocks_and_lanes(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK_BYTES", 64 * 8 * 50)
    monkeypatch.setattr(S, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(S, "LANE_BYTES", 64 * 8 * 200)
    monkeypatch.setattr(topk, "SOME", 3)
    rows = vectors(900, seed=9)
    assert searched(spark, rows) == brute(rows)

"""Searches and pairs over blocks against plain products, with blocks of a few rows and lanes."""

from __future__ import annotations

import os
import subprocess
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import similarity as S


def corpus(spark, m, ids=None):
    ids = range(len(m)) if ids is None else ids
    return spark.createDataFrame([(int(i), [float(x) for x in v]) for i, v in zip(ids, m, strict=True)], "id long, v array<double>").repartition(3)


def unit(n, dim=24, groups=0, seed=4):
    r = np.random.default_rng(seed)
    m = r.normal(size=(n, dim))
    if groups:
        m = r.normal(size=(groups, dim))[np.arange(n) % groups] * 3 + m
    return m / np.linalg.norm(m, axis=1)[:, None]


@pytest.fixture(params=["few", "lanes"])
def small(request, monkeypatch):
    monkeypatch.setattr(S, "BLOCK_BYTES", 24 * 8 * 17)
    if request.param == "lanes":
        monkeypatch.setattr(S, "BROADCAST_BYTES", 0)
        monkeypatch.setattr(S, "LANE_BYTES", 24 * 8 * 60)


def plain(m, least):
    s = np.round(m @ m.T, 6)
    return {(i, j): s[i, j] for i in range(len(m)) for j in range(i + 1, len(m)) if s[i, j] >= least}


@pytest.mark.parametrize("least", [-1.0, 0.3, 0.9])
def test_all_pairs(spark, small, least):
    m = unit(160, groups=12)
    m[5] = m[9]
    got = S.all_pairs(corpus(spark, m), least).collect()
    want = plain(m, least)
    assert len(got) == len(want) and {(r.a, r.b) for r in got} == set(want)
    assert max((abs(r.score - want[r.a, r.b]) for r in got), default=0) < 2e-6


def test_bounds_rule_pairs_out_where_vectors_gather(spark):
    r = S.pairs_scored(corpus(spark, unit(400, groups=20)), 0.85).first()
    assert r.n_pairs == 400 * 399 // 2 and len(plain(unit(400, groups=20), 0.85)) <= r.n_scored < r.n_pairs // 8


def test_top_pairs_with_ties(spark, small):
    m = unit(90)
    m[40:60] = m[40]
    want = sorted(((-s, i, j) for (i, j), s in plain(m, 0.0).items()))[:25]
    assert [(r.a, r.b) for r in S.top_pairs(corpus(spark, m), 25).collect()] == [(i, j) for _, i, j in want]
    assert S.top_pairs(corpus(spark, m[:1]), 5).count() == 0


def test_knn_over_many_blocks(spark, small):
    m = unit(150)
    m[30:80] = m[30]
    rows = corpus(spark, m)
    got = {(r.query_id, r.rank): r.id for r in S.knn(rows.filter("id % 10 = 0"), rows, 7, -1.0, exclude_self=True).collect()}
    s = np.round(m @ m.T, 6)
    for q in range(0, 150, 10):
        best = sorted((-s[q, i], i) for i in range(150) if i != q)[:7]
        assert [got[q, n + 1] for n in range(7)] == [i for _, i in best]


def test_centroids_by_task_sums(spark):
    m = unit(60)
    rows = spark.createDataFrame([(None if i % 7 == 0 else f"k{i % 3}", i % 2, [float(x) for x in v]) for i, v in enumerate(m)] + [("zero", 0, [0.0] * 24), ("k0", 0, None)], "k string, b int, v array<double>").repartition(5)
    got = {(r.k, r.b): (r.centroid, r.n) for r in S.centroid(rows, ["k", "b"], "v").collect()}
    keys = {(None if i % 7 == 0 else f"k{i % 3}", i % 2) for i in range(60)}
    assert set(got) == keys
    for k, b in keys:
        some = [m[i] for i in range(60) if (None if i % 7 == 0 else f"k{i % 3}") == k and i % 2 == b]
        mean = np.mean(some, axis=0)
        assert got[k, b][1] == len(some) and np.allclose(got[k, b][0], mean / np.linalg.norm(mean))


def test_empty_tables(spark):
    none = spark.createDataFrame([], "id long, v array<double>")
    one = corpus(spark, unit(3))
    assert S.all_pairs(none, 0.1).count() == 0 and S.knn(none, one).count() == 0 and S.knn(one, none).count() == 0
    assert S.centroid(none, ["id"], "v").count() == 0 and S.pairs_scored(none, 0.5).first().n_pairs == 0


@pytest.mark.parametrize("unknown", [False, True])
def test_pairs_are_counted_where_they_are_scored(spark, small, unknown):
    m = unit(120, groups=9)
    m[3] = m[8]
    m[50] *= 3  # its scores leave [-1, 1]
    label = [None if unknown and i % 11 == 0 else f"k{i % 4}" for i in range(120)]
    rows = spark.createDataFrame([(i, [float(x) for x in m[i]], label[i]) for i in range(120)], "id long, v array<double>, label string").repartition(3)
    s = np.round(m @ m.T, 6)
    want = [(s[i, j], None if label[i] is None or label[j] is None else label[i] == label[j]) for i in range(120) for j in range(i + 1, 120)]
    for r in S.confusion_of_all(rows, [-0.2, 0.1, 0.5]).collect():
        n = lambda said, dup, t=r.threshold: sum((x >= t) == said and d is dup for x, d in want)
        assert (r.tp, r.fp, r.fn, r.tn) == (n(True, True), n(True, False), n(False, True), n(False, False))
    got = {(r.bucket, r.is_dup): r.n for r in S.score_histogram_of_all(rows).collect()}
    assert got == Counter((round(np.floor(x / 0.05) * 0.05, 2), dup) for x, dup in want)
    dups, others = ([x for x, d in want if d is flag] for flag in (True, False))
    r = S.separation_of_all(rows).first()
    assert (r.min_dup, r.max_dup, r.min_other, r.max_other) == pytest.approx((min(dups), max(dups), min(others), max(others)), abs=1e-5)
    assert (r.avg_dup, r.avg_other) == pytest.approx((np.mean(dups), np.mean(others)), abs=1e-5) and r.n_overlap == sum(x >= min(dups) for x in others)
    assert S.separation_of_all(rows.filter("id = 1")).first().n_overlap == 0


@pytest.mark.parametrize("few", [True, False])
def test_blocks_meet_in_many_tasks(spark, monkeypatch, few):
    monkeypatch.setattr(S, "BLOCK_BYTES", 24 * 8 * 10)
    monkeypatch.setattr(S, "BROADCAST_BYTES", 16 << 20 if few else 0)
    monkeypatch.setattr(S, "LANE_BYTES", 24 * 8 * 50)
    rows = corpus(spark, unit(200))
    assert S.cells(rows, rows, half=True).rdd.getNumPartitions() == (3 if few else 16)
    assert S.pair_counts(rows.withColumn("label", F.lit(1)), thresholds=[0.5]).agg(F.sum("n")).first()[0] == 19900


def test_pairs_of_a_label_are_made_in_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(S, "LANE_ROWS", 10)
    rows = spark.createDataFrame([(i, str(i), None if i % 9 == 0 else 1) for i in range(90)], "id long, i string, label int")
    got = S.labelled_pairs(rows)
    ids = [i for i in range(90) if i % 9]
    assert sorted((r.id, r.jd) for r in got.collect()) == [(a, b) for a in ids for b in ids if a < b]
    assert len(set(got.select(F.spark_partition_id()).toPandas().iloc[:, 0])) > 4


def test_few_queries_travel_in_full_blocks(spark):
    rows = corpus(spark, unit(160)).repartition(8)
    assert S.cells(rows.filter("id % 2 = 0"), rows).select("q_ids").distinct().count() == 1


def test_single_precision_only_rules_out(spark):
    """Scores at edges of buckets, floors and ranks come out as in double precision; what it cannot hold is left to that."""
    m = np.zeros((64, 4))
    m[:, 0], m[:, 1] = 1.0, [0.05 * (i % 8) + (i // 8 - 4) * 6e-7 for i in range(64)]
    m[::8, 2] = [1e-9 * i for i in range(8)]
    q, one = np.array([[0.0, 1.0, 0.0, 0.0]]), np.ones((1, 64), bool)
    want = Counter(np.floor(np.round(q @ m.T, 6) / 0.05)[0].tolist())
    assert Counter({b: n for b, _, n in S._buckets(q, m, 0.05, one, None, None)}) == want
    single, _, scale, error = S._single(q, m)
    assert single.dtype == np.float32 and 0 < error < 1e-5 * scale
    for odd in (np.nan, np.inf, 1e30):
        m[3, 3] = odd
        assert S._single(q, m)[0].dtype == S._single(m, q)[0].dtype == np.float64 and S._buckets(q, m, 0.05, one, None, None) is None
    r = np.random.default_rng(7).normal(size=(300, 8)) * 1e3
    got = {(x.a, x.b) for x in S.all_pairs(corpus(spark, r), 5e6).collect()}
    assert got == set(plain(r, 5e6)) and got
    hit = np.random.default_rng(8).random((6, 40)) > 0.9
    assert all(np.array_equal(a, b) for h in (hit, hit[:, :37].copy()) for a, b in zip(S._found(h), np.nonzero(h), strict=True))


def test_rows_that_repeat_ids_meet_in_both_orders(spark):
    """Two blocks of the same ids and other vectors meet once, with all pairs of different ids."""
    m = unit(24)
    side = lambda n: corpus(spark, m[12 * n : 12 * n + 12]).select("*", F.lit(n).alias("side"), (F.col("id") % 2).alias("label"))
    rows = side(0).unionByName(side(1)).repartitionByRange(2, "side")
    assert [list(b.ids) for b in S.blocks(rows).collect()] == [[*range(12)]] * 2
    ids, s = [i % 12 for i in range(24)], np.round(m @ m.T, 6)
    pairs = [(i, j) for i in range(24) for j in range(24) if ids[i] < ids[j]]
    want = Counter((round(np.floor(s[i, j] / 0.05) * 0.05, 2), ids[i] % 2 == ids[j] % 2) for i, j in pairs)
    assert {(r.bucket, r.is_dup): r.n for r in S.score_histogram_of_all(rows).collect()} == want
    assert S.all_pairs(rows, -1.0).count() == len(pairs)


def test_numbers_that_are_whole_in_four_bytes_travel_so(spark, small):
    m = unit(90).astype(np.float32).astype(float)
    rows = corpus(spark, m).withColumn("label", F.col("id") % 3)
    assert all(len(b.m) == 4 * len(b.ids) * b.dim for b in S.blocks(rows).collect())
    mixed = rows.unionByName(corpus(spark, unit(40, seed=5), range(100, 140)).withColumn("label", F.col("id") % 3))
    assert {len(b.m) // (len(b.ids) * b.dim) for b in S.blocks(mixed).collect()} == {4, 8}
    for some, v in ((rows, m), (mixed, np.concatenate([m, unit(40, seed=5)]))):
        s, ids = np.round(v @ v.T, 6), [*range(90), *range(100, 140)]
        want = Counter((round(np.floor(s[i, j] / 0.05) * 0.05, 2), ids[i] % 3 == ids[j] % 3) for i in range(len(v)) for j in range(i + 1, len(v)))
        assert {(r.bucket, r.is_dup): r.n for r in S.score_histogram_of_all(some).collect()} == want
        assert {(r.a, r.b) for r in S.all_pairs(some, 0.3).collect()} == {(ids[i], ids[j]) for i, j in plain(v, 0.3)}


def test_products_stay_in_their_task_s_thread():
    """BLAS gives large products to threads of all cores, which wait for each other where many tasks run."""
    code = """
import time, numpy as np
from tessella.operators import similarity as S
m = np.random.default_rng(3).normal(size=(1500, 64)) / 8
same = np.ones((1500, 1500), bool)
S._buckets(m, m, 0.05, same, None, None)
a, b = time.process_time(), time.thread_time()
for _ in range(5):
    S._buckets(m, m, 0.05, same, None, None)
print((time.process_time() - a) / (time.thread_time() - b))
"""
    out = subprocess.run([sys.executable, "-c", code], env=os.environ | {"OMP_NUM_THREADS": "4", "PYTHONPATH": str(Path(__file__).parents[1])}, capture_output=True, text=True, check=True)
    assert float(out.stdout) < 1.2
    r = np.random.default_rng(6)
    for rows, n, dim in ((3, 5, 0), (70, 130, 1), (130, 333, 24), (64, 128, 64), (65, 129, 300), (9, 20, 5000)):
        q, m = r.normal(size=(rows, dim)), r.normal(size=(n, dim))
        assert np.allclose(S.product(q, m, np.empty((rows + 2, n))), q @ m.T)

"""Entropy balancing against a dual solved by plain bisection, and against the best of all copies on small sources."""

import itertools
import math
from collections import defaultdict

import pytest

from tessella.llm import mixing
from tessella.llm.mixing import mix_sources


def brute_rates(sizes, target, cap=3.0):
    """Rates exp(x * size) cut at cap whose tokens meet the target."""
    if target >= cap * sum(sizes) * (1 - 1e-12):
        return [cap] * len(sizes)
    rate = lambda x, s: min(cap, math.exp(min(x * s, math.log(cap))))
    low, high = -80.0, 2.0
    for _ in range(200):
        x = (low + high) / 2
        if sum(s * rate(x, s) for s in sizes) < target:
            low = x
        else:
            high = x
    return [rate(low, s) for s in sizes]


@pytest.mark.parametrize("few", [0, 500])
def test_rates_are_those_of_the_dual(spark, monkeypatch, few):
    monkeypatch.setattr(mixing, "FEW_SOURCES", few)
    sizes = {"a": [1, 5, 30, 400], "b": [10] * 6, "c": [3, 3, 50, 900, 2], None: [7, 8]}
    rows = [(i, " ".join(["w"] * n), s) for i, (s, n) in enumerate((s, n) for s, every in sizes.items() for n in every)]
    got = mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    by = defaultdict(list)
    for r in sorted(got, key=lambda r: r.doc_id):
        by[r.source].append(r)
    assert any(len({r.rate for r in rs}) > 1 for rs in by.values())
    for s, rs in by.items():
        want = brute_rates([r.size for r in rs], rs[0].target)
        assert [r.size for r in rs] == sizes[s]
        assert [r.rate for r in rs] == pytest.approx(want, abs=1e-6), s


def test_few_documents_come_near_the_best_that_whole_copies_allow(spark):
    """Six documents a source: all 4 ** 6 choices of copies are tried."""
    rows, n = [], 0
    for s in range(12):
        for j in range(6):
            rows.append((n, " ".join(["w"] * (1 + (s * 37 + j * j * 53 + 11 * j) % (40 * (j + 1)))), f"s{s:02d}"))
            n += 1
    by = defaultdict(list)
    for r in mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect():
        by[r.source].append(r)
    for s, rs in by.items():
        target = rs[0].target
        best = min(abs(sum(c * r.size for c, r in zip(cs, rs)) - target) for cs in itertools.product(range(4), repeat=6))
        assert abs(sum(r.taken for r in rs) - target) <= best + 0.02 * target, s


@pytest.mark.parametrize("rows", [[], [(1, None, None)], [(None, "a b", "x"), (None, "a b", "x"), (2, "", "y")]])
def test_empty_and_null_rows(spark, rows):
    got = mix_sources(spark.createDataFrame([(*r, "extra") for r in rows], "doc_id long, text string, source string, rate string")).collect()
    assert len(got) == len(rows) and all(r.taken == r.copies * r.size <= 3 * r.size for r in got)

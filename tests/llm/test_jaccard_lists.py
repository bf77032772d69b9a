"""Overlong lists of 2-subsets."""

from __future__ import annotations

import random

from tessella.llm import jaccard
from tests.llm.test_operators import brute_components, order, prose


def test_overlong_subset_lists_end(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "LONGEST_LIST", 8)
    monkeypatch.setattr(jaccard, "HEAVY_FROM", 10**6)
    rounds, real = [], jaccard._postings

    def counted(*args):
        rounds.append(1)
        assert len(rounds) < 12, "the same lists come back"
        return real(*args)

    monkeypatch.setattr(jaccard, "_postings", counted)
    rng = random.Random(4)
    phrase = prose(rng, 8, 10**6)
    rows = [(i, f"{phrase} {prose(rng, 4, 10**6)}", "s") for i in range(60)]
    rows += [(100 + i, rows[i][1] + " more", "s") for i in range(0, 60, 3)]
    got = jaccard.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert order((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == order(brute_components(rows))

"""Repeated passages against a plain search, without slack, and where documents share pieces with several others."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest

from tessella.llm.repeats import LEAST, find_repeats
from tests.llm.test_operators import prose, words


def plain(rows):
    """(id, text) to the number of words in passages of LEAST words that stand in another document; equal rows are one."""
    where = defaultdict(set)
    for d, t in set(rows):
        w = words(t)
        for i in range(len(w) - LEAST + 1):
            where[tuple(w[i : i + LEAST])].add((d, t))
    out = []
    for d, t in rows:
        w, hit = words(t), set()
        for i in range(len(w) - LEAST + 1):
            if len(where[tuple(w[i : i + LEAST])]) > 1:
                hit |= set(range(i, i + LEAST))
        out.append((d, len(w), len(hit)))
    return sorted(out, key=str)


def check(spark, rows):
    got = find_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_repeat_words) for r in got), key=str) == plain(rows)
    texts = defaultdict(list)
    for d, t in rows:
        texts[d].append(" ".join(words(t)))
    for r in got:  # each span stands in one piece in a partner (a document without an id is not named)
        mine = [t for t in texts[r.doc_id]]
        for s in r.spans:
            parts = [" ".join(t.split()[s.start : s.stop]) for t in mine]
            others = [t for p in r.partners for t in texts[p]] + texts[None] + ([t for t in mine] if len(mine) > 1 else [])
            assert s.stop - s.start >= LEAST and any(f" {p} " in f" {t} " for p in parts for t in others)
    return got


def test_pieces_of_two_documents_are_no_passage(spark):
    """Two pieces of 45 words that stand in different documents: no 50 words are shared."""
    rng, rows = random.Random(3), []
    for i in range(60):
        a, b = prose(rng, 45, 10**6), prose(rng, 45, 10**6)
        rows += [(3 * i, f"{a} {b}"), (3 * i + 1, f"{prose(rng, 20, 10**6)} {a} {prose(rng, 20, 10**6)}"), (3 * i + 2, f"{prose(rng, 20, 10**6)} {b} {prose(rng, 20, 10**6)}")]
    assert not any(r.n_repeat_words for r in check(spark, rows))


@pytest.mark.parametrize("common", [30, 44, 49])
def test_passages_that_begin_with_common_words_are_found(spark, common):
    rng = random.Random(common)
    boiler, rows = prose(rng, common, 10**6), []
    for i in range(60):
        own = f"{boiler} {prose(rng, 60 - common, 10**6)}"
        rows += [(2 * i, f"{prose(rng, 30, 10**6)} {own} {prose(rng, 9, 10**6)}"), (2 * i + 1, f"{prose(rng, 7, 10**6)} {own} {prose(rng, 30, 10**6)}")]
    rows += [(1000 + i, f"{prose(rng, 10, 10**6)} {boiler} {prose(rng, 40, 10**6)}") for i in range(40)]
    assert sum(r.n_repeat_words >= 60 for r in check(spark, rows)) == 120


def test_null_ids_repeated_rows_and_long_texts(spark):
    rng = random.Random(8)
    shared = [prose(rng, n, 10**6) for n in (49, 50, 51, 64, 200)]
    rows = [(None, None), (1, ""), (2, " "), (3, shared[1]), (3, shared[1]), (4, shared[2].upper()), (5, f"x {shared[2]} y"), (None, shared[3]), (None, f"{shared[3]} z"), (6, shared[0]), (7, f"{shared[0]} q")]
    rows += [(8, shared[4]), (8, f"{shared[4]} more"), (9, " ".join([shared[4]] * 40)), (10, "same " * 3000), (11, "same " * 120), (12, prose(rng, 20_000, 10**6))]
    check(spark, rows)

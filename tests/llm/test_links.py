"""Numbers of links and components, with families cut into many small blocks, and components both ways."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest

from tessella.llm import graph, jaccard
from tests.llm.test_operators import edited, order, prose, words


def plain_links(rows):
    """(id, class's smallest id, links of the class) by comparing all pairs of sets."""
    sets = {}
    for d, t in rows:
        w = words(t)
        sets.setdefault(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []), []).append(d)
    n = Counter()
    every = [s for s in sets if s]
    for i, a in enumerate(every):
        for b in every[:i]:
            if 4 * len(a & b) >= 3 * len(a | b):
                n[a] += 1
                n[b] += 1
    return order((d, min(ids) if s else None, n[s]) for s, ids in sets.items() for d in ids)


@pytest.mark.parametrize("block, heavy", [(4, 3), (7, 8), (256, 16)])
def test_links_are_counted_once(spark, monkeypatch, block, heavy):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "HEAVY_FROM", heavy)
    rng = random.Random(9)
    rows = [(0, ""), (1, None), (2, " ")]
    for family in range(3):
        base = prose(rng, 60 + 80 * family, 10**5)
        rows += [(100 * (family + 1) + i, edited(rng, base, rng.choice([0.0, 0.01, 0.03, 0.05]))) for i in range(40)]
    rows += [(1000 + i, prose(rng, rng.randrange(1, 40), 40)) for i in range(60)]
    got = jaccard.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()
    assert order((r.doc_id, r.class_doc, r.n_links) for r in got) == plain_links(rows)


@pytest.mark.parametrize("most", [0, 10**6])
def test_components_both_ways(spark, monkeypatch, most):
    monkeypatch.setattr(graph, "BROADCAST_ROWS", most)
    rng = random.Random(5)
    edges = [(rng.randrange(-300, 300), rng.randrange(-300, 300)) for _ in range(250)] + [(i, i + 1) for i in range(1000, 1040)] + [(7, 7), (None, 3)]
    up = defaultdict(set)
    for a, b in edges:
        if a is not None and a != b:
            up[a].add(b)
            up[b].add(a)
    want, seen = {}, set()
    for x in sorted(up):
        todo = [x] if x not in seen else []
        while todo:
            y = todo.pop()
            if y not in want:
                want[y] = x
                seen.add(y)
                todo += up[y]
    got = graph.components(spark.createDataFrame(edges, "p long, q long"), "p", "q").collect()
    assert {r.node: r.root for r in got} == want and len(got) == len(want)

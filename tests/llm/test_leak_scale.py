"""Decontamination by shuffles gives what the broadcast index gives; repetitive texts take linear work."""

from __future__ import annotations

import random
import time
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from tessella.llm import kernel as K
from tessella.llm.decontaminate import Index, drop_leaks, find_leaks
from tests.llm.test_operators import leak_words, order, prose


def tables(spark):
    rng = random.Random(41)
    bench = [(i, prose(rng, n, 300)) for i, n in enumerate([30, 12, 10, 9, 4, 1, 60, 25] * 3)] + [(None, "same ROW, twice"), (70, None), (71, ""), (72, "tick " * 40)]
    docs = [(None, None), (1, ""), (2, "-- !"), (3, "tick " * 300), (4, "TICK tick tick tick tick tick tick tick tick"), (5, bench[0][1]), (5, bench[0][1]), (None, "a same row TWICE b")]
    for i in range(10, 120):
        w = prose(rng, rng.randrange(1, 90), 300).split()
        b = bench[i % 24][1].split()
        a = rng.randrange(len(b))
        docs.append((i, " ".join(w[: len(w) // 2] + b[a : a + rng.randrange(4, 40)] + w[len(w) // 2 :])))
    return docs, bench, spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, items string"), spark.createDataFrame(bench, "item_id long, text string")


def plain(docs, bench):
    out = []
    for d, t in docs:
        w, hit, items = leak_words(t), set(), set()
        for i, x in bench:
            b = leak_words(x)
            k = min(10, len(b))
            windows = {tuple(b[j : j + k]) for j in range(len(b) - k + 1)} if b else set()
            for p in range(len(w) - k + 1) if windows else ():
                if tuple(w[p : p + k]) in windows:
                    hit |= set(range(p, p + k))
                    items.add("null" if i is None else str(i))
        out.append((d, len(w), len(hit), ",".join(sorted(items))))
    return order(out)


@pytest.mark.parametrize("most", [0, 1 << 20])
def test_both_ways_match_a_plain_search(spark, most):
    docs, bench, table, items = tables(spark)
    got = order((r.doc_id, r.n_words, sum(s.end - s.start for s in r.spans), ",".join(r["items"])) for r in find_leaks(table, items, most=most).collect())
    assert got == plain(docs, bench)
    assert find_leaks(table.limit(0), items, most=most).count() == 0


def test_whole_rows_are_carried_by_shuffles(spark):
    from pyspark.sql import functions as F

    docs, bench, table, items = tables(spark)
    rows = table.select(F.struct("*").alias("row"), "text")
    one, two = (order((str(r.doc_id), str(r.spans), str(r["items"])) for r in find_leaks(rows, items, id_col="row", most=m).collect()) for m in (0, 1 << 20))
    assert one == two


def test_equal_words_take_linear_time_and_memory():
    index = Index(["a", "b"], ["tick " * 3000, "tick tock " * 2000])
    data, offs = K.buffers(pa.array(["tick " * 20_000 + "tock tick " * 20_000]))
    tracemalloc.start()
    began = time.perf_counter()
    found = index.hits(K.Words(data, offs, K.NON_ALNUM))
    took, peak = time.perf_counter() - began, tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found[0][1] == {0, 1} and np.sum([e - s for s, e in found[0][0]]) >= 59_990
    assert took < 2 and peak < 100 << 20


@pytest.mark.parametrize("most", [0, 1 << 20])
def test_rows_without_leaks_stay_whole(spark, most):
    docs, bench, table, items = tables(spark)
    hits = {t: plain([(0, t)], bench)[0][2] for _, t in docs}
    want = order((d, t, "x") for d, t in docs if not hits[t])
    assert order(tuple(r) for r in drop_leaks(table, items, most=most).collect()) == want
    assert drop_leaks(table.limit(0), items, most=most).count() == 0

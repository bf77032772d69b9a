"""Sharding against hashing alone, and the quality score against a plain count of words and pairs."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from tessella.llm import kernel as K
from tessella.llm import quality as Q
from tessella.llm.quality import quality_rules
from tessella.llm.sharding import shard_documents
from tests.llm.test_operators import prose, words


def cut(groups):
    """Pairs of equal texts in different shards."""
    n = 0
    for shards in groups.values():
        by = Counter(shards)
        n += (len(shards) ** 2 - sum(x * x for x in by.values())) // 2
    return n


def test_far_fewer_links_are_cut_than_by_hash_and_no_more_than_sizes_force(spark):
    rng = random.Random(4)
    texts = [f"hot {0}"] * 400 + [f"mid {i % 9}" for i in range(270)] + [f"pair {i // 2}" for i in range(300)] + [f"alone {i}" for i in range(230)]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    got = shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), 20).collect()
    where, hashed = defaultdict(list), defaultdict(list)
    for r in got:
        where[texts[r.doc_id]].append(r.shard)
        hashed[texts[r.doc_id]].append(r.doc_id * 7919 % 20)
    size = len(rows) // 20
    least = cut({"hot": [i // size for i in range(400)]})  # a group of more than a shard must be cut
    assert cut(where) <= 1.1 * least + 0.1 * cut(hashed)
    assert sum(len(set(s)) > 1 for t, s in where.items() if t.startswith("pair")) <= 0.1 * 150
    again = shard_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), 20).collect()
    assert {r.doc_id: (r.shard, r.slot) for r in got} == {r.doc_id: (r.shard, r.slot) for r in again}


def buckets(word_list):
    """Buckets of words and pairs, one text at a time."""
    text = " ".join(word_list)
    w = K.Words(*K.buffers(pa.array([text])), K.BLANKS)
    one, two = Q._buckets(w)
    return [*one.tolist(), *two.tolist()]


def test_scores_match_a_plain_count(spark):
    rng = random.Random(6)
    docs = [(i, prose(rng, rng.randrange(0, 120), 300)) for i in range(60)] + [(100, None), (101, ""), (102, "a"), (None, "b c"), (5, "other text of five")]
    trusted = [(i,) for i in range(0, 60, 3)] + [(None,)]
    raw, good = Counter(), Counter()
    for d, t in docs:
        b = Counter(buckets(words(t)))
        raw += b
        if d is not None and d < 60 and d % 3 == 0:
            good += b
    n = 1 << Q.BITS
    base = lambda x: (raw[x] + 1) / (sum(raw.values()) + n)
    total = sum(good.values()) + Q.SMOOTH * n * sum(base(x) for x in raw) + Q.SMOOTH * n * (n - len(raw)) / (sum(raw.values()) + n)
    ratio = {x: math.log((good[x] + base(x) * Q.SMOOTH * n) / total) - math.log(base(x)) for x in raw}
    want = sorted(((d, round(float(np.mean([ratio[x] for x in buckets(words(t))])) if words(t) else 0.0, 6)) for d, t in docs), key=str)
    for parts in (1, 7):
        got = quality_rules(spark.createDataFrame(docs, "doc_id long, text string").repartition(parts), spark.createDataFrame(trusted, "doc_id long")).collect()
        assert sorted(((r.doc_id, round(r.score, 6)) for r in got), key=str) == want
        assert all(r.kept == (not r.base_failed and r.score >= Q.THRESHOLD) for r in got)

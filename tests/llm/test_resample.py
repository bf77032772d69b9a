"""Importance resampling against counts of words in memory."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from tessella.llm import resample as R
from tessella.llm.resample import resample

SCHEMA = "doc_id long, text string, piece string, rank string, gram string, bucket string"
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def features(text, most):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return words, [" ".join(words[i : i + n]) for n in range(1, most + 1) for i in range(len(words) - n + 1)]


def brute(docs, target, most=1, buckets=10_000, least=20, percent=10):
    of = lambda x: zlib.crc32(x.encode()) % buckets
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(map(of, features(text, most)[1]))
    for text in target:
        t.update(map(of, features(text, most)[1]))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets))))
    out = []
    for doc_id, text in docs:
        words, f = features(text, most)
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(of(x)) for x in f)
        out.append([doc_id, len(words), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None])
    enough = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for n, r in enumerate(enough[: len(enough) * percent // 100]):
        r[5] = n + 1
    return sorted(map(tuple, out), key=str)


def drawn(spark, docs, target, **more):
    d = spark.createDataFrame([(*r, "a", "b", "c", "d") for r in docs], SCHEMA).repartition(3)
    t = spark.createDataFrame([(i, x) for i, x in enumerate(target)], "item_id long, text string")
    rows = resample(d, t, **more).select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect()
    return sorted((tuple(r) for r in rows), key=str)


def some(seed=5, n=300):
    r = random.Random(seed)
    word = lambda: r.choice(["The", "of", "É", "x9", "naïve", "日本", "ab"]) if r.random() < 0.5 else f"w{r.randrange(500)}"
    text = lambda k: "".join(word() + r.choice([" ", ", ", "\n", "--", "\x7f"]) for _ in range(k))
    docs = [(i, text(r.randrange(0, 80))) for i in range(n)]
    docs += [(None, "one two"), (n, None), (n + 1, ""), (n + 2, " \t.\n"), (n + 3, text(20_000)), (n + 4, "w" * 100_000), docs[3], docs[3], (None, docs[5][1])]
    return docs, [text(30) for _ in range(20)] + [None, ""]


@pytest.mark.parametrize("most", [1, 3])
def test_same_as_counts_in_memory(spark, most):
    docs, target = some()
    assert drawn(spark, docs, target, most=most) == brute(docs, target, most)


def test_small_pieces_and_few_buckets(spark, monkeypatch):
    monkeypatch.setattr(R, "PIECE_BYTES", 300)
    monkeypatch.setattr(R, "FEW", 0)
    docs, target = some(6, 120)
    assert drawn(spark, docs, target, most=2, buckets=97, percent=50) == brute(docs, target, 2, 97, percent=50)


def test_empty_tables(spark):
    docs, target = some(7, 40)
    assert drawn(spark, [], target) == []
    assert drawn(spark, docs, []) == brute(docs, [])
    assert drawn(spark, [(1, None), (2, "")], []) == brute([(1, None), (2, "")], [])


def test_string_ids_and_equal_scores(spark):
    d = spark.createDataFrame([(f"d{i % 4}", "a b c " * 10) for i in range(40)], "name string, body string")
    t = spark.createDataFrame([("a b",)], "text string")
    got = resample(d, t, id_col="name", text_col="body", percent=50).collect()
    ranks = sorted(r.rank for r in got if r.rank is not None)
    assert len(got) == 40 and ranks == list(range(1, 21))
    top = max(r.score for r in got)
    assert {r.doc_id for r in got if r.rank and r.rank <= 10} == {r.doc_id for r in got if r.score == top}

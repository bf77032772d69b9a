"""Decisions joined back to whole rows, with repeats, nulls and columns of any name."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessella.llm import attach as A


@pytest.mark.parametrize("few", [1_000_000, 0])
def test_each_decision_goes_to_one_row(spark, monkeypatch, few):
    monkeypatch.setattr(A, "BROADCAST_ROWS", few)
    rows = [(i, f"text {i % 50}", "x", "y") for i in range(100)] + [(7, "text 7", "p", "q")] * 40 + [(None, "text", "", "")] * 3 + [(8, None, "", ""), (None, None, "", ""), (8, None, "", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, hash string, nth string").repartition(5)
    decided = docs.select("doc_id", F.xxhash64("text").alias("text_hash")).withColumn("slot", F.monotonically_increasing_id() % 1000)
    decided = spark.createDataFrame([tuple(r) for r in decided.withColumn("same", F.col("doc_id") % 3).collect()], "doc_id long, text_hash long, slot long, same long")
    for columns in (["slot", "same"], ["same"]):
        got = A.attach(docs, decided, "doc_id", "text_hash", columns).collect()
        assert Counter((r.row.doc_id, r.row.text, r.row.hash, r.row.nth) for r in got) == Counter(rows)
        assert Counter(tuple(r[c] for c in columns) for r in got) == Counter(tuple(r[c] for c in columns) for r in decided.collect())
        assert all(r.same == (None if r.row.doc_id is None else r.row.doc_id % 3) for r in got)


def test_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    decided = spark.createDataFrame([], "doc_id long, text_hash long, copies long")
    assert A.attach(docs, decided, "doc_id", "text_hash", ["copies"]).count() == 0

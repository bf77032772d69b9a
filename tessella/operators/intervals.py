"""Unions of closed intervals of whole numbers by a sweep: starts in order, and the furthest end so far."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_LEAST = -(2**62)


def union_length(spans: Column) -> Column:
    """How many numbers an array<struct<start, end>> covers; an interval that ends before it starts is its start alone."""
    long = lambda x: x.cast("long")
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(long(s["start"]).alias("a"), F.greatest(long(s["start"]), long(s["end"])).alias("b"))))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(_LEAST).cast("long").alias("reach"))
    step = lambda acc, s: F.struct((acc["n"] + F.greatest(F.lit(0).cast("long"), s["b"] - F.greatest(s["a"] - 1, acc["reach"]))).alias("n"), F.greatest(acc["reach"], s["b"]).alias("reach"))
    return F.aggregate(ordered, zero, step, lambda acc: acc["n"])


def union_lengths(rows: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """(keys..., n_intervals, length, n_runs): numbers covered by the intervals of each key, and their unbroken runs.

    One sort of the intervals of a key, whatever their length; rows with a null bound take no part.
    """
    some = rows.filter(F.col(start).isNotNull() & F.col(end).isNotNull()).select(*keys, F.col(start).cast("long").alias("_a"), F.greatest(F.col(start), F.col(end)).cast("long").alias("_b"))
    # Equal starts in any order give the same sums: what an end adds beyond the furthest one so far.
    before = Window.partitionBy(*keys).orderBy("_a", "_b").rowsBetween(Window.unboundedPreceding, -1)
    swept = some.withColumn("_reach", F.coalesce(F.max("_b").over(before), F.lit(_LEAST)))
    new = F.greatest(F.lit(0).cast("long"), F.col("_b") - F.greatest(F.col("_a") - 1, F.col("_reach")))
    return swept.groupBy(*keys).agg(F.count("*").alias("n_intervals"), F.sum(new).alias("length"), F.count_if(F.col("_a") > F.col("_reach") + 1).alias("n_runs"))

"""Snapshots: diffs, upserts, retention and caches kept up to date by content hash.

A snapshot is a table keyed by one column; there is no table format underneath, so an update writes a new version next
to the old one and then moves a pointer (see `sources.snapshots`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

c = F.col


def diff(now: DataFrame, before: DataFrame, key: str, hash_col: str) -> DataFrame:
    """(key, state): new, modified, cached or deleted."""
    a = now.select(key, c(hash_col).alias("a"), F.lit(True).alias("in_a"))
    b = before.select(key, c(hash_col).alias("b"), F.lit(True).alias("in_b"))
    state = F.when(c("in_b").isNull(), "new").when(c("in_a").isNull(), "deleted").when(c("a").eqNullSafe(c("b")), "cached").otherwise("modified")
    return a.join(b, key, "full_outer").select(key, state.alias("state"))


def upsert(base: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """base with the rows of changes in place of those with equal keys."""
    return base.join(changes.select(*keys), keys, "left_anti").unionByName(changes, allowMissingColumns=True)


def latest(rows: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The last row per key by an order; an aggregate, so only one row per key and task is shuffled."""
    whole = F.max_by(F.struct(*rows.columns), order)
    return rows.groupBy(*[c(k).alias(f"__{k}") for k in keys]).agg(whole.alias("r")).select("r.*")


def delete_where(base: DataFrame, condition: Column) -> DataFrame:
    """Rows that do not meet a condition; rows where it is null stay."""
    return base.filter(~F.coalesce(condition, F.lit(False)))


def orphans(base: DataFrame, valid: DataFrame, key: str) -> DataFrame:
    """Rows of base whose key is no longer valid."""
    return base.join(valid.select(key), key, "left_anti")


def keep_valid(cache: DataFrame, valid: DataFrame, key: str) -> DataFrame:
    return cache.join(valid.select(key), key, "left_semi")


def stale_sections(cached: DataFrame, kept: DataFrame) -> DataFrame:
    """(section_id): sections of cached documents (file, section_ids) that are not kept."""
    return cached.join(kept.select("file"), "file", "left_anti").select(F.explode("section_ids").alias("section_id"))


def needs_reindex(now: DataFrame, cache: DataFrame, key: str, hash_col: str) -> DataFrame:
    """Rows of now that the cache does not hold with the same hash."""
    old = cache.select(c(key).alias("__k"), c(hash_col).alias("__h"))
    return now.join(old, (c(key) == c("__k")) & (c(hash_col).eqNullSafe(c("__h"))), "left_anti")


def cache_aside(rows: DataFrame, cache: DataFrame, key: str, hash_col: str) -> tuple[DataFrame, DataFrame]:
    """(hits with the cached value, misses) by key and hash: only misses go on to the costly step."""
    old = cache.select(c(key).alias("__k"), c(hash_col).alias("__h"), "value")
    both = rows.join(old, (c(key) == c("__k")) & (c(hash_col) == c("__h")), "left").drop("__k", "__h")
    return both.filter("value is not null"), both.filter("value is null").drop("value")


def merge_newest(caches: list[tuple[DataFrame, int]], key: str) -> DataFrame:
    """Several caches into one; of equal keys the entry of the newest (largest time) stays."""
    every = None
    for df, time in caches:
        df = df.withColumn("mtime", F.lit(time))
        every = df if every is None else every.unionByName(df)
    return latest(every, [key], c("mtime")).drop("mtime")


def trees_equal(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row (equal): whether two trees (path, size, hash) are the same."""
    one, two = a.select("path", "size", "hash"), b.select("path", "size", "hash")
    return one.exceptAll(two).unionAll(two.exceptAll(one)).agg((F.count("*") == 0).alias("equal"))


def alias_source(rows: DataFrame, source: str, target: str, new_id: Column, new_path: Column) -> DataFrame:
    """Rows with those of one source copied to another in place of what it held."""
    copies = rows.filter(c("source") == source).withColumns({"id": new_id, "path": new_path, "source": F.lit(target)})
    return rows.filter(c("source") != target).unionByName(copies)


def reclassify(memory: DataFrame, news: DataFrame) -> DataFrame:
    """Registry (symbol, dependency, axis, from, to, at): per axis the last entry; a null dependency is a key of its own."""
    return latest(memory.unionByName(news), ["symbol", "dependency", "axis"], c("at"))


def migrate_registry(old: DataFrame) -> DataFrame:
    """Flat entries (symbol, dependency, axis, from, to, at) to one row per (symbol, dependency) with the first of each axis."""
    first = old.groupBy("symbol", "dependency", "axis").agg(F.min_by(F.struct("from", "to"), "at").alias("t"), F.min("at").alias("at"))
    return first.groupBy("symbol", "dependency").agg(F.array_sort(F.collect_list(F.struct("axis", "t.from", "t.to"))).alias("reclassifications"), F.min("at").alias("recorded_at"))


def retain(runs: DataFrame, keep: int) -> DataFrame:
    """runs (run_id) with `kept`: the newest ids stay. Runs are a small table: one task ranks them."""
    return runs.withColumn("kept", F.row_number().over(Window.orderBy(F.desc("run_id"))) <= keep)


def repair(runs: DataFrame) -> DataFrame:
    """Runs marked running whose process is gone are crashed."""
    return runs.withColumn("status", F.when((c("status") == "running") & ~c("alive"), "crashed").otherwise(c("status")))


def resolve_latest(runs: DataFrame, pointer: str | None) -> DataFrame:
    """One row (run_id): the pointer if that run is there, else the largest id but 'latest'."""
    some = runs.filter("run_id <> 'latest'")
    named = F.max(F.when(c("run_id") == F.lit(pointer), c("run_id")))
    return some.agg(F.coalesce(named, F.max("run_id")).alias("run_id"))

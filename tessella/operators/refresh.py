"""The index brought up to date in one operation: what is gone is dropped, what changed is embedded again and upserted.

Everything is decided by content hashes against a cache. What is written are the rows that change and the keys that go,
as versions of two tables; the cache follows the index, so that a run that stops between the two embeds some rows again
and loses none.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import docs as D
from tessella.operators import incremental as I
from tessella.operators import index as X
from tessella.sources.versions import Lease, Table

c = F.col


class Refreshed(NamedTuple):
    """The index and the cache as they are to be, what was embedded, and (puts, drops) that lead there."""

    index: DataFrame
    cache: DataFrame
    changed: DataFrame
    key: str
    index_change: tuple[DataFrame, DataFrame | None]
    cache_change: tuple[DataFrame, DataFrame | None]


def project(index: DataFrame | None, cache: DataFrame | None, symbols: DataFrame, sources: DataFrame, embed: Callable[[DataFrame], DataFrame], dims: tuple[int, int]) -> Refreshed:
    """Cards of all functions of sources (file, content), embedded where their body changed.

    embed adds vector, nlp_vector, doc_vector and summaries to cards; null vectors become zero vectors. Cards of files or
    lines that are gone leave the index and the cache (id, body_hash); sections are not touched. Without an index or a
    cache everything is embedded.
    """
    now = X.cards(symbols, sources)
    changed = now if index is None or cache is None else I.needs_reindex(now, cache, "id", "body_hash")
    rows = X.rows_of_cards(embed(changed), dims)
    entries = changed.select("id", "body_hash")
    if index is None:
        return Refreshed(rows, entries, changed, "id", (rows, None), (entries, None))
    ids = now.select("id").withColumn("type", F.lit("function"))
    kept = index.filter("type <> 'function'").unionByName(index.filter("type = 'function'").join(ids, ["id", "type"], "left_semi").select(index.columns))
    old = entries.limit(0) if cache is None else I.keep_valid(cache, now, "id")
    gone = I.orphans(index.filter("type = 'function'").select("id"), now, "id")
    stale = None if cache is None else I.orphans(cache, now, "id")
    return Refreshed(X.upsert(kept, rows), I.upsert(old, entries, ["id"]), changed, "id", (rows.filter(X.valid_id(c("id"))), gone), (entries, stale))


def sections(index: DataFrame, cache: DataFrame | None, docs: DataFrame, source: str, embed: Callable[[DataFrame], DataFrame], dims: tuple[int, int], smart: bool = True) -> Refreshed:
    """Sections of docs (file, content) of one source, chunked and embedded where a document's text changed.

    The cache (file, hash, section_ids) names the sections of each document: those of changed or missing documents leave
    the index before the new ones come. embed adds nlp_vector to (id, file, heading, embed_text).
    """
    now = docs.withColumn("hash", F.sha2("content", 256))
    changed = now if cache is None else I.needs_reindex(now, cache, "file", "hash")
    parts = D.chunk(changed, smart)
    rows = X.rows_of_sections(embed(parts.select("id", "file", "heading", "embed_text")), dims, source)
    ids = parts.groupBy("file").agg(F.array_sort(F.collect_list("id")).alias("section_ids"))
    entries = changed.select("file", "hash").join(ids, "file", "left").withColumn("section_ids", F.coalesce("section_ids", F.array().cast("array<string>")))
    if cache is None:
        touched = rows.select("file").distinct()
        gone = index.filter("type = 'doc_section'").join(touched, "file", "left_semi").select("id")
        return Refreshed(X.upsert_sections(index, rows), entries, changed, "file", (rows, gone), (entries, None))
    kept = now.join(changed.select("file"), "file", "left_anti")
    gone = I.stale_sections(cache, kept).select(c("section_id").alias("id"))
    after = X.delete_sections(index, gone).unionByName(rows, allowMissingColumns=True)
    entries_after = I.upsert(I.keep_valid(cache, kept, "file"), entries, ["file"])
    return Refreshed(after, entries_after, changed, "file", (rows, gone), (entries, I.orphans(cache, now, "file")))


def chunked(docs: DataFrame, cache: DataFrame | None, smart: bool = True) -> tuple[DataFrame, DataFrame]:
    """(sections, cache (file, hash, value)): documents whose text is cached are not chunked again."""
    now = docs.withColumn("hash", F.sha2("content", 256))
    value = F.array_sort(F.collect_list(F.struct("ordinal", "heading", "embed_text", "content", "id"))).alias("value")
    hits, misses = (now.limit(0).withColumn("value", F.lit(None)), now) if cache is None else I.cache_aside(now, cache, "file", "hash")
    new = misses.select("file", "hash").join(D.chunk(misses, smart).groupBy("file").agg(value), "file")
    every = new.select("file", "hash", "value")
    if cache is not None:
        every = hits.select("file", "hash", "value").unionByName(every)
    return every.select("file", F.inline("value")), every


def commit(done: Refreshed, root: str, lease: Lease | None = None, share: float = 0.2) -> None:
    """Write the changes of the index, then those of the cache; tables whose changes exceed a share of them are compacted."""
    spark = done.index.sparkSession
    for name, key, change in (("index", "id", done.index_change), ("cache", done.key, done.cache_change)):
        table = Table(spark, f"{root}/{name}", key)
        table.write(*change, lease=lease)
        table.compact(share, lease)


def committed(spark: SparkSession, root: str, key: str = "id") -> tuple[DataFrame | None, DataFrame | None]:
    """(index, cache) as they were committed last; None for what is not there. key is that of the cache (id, or file for sections)."""
    return Table(spark, f"{root}/index", "id").read(), Table(spark, f"{root}/cache", key).read()

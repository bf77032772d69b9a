"""Queries op9 (mixing) and op8 (sharding)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import table
from tessella.llm.mixing import mix_sources
from tessella.llm.sharding import shard_documents


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"), shards=40).drop("text_hash")


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources and targets of op9, and whether each source's taken words come within a hundredth of its target."""
    mixed = op9_mixing(spark, sf_dir).groupBy("source").agg(F.first("source_size").alias("source_size"), F.first("target").alias("t"), F.sum("taken").alias("taken"), F.max("copies").alias("most"))
    near = (F.abs(F.col("taken") - F.col("t")) <= 0.01 * F.col("t")) & (F.col("most") <= 3)
    return mixed.select("source", "source_size", F.round("t", 4).alias("target"), near.alias("near"))


def shard_law(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, sizes and slots by shard of op8, as far as the law fixes them."""
    out = op8_sharding(spark, sf_dir).groupBy("shard").agg(F.count("*").alias("n"), F.count_distinct("slot").alias("slots"), F.min("slot").alias("first_slot"), F.max("slot").alias("last_slot"))
    return out.select(F.col("shard").cast("long").alias("shard"), "n", "slots", "first_slot", "last_slot")


def shard_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op8 says about each row alone."""
    return op8_sharding(spark, sf_dir).select("doc_id", "size", "law", F.col("shard").between(0, 39).alias("in_range"), "grown_shard")


QUERIES = {"op9_mixing": op9_mixing, "op8_sharding": op8_sharding, "mixing_targets": mixing_targets, "shard_law": shard_law, "shard_rows": shard_rows}

ORACLES = {
    # Sources stop at their limit in order of limit / weight: the level is that of the first prefix that keeps it.
    "mixing_targets": r"""WITH sizes AS (SELECT source, sum(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))) AS z FROM documents GROUP BY source),
weighed AS (SELECT source, z, 1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 AS w FROM sizes),
ranked AS (SELECT *, 3.0 * z / w AS limit_level, sum(3.0 * z) OVER o - 3.0 * z AS held, sum(w) OVER () - sum(w) OVER o + w AS free, sum(z) OVER () AS total
  FROM weighed WINDOW o AS (ORDER BY 3.0 * z / w, source ROWS UNBOUNDED PRECEDING)),
level AS (SELECT coalesce(arg_min((total - held) / free, limit_level) FILTER ((total - held) / free <= limit_level), max(limit_level)) AS v FROM ranked)
SELECT source, CAST(z AS BIGINT) AS source_size, round(least(3.0 * z, w * v), 4) AS target, true AS near FROM weighed, level""",
    "shard_law": """WITH n AS (SELECT count(*) AS n FROM documents), s AS (SELECT unnest(range(40)) AS shard),
q AS (SELECT shard, (shard + 1) * n // 40 - shard * n // 40 AS n FROM s, n)
SELECT shard, n, n AS slots, CAST(0 AS BIGINT) AS first_slot, n - 1 AS last_slot FROM q WHERE n > 0""",
    "shard_rows": "SELECT doc_id, CAST(strlen(coalesce(text, '')) + 16 AS BIGINT) AS size, 'rows' AS law, true AS in_range, CAST(NULL AS INTEGER) AS grown_shard FROM documents",
}

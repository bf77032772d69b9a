"""The training-data pipeline: STAGES applied to documents one after another.

toxicity drops documents that the classifier chain rejects; near_duplicates keeps one document of each group of linked
ones; decontamination drops documents with benchmark passages; mixing repeats or leaves out documents so that sources
meet their target weights; sharding adds the shard and slot of each row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm.attach import attach
from tessella.llm.common import table
from tessella.llm.decontaminate import drop_leaks
from tessella.llm.jaccard import jaccard_classes
from tessella.llm.mixing import mix_sources
from tessella.llm.sharding import shard_documents
from tessella.llm.store import BROADCAST_ROWS, scope
from tessella.llm.toxicity import CATEGORIES, fit_toxicity, is_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Train on labelled documents, drop every document that the chain rejects. Null and empty texts stay."""
    chain = fit_toxicity(docs, table(spark, sf_dir, "labels"), CATEGORIES)
    return docs.filter(~is_toxic(spark, chain, F.col("text")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one of the smallest id stays, of several texts of that id the one whose hash
    is smallest; documents without an id come last.

    Decisions go by id and text, so an id that stands for several texts loses none that has no link. Of rows that repeat
    id and text one stays (which one is arbitrary where other columns differ). Texts without words have no links.
    """
    classes = jaccard_classes(docs)
    mine = F.struct(F.col("doc_id").isNull().alias("bare"), "doc_id", "text_hash")
    first = classes.filter("component is not null").groupBy("component").agg(F.min(mine).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    few = first.count() <= BROADCAST_ROWS // 10
    first = F.broadcast(first) if few else first
    name = [F.col("doc_id").alias("id_"), F.col("text_hash").alias("hash_")]
    gone = classes.join(first, "component").filter(mine != F.col("first")).select(*name).distinct()
    twice = classes.groupBy("doc_id", "text_hash").count().filter("count > 1").select(*name)
    side = lambda df: F.broadcast(df) if df.count() <= BROADCAST_ROWS else df
    same = F.col("id").eqNullSafe(F.col("id_")) & (F.col("hash") == F.col("hash_"))
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"))
    out = rows.join(side(gone), same, "left_anti")
    if twice.limit(1).count():
        twice = side(twice)
        nth = F.row_number().over(Window.partitionBy("id", "hash").orderBy("id"))
        once = out.join(twice, same, "left_semi").withColumn("nth", nth).filter("nth = 1").drop("nth")
        out = out.join(twice, same, "left_anti").unionByName(once)
    return out.select("row.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop every document in which a window of a benchmark item occurs."""
    return drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its copies in the mix: not at all, or up to three times."""
    mixed = mix_sources(docs)
    taken = attach(docs, mixed, "doc_id", "text_hash", ["copies"])
    return taken.filter("copies > 0").select("row", F.explode(F.sequence(F.lit(1), "copies")).alias("copy")).select("row.*")


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with shard (0 to 39) and slot. Columns of these names that the documents had are replaced."""
    dealt = shard_documents(docs, shards=40)
    out = attach(docs, dealt, "doc_id", "text_hash", ["shard", "slot"])
    kept = [c for c in docs.columns if c.lower() not in ("shard", "slot")]
    return out.select(*[F.col("row")[c].alias(c) for c in kept], "shard", "slot")


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixing), ("sharding", sharding)]

#: The first stage is a trained model, which SQL cannot express; tests hold the run against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply every stage to the documents of sf_dir, each written before the next reads it; then what it needed goes."""
    docs = table(spark, sf_dir, "documents")
    with scope(spark) as whole:
        for name, stage in STAGES:
            with scope(spark) as tables:
                docs = tables.result(stage(spark, docs, sf_dir), f"stage-{name}")
        whole.keep(docs)
    return docs

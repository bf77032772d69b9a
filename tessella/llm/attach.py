"""Joining decisions about single rows back to the rows themselves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.store import BROADCAST_ROWS, stash


def _side(df: DataFrame) -> DataFrame:
    """The small rows of a join with whole rows: sent to these where they are few, else looked up without a sort."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS // 4 else df.hint("shuffle_hash")


def _same(extra: Column | None = None) -> Column:
    test = F.col("id").eqNullSafe(F.col("id_")) & F.col("hash").eqNullSafe(F.col("hash_"))
    return test if extra is None else test & extra


def attach(docs: DataFrame, decisions: DataFrame, id_col: str, text_hash: str, columns: list[str], text_col: str = "text") -> DataFrame:
    """(row, *columns): whole rows of docs as a struct beside columns of decisions (named by doc_id and text_hash).

    Matched by id (null matches null) and hash of the text. Rows that repeat both are numbered on either side, so each
    decision goes to exactly one row; all others are joined as they are. Whole rows move at most once, and not at all
    where decisions are few. Rows of one id and text that all have the same decision need no numbers either.
    """
    left = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("hash"))
    right = decisions.select(F.col("doc_id").alias("id_"), F.col(text_hash).alias("hash_"), *[F.col(c).alias(f"_{c}") for c in columns])
    told = right.groupBy("id_", "hash_").agg(F.count("*").alias("n"), F.min(F.struct(*[f"_{c}" for c in columns])).alias("low"), F.max(F.struct(*[f"_{c}" for c in columns])).alias("high"))
    told = stash(told, "told")
    same = told.filter(F.col("low").eqNullSafe(F.col("high"))).select("id_", "hash_", "low.*")
    out = left.join(_side(same), _same()).select("row", *[f"_{c}" for c in columns])
    mixed = told.filter(~F.col("low").eqNullSafe(F.col("high"))).select("id_", "hash_")
    if mixed.limit(1).count():  # repeats that are told apart
        of = right.withColumnsRenamed({"id_": "id", "hash_": "hash"}).join(_side(mixed), _same(), "left_semi").withColumnsRenamed({"id": "id_", "hash": "hash_"})
        of = of.withColumn("nth_", F.row_number().over(Window.partitionBy("id_", "hash_").orderBy(*[f"_{c}" for c in columns])))
        rows = left.join(_side(mixed), _same(), "left_semi").withColumn("nth", F.row_number().over(Window.partitionBy("id", "hash").orderBy("id")))
        out = out.unionAll(rows.join(of, _same(F.col("nth") == F.col("nth_"))).select("row", *[f"_{c}" for c in columns]))
    return out.select("row", *[F.col(f"_{c}").alias(c) for c in columns])

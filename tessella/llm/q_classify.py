"""Query op5: toxicity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessella.llm.common import table
from tessella.llm.toxicity import CATEGORIES, fit_toxicity, score_toxicity


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_toxicity(docs, fit_toxicity(docs, table(spark, sf_dir, "labels"), CATEGORIES))


QUERIES = {"op5_toxicity": op5_toxicity}
ORACLES: dict[str, str] = {}

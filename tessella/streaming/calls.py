"""The call log as a stream: each batch is written once, with running totals beside it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tessella.sources import schemas
from tessella.sources.versions import Log

c = F.col


def record_calls(calls: DataFrame, root: str, checkpoint: str, available_now: bool = True):
    """Start a query that appends a stream of calls (of schemas.LLM_CALL) to the log below root.

    A batch is a folder named by its number and an entry with the totals so far. A batch that comes again after a failure
    overwrites a folder without an entry, and is passed over where the entry is there: its calls count once.
    """

    def step(batch: DataFrame, number: int) -> None:
        log = Log(batch.sparkSession, f"{root}/log")
        last, entry = log.last()
        if entry and entry["batch"] >= number:
            return
        seen = Observation()
        cost, tokens = F.coalesce(F.sum("costUsd"), F.lit(0.0)), F.coalesce(F.sum(F.coalesce("inputTokens", F.lit(0)) + F.coalesce("outputTokens", F.lit(0))), F.lit(0))
        out = batch.observe(seen, F.count(F.lit(1)).alias("calls"), cost.alias("cost"), tokens.alias("tokens"), F.count_if(~F.coalesce("success", F.lit(True))).alias("failures"))
        out.write.mode("overwrite").json(f"{root}/batch-{number}")
        totals = {k: v + (entry or {}).get(k, 0) for k, v in seen.get.items()}
        log.put({"batch": number} | totals, last)

    q = calls.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (q.trigger(availableNow=True) if available_now else q).start()


def recorded_calls(spark: SparkSession, root: str) -> DataFrame:
    """All calls of batches with an entry."""
    names = [f"{root}/batch-{e['batch']}" for _, e in Log(spark, f"{root}/log").entries()]
    return spark.read.schema(schemas.LLM_CALL).json(names) if names else spark.createDataFrame([], schemas.LLM_CALL)


def call_totals(spark: SparkSession, root: str) -> dict:
    """Running totals (calls, cost, tokens, failures) as of the last batch; none are read again for that."""
    return {k: v for k, v in (Log(spark, f"{root}/log").last()[1] or {}).items() if k != "batch"}

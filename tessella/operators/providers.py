"""Pluggable model providers: embeddings, summaries and verdicts.

Models are outside of this library. A provider is any object with the method named below; it is created once per task
from a picklable factory and fed Arrow batches. The providers here are deterministic and serve tests; they carry no
semantics of a real model. A provider that fails on a row gives an error row and does not fail the job.
"""

from __future__ import annotations

import time
import zlib
from collections.abc import Callable, Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

c = F.col


class HashingEmbedder:
    """Signed hashing of words and word pairs, brought to unit length."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.dim))
        for i, t in enumerate(texts):
            words = t.lower().split()
            for token in words + [f"{a} {b}" for a, b in zip(words, words[1:])]:
                h = zlib.crc32(token.encode())
                out[i, (h >> 1) % self.dim] += 1 if h & 1 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(norm > 0, norm, 1)).tolist()


def embed(df: DataFrame, text: Column, name: str, factory: Callable, dim: int) -> DataFrame:
    """df with a vector column; null or empty texts get zero vectors and never reach the provider."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = factory()
        for s in batches:
            yield pd.Series(model.embed(s.tolist()))

    some = F.length(text) > 0
    zero = F.array_repeat(F.lit(0.0).cast("float"), dim)
    # Rows are split, not guarded by a condition: Spark may evaluate a UDF under `when` for every row.
    return df.filter(some).withColumn(name, run(text)).unionByName(df.filter(~F.coalesce(some, F.lit(False))).withColumn(name, zero))


#: Least and most calls of a provider at a time.
LEAST_CALLS, MOST_CALLS = 1, 32


def gate(df: DataFrame, calls: int) -> DataFrame:
    """df in as many tasks as calls may run at a time: a task makes one call after another, so no more ever run."""
    if not LEAST_CALLS <= calls <= MOST_CALLS:
        raise ValueError(f"calls at a time must be {LEAST_CALLS} to {MOST_CALLS}, not {calls}")
    return df.repartition(calls)


class Breaker:
    """Opens after some failures in a row; after a pause one call may try again."""

    def __init__(self, failures: int = 3, pause: float = 300.0, clock: Callable[[], float] | None = None):
        self.failures, self.pause, self.clock = failures, pause, clock or time.monotonic
        self.count, self.opened = 0, None

    def allows(self) -> bool:
        return self.opened is None or self.clock() - self.opened >= self.pause

    def record(self, success: bool) -> None:
        self.count = 0 if success else self.count + 1
        if success:
            self.opened = None
        elif self.count >= self.failures or self.opened is not None:
            self.opened = self.clock()


def retried(call: Callable, attempts: int = 3, base: float = 5.0, most: float = 60.0, sleep: Callable[[float], None] | None = None):
    """The call's result; between failures a pause that doubles up to a limit. The last failure is raised."""
    for n in range(attempts):
        try:
            return call()
        except Exception:  # noqa: BLE001
            if n == attempts - 1:
                raise
            (sleep or time.sleep)(min(base * 2**n, most))
    return None


def evaluate(df: DataFrame, factory: Callable, schema: str, attempts: int = 2, calls: int | None = None, pause: float = 0.0, breaker: Callable[[], Breaker] | None = None) -> DataFrame:
    """Rows of a provider's `evaluate(row) -> list of dicts` with `error`; a failure after some attempts is one error row.

    calls: how many may run at a time, over the whole cluster. pause: seconds before the second attempt, doubled before
    each further one. breaker: makes a task's circuit breaker; while it is open, rows get an error without a call.
    """
    df = df if calls is None else gate(df, calls)
    from pyspark.sql.types import _parse_datatype_string

    names = _parse_datatype_string(schema).names

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, guard = factory(), breaker() if breaker else None
        for pdf in frames:
            rows = []
            for r in pdf.to_dict("records"):
                error = "CircuitOpen: not called"
                if guard is None or guard.allows():
                    try:
                        rows += [{**x, "error": None} for x in retried(lambda: model.evaluate(r), attempts, pause)]  # noqa: B023
                        error = None
                    except Exception as e:  # noqa: BLE001  a provider may fail in any way
                        error = f"{type(e).__name__}: {e}"
                    if guard is not None:
                        guard.record(error is None)
                if error is not None:
                    rows.append({k: r.get(k) for k in names} | {"error": error})
            yield pd.DataFrame(rows, columns=[*names, "error"])

    return df.mapInPandas(run, f"{schema}, error string")


class Router:
    """Model names to providers: of the prefixes of a name the longest one decides, and its providers are asked in order."""

    def __init__(self, routes: dict[str, list[str]], fallback: list[str] = ()):
        self.routes, self.fallback = routes, list(fallback)

    def chain(self, model: Column) -> Column:
        """The providers of a model: those of its route, then the fallback."""
        of = lambda names: F.array(*map(F.lit, dict.fromkeys([*names, *self.fallback]))).cast("array<string>")
        out = of([])
        for prefix in sorted(self.routes, key=len):
            out = F.when(model.startswith(prefix), of(self.routes[prefix])).otherwise(out)
        return out

    @property
    def length(self) -> int:
        return max([len(self.fallback), *(len(dict.fromkeys([*names, *self.fallback])) for names in self.routes.values())])


class Routed(NamedTuple):
    """Answers with the provider that gave them (or failed last), and one row of counts a provider and pass."""

    answers: DataFrame
    circuits: DataFrame


def evaluate_routed(df: DataFrame, router: Router, providers: dict[str, Callable], schema: str, root: str, key: str = "id", model: str = "model", share: float = 0.5, least: int = 3, **how) -> Routed:
    """Rows of df (key, model, ...) evaluated by the providers of their models, in passes.

    In a pass each open row goes to the next provider of its chain whose circuit is not open. Answers are written below
    root, so no call is made twice; failures are counted per provider, and a circuit opens where `least` calls and a
    share of all calls so far have failed. Only rows that failed go on to the next pass, at most as many as a chain is
    long. Answers hold the columns of schema (key among them), error and provider; a row without a provider fails.
    how: attempts, calls, pause and breaker of `evaluate`.
    """
    spark = df.sparkSession
    rows = df.withColumn("_chain", router.chain(c(model)))
    open_: list[str] = []
    answers: list[DataFrame] = []
    circuits: list[tuple] = []
    counts: dict[str, tuple[int, int]] = {}
    for n in range(router.length):
        # The first provider that has not been asked and is not open; asked ones are cut off the chain.
        usable = F.filter("_chain", lambda p: ~p.isin(open_)) if open_ else c("_chain")
        rows = rows.withColumn("_provider", F.get(usable, F.lit(0)))
        parts = [evaluate(rows.filter(c("_provider") == name).drop("_chain", "_provider"), factory, schema, **how).withColumn("provider", F.lit(name)) for name, factory in providers.items() if name not in open_]
        reduce(DataFrame.unionByName, parts).write.parquet(f"{root}/pass-{n}")
        got = spark.read.parquet(f"{root}/pass-{n}")
        for r in got.groupBy("provider").agg(F.count("*").alias("n"), F.count_if(c("error").isNotNull()).alias("failed")).collect():  # a row a provider
            calls, failed = (a + b for a, b in zip(counts.get(r.provider, (0, 0)), (r.n, r.failed), strict=True))
            counts[r.provider] = calls, failed
            if failed >= least and failed >= share * calls and r.provider not in open_:
                open_.append(r.provider)
            circuits.append((n, r.provider, r.n, r.failed, r.provider in open_))
        failed = got.filter("error is not null").select(c(key).alias("_key"), c("provider").alias("_failed"))
        answers.append(got.filter("error is null"))
        asked = rows.join(failed, c(key) == c("_key")).withColumn("_chain", F.array_remove("_chain", c("_failed"))).drop("_key", "_failed")
        left = F.filter("_chain", lambda p: ~p.isin(open_)) if open_ else c("_chain")
        rest = F.size(left) > 0
        # Who has nobody left to ask keeps the last error.
        done = asked.filter(~rest).select(c(key).alias("_key"))
        answers.append(got.filter("error is not null").join(done, c(key) == c("_key"), "left_semi"))
        nobody = rows.filter("_provider is null").select(*[c(x) if x in df.columns else F.lit(None).alias(x) for x in got.columns if x not in ("error", "provider")], F.lit("NoProvider: none is left").alias("error"), F.lit(None).cast("string").alias("provider"))
        answers.append(nobody.select(got.columns))
        rows = asked.filter(rest).drop("_provider")
        if not got.filter("error is not null").limit(1).count():
            break
    table = spark.createDataFrame(circuits, "pass int, provider string, n_calls long, n_failed long, open boolean")
    return Routed(reduce(DataFrame.unionByName, answers), table)


def summarize(rows: DataFrame, cache: DataFrame, factory: Callable) -> DataFrame:
    """(id, body_hash, value): cached summaries where the body is unchanged, the provider's for the rest."""
    from tessella.operators.incremental import cache_aside

    hits, misses = cache_aside(rows, cache, "id", "body_hash")
    new = evaluate(misses, factory, "id string, body_hash string, value string").filter("error is null").drop("error")
    return hits.select("id", "body_hash", "value").unionByName(new)


def auto_unique(symbols: DataFrame, candidates: DataFrame) -> DataFrame:
    """Symbols (file, name, lines) with `auto`: UNIQUE without asking a model if tiny or without any similar function."""
    near = candidates.select("file", "name").distinct().withColumn("has", F.lit(True))
    return symbols.join(near, ["file", "name"], "left").withColumn("auto", F.when((F.col("lines") <= 2) | F.col("has").isNull(), "UNIQUE")).drop("has")

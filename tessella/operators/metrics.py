"""Run metrics: roll-ups of call events, calibration, cost and forecasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

c = F.col

#: Prices up to which they are broadcast.
PRICE_ROWS = 100_000

# Fixed values of the estimates.
SYSTEM_TOKENS, FILE_TOKENS, OUT_BASE, OUT_PER_SYMBOL = 600, 50, 1500, 400
EFFICIENCY = 0.75
DEFAULT_MEDIANS = {"duplication": 10_400, "utility": 13_500, "overengineering": 19_000, "tests": 21_700, "documentation": 60_000, "correction": 83_000, "best_practices": 117_100}
STATUSES = ["PENDING", "IN_PROGRESS", "DONE", "ERROR", "CACHED", "SKIPPED"]


def _between(start: Column, end: Column) -> Column:
    """Whole milliseconds from one time to another."""
    return F.floor((F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / 1000).cast("long")


def rollup(events: DataFrame, dims: list[str], sums: list[str]) -> DataFrame:
    """(dim, key, calls, sums...): totals and one break-down per dimension in a single pass (grouping sets)."""
    spark = events.sparkSession
    sets = ", ".join(["()"] + [f"({d})" for d in dims])
    which = " ".join(f"WHEN grouping({d}) = 0 THEN '{d}'" for d in dims)
    keys = " ".join(f"WHEN grouping({d}) = 0 THEN CAST({d} AS STRING)" for d in dims)
    total = ", ".join(f"sum({s}) AS {s}" for s in sums)
    return spark.sql(f"SELECT CASE {which} ELSE 'total' END AS dim, CASE {keys} END AS key, count(*) AS calls, {total} FROM {{e}} GROUP BY GROUPING SETS ({sets})", e=events)


def status_histogram(rows: DataFrame, column: str, values: list[str]) -> DataFrame:
    """(status, n) with a row for every value, zeros too."""
    grid = rows.sparkSession.createDataFrame([(v,) for v in values], "status string")
    n = rows.groupBy(c(column).alias("status")).agg(F.count("*").alias("n"))
    return grid.join(n, "status", "left").fillna(0, ["n"])


def calibrate(runs: DataFrame, last: int = 20) -> DataFrame:
    """(axis, median_ms, samples) over the last runs (run_id, axis, total_ms, calls): exact median of means per call.

    Axes without a sample keep their default.
    """
    recent = runs.select("run_id").distinct().orderBy(F.desc("run_id")).limit(last)
    per = runs.filter("calls > 0").join(F.broadcast(recent), "run_id", "left_semi")
    found = per.groupBy("axis").agg(F.median(c("total_ms") / c("calls")).alias("m"), F.count("*").alias("samples"))
    default = runs.sparkSession.createDataFrame([(a, float(m)) for a, m in DEFAULT_MEDIANS.items()], "axis string, d double")
    return default.join(found, "axis", "full_outer").select("axis", F.coalesce("m", "d").alias("median_ms"), F.coalesce("samples", F.lit(0)).cast("long").alias("samples"))


def price(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """calls with `cost` in USD: the price of the model, else of its id without provider or date; unpriced is 0.

    prices: (model, input, output, cache_read, cache_creation) per million tokens; cache rates default to input. Up to
    PRICE_ROWS prices are broadcast and calls stay where they are, as all calls may name a few models; of more, the three
    ranked candidates of a model are joined once per distinct model.
    """
    bare = F.regexp_replace("model", r"^.*/", "")
    tries = F.array(c("model"), bare, F.regexp_replace(bare, r"-\d{8}$", ""))
    rate = F.struct("input", "output", F.coalesce("cache_read", "input").alias("cache_read"), F.coalesce("cache_creation", "input").alias("cache_creation"))
    p = prices.groupBy(c("model").alias("candidate")).agg(F.min(rate).alias("rate"))
    if prices.count() <= PRICE_ROWS:
        out = calls
        for i in range(3):
            out = out.join(F.broadcast(p.select(c("candidate").alias(f"candidate{i}"), c("rate").alias(f"rate{i}"))), tries[i] == c(f"candidate{i}"), "left")
        out = out.withColumn("rate", F.coalesce("rate0", "rate1", "rate2")).drop(*[f"{x}{i}" for x in ("candidate", "rate") for i in range(3)])
    else:
        ranked = calls.select("model").distinct().select("model", F.posexplode(tries).alias("rank", "candidate"))
        best = ranked.join(p, "candidate").groupBy("model").agg(F.min_by("rate", "rank").alias("rate"))
        out = calls.join(best, "model", "left")
    cost = sum((F.coalesce(c(n), F.lit(0)) * c(f"rate.{r}") for n, r in (("in_tokens", "input"), ("out_tokens", "output"), ("read_tokens", "cache_read"), ("creation_tokens", "cache_creation"))), F.lit(0.0)) / 1e6
    return out.withColumn("cost", F.coalesce(cost, F.lit(0.0))).drop("rate")


def estimate_tokens(files: DataFrame) -> DataFrame:
    """One row (tokens_in, tokens_out) of files (tokens, n_symbols, n_lines); unknown tokens count 8 a line."""
    t = F.coalesce("tokens", c("n_lines") * 8)
    return files.agg(F.sum(SYSTEM_TOKENS + t + FILE_TOKENS).cast("long").alias("tokens_in"), F.sum(OUT_BASE + OUT_PER_SYMBOL * c("n_symbols")).cast("long").alias("tokens_out"))


def estimate_minutes(medians: DataFrame, files: int, workers: int, before_ms: float = 0.0, after_ms: float = 0.0) -> DataFrame:
    """One row (minutes): the slowest axis bounds the run; several workers reach three quarters of their number."""
    speed = workers * EFFICIENCY if workers > 1 else 1
    return medians.agg(F.ceil((F.lit(before_ms) + F.max("median_ms") * files / speed + F.lit(after_ms)) / 60_000).cast("long").alias("minutes"))


def forecast(steps: DataFrame) -> DataFrame:
    """(model, cost, tokens_in, tokens_out) of forecast steps but embeddings, which are not paid by token."""
    return steps.filter("category <> 'embed'").groupBy("model").agg(F.sum("cost").alias("cost"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"))


def hit_rate(read: Column, fresh: Column, creation: Column) -> Column:
    """Percent of input tokens that a cache gave; 0 of none."""
    total = read + fresh + creation
    return F.when(total > 0, F.round(100 * read / total)).otherwise(0).cast("long")


def run_table(runs: DataFrame, now: Column) -> DataFrame:
    """runs with duration_ms up to their end, or to now while they go on."""
    return runs.withColumn("duration_ms", _between(c("started_at"), F.coalesce("completed_at", now)))


def run_info(files: DataFrame) -> DataFrame:
    """(run_id, n_files, kb) of files (run_id, length)."""
    return files.groupBy("run_id").agg(F.count("*").alias("n_files"), F.round(F.sum("length") / 1024).cast("long").alias("kb"))


def timeline(events: DataFrame, run: str, time: str) -> DataFrame:
    """Events with their place within the run and the time since the one before."""
    w = Window.partitionBy(run).orderBy(time, *[x for x in events.columns if x.endswith("_id")])
    return events.withColumn("place", F.row_number().over(w)).withColumn("since", _between(F.lag(time).over(w), c(time)))


def run_id(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd_HHmmss")


def backoff(attempt: Column, base: float = 5_000, most: float = 60_000) -> Column:
    """Delay before an attempt (from 0), without jitter."""
    return F.least(base * F.pow(F.lit(2.0), attempt), F.lit(float(most)))


def embed_tokens(cards: DataFrame, chunks: DataFrame) -> DataFrame:
    """(kind, units, tokens) of texts to embed: cards (text) and chunks (text), each as they are cut for the model."""
    from tessella.functions.text import EMBED_CHARS, estimate_tokens

    of = lambda df, kind: df.agg(F.count("*").alias("units"), F.coalesce(F.sum(estimate_tokens(F.substring("text", 1, EMBED_CHARS))), F.lit(0)).alias("tokens")).select(F.lit(kind).alias("kind"), "units", "tokens")
    return of(cards, "code").unionAll(of(chunks, "text"))

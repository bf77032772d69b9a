"""Report aggregates over symbol reviews. All are single group-bys over long rows, combined before they shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.rules import AXES, CLEAN_VALUES, REPORT_CONFIDENCE, SYSTEMIC_DEAD, has_finding, symbol_severity

c = F.col


def _long(df: DataFrame) -> DataFrame:
    """(file, name, confidence, axis, value) of evaluated verdicts."""
    return df.select("file", "name", "confidence", F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), c(a).alias("value")) for a in AXES])).alias("x")).select("file", "name", "confidence", "x.*").filter("value <> '-'")


def axis_counts(df: DataFrame) -> DataFrame:
    """(axis, severity, n) over symbols of confidence 30 and more, with zero rows."""
    hits = F.array(*[F.when(has_finding(a) if a != "utility" else c("utility") == "DEAD", F.lit(a)) for a in AXES])
    rows = df.filter(c("confidence") >= REPORT_CONFIDENCE).select(symbol_severity().alias("severity"), F.explode(hits).alias("axis")).filter("axis is not null").groupBy("axis", "severity").agg(F.count("*").alias("n"))
    grid = df.sparkSession.createDataFrame([(a, s) for a in AXES for s in ("high", "medium", "low")], "axis string, severity string")
    return grid.join(rows, ["axis", "severity"], "left").select("axis", "severity", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def axis_health(df: DataFrame) -> DataFrame:
    """(axis, n_ok, n_evaluated, pct): percent in order of symbols evaluated with confidence 30 and more; 100 of none."""
    ok = F.lit(False)
    for a in AXES:
        ok = ok | ((c("axis") == a) & c("value").isin(*CLEAN_VALUES[a]))
    rows = _long(df.filter(c("confidence") >= REPORT_CONFIDENCE)).groupBy("axis").agg(F.count_if(ok).alias("n_ok"), F.count("*").alias("n_evaluated"))
    grid = df.sparkSession.createDataFrame([(a,) for a in AXES], "axis string")
    out = grid.join(rows, "axis", "left").fillna(0)
    return out.withColumn("pct", F.when(c("n_evaluated") == 0, 100).otherwise(F.round(100 * c("n_ok") / c("n_evaluated"))).cast("long"))


def verdict_distribution(df: DataFrame, least_share: float = 0.0) -> DataFrame:
    """(axis, value, n, pct) of evaluated verdicts; axes evaluated on less than least_share of symbols are left out."""
    n = _long(df).groupBy("axis", "value").agg(F.count("*").alias("n"))
    whole = F.sum("n").over(Window.partitionBy("axis"))
    out = n.withColumn("pct", F.round(100 * c("n") / whole).cast("long")).withColumn("evaluated", whole)
    if least_share:
        total = df.agg(F.count("*").alias("total"))
        out = out.join(F.broadcast(total)).filter(c("evaluated") >= least_share * c("total")).drop("total")
    return out.drop("evaluated")


def systemic_dead(df: DataFrame, more_than: int = SYSTEMIC_DEAD) -> DataFrame:
    """(dir, n) of directories with more than ten dead symbols."""
    return df.filter("utility = 'DEAD'").groupBy(F.regexp_replace("file", "/[^/]*$", "").alias("dir")).agg(F.count("*").alias("n")).filter(c("n") > more_than)


def sort_findings(files: DataFrame) -> DataFrame:
    """files (file, verdict, n_findings, max_confidence) with `position`: worst verdict, most findings, most certain.

    Files that agree in these three are numbered among themselves; one task orders only the kinds of files there are.
    """
    rank = F.when(c("verdict") == "CRITICAL", 0).when(c("verdict") == "NEEDS_REFACTOR", 1).otherwise(2)
    kind = ["rank", "n_findings", "max_confidence"]
    some = files.withColumn("rank", rank)
    before = F.sum("n").over(Window.orderBy("rank", F.desc("n_findings"), F.desc("max_confidence"))) - c("n")
    kinds = some.groupBy(*kind).agg(F.count("*").alias("n")).withColumn("before", before).select(*[c(k).alias(f"k_{k}") for k in kind], "before")
    same = c("rank").eqNullSafe(c("k_rank")) & c("n_findings").eqNullSafe(c("k_n_findings")) & c("max_confidence").eqNullSafe(c("k_max_confidence"))
    nth = F.row_number().over(Window.partitionBy(*kind).orderBy("file"))
    return some.withColumn("nth", nth).join(kinds, same).select(*files.columns, (c("before") + c("nth")).cast("int").alias("position"))


def shards(ordered: DataFrame, size: int = 10) -> DataFrame:
    """(shard, n_files, n_findings, first_file) of fixed-size runs in sorted order."""
    return ordered.withColumn("shard", F.ceil(c("position") / size)).groupBy("shard").agg(F.count("*").alias("n_files"), F.sum("n_findings").alias("n_findings"), F.min_by("file", "position").alias("first_file"))


def directory_shards(rows: DataFrame, size: int = 20) -> DataFrame:
    """rows (dir, pos) with the number of their shard within the directory, split at `size`."""
    return rows.withColumn("shard", F.floor((F.row_number().over(Window.partitionBy("dir").orderBy("pos")) - 1) / size))


def budget_prefix(rows: DataFrame, order: str, cost: str, group: str, cap: float) -> DataFrame:
    """Rows that start before the running cost of their group has reached the cap."""
    before = F.sum(cost).over(Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("spent", F.coalesce(before, F.lit(0.0))).filter(c("spent") < cap)


def axis_files(df: DataFrame, axis: str) -> DataFrame:
    """Files with a finding on an axis, with how many and how sure."""
    return df.groupBy("file").agg(F.count_if(has_finding(axis)).alias("n_findings"), F.max("confidence").alias("max_confidence")).filter("n_findings > 0")


def health_bar(pct, density) -> Column:
    """Ten cells, filled by percent; the label follows the density of findings."""
    cells = F.round(pct / 10).cast("int")
    return F.concat(F.rpad(F.lit(""), cells, "█"), F.rpad(F.lit(""), 10 - cells, "░"), F.when(density > 0.15, " red").when(density > 0.03, " amber").when(density > 0, " yellow").otherwise(" green"))

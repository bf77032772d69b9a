"""The incremental scan, and what is kept of earlier runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators.incremental import diff
from tessella.operators.rules import AXES
from tessella.sources.parse import parse_files

c = F.col


def scan(files: DataFrame, tasks: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(tasks, counts): files (file, content, hash) against the tasks of the last scan (file, hash, symbols...).

    Files with the hash they had keep their row; only new and modified ones are parsed; rows of files that are gone are
    dropped. counts: (state, n_files, n_symbols).
    """
    spark = files.sparkSession
    if tasks is None:
        tasks = spark.createDataFrame([], "file string, hash string, language string, parse_method string, symbols array<struct<name:string,kind:string,exported:boolean,line_start:int,line_end:int>>")
    state = diff(files, tasks, "file", "hash")
    todo = files.join(state.filter(c("state").isin("new", "modified")), "file", "left_semi")
    symbols = parse_files(todo).groupBy("file").agg(F.first("language").alias("language"), F.first("parse_method").alias("parse_method"), F.array_sort(F.collect_list(F.struct("line_start", "line_end", "name", "kind", "exported"))).alias("s"))
    ordered = F.transform("s", lambda x: F.struct(x["name"].alias("name"), x["kind"].alias("kind"), x["exported"].alias("exported"), x["line_start"].alias("line_start"), x["line_end"].alias("line_end")))
    fresh = todo.select("file", "hash").join(symbols, "file", "left").select("file", "hash", "language", "parse_method", F.coalesce(ordered, F.array().cast("array<struct<name:string,kind:string,exported:boolean,line_start:int,line_end:int>>")).alias("symbols"))
    kept = tasks.join(state.filter("state = 'cached'"), "file", "left_semi").select(*fresh.columns)
    out = kept.unionByName(fresh)
    counts = state.join(out.select("file", F.size("symbols").alias("k")), "file", "left").groupBy("state").agg(F.count("*").alias("n_files"), F.coalesce(F.sum("k"), F.lit(0)).alias("n_symbols"))
    return out, counts


def mask_axes(reviews: DataFrame, enabled: list[str]) -> DataFrame:
    """Cached reviews with '-' on axes that are switched off now."""
    return reviews.withColumns({a: F.lit("-") for a in AXES if a not in enabled})


def changed_docs(docs: DataFrame, cache: DataFrame, scaffold) -> DataFrame:
    """One row (total, changed, cached) of docs (file, content, hash), scaffolds aside."""
    old = cache.select(c("file").alias("f"), c("hash").alias("h"))
    some = docs.filter(~scaffold).join(old, c("file") == c("f"), "left")
    return some.agg(F.count("*").alias("total"), F.count_if(~c("hash").eqNullSafe(c("h"))).alias("changed"), F.count_if(c("hash") == c("h")).alias("cached"))


def skip_axes(reason) -> Column:
    """Axes that still run on a file that triage skips."""
    return F.when(reason == "trivial", F.array(F.lit("correction"), F.lit("duplication"), F.lit("utility"))).otherwise(F.array().cast("array<string>"))


def triage(files: DataFrame) -> DataFrame:
    """files (file, content, symbols) with `tier` and `reason`, first match."""
    lines = F.filter(F.split("content", "\n"), lambda x: F.length(F.trim(x)) > 0)
    n = F.size(F.split("content", "\n"))
    s = F.size("symbols")
    all_of = lambda *kinds: (s > 0) & F.forall("symbols", lambda x: x["kind"].isin(*kinds))
    barrel = (s == 0) & (F.size(lines) > 0) & F.forall(lines, lambda x: x.rlike(r"^\s*export\s"))
    reason = F.when(barrel, "barrel-export").when((n < 10) & (s <= 1), "trivial").when(all_of("type", "enum"), "type-only").when(all_of("constant"), "constants-only").when((s > 0) & ~F.exists("symbols", lambda x: x["exported"]), "internal").when(s < 3, "simple").otherwise("complex")
    skip = reason.isin("barrel-export", "trivial", "type-only", "constants-only")
    return files.withColumns({"tier": F.when(skip, "skip").otherwise("evaluate"), "reason": reason})


def skip_reviews(triaged: DataFrame, utility: DataFrame) -> DataFrame:
    """One synthetic review row per symbol of a skipped file; utility (file, name, value) from the usage graph."""
    rows = triaged.filter("tier = 'skip'").select("file", "reason", F.explode("symbols").alias("s")).select("file", "reason", "s.*")
    out = rows.join(utility.select("file", "name", c("value").alias("utility")), ["file", "name"], "left")
    return out.withColumns({"utility": F.coalesce("utility", F.lit("USED")), "correction": F.lit("OK"), "overengineering": F.lit("LEAN"), "duplication": F.lit("UNIQUE"), "tests": F.lit("-"), "documentation": F.lit("-"), "confidence": F.lit(95), "is_generated": F.lit(True)})


def implicated_dependency(detail, dependencies) -> Column:
    """The dependency whose name comes first in a text; null if none does."""
    at = F.transform(dependencies, lambda d: F.struct(F.instr(F.lower(detail), F.lower(d)).alias("at"), d.alias("name")))
    return F.try_element_at(F.array_sort(F.filter(at, lambda x: x["at"] > 0)), F.lit(1))["name"]


def resolve_prompt(by_framework, by_language, default) -> Column:
    """Most specific prompt that there is."""
    return F.coalesce(by_framework, by_language, default)

"""File sources and sinks: source trees, JSON relations, event logs, Markdown and coverage maps."""

from __future__ import annotations

import subprocess

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators.intervals import union_length
from tessella.sources import schemas

c = F.col


def glob_to_regex(glob: str) -> str:
    """A path glob (*, **, ?, {a,b}) as a regular expression for whole paths."""
    out, i, depth = "", 0, 0
    while i < len(glob):
        ch = glob[i]
        if glob.startswith("**/", i):
            out, i = out + "(?:[^/]+/)*", i + 3
            continue
        if glob.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        if ch in "{}":
            depth += 1 if ch == "{" else -1
            out += "(?:" if ch == "{" else ")"
        elif ch == "," and depth:
            out += "|"
        else:
            out += "[^/]*" if ch == "*" else "[^/]" if ch == "?" else "\\" + ch if ch in ".+()[]^$|\\" else ch
        i += 1
    return "^" + out + "$"


def _any(path: Column, globs: list[str]) -> Column:
    hit = F.lit(False)
    for g in globs:
        hit = hit | path.rlike(glob_to_regex(g))
    return hit


def collect_files(spark: SparkSession, root: str, include: list[str], exclude: list[str] = (), tracked: DataFrame | None = None) -> DataFrame:
    """(file, content, length, modified): files under root by globs, each once; tracked (file) narrows them.

    Content is only read where it is used: a plan that asks for paths alone reads no bytes.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = raw.withColumn("file", F.regexp_replace(F.regexp_replace("path", r"^file:/+", "/"), "^" + _quote(root.removeprefix("file://").rstrip("/")) + "/", ""))
    out = base.filter(_any(c("file"), include) & ~_any(c("file"), list(exclude)))
    if tracked is not None:
        out = out.join(tracked.select("file").distinct(), "file", "left_semi")
    return out.select("file", c("content"), "length", c("modificationTime").alias("modified")).dropDuplicates(["file"])


def _quote(s: str) -> str:
    return "\\Q" + s + "\\E"


def tracked_files(spark: SparkSession, root: str) -> DataFrame | None:
    """(file): what git tracks below root; None outside a repository (then nothing is narrowed)."""
    got = subprocess.run(["git", "-C", root, "ls-files", "-z"], capture_output=True, text=True)
    if got.returncode:
        return None
    return spark.createDataFrame([(f,) for f in got.stdout.split("\0") if f], "file string")


def text_of(files: DataFrame) -> DataFrame:
    return files.select("file", c("content").cast("string").alias("content"), F.sha2("content", 256).alias("hash"))


def read_tasks(spark: SparkSession, path: str, existing: DataFrame | None = None) -> DataFrame:
    """Task rows; with `existing` (file) those of files that are gone are dropped."""
    out = spark.read.schema(schemas.TASK).option("mode", "FAILFAST").json(path, multiLine=True)
    return out if existing is None else out.join(existing.select("file"), "file", "left_semi")


def read_reviews(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(valid reviews, quarantined rows): invalid ones are counted, not lost."""
    raw = spark.read.schema(schemas.REVIEW + ", _corrupt_record string").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    raw = raw.withColumn("origin", F.col("_metadata.file_path"))
    good = c("_corrupt_record").isNull() & c("file").isNotNull() & c("symbols").isNotNull()
    for axis, values in schemas.VERDICTS.items():
        good = good & ~F.exists(F.transform("symbols", _get(axis)), _outside(values))
    return raw.filter(good).drop("_corrupt_record", "origin"), raw.filter(~F.coalesce(good, F.lit(False))).select("origin", "file")


def _get(field: str):
    return lambda s: s[field]


def _outside(values: list[str]):
    return lambda v: v.isNotNull() & ~v.isin([*values, "-"])


def normalize_review(df: DataFrame) -> DataFrame:
    """Lenient coercions: unknown rule severities are MEDIUM, rule ids stay within 1 to 17."""
    fix = lambda r: r.withField("severity", F.when(r["severity"].isin("CRITICAL", "HIGH", "MEDIUM", "LOW"), r["severity"]).otherwise("MEDIUM")).withField("rule_id", F.greatest(F.lit(1), F.least(F.lit(17), r["rule_id"])))
    return df.withColumn("best_practices", F.when(c("best_practices").isNotNull(), c("best_practices").withField("rules", F.transform("best_practices.rules", fix))))


def read_call_log(spark: SparkSession, path: str) -> DataFrame:
    """Append-only event log, one JSON object a line; broken lines are dropped."""
    return spark.read.schema(schemas.LLM_CALL).option("mode", "DROPMALFORMED").json(path)


def append_call_log(events: DataFrame, path: str) -> None:
    events.write.mode("append").json(path)


def read_markdown(spark: SparkSession, root: str, head_lines: int = 5) -> DataFrame:
    """(file, content, head) of *.md below root."""
    files = text_of(collect_files(spark, root, ["**/*.md"]))
    return files.withColumn("head", F.array_join(F.slice(F.split("content", "\n"), 1, head_lines), "\n"))


def coverage(raw: DataFrame) -> DataFrame:
    """Coverage map rows (file, statements array<(start, end, hits)>, functions array<int>, branches array<array<int>>) to totals.

    A line is total if any statement spans it, covered if one of these was hit. Spans are united, not listed line by line.
    """
    flat = F.flatten("branches")
    return raw.select(
        "file",
        F.size("statements").alias("statements_total"), F.size(F.filter("statements", lambda s: s["hits"] > 0)).alias("statements_covered"),
        F.size("functions").alias("functions_total"), F.size(F.filter("functions", lambda n: n > 0)).alias("functions_covered"),
        F.size(flat).alias("branches_total"), F.size(F.filter(flat, lambda n: n > 0)).alias("branches_covered"),
        union_length(c("statements")).cast("int").alias("lines_total"), union_length(F.filter("statements", lambda s: s["hits"] > 0)).cast("int").alias("lines_covered"),
    )


def output_name(path: Column) -> Column:
    """A flat name for a path that no other path has: slashes become dashes, a hash of the whole path follows."""
    return F.concat(F.regexp_replace(F.regexp_replace(path, r"\.[^./]+$", ""), "/", "-"), F.lit("-"), F.substring(F.sha2(path, 256), 1, 8))


def render_review(df: DataFrame) -> DataFrame:
    """(file, markdown): one section per review row (file, name, verdict columns, detail), symbols in order of name."""
    line = F.concat(F.lit("- **"), "name", F.lit("** — "), F.concat_ws(" · ", "correction", "overengineering", "utility", "duplication", "tests", "documentation"), F.lit(" ("), c("confidence").cast("string"), F.lit("%)\n  "), "detail")
    rows = df.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("name", line.alias("line")))).alias("rows"))
    return rows.select("file", F.concat(F.lit("# Review: "), "file", F.lit("\n\n"), F.array_join(F.transform("rows", lambda r: r["line"]), "\n"), F.lit("\n")).alias("markdown"))


def inject_block(text: Column, block: Column, start: str = "<!-- badge:start -->", end: str = "<!-- badge:end -->") -> Column:
    """Replace a marked block, or put it at the end; doing so twice changes nothing."""
    whole = F.concat(F.lit(start + "\n"), block, F.lit("\n" + end))
    at = F.instr(text, start)
    after = F.instr(text, end)
    return F.when((at > 0) & (after > at), F.concat(F.substring(text, 1, at - 1), whole, F.substring(text, after + len(end), F.length(text)))).otherwise(F.concat(F.rtrim(text), F.lit("\n\n"), whole, F.lit("\n")))


def write_reviews(reviews: DataFrame, markdown: DataFrame, root: str) -> None:
    """Reviews as JSON lines and their Markdown (file, markdown), each in a folder of its own."""
    reviews.write.mode("overwrite").json(f"{root}/json")
    markdown.write.mode("overwrite").parquet(f"{root}/markdown")


def write_transcripts(lines: DataFrame, root: str) -> None:
    """Log lines (file, at, line) in order, one folder a file."""
    rows = lines.repartition("file").sortWithinPartitions("file", "at").select(c("file"), c("line").alias("value"))
    rows.write.mode("append").partitionBy("file").text(root)

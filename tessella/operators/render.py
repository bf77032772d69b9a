"""Report texts: rendered from aggregates, one row a page, so that writing them is an ordinary sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators import report
from tessella.operators.rules import AXES, has_finding

c = F.col


def index(reviews: DataFrame, files: DataFrame) -> DataFrame:
    """(path, markdown): the report's index: verdict, health per axis and the files in order."""
    health = report.axis_health(reviews).withColumn("line", F.concat(F.lit("| "), "axis", F.lit(" | "), c("pct").cast("string"), F.lit(" % | "), report.health_bar(c("pct"), 1 - c("pct") / 100), F.lit(" |")))
    table = health.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("axis", "line"))), lambda r: r["line"]), "\n").alias("health"))
    rows = report.sort_findings(files).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", F.concat(F.lit("- `"), "file", F.lit("` — "), "verdict", F.lit(", "), c("n_findings").cast("string"), F.lit(" findings")).alias("line")))), lambda r: r["line"]), "\n").alias("files"))
    return table.join(F.broadcast(rows)).select(F.lit("index.md").alias("path"), F.concat(F.lit("# Report\n\n| axis | in order | |\n|-|-|-|\n"), "health", F.lit("\n\n## Files\n\n"), "files", F.lit("\n")).alias("markdown"))


def axis_shards(reviews: DataFrame, size: int = 10) -> DataFrame:
    """(path, markdown): for every axis its files with findings, `size` to a page."""
    pages = None
    for a in AXES:
        hits = reviews.filter(has_finding(a)).groupBy("file").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("name", c(a).alias("value"), "confidence", "detail"))).alias("rows"))
        hits = hits.withColumn("axis", F.lit(a)).withColumn("shard", F.ceil(F.row_number().over(Window.partitionBy("axis").orderBy(F.desc("n"), "file")) / size))
        pages = hits if pages is None else pages.unionByName(hits)
    line = lambda r: F.concat(F.lit("- **"), r["name"], F.lit("** "), r["value"], F.lit(" ("), r["confidence"].cast("string"), F.lit(" %): "), r["detail"])
    part = F.concat(F.lit("## `"), "file", F.lit("`\n\n"), F.array_join(F.transform("rows", line), "\n"))
    out = pages.withColumn("part", part).groupBy("axis", "shard").agg(F.array_sort(F.collect_list(F.struct((-c("n")).alias("n"), "file", "part"))).alias("parts"))
    return out.select(F.concat_ws("", c("axis"), F.lit("/shard-"), c("shard").cast("string"), F.lit(".md")).alias("path"), F.concat(F.lit("# "), "axis", F.lit("\n\n"), F.array_join(F.transform("parts", lambda p: p["part"]), "\n\n"), F.lit("\n")).alias("markdown"))


def message(reviews: DataFrame, files: DataFrame, top: int = 3) -> DataFrame:
    """One row (text): a short notification with health per axis and the worst files."""
    h = report.axis_health(reviews).agg(F.array_join(F.array_sort(F.collect_list(F.concat("axis", F.lit(" "), c("pct").cast("string"), F.lit(" %")))), " · ").alias("h"))
    w = report.sort_findings(files).filter(c("position") <= top).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "file"))), lambda r: r["file"]), ", ").alias("w"))
    return h.join(F.broadcast(w)).select(F.concat("h", F.lit("\n"), "w").alias("text"))


def tree_rows(files: DataFrame) -> DataFrame:
    """(path, depth, is_dir): every directory and file once, in the order of a printed tree (directories first)."""
    parts = F.split("file", "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(F.array_join(F.slice(parts, F.lit(1), n), "/").alias("path"), n.alias("depth"), (n < F.size(parts)).alias("is_dir")))
    return files.select(F.explode(up).alias("x")).select("x.*").distinct()


def ratio_bar(done: Column, total: Column, width: int = 20) -> Column:
    n = F.when(total > 0, F.round(width * done / total)).otherwise(0).cast("int")
    return F.concat(F.rpad(F.lit(""), n, "#"), F.rpad(F.lit(""), width - n, "."))


def status_counts(reviews: DataFrame) -> DataFrame:
    """One row of findings whatever their confidence."""
    return reviews.agg(F.count_if(c("utility") == "DEAD").alias("dead"), F.count_if(c("duplication") == "DUPLICATE").alias("duplicate"), F.count_if(c("overengineering") == "OVER").alias("over"), F.count_if(c("correction").isin("NEEDS_FIX", "ERROR")).alias("correction"))


def by_category(actions: DataFrame) -> DataFrame:
    """(category, n, files) of quickwin, refactor and hygiene actions."""
    return actions.groupBy("category").agg(F.count("*").alias("n"), F.count_distinct("file").alias("files"))


def merge_file_levels(rows: DataFrame) -> DataFrame:
    """rows (file, unused array, cycles array, note) to one per file: distinct lists, notes joined."""
    flat = lambda x: F.array_sort(F.array_distinct(F.flatten(F.collect_list(x)))).alias(x)
    return rows.groupBy("file").agg(flat("unused"), flat("cycles"), F.array_join(F.array_sort(F.collect_list(F.when(F.length("note") > 0, c("note")))), " | ").alias("note"))


def stories(lines: DataFrame) -> DataFrame:
    """lines (text, priority) of the form `[axis] file: text` to (axis, file, n, priority), most urgent first."""
    parts = lambda n: F.regexp_extract("text", r"^\[(\w+)\] ([^:]+): ", n)
    return lines.select(parts(1).alias("axis"), parts(2).alias("file"), "priority").filter("axis <> ''").groupBy("axis", "file").agg(F.count("*").alias("n"), F.min("priority").alias("priority"))


def sync_checked(actions: DataFrame, done: DataFrame) -> DataFrame:
    """actions (id, shard) with `checked` where a finished story (id) covers them, and whether the whole shard is."""
    d = done.select("id").distinct().withColumn("checked", F.lit(True))
    out = actions.join(d, "id", "left").withColumn("checked", F.coalesce("checked", F.lit(False)))
    return out.withColumn("shard_done", F.min("checked").over(Window.partitionBy("shard")))


def tree_text(rows: DataFrame) -> str:
    """The tree as text on the driver, one line a path: a listing for people, of one project."""
    kinds = {r.path: r.is_dir for r in rows.toLocalIterator()}
    key = lambda p: tuple((not kinds["/".join(p.split("/")[: i + 1])], x) for i, x in enumerate(p.split("/")))
    return "\n".join("  " * p.count("/") + p.rsplit("/", 1)[-1] + ("/" if kinds[p] else "") for p in sorted(kinds, key=key))


def write_pages(pages: DataFrame, root: str) -> None:
    """Rendered pages (path, markdown) as text below root, one folder a page."""
    pages.select("path", c("markdown").alias("value")).repartition("path").write.mode("overwrite").partitionBy("path").text(root)

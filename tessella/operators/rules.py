"""Rule cascades over symbol reviews: merging, coherence, refinement tiers and verdicts.

A symbol review is a row (file, name, exported, line_start, line_end, correction, overengineering, utility, duplication,
tests, documentation, confidence, detail). '-' in a verdict column means "not evaluated" and is a value, not null.
Every rule is a column expression, so a cascade is one projection; per-file verdicts are aggregates that combine before
they shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

AXES = ("correction", "overengineering", "utility", "duplication", "tests", "documentation")

#: Thresholds and keywords that decide verdicts.
VERDICT_CONFIDENCE, REPORT_CONFIDENCE, HIGH_CONFIDENCE, CONTRADICTED = 60, 30, 80, 55
CONTRADICTION_KEYWORDS = {
    13: ["injection", "xss", "eval", "secret", "hardcoded", "credential", "sanitiz", "escap"],
    1: ["strict mode", "implicit any", "noImplicitAny", "strictNullChecks", "null check"],
    14: ["n+1", "sync i/o", "synchronous", "blocking", "re-render", "performance"],
}
CLEAN_VALUES = {"correction": ["OK"], "overengineering": ["LEAN", "ACCEPTABLE"], "utility": ["USED"], "duplication": ["UNIQUE"], "tests": ["GOOD"], "documentation": ["DOCUMENTED"]}
SYSTEMIC_DEAD = 10

c = F.col


def merge_axes(symbols: DataFrame, results: DataFrame) -> DataFrame:
    """Verdicts per axis onto the scanned symbols: one pivot instead of a join per axis.

    results: (file, name, axis, pos, value, confidence, detail, failed). Of results that repeat a name the last one
    (largest pos) counts. An axis without a result gives '-'. confidence is the least over axes that did not fail, 80
    without any result, 0 if all failed; details are joined as `[VALUE] text` in axis order.
    """
    last = results.withColumn("rn", F.row_number().over(Window.partitionBy("file", "name", "axis").orderBy(F.desc("pos")))).filter("rn = 1")
    rows = last.groupBy("file", "name").agg(
        *[F.max(F.when((c("axis") == a) & ~c("failed"), c("value"))).alias(a) for a in AXES],
        F.min(F.when(~c("failed"), c("confidence"))).alias("least"),
        F.count("*").alias("n_results"),
        F.array_sort(F.collect_list(F.when(~c("failed") & (F.length("detail") > 0), F.struct(F.array_position(F.array(*[F.lit(a) for a in AXES]), c("axis")).alias("o"), F.concat(F.lit("["), "value", F.lit("] "), "detail").alias("d"))))).alias("parts"),
    )
    out = symbols.join(rows, ["file", "name"], "left")
    confidence = F.when(c("n_results").isNull(), 80).otherwise(F.coalesce("least", F.lit(0))).cast("int")
    detail = F.array_join(F.transform(F.coalesce("parts", F.array().cast("array<struct<o:bigint,d:string>>")), lambda p: p["d"]), " | ")
    return out.select(*symbols.columns, *[F.coalesce(a, F.lit("-")).alias(a) for a in AXES], confidence.alias("confidence"), detail.alias("detail"))


def parse_detail(detail: Column) -> Column:
    """Inverse of the joined detail: an array of (value, text)."""
    parts = F.split(detail, r" \| ")
    return F.transform(parts, lambda p: F.struct(F.regexp_extract(p, r"^\[([^\]]*)\] ", 1).alias("value"), F.regexp_replace(p, r"^\[[^\]]*\] ", "").alias("text")))


def coherence(df: DataFrame, parity: bool = False) -> DataFrame:
    """Dead code needs no tests or documentation, errors moot complexity, small private symbols are let off.

    Values '-' stay '-'; with parity=True they are overwritten as well.
    """
    on = lambda axis: F.lit(True) if parity else c(axis) != "-"
    dead = c("utility") == "DEAD"
    df = df.withColumn("tests", F.when(dead & on("tests"), "NONE").otherwise(c("tests")))
    df = df.withColumn("overengineering", F.when((c("correction") == "ERROR") & on("overengineering"), "ACCEPTABLE").otherwise(c("overengineering")))
    df = df.withColumn("documentation", F.when(dead & on("documentation"), "UNDOCUMENTED").otherwise(c("documentation")))
    small = ~c("exported") & (c("line_end") - c("line_start") + 1 < 15)
    undocumented, untested = small & (c("documentation") == "UNDOCUMENTED"), small & (c("tests") == "NONE")
    confidence = F.when(undocumented | untested, F.least(c("confidence"), F.lit(60))).otherwise(c("confidence"))
    return df.withColumns({"confidence": confidence, "documentation": F.when(undocumented, "DOCUMENTED").otherwise(c("documentation")), "tests": F.when(untested, "WEAK").otherwise(c("tests"))})


def contradictions(df: DataFrame, rules: DataFrame) -> DataFrame:
    """Cap confidence at 55 where a passed best-practice rule speaks against a NEEDS_FIX.

    rules: (file, rule_id, status). Passing rules come as one array per file.
    """
    passed = rules.filter("status = 'PASS'").groupBy("file").agg(F.collect_set("rule_id").alias("passed"))
    low = F.lower("detail")
    hit = F.lit(False)
    for rule, words in CONTRADICTION_KEYWORDS.items():
        says = F.lit(False)
        for w in words:
            says = says | low.contains(w)
        hit = hit | (F.array_contains(F.coalesce("passed", F.array().cast("array<int>")), rule) & says)
    out = df.join(passed, "file", "left")
    return out.withColumn("confidence", F.when((c("correction") == "NEEDS_FIX") & hit, F.least(c("confidence"), F.lit(CONTRADICTED))).otherwise(c("confidence"))).drop("passed")


def symbol_severity() -> Column:
    """One severity per symbol over all axes, first match."""
    sure = c("confidence") >= HIGH_CONFIDENCE
    medium = c("correction").eqNullSafe("NEEDS_FIX") | (c("utility") == "DEAD") | (c("duplication") == "DUPLICATE")
    return F.when(c("correction") == "ERROR", "high").when(medium & sure, "high").when(medium | (c("overengineering") == "OVER"), "medium").otherwise("low")


def has_finding(axis: str) -> Column:
    """Whether a symbol shows a finding on an axis."""
    return {
        "correction": c("correction").isin("NEEDS_FIX", "ERROR"), "utility": c("utility").isin("DEAD", "LOW_VALUE"), "duplication": c("duplication") == "DUPLICATE",
        "overengineering": c("overengineering") == "OVER", "tests": c("tests").isin("WEAK", "NONE"),
        "documentation": (c("documentation") == "PARTIAL") | ((c("documentation") == "UNDOCUMENTED") & c("exported")),
    }[axis]


def _worst() -> Column:
    return (c("utility") == "DEAD") | (c("duplication") == "DUPLICATE") | (c("overengineering") == "OVER") | ((c("documentation") == "UNDOCUMENTED") & c("exported"))


def _verdict(critical: Column, refactor: Column) -> Column:
    return F.when(critical, "CRITICAL").when(refactor, "NEEDS_REFACTOR").otherwise("CLEAN")


def verdict_merged(partial: bool = True) -> Column:
    """Aggregate: verdict of a file after merging; partial=False is that of the refinement tiers."""
    sure = c("confidence") >= VERDICT_CONFIDENCE
    refactor = F.coalesce(F.bool_or(sure & ((c("correction") == "NEEDS_FIX") | _worst())), F.lit(False))
    if partial:
        refactor = refactor | (F.count_if(sure & (c("documentation") == "PARTIAL")) >= 3)
    return _verdict(F.coalesce(F.bool_or(sure & (c("correction") == "ERROR")), F.lit(False)), refactor)


def verdict_deliberated(model: Column) -> Column:
    """Aggregate: any finding counts whatever its confidence, and the model's verdict is the floor."""
    finding = c("correction").isin("NEEDS_FIX") | c("utility").isin("DEAD", "LOW_VALUE") | (c("duplication") == "DUPLICATE") | (c("overengineering") == "OVER") | c("tests").isin("WEAK", "NONE") | c("documentation").isin("UNDOCUMENTED", "PARTIAL")
    error = F.coalesce(F.bool_or(c("correction") == "ERROR"), F.lit(False))
    said = F.max(model)
    return F.when(error, "CRITICAL").when((said == "CLEAN") & F.bool_or(finding), "NEEDS_REFACTOR").otherwise(said)


def verdict_reported(any_fail: Column) -> Column:
    """Aggregate: the report's verdict; a failed best-practice rule alone asks for refactoring."""
    sure = c("confidence") >= VERDICT_CONFIDENCE
    issue = F.lit(False)
    for a in AXES:
        issue = issue | has_finding(a)
    return _verdict(F.coalesce(F.bool_or(sure & (c("correction") == "ERROR")), F.lit(False)), F.coalesce(F.bool_or(sure & issue), F.lit(False)) | F.coalesce(F.bool_or(any_fail), F.lit(False)))


def global_verdict(files: DataFrame, column: str = "verdict") -> DataFrame:
    """One row: the worst verdict of all files; CLEAN without any."""
    rank = F.max(F.when(c(column) == "CRITICAL", 2).when(c(column) == "NEEDS_REFACTOR", 1).otherwise(0))
    return files.agg(F.when(rank == 2, "CRITICAL").when(rank == 1, "NEEDS_REFACTOR").otherwise("CLEAN").alias("verdict"))


def tier1(df: DataFrame, usage: DataFrame, neighbours: DataFrame) -> DataFrame:
    """Deterministic re-classification from what the usage graph and the similarity search know.

    usage: (file, name, n_importers); neighbours: (file, name, top_score); both left-joined. Adds is_entry-free rules:
    DEAD with importers is USED, DUPLICATE without a neighbour of 0.68 and without a target is UNIQUE, OVER below 6
    lines is LEAN, an exported LEAN class of 15 lines with one importer at most is OVER, a private or type-like
    UNDOCUMENTED symbol of 2 lines at most is DOCUMENTED. Adds n_changed.
    """
    out = df.join(usage, ["file", "name"], "left").join(neighbours, ["file", "name"], "left")
    lines = c("line_end") - c("line_start") + 1
    importers = F.coalesce("n_importers", F.lit(0))
    entry = F.lower("name").rlike("^(main|index|app|server|cli|plugin|handler)$")
    rules = {
        "utility": F.when((c("utility") == "DEAD") & (importers > 0), "USED").otherwise(c("utility")),
        "duplication": F.when((c("duplication") == "DUPLICATE") & c("duplicate_target").isNull() & (F.coalesce("top_score", F.lit(0.0)) < 0.68), "UNIQUE").otherwise(c("duplication")),
        "overengineering": F.when((c("overengineering") == "OVER") & (lines <= 5), "LEAN").when((c("overengineering") == "LEAN") & (c("kind") == "class") & c("exported") & (lines >= 15) & (importers <= 1) & ~entry, "OVER").otherwise(c("overengineering")),
        "documentation": F.when((c("documentation") == "UNDOCUMENTED") & (lines <= 2), "DOCUMENTED").otherwise(c("documentation")),
    }
    changed = sum(((new != c(a)).cast("int") for a, new in rules.items()), F.lit(0))
    return out.withColumns({**rules, "n_changed": changed}).drop("n_importers", "top_score")


def tier2(df: DataFrame) -> DataFrame:
    """Moot findings of dead and low-value code, and `escalated`: why a symbol needs a closer look (null if not)."""
    others = F.lit(True)
    for a in AXES[1:]:
        others = others & (c(a).isin(*CLEAN_VALUES[a]) | (c(a) == "-"))
    error = c("correction") == "ERROR"
    dead, low = (c("utility") == "DEAD") & ~error, (c("utility") == "LOW_VALUE") & ~error
    fixes = c("correction") == "NEEDS_FIX"
    behavioural = F.lower("detail").rlike("behavio|return value|side effect|breaking|semantics")
    why = F.when(error, "error").when(dead, None).when(fixes & others & (c("confidence") < 75), "isolated").when(fixes & behavioural, "behavioural")
    return df.withColumns({
        "escalated": why,
        "correction": F.when(dead & fixes, "OK").otherwise(c("correction")),
        "overengineering": F.when((dead | low) & (c("overengineering") == "OVER"), "ACCEPTABLE").otherwise(c("overengineering")),
        "tests": F.when(dead & c("tests").isin("WEAK", "NONE"), "-").otherwise(c("tests")),
        "documentation": F.when((dead | low) & c("documentation").isin("UNDOCUMENTED", "PARTIAL"), "-").otherwise(c("documentation")),
    })


def needs_deliberation() -> Column:
    """Aggregate: whether a file goes to deliberation: any finding below certainty, or a clean file nobody is sure of."""
    finding = F.lit(False)
    for a in AXES:
        finding = finding | has_finding(a)
    return F.coalesce(F.bool_or(finding & (c("confidence") < 95)), F.lit(False)) | (~F.coalesce(F.bool_or(finding), F.lit(False)) & F.coalesce(F.min("confidence") < 70, F.lit(False)))


def apply_deliberation(df: DataFrame, said: DataFrame) -> DataFrame:
    """Verdicts of a model (file, name, axis, value, confidence) over the reviews; an ERROR below 95 stays one."""
    wide = said.groupBy("file", "name").agg(*[F.max(F.when(c("axis") == a, c("value"))).alias(f"new_{a}") for a in AXES], F.max("confidence").alias("new_confidence"))
    out = df.join(wide, ["file", "name"], "left")
    guarded = (c("correction") == "ERROR") & (c("new_correction") != "ERROR") & (F.coalesce("new_confidence", F.lit(0)) < 95)
    values = {a: F.coalesce(c(f"new_{a}"), c(a)) for a in AXES}
    values["correction"] = F.when(guarded, c("correction")).otherwise(values["correction"])
    values["confidence"] = F.coalesce("new_confidence", "confidence")
    return out.withColumns(values).drop(*[f"new_{a}" for a in AXES], "new_confidence")


def drop_ok_ranges(actions: DataFrame, ok: DataFrame) -> DataFrame:
    """Actions whose line lies in no range that a second pass found in order: a range anti-join within the file."""
    o = ok.select(c("file").alias("o_file"), "start", "end")
    return actions.join(o, (c("file") == c("o_file")) & (c("line") >= c("start")) & (c("line") <= c("end")), "left_anti")


def synthesize_actions(df: DataFrame) -> DataFrame:
    """Up to six rows (file, name, axis, severity, category) per symbol that one can trust."""
    row = lambda a, category: F.when(has_finding(a), F.struct(F.lit(a).alias("axis"), symbol_severity().alias("severity"), F.lit(category).alias("category")))
    kinds = {"correction": "quickwin", "utility": "quickwin", "duplication": "refactor", "overengineering": "refactor", "tests": "hygiene", "documentation": "hygiene"}
    rows = F.filter(F.array(*[row(a, k) for a, k in kinds.items()]), lambda x: x.isNotNull())
    return df.filter(c("confidence") >= REPORT_CONFIDENCE).select("file", "name", F.explode(rows).alias("a")).select("file", "name", "a.*")


def merge_actions(parts: list[tuple[str, DataFrame]]) -> DataFrame:
    """Union of the actions of all axes with their source, numbered per file in order of source and id."""
    out = None
    for source, df in parts:
        df = df.withColumn("source", F.lit(source))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out.withColumn("id", F.row_number().over(Window.partitionBy("file").orderBy("source", "id")))


def group_identical(actions: DataFrame, least: int = 3) -> DataFrame:
    """Actions alike but for the symbol's name, `least` or more in a file, become one row that lists their targets."""
    blank = F.expr("replace(description, target, '<symbol>')")
    groups = actions.withColumn("pattern", blank).groupBy("file", "source", "category", "pattern").agg(F.count("*").alias("n"), F.min("id").alias("id"), F.array_sort(F.collect_list(F.struct("id", "target", "description"))).alias("rows"))
    many = groups.filter(c("n") >= least).select("file", "source", "category", "id", "n", c("pattern").alias("description"), F.array_join(F.transform("rows", lambda r: r["target"]), ", ").alias("target"))
    few = groups.filter(c("n") < least).select("file", "source", "category", F.explode("rows").alias("r")).select("file", "source", "category", c("r.id").alias("id"), F.lit(1).cast("long").alias("n"), c("r.description").alias("description"), c("r.target").alias("target"))
    return many.unionByName(few)


def enforce_duplication() -> Column:
    """A target makes an evaluated symbol a duplicate."""
    return F.when(c("duplicate_target").isNotNull() & (c("duplication") != "-"), "DUPLICATE").otherwise(c("duplication"))


def without_test_files(df: DataFrame, tested: DataFrame) -> DataFrame:
    """WEAK tests of files that no test file (file) belongs to are NONE."""
    t = tested.select("file").distinct().withColumn("has_tests", F.lit(True))
    return df.join(t, "file", "left").withColumn("tests", F.when((c("tests") == "WEAK") & c("has_tests").isNull(), "NONE").otherwise(c("tests"))).drop("has_tests")


def data_files_documented(df: DataFrame) -> DataFrame:
    """Symbols of JSON files need no documentation."""
    return df.withColumn("documentation", F.when(c("file").endswith(".json"), "DOCUMENTED").otherwise(c("documentation")))

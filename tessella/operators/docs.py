"""Documentation: sections, scoring, mapping, coverage gaps and linting."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from tessella.functions import text as T

c = F.col

# Limits of the chunker and weights of the score.
SECTION_FLOOR, PARAGRAPH_FLOOR, SPLIT_AT, BATCH_CHARS = 50, 20, 600, 30_000
REQUIRED_PAGES = [r"(?i)(?:^|/)index\.md$", r"(?i)(?:^|/)(?:\d+-)?getting-started", r"(?i)(?:^|/)(?:\d+-)?architecture", r"(?i)(?:^|/)(?:\d+-)?api-reference", r"(?i)(?:^|/)(?:\d+-)?development"]
TYPE_PAGES = {
    "Backend API": [r"(?i)rest-endpoints|routes|controllers|endpoints", r"(?i)authentication|auth"],
    "ORM": [r"(?i)data-model|models|entities", r"(?i)migration"],
    "Frontend": [r"(?i)component-api|components", r"(?i)state-management|stores"],
    "CLI": [r"(?i)cli-reference|cli"],
    "Monorepo": [r"(?i)package-overview|packages"],
}
WEIGHTS = {"structural": 25, "api": 25, "module": 20, "quality": 15, "navigation": 15}
MODULE_LOC, MODULE_FILES = 200, 3
_STEPS = [(re.compile(r"```.*?```", re.S), ""), (re.compile(r"`([^`\n]+)`"), r"\1"), (re.compile(r"^\|.*\|$", re.M), ""), (re.compile(r"^>\s.*$", re.M), ""), (re.compile(r"<[^>]+>"), ""), (re.compile(r"^---+$", re.M), ""), (re.compile(r"^\s*\n", re.M), "\n")]


def _prose(text: str) -> str:
    for pattern, by in _STEPS:
        text = pattern.sub(by, text)
    return text.strip()


def _headed_blocks(source: str, deepest: int, fences: bool) -> Iterator[tuple[str | None, str]]:
    """(heading, text) between headings of level 2 to `deepest`; text before the first has no heading."""
    heading, above, lines, fenced = None, None, [], False
    for line in source.split("\n"):
        if fences and line.startswith("```"):
            fenced = not fenced
        m = None if fenced else re.match(r"(#{2,3})\s+(.+)", line)
        if m and len(m.group(1)) <= deepest:
            if heading is None or lines:
                yield heading, "\n".join(lines)
            lines, title = [], m.group(2).strip()
            if len(m.group(1)) == 2:
                above = heading = title
            else:
                heading = f"{above} — {title}" if above else title
        elif heading is not None or not re.match(r"#\s+", line):
            lines.append(line)
    yield heading, "\n".join(lines)


def h2_sections(source: str) -> list[tuple[str, str, str]]:
    """(heading, prose, content) per H2 section with 50 characters of prose; text before them is the Introduction."""
    found = []
    for heading, raw in _headed_blocks(source, 2, False):
        prose = _prose(raw)
        if len(prose) >= SECTION_FLOOR:
            found.append((heading or "Introduction", prose, raw.strip()))
    return found


def smart_sections(source: str) -> list[tuple[str, str, str]]:
    """H2 and H3 sections outside fences; long ones are split between paragraphs, later parts marked (cont.)."""
    found = []
    for heading, raw in _headed_blocks(source, 3, True):
        raw, heading = raw.strip(), heading or "Introduction"
        prose = _prose(raw)
        if len(prose) < SECTION_FLOOR:
            continue
        if len(prose) <= SPLIT_AT:
            found.append((heading, prose, raw))
            continue
        part, texts, held = 0, [], ""
        name = lambda: heading if part == 0 else f"{heading} (cont.)"  # noqa: B023, E731
        for paragraph in re.split(r"\n\n+", raw):
            own = _prose(paragraph)
            joined = held if len(own) < PARAGRAPH_FLOOR else f"{held}\n{own}" if held else own
            if len(joined) > SPLIT_AT and len(held) >= SECTION_FLOOR and joined is not held:
                found.append((name(), held, "\n\n".join(texts)))
                part, texts, held = part + 1, [paragraph], own
            else:
                texts.append(paragraph)
                held = joined
        if len(held) >= SECTION_FLOOR:
            found.append((name(), held, "\n\n".join(texts)))
    return found


def chunk(docs: DataFrame, smart: bool = True) -> DataFrame:
    """docs (file, content) to (file, ordinal, heading, embed_text, content, id); one task step, no shuffle."""
    split = smart_sections if smart else h2_sections

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = [(f, i, *s) for f, text in zip(pdf["file"], pdf["content"], strict=True) for i, s in enumerate(split(text or ""))]
            yield pd.DataFrame(rows, columns=["file", "ordinal", "heading", "embed_text", "content"])

    out = docs.select("file", "content").mapInPandas(run, "file string, ordinal int, heading string, embed_text string, content string")
    return out.withColumn("id", T.section_id(c("file"), c("heading"), c("ordinal")))


def _folded(rows: DataFrame, key: str, order: list, schema: T_.StructType, start: Callable, step: Callable) -> DataFrame:
    """rows with a value per row (null: the row is dropped) that depends on those before it under the same key.

    A key's rows come sorted to one task and are folded as they stream by: no row holds a whole key, and memory follows
    a batch of Arrow rows. step(state, row) gives (state, value).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = object(), None
        for batch in batches:
            values = []
            for row in batch.to_pylist():
                if row[key] != last:
                    last, state = row[key], start()
                state, value = step(state, row)
                values.append(value)
            got = pa.array(values, pa.int32())
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in schema.fields[:-1]), got], names=schema.names).filter(got.is_valid())

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)


def greedy_batches(rows: DataFrame, key: str, order: str, size: str, limit: int = BATCH_CHARS) -> DataFrame:
    """(key, order, batch): filled in order until the next row would not fit; one larger than the limit is alone.

    The running sum starts anew with each batch, which no window frame can say.
    """

    def step(state, row):
        used, batch = state
        n = row[size] or 0
        if used and used + n > limit:
            used, batch = 0, batch + 1
        return (used + n, batch), batch

    some = rows.select(key, order, size)
    schema = T_.StructType([some.schema[key], some.schema[order], T_.StructField("batch", T_.IntegerType())])
    return _folded(some, key, [order], schema, lambda: (0, 0), step)


def pack_sections(sections: DataFrame, budget: int) -> DataFrame:
    """Sections (package, position, score, size) to keep: the first one, then by score what still fits."""

    def step(used, row):
        takes = not row["later"] or (row["score"] > 0 and used + row["size"] <= budget)
        return (used + row["size"], 1) if takes else (used, None)

    some = sections.select("package", "position", "score", "size", (c("position") > 0).alias("later"))
    schema = T_.StructType([some.schema["package"], some.schema["position"], T_.StructField("kept", T_.IntegerType())])
    return _folded(some, "package", ["later", F.desc("score"), "position"], schema, lambda: 0, step).drop("kept")


def weights(types: Column) -> dict[str, Column]:
    """Weights of the five dimensions: types raise structure and API at the cost of the others."""
    has = lambda t: F.array_contains(types, t).cast("int")
    structure = 10 * (has("Backend API") + has("ORM") + has("Frontend") + has("Monorepo"))
    api = 15 * has("Library")
    pool = WEIGHTS["module"] + WEIGHTS["quality"] + WEIGHTS["navigation"]
    factor = (pool - F.least(structure + api, F.lit(pool))) / F.lit(float(pool))
    module, quality = (F.round(WEIGHTS[k] * factor).cast("int") for k in ("module", "quality"))
    s, a = WEIGHTS["structural"] + structure, WEIGHTS["api"] + api
    return {"structural": s, "api": a, "module": module, "quality": quality, "navigation": F.greatest(F.lit(0), 100 - s - a - module - quality)}


def structural(pages: Column, types: Column) -> Column:
    """Percent of required pages that are there."""
    has_page = lambda r: F.exists(pages, lambda p: p.rlike(r)).cast("int")
    found = lambda patterns: sum((has_page(r) for r in patterns), F.lit(0))
    n, hit = F.lit(len(REQUIRED_PAGES)), found(REQUIRED_PAGES)
    for kind, patterns in TYPE_PAGES.items():
        has = F.array_contains(types, kind)
        n = n + F.when(has, len(patterns)).otherwise(0)
        hit = hit + F.when(has, found(patterns)).otherwise(0)
    return F.round(100 * hit / n).cast("long")


def navigation(pages: Column, ideal: Column) -> Column:
    index = F.when(F.exists(pages, lambda p: p.rlike(REQUIRED_PAGES[0])), 50).otherwise(0)
    return F.when(ideal == 0, 100).otherwise(F.round(index + F.least(F.lit(1.0), F.size(pages) / ideal) * 50)).cast("long")


def score(df: DataFrame) -> DataFrame:
    """Adds the five dimensions, overall, verdict and sync_gap to rows of pages, types, ideal_pages and counts."""
    dims = {"structural": structural(c("pages"), c("types")), "api": T.safe_percent(c("exports_documented"), c("exports")), "module": T.safe_percent(c("modules_documented"), c("modules")), "quality": c("content_quality").cast("long"), "navigation": navigation(c("pages"), c("ideal_pages"))}
    out = df.withColumns({f"{k}_pct": v for k, v in dims.items()})
    overall = F.round(sum((c(f"{k}_pct") * w for k, w in weights(c("types")).items()), F.lit(0)) / 100).cast("long")
    out = out.withColumn("overall", overall)
    return out.withColumn("verdict", F.when(c("overall") >= 80, "DOCUMENTED").when(c("overall") >= 50, "PARTIAL").otherwise("UNDOCUMENTED")).withColumn("sync_gap", F.greatest(F.lit(0), c("ideal_pages") - F.size("pages")).cast("long"))


def module_pages(files: DataFrame) -> DataFrame:
    """files (module, name, loc) to numbered pages: one for a module of three files of 200 lines, else one for each."""
    large = files.filter(c("loc") >= MODULE_LOC).withColumn("n", F.count("*").over(Window.partitionBy("module")))
    base = F.regexp_replace("name", r"\.[^.]+$", "")
    pages = large.select(F.when(c("n") >= MODULE_FILES, c("module")).otherwise(base).alias("title"), "module", (c("n") >= MODULE_FILES).alias("whole")).distinct()
    path = F.concat(F.lit("05-Modules/"), T.kebab(c("title")), F.lit(".md"))
    # Numbering is over pages, some hundred per project.
    number = F.lpad(F.row_number().over(Window.orderBy(path, "module")).cast("string"), 2, "0")
    return pages.select("title", "module", "whole", F.concat(F.lit("05-Modules/"), number, F.lit("-"), T.kebab(c("title")), F.lit(".md")).alias("path"))


def concept_frequency(concepts: DataFrame, least: int = 5, top: int = 30) -> DataFrame:
    """The most frequent concepts (trimmed, lower case, two characters at least), ties by name."""
    term = F.lower(F.trim("concept"))
    counts = concepts.select(term.alias("concept")).filter(F.length("concept") >= 2).groupBy("concept").agg(F.count("*").alias("n")).filter(c("n") >= least)
    return counts.orderBy(F.desc("n"), "concept").limit(top)


def longest_prefix(paths: DataFrame, mapping: DataFrame) -> DataFrame:
    """paths (path) with the target of the longest mapping prefix: a path is expanded to its own prefixes and hash-joined.

    A mapping may be far larger than the depth of a path, so prefixes of the path are the side that is expanded.
    """
    parts = F.split("path", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    hits = paths.distinct().select("path", F.explode(prefixes).alias("prefix")).join(mapping, "prefix")
    best = hits.groupBy("path").agg(F.max_by(F.struct("prefix", "target"), F.length("prefix")).alias("b")).select("path", c("b.prefix").alias("prefix"), c("b.target").alias("target"))
    return paths.join(best, "path", "left")


def interleave(rows: DataFrame, key: str, source: str, order: str, limit: int = 3) -> DataFrame:
    """Per key the first rows of all sources in turn, `limit` altogether."""
    turn = F.row_number().over(Window.partitionBy(key, source).orderBy(order))
    place = F.row_number().over(Window.partitionBy(key).orderBy("turn", source))
    return rows.withColumn("turn", turn).filter(c("turn") <= limit).withColumn("place", place).filter(c("place") <= limit).drop("turn")


def page_diff(now: DataFrame, cached: DataFrame) -> DataFrame:
    """(page, state): fresh, stale, added or removed, from maps page -> {file: hash} held as rows (page, file, hash)."""
    fold = lambda df, n: df.groupBy("page").agg(F.array_sort(F.collect_set(F.struct("file", "hash"))).alias(n))
    both = fold(now, "a").join(fold(cached, "b"), "page", "full_outer")
    return both.select("page", F.when(c("b").isNull(), "added").when(c("a").isNull(), "removed").when(c("a") == c("b"), "fresh").otherwise("stale").alias("state"))


def lint(pages: DataFrame) -> DataFrame:
    """(file, rule) of structural faults in pages (file, content): headings, fences, numbering, index and links."""
    text, name = c("content"), F.element_at(F.split("file", "/"), -1)
    heads = F.size(F.regexp_extract_all(F.regexp_replace("content", r"(?s)```.*?```", ""), F.lit(r"(?m)^#\s+(.+)$"), 1))
    single = [
        ("preamble", ~F.ltrim(text).rlike(r"^(#|<!--)")), ("wrapped-in-fence", text.rlike(r"(?s)\A\s*```(?:markdown|md)?\n.*```\s*\z")),
        ("no-h1", heads == 0), ("many-h1", heads > 1), ("empty", F.length(F.trim(text)) == 0),
    ]
    rules = pages.select("file", F.explode(F.filter(F.array(*[F.when(p, F.lit(n)) for n, p in single]), lambda x: x.isNotNull())).alias("rule"))
    numbered = pages.select("file", F.regexp_replace("file", "/?[^/]*$", "").alias("dir"), F.regexp_extract(name, r"^(\d+)-", 1).try_cast("int").alias("number")).filter("number is not null")
    gap = numbered.withColumn("before", F.lag("number").over(Window.partitionBy("dir").orderBy("number", "file"))).filter(c("number") - c("before") > 1).select("file", F.lit("numbering-gap").alias("rule"))
    index = pages.filter(name == "index.md").select(F.explode(F.regexp_extract_all("content", F.lit(r"\]\(([^)#\s]+\.md)"), 1)).alias("target")).select(F.regexp_replace("target", r"^\./", "").alias("target")).distinct()
    others = pages.filter(name != "index.md")
    orphan = others.join(index, c("file") == c("target"), "left_anti").select("file", F.lit("not-in-index").alias("rule"))
    missing = index.join(pages, c("file") == c("target"), "left_anti").select(c("target").alias("file"), F.lit("index-of-missing").alias("rule"))
    links = others.select("file", F.explode(F.regexp_extract_all("content", F.lit(r"\]\(([^)#\s:]+\.md)"), 1)).alias("target"))
    broken = links.join(pages.select(c("file").alias("known")), F.regexp_replace("target", r"^\./", "") == c("known"), "left_anti").select("file", F.lit("broken-link").alias("rule")).distinct()
    return rules.unionAll(gap).unionAll(orphan).unionAll(missing).unionAll(broken)


def sections_by_prefix(pages: DataFrame) -> DataFrame:
    """(section, place, pages): sections ordered by their numeric prefix, those without one last."""
    section = F.when(F.instr("file", "/") > 0, F.substring_index("file", "/", 1)).otherwise("")
    number = F.coalesce(F.regexp_extract(section, r"^(\d+)", 1).try_cast("int"), F.lit(99))
    return pages.groupBy(section.alias("section")).agg(F.min(number).alias("place"), F.array_sort(F.collect_list("file")).alias("pages"))

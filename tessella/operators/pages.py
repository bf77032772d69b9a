"""Documentation plans: which pages there should be, which there are, and what they lack."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.operators import similarity as S

c = F.col

# Conventions of the page layout.
CONVENTIONS = {
    "routes": "04-API-Reference/04-REST-Endpoints.md",
    "controllers": "04-API-Reference/04-REST-Endpoints.md",
    "middleware": "04-API-Reference/05-Middleware.md",
    "commands": "04-API-Reference/04-CLI-Reference.md",
    "components": "05-Modules/Components.md",
    "hooks": "05-Modules/Hooks.md",
    "stores": "05-Modules/Stores.md",
    "styles": "05-Modules/Styles.md",
    "models": "05-Modules/Models.md",
    "services": "05-Modules/Services.md",
    "validators": "05-Modules/Validators.md",
    "dtos": "05-Modules/DTOs.md",
    "migrations": "05-Modules/Migrations.md",
}
SYNONYMS = {"api": "routes", "handlers": "controllers", "entities": "models", "composables": "hooks"}
PATTERN_PAGES = {"@Controller()": "04-API-Reference/04-REST-Endpoints.md", "express.Router()": "04-API-Reference/04-REST-Endpoints.md", "@Injectable()": "05-Modules/Services.md"}
CONCEPT_OF_DIR = {"00-Monorepo": "monorepo", "01-Getting-Started": "getting-started", "02-Architecture": "architecture", "03-Guides": "guides", "04-API-Reference": "api-reference", "05-Modules": "modules", "06-Development": "development"}
BASE_PAGES = [
    "index.md",
    "01-Getting-Started/01-Overview.md", "01-Getting-Started/02-Installation.md", "01-Getting-Started/03-Configuration.md", "01-Getting-Started/04-Quick-Start.md",
    "02-Architecture/01-System-Overview.md", "02-Architecture/02-Core-Concepts.md", "02-Architecture/03-Data-Flow.md", "02-Architecture/04-Design-Decisions.md",
    "03-Guides/01-Common-Workflows.md", "03-Guides/02-Advanced-Configuration.md", "03-Guides/03-Troubleshooting.md",
    "04-API-Reference/01-Public-API.md", "04-API-Reference/02-Configuration-Schema.md", "04-API-Reference/03-Types-and-Interfaces.md",
    "06-Development/01-Source-Tree.md", "06-Development/02-Build-and-Test.md", "06-Development/03-Code-Conventions.md", "06-Development/04-Release-Process.md",
]
TYPE_PAGES = {
    "CLI": ["04-API-Reference/04-CLI-Reference.md"],
    "Frontend": ["03-Guides/04-Component-Patterns.md", "03-Guides/05-State-Management.md", "03-Guides/06-Routing.md", "04-API-Reference/04-Component-API.md", "05-Modules/Components.md", "05-Modules/Hooks.md", "05-Modules/Stores.md", "05-Modules/Styles.md"],
    "Backend API": ["03-Guides/04-Authentication.md", "03-Guides/05-Error-Handling.md", "03-Guides/06-Pagination-and-Filtering.md", "04-API-Reference/04-REST-Endpoints.md", "04-API-Reference/05-Middleware.md", "05-Modules/Routes.md", "05-Modules/Services.md", "05-Modules/Validators.md", "05-Modules/DTOs.md"],
    "ORM": ["02-Architecture/05-Data-Model.md", "03-Guides/07-Migrations.md", "03-Guides/08-Seeding.md", "03-Guides/09-Query-Patterns.md", "05-Modules/Models.md", "05-Modules/Migrations.md"],
    "Monorepo": ["00-Monorepo/01-Package-Overview.md", "00-Monorepo/02-Dependency-Graph.md", "00-Monorepo/03-Shared-Conventions.md"],
}
LEAST_LOC = 200


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def doc_mappings(dirs: DataFrame) -> DataFrame:
    """(dir, page, strategy) of dirs (dir, loc, patterns): convention, synonym, framework, else a page of its own."""
    name = F.lower("dir")
    convention, synonym = _lookup(CONVENTIONS, name), _lookup(CONVENTIONS, _lookup(SYNONYMS, name))
    framework = F.coalesce(*[F.when(F.array_contains("patterns", p), F.lit(page)) for p, page in PATTERN_PAGES.items()])
    strategy = F.when(convention.isNotNull(), "convention").when(synonym.isNotNull(), "synonym").when(framework.isNotNull(), "framework").otherwise("catch-all")
    own = F.concat(F.lit("05-Modules/"), T.kebab(c("dir")), F.lit(".md"))
    return dirs.filter(c("loc") >= LEAST_LOC).select("dir", F.coalesce(convention, synonym, framework, own).alias("page"), strategy.alias("strategy"))


def page_list(project: DataFrame, modules: DataFrame) -> DataFrame:
    """(path): base pages, those of the project's types (one row `types`), and module pages (path); 06- moves up without modules."""
    spark = project.sparkSession
    base = spark.createDataFrame([(p,) for p in BASE_PAGES], "path string")
    typed = spark.createDataFrame([(t, p) for t, ps in TYPE_PAGES.items() for p in ps], "type string, path string")
    typed = typed.join(project.select(F.explode("types").alias("type")).distinct(), "type", "left_semi").select("path")
    every = reduce(DataFrame.unionByName, [base, typed, modules.select("path")]).distinct()
    some = modules.agg((F.count("*") > 0).alias("some"))
    return every.join(F.broadcast(some)).select(F.when(~c("some"), F.regexp_replace("path", "^06-", "05-")).otherwise(c("path")).alias("path"))


def page_sources(pages: DataFrame, modules: DataFrame) -> DataFrame:
    """(page, file): sources of module pages by title, each page once; modules (module, file)."""
    title = F.regexp_replace(F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.md$", ""), r"^\d+-", "")
    named = pages.select(c("path").alias("page"), title.alias("kebab"))
    return named.join(modules.select(T.kebab(c("module")).alias("kebab"), "file"), "kebab").select("page", "file").distinct()


def pages_to_update(sources: DataFrame, changed: DataFrame) -> DataFrame:
    """(page): pages that a changed file belongs to."""
    return sources.join(changed.select("file"), "file", "left_semi").select("page").distinct()


def classify_user_docs(pages: DataFrame) -> DataFrame:
    """(path, concept, title) of pages (path, head): by directory or file name, else by words of the first lines."""
    parts = F.split("path", "/")
    name = F.when(F.size(parts) > 1, F.element_at(parts, 1)).otherwise(F.regexp_replace(F.element_at(parts, 1), r"(?i)\.md$", ""))
    title = F.nullif(F.regexp_extract("head", r"(?m)^#\s+(.+?)\s*$", 1), F.lit(""))
    return pages.select("path", F.coalesce(T.concept(name), T.concept(title), F.lit("other")).alias("concept"), title.alias("title"))


def user_doc_plan(classified: DataFrame, root: str = "docs") -> DataFrame:
    """(concept, directory): the first directory that stands for a concept."""
    subs = classified.filter((F.instr("path", "/") > 0) & (c("concept") != "other"))
    return subs.groupBy("concept").agg(F.concat(F.lit(root + "/"), F.min_by(F.substring_index("path", "/", 1), "path"), F.lit("/")).alias("directory"))


def recommendations(gaps: DataFrame, plan: DataFrame, root: str = "docs") -> DataFrame:
    """gaps (type, path_ideal, rationale, priority, existing) with path_user and content_ref.

    The page that exists, else the plan's directory of the concept, else the ideal path below root.
    """
    top = F.substring_index("path_ideal", "/", 1)
    file = F.regexp_replace(F.element_at(F.split("path_ideal", "/"), -1), r"^\d+[-_.]", "")
    out = gaps.withColumn("concept", _lookup(CONCEPT_OF_DIR, top)).join(plan, "concept", "left")
    path = F.coalesce("existing", F.concat("directory", file), F.concat(F.lit(root + "/"), "path_ideal"))
    return out.select(*gaps.columns, path.alias("path_user"), c("path_ideal").alias("content_ref"))


def gaps_from_reviews(symbols: DataFrame, pages: DataFrame, ideal: DataFrame) -> DataFrame:
    """Gaps of three kinds: undocumented exports, ideal pages that are missing, pages that name no symbol of theirs."""
    undocumented = symbols.filter("documentation = 'UNDOCUMENTED' and exported").select(F.lit("missing_jsdoc").alias("type"), c("file").alias("path_ideal"), F.concat(F.lit("Undocumented: "), "name").alias("rationale"), F.lit("medium").alias("priority"))
    missing = ideal.select("path").join(pages.select("path"), "path", "left_anti").select(F.lit("missing_page").alias("type"), c("path").alias("path_ideal"), F.lit("Page is missing").alias("rationale"), F.lit("high").alias("priority"))
    partial = symbols.filter("documentation = 'PARTIAL'").select(F.lit("incomplete_jsdoc").alias("type"), c("file").alias("path_ideal"), F.concat(F.lit("Incomplete: "), "name").alias("rationale"), F.lit("low").alias("priority"))
    return undocumented.unionByName(missing).unionByName(partial)


def domain_gaps(functions: DataFrame, sections: DataFrame, gap: float = 0.55, drift: float = 0.75, fn_gap: float = 0.50, fn_drift: float = 0.75, split_at: int = 50, least: int = 2) -> dict[str, DataFrame]:
    """Coverage of code by pages: {'domains', 'functions'}.

    functions (id, file, name, doc_vector), sections (id, page, vector). Domains are modules, split into files from
    more than split_at functions; the centroid of a domain finds its five nearest sections, the page with the best mean
    is its page. A function counts as covered, of low relevance or missing by its best section among its three nearest
    that stand on this page. All searches of a kind run as one batch.
    """
    base = functions.withColumn("module", F.coalesce(T.module_name(c("file")), F.lit("root")))
    base = base.withColumn("n", F.count("*").over(Window.partitionBy("module")))
    base = base.withColumn("domain", F.when(c("n") > split_at, T.sub_domain(c("file"))).otherwise(c("module"))).drop("n")
    base = base.withColumn("size", F.count("*").over(Window.partitionBy("domain"))).filter(c("size") >= least)
    centres = S.centroid(base, ["domain"], "doc_vector").select(F.xxhash64("domain").alias("id"), "domain", c("centroid").alias("v"))
    corpus = sections.select("id", c("vector").alias("v"))
    of = sections.select("id", "page")
    near = S.knn(centres, corpus, 5, 0.0).join(of, "id").groupBy("query_id", "page").agg(F.avg("score").alias("mean"))
    best = near.groupBy("query_id").agg(F.max_by(F.struct("page", "mean"), F.struct("mean", "page")).alias("b")).select(c("query_id").alias("k"), c("b.page").alias("page"), c("b.mean").alias("similarity"))
    size = base.groupBy("domain").agg(F.count("*").alias("n_functions"))
    s = F.coalesce("similarity", F.lit(0.0))
    domains = size.join(best, F.xxhash64("domain") == c("k"), "left").select("domain", "n_functions", "page", s.alias("similarity"), F.when(s > drift, "COVERED").when(s > gap, "LOW_RELEVANCE").otherwise("NOT_FOUND").alias("class"))
    hits = S.knn(base.select("id", c("doc_vector").alias("v")), corpus, 3, 0.0).join(of.withColumnRenamed("id", "sid"), c("id") == c("sid")).select("query_id", c("page").alias("hit_page"), "score")
    mine = base.select("id", "file", "name", "domain").join(domains.filter("class <> 'NOT_FOUND'").select("domain", "page"), "domain", "left")
    scored = mine.join(hits, (c("id") == c("query_id")) & (c("page") == c("hit_page")), "left").groupBy("id", "file", "name", "domain", "page").agg(F.max("score").alias("score"))
    kind = F.when(c("score").isNull() | (c("score") < fn_gap), "missing").when(c("score") < fn_drift, "low_relevance").otherwise("covered")
    return {"domains": domains, "functions": scored.withColumn("state", kind)}


def concept_gaps(concepts: DataFrame, pages: DataFrame) -> DataFrame:
    """(concept, n, page): the page that names a concept in one of three spellings, longest first; null if none does."""
    spelled = concepts.select("concept", "n", F.explode(F.array_distinct(F.array("concept", F.regexp_replace("concept", "[ _]", "-"), F.regexp_replace("concept", "[-_]", " ")))).alias("term"))
    words = pages.select("page", F.lower("content").alias("text"))
    found = words.join(F.broadcast(spelled), F.instr(c("text"), c("term")) > 0).groupBy("concept").agg(F.max_by("page", F.struct(F.length("term"), "page")).alias("page"))  # thirty concepts at most
    return concepts.join(found, "concept", "left")


def coverage(gaps: dict[str, DataFrame]) -> DataFrame:
    """One row: shares of domains with a page and of functions covered."""
    d = gaps["domains"].agg(F.count("*").alias("n_domains"), F.round(F.avg((c("class") != "NOT_FOUND").cast("int")), 4).alias("domain_share"))
    f = gaps["functions"].agg(F.count("*").alias("n_functions"), F.round(F.avg((c("state") == "covered").cast("int")), 4).alias("function_share"))
    return d.join(F.broadcast(f))


def gaps_per_page(functions: DataFrame, concepts: DataFrame) -> DataFrame:
    """(page, items): missing functions and concepts as work per page."""
    a = functions.filter("state = 'missing' and page is not null").select("page", F.struct(F.lit("function").alias("kind"), "name").alias("item"))
    b = concepts.filter("page is not null").select("page", F.struct(F.lit("concept").alias("kind"), c("concept").alias("name")).alias("item"))
    return a.unionAll(b).groupBy("page").agg(F.array_sort(F.collect_set("item")).alias("items"))


def sync_stats(ideal: DataFrame, user: DataFrame) -> DataFrame:
    """One row: pages on either side, how many ideal ones exist, and whether these are four fifths."""
    have = ideal.select("path").distinct().join(user.select("path").distinct().withColumn("there", F.lit(1)), "path", "left")
    r = have.agg(F.count("*").alias("n_ideal"), F.count("there").alias("n_shared"))
    return r.join(F.broadcast(user.agg(F.count("*").alias("n_user")))).withColumn("in_sync", (c("n_ideal") > 0) & (c("n_shared") >= 0.8 * c("n_ideal")))


def within_budget(sections: DataFrame, window_tokens: int, share: float = 0.2, most: int = 5, lines: int = 100) -> DataFrame:
    """Sections (file, source, rank, content) for a prompt: five a source, 100 lines each, half of the budget a source."""
    cut = F.array_join(F.slice(F.split("content", "\n"), 1, lines), "\n")
    budget = int(window_tokens * share / 2) * 4
    w = Window.partitionBy("file", "source").orderBy("rank")
    out = sections.filter(c("rank") <= most).withColumn("content", cut)
    return out.withColumn("used", F.sum(F.length("content")).over(w)).filter(c("used") <= budget).drop("used")


def truncate_context(df: DataFrame, budget: int) -> DataFrame:
    """Page contexts (signatures, docs, bodies, internals, exports array) in as many stages as the budget asks for.

    Internals go first, then bodies, then docs, and at last exports from the end until the rest fits.
    """
    tokens = lambda *parts: sum((T.estimate_tokens(p) for p in parts), F.lit(0))
    joined = F.array_join("exports", "\n")
    stage = F.when(tokens("signatures", "docs", "bodies", "internals", joined) <= budget, 0).when(tokens("signatures", "docs", "bodies", joined) <= budget, 1).when(tokens("signatures", "docs", joined) <= budget, 2).when(tokens("signatures", joined) <= budget, 3).otherwise(4)
    fits = F.filter(F.sequence(F.lit(0), F.size("exports")), lambda n: T.estimate_tokens("signatures") + T.estimate_tokens(F.array_join(F.slice("exports", F.lit(1), n), "\n")) <= budget)
    kept = F.slice("exports", F.lit(1), F.coalesce(F.array_max(fits), F.lit(0)))
    out = df.withColumn("stage", stage)
    empty = lambda from_stage, col: F.when(c("stage") >= from_stage, "").otherwise(c(col))
    return out.withColumns({"internals": empty(1, "internals"), "bodies": empty(2, "bodies"), "docs": empty(3, "docs"), "exports": F.when(c("stage") == 4, kept).otherwise(c("exports"))})


def relevant_sections(index: DataFrame, window_tokens: int, k: int = 5, least: float = 0.5) -> DataFrame:
    """(file, source, rank, name, content) of sections near to each file's centroid, packed into the prompt's budget.

    All files are searched as one batch, sources apart so that neither crowds out the other.
    """
    centres = S.centroid(index.filter("type = 'function'"), ["file"], "nlp_vector").select(F.xxhash64("file").alias("id"), "file", c("centroid").alias("v"))
    docs = index.filter("type = 'doc_section'").select(F.xxhash64("id").alias("id"), c("nlp_vector").alias("v"), "source", "name", c("summary").alias("content"))
    parts = []
    for source in ("internal", "project"):
        some = docs.filter(c("source") == source)
        hits = S.knn(centres, some, k, least).join(some.drop("v"), "id")
        parts.append(hits.join(centres.select(c("id").alias("query_id"), "file"), "query_id").select("file", "source", "rank", "name", "content"))
    return within_budget(parts[0].unionByName(parts[1]), window_tokens, most=k)


def renumber(pages: DataFrame) -> DataFrame:
    """(file, new_file): numbered pages of each directory counted anew without gaps, others as they are."""
    name = F.element_at(F.split("file", "/"), -1)
    folder = F.regexp_replace("file", "[^/]*$", "")
    numbered = name.rlike(r"^\d+-")
    place = F.row_number().over(Window.partitionBy(folder, numbered).orderBy(F.regexp_extract(name, r"^(\d+)", 1).try_cast("int"), "file"))
    return pages.select("file", F.when(numbered, F.concat(folder, F.lpad(place.cast("string"), 2, "0"), F.regexp_replace(name, r"^\d+", ""))).otherwise(c("file")).alias("new_file"))

"""Queries of the scan, of documentation plans and of report texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import scanners as N
from tessella.functions import text as T
from tessella.operators import pages as P
from tessella.operators import project as J
from tessella.operators import render as D
from tessella.operators import report, rules
from tessella.operators import scan as S
from tessella.plans.base import Catalog, table
from tessella.plans.q_review import _ANY, _FINDING, _MERGED, _R, reviews

CATALOG = Catalog()
c = F.col


def _docs(spark, sf):
    return table(spark, sf, "documents")


_KIND = "CASE doc_id % 5 WHEN 0 THEN 'type' WHEN 1 THEN 'constant' ELSE 'function' END"


@CATALOG.add("triage_class", f"""WITH t AS (SELECT doc_id, len(string_split(text, chr(10))) AS n, doc_id % 4 AS s, {_KIND} AS kind, doc_id % 6 = 0 AS exported FROM documents),
r AS (SELECT doc_id, CASE WHEN n < 10 AND s <= 1 THEN 'trivial' WHEN s > 0 AND kind = 'type' THEN 'type-only' WHEN s > 0 AND kind = 'constant' THEN 'constants-only' WHEN s > 0 AND NOT exported THEN 'internal' WHEN s < 3 THEN 'simple' ELSE 'complex' END AS reason FROM t)
SELECT doc_id, reason, CASE WHEN reason IN ('trivial', 'type-only', 'constants-only') THEN 'skip' ELSE 'evaluate' END AS tier FROM r""")
def triage_class(spark, sf):
    one = F.struct(F.expr(_KIND).alias("kind"), (c("doc_id") % 6 == 0).alias("exported"))
    files = _docs(spark, sf).select("doc_id", c("text").alias("content"), F.array_repeat(one, (c("doc_id") % 4).cast("int")).alias("symbols"))
    return S.triage(files).select("doc_id", "reason", "tier")


@CATALOG.add("scan_counts", "SELECT CASE WHEN doc_id % 13 = 0 THEN 'new' WHEN doc_id % 5 = 0 THEN 'modified' ELSE 'cached' END AS state, count(*) AS n_files FROM documents WHERE doc_id % 11 <> 0 GROUP BY 1 UNION ALL SELECT 'deleted', count(*) FROM documents WHERE doc_id % 11 = 0 AND doc_id % 13 <> 0")
def scan_counts(spark, sf):
    d = _docs(spark, sf).select("doc_id", F.concat(c("doc_id").cast("string"), F.lit(".sh")).alias("file"), c("text").alias("content"), F.sha2("text", 256).alias("hash"))
    one, _ = S.scan(d.filter("doc_id % 13 <> 0").withColumn("hash", F.when(c("doc_id") % 5 == 0, "old").otherwise(c("hash"))), None)
    return S.scan(d.filter("doc_id % 11 <> 0"), one)[1].select("state", "n_files")


@CATALOG.add("classify_files", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'Python' WHEN 1 THEN 'TypeScript' WHEN 2 THEN 'Docker' END AS language FROM documents")
def classify_files(spark, sf):
    path = F.concat(c("source"), F.lit("/"), F.element_at(F.array(F.lit("a.PY"), F.lit("b.tsx"), F.lit("Dockerfile"), F.lit("x.bin")), (c("doc_id") % 4 + 1).cast("int")))
    return _docs(spark, sf).select("doc_id", J.classify_file(path).alias("language"))


@CATALOG.add("doc_mappings", """WITH d AS (SELECT concat(CASE length(source) % 2 WHEN 0 THEN 'handlers' ELSE 'MyDir' END, '') AS k, source, CAST(sum(n_chars) AS BIGINT) AS loc FROM documents GROUP BY source)
SELECT source, CASE k WHEN 'handlers' THEN '04-API-Reference/04-REST-Endpoints.md' ELSE concat('05-Modules/my-dir.md') END AS page, CASE k WHEN 'handlers' THEN 'synonym' ELSE 'catch-all' END AS strategy FROM d WHERE loc >= 200""")
def doc_mappings(spark, sf):
    d = _docs(spark, sf).groupBy("source").agg(F.sum("n_chars").alias("loc")).select("source", F.when(F.length("source") % 2 == 0, "handlers").otherwise("MyDir").alias("dir"), "loc", F.array().cast("array<string>").alias("patterns"))
    m = P.doc_mappings(d).distinct()
    return d.select("source", "dir").join(m, "dir").select("source", "page", "strategy")


@CATALOG.add("page_list", f"SELECT unnest({P.BASE_PAGES + P.TYPE_PAGES['ORM']}) AS path UNION ALL SELECT DISTINCT concat('05-Modules/', source, '.md') FROM documents")
def page_list(spark, sf):
    project = _docs(spark, sf).agg(F.array_distinct(F.collect_set(F.lit("ORM"))).alias("types"))
    return P.page_list(project, _docs(spark, sf).select(F.concat(F.lit("05-Modules/"), "source", F.lit(".md")).alias("path")).distinct())


@CATALOG.add("user_doc_plan", "WITH h AS (SELECT page_id, string_split(regexp_replace(url, '^https?://', ''), '/') AS p FROM pages) SELECT 'guides' AS concept, concat('docs/', min(concat('guide-', p[1])), '/') AS directory FROM h")
def user_doc_plan(spark, sf):
    host = F.element_at(F.split(F.regexp_replace("url", "^https?://", ""), "/"), 1)
    rows = table(spark, sf, "pages").select(F.concat(F.lit("guide-"), host, F.lit("/x.md")).alias("path"), F.lit("").alias("head"))
    return P.user_doc_plan(P.classify_user_docs(rows))


@CATALOG.add("recommendations", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'docs/own.md' WHEN doc_id % 3 = 1 THEN 'docs/guide/' || source || '.md' ELSE concat('docs/99-Other/', source, '.md') END AS path_user FROM documents")
def recommendations(spark, sf):
    ideal = F.when(c("doc_id") % 3 == 2, F.concat(F.lit("99-Other/"), "source", F.lit(".md"))).otherwise(F.concat(F.lit("03-Guides/01-"), "source", F.lit(".md")))
    gaps = _docs(spark, sf).select("doc_id", F.lit("missing_page").alias("type"), ideal.alias("path_ideal"), F.lit("").alias("rationale"), F.lit("low").alias("priority"), F.when(c("doc_id") % 3 == 0, "docs/own.md").alias("existing"))
    plan = spark.createDataFrame([("guides", "docs/guide/")], "concept string, directory string")
    return P.recommendations(gaps, plan).select("doc_id", "path_user")


@CATALOG.add("sync_stats", "WITH i AS (SELECT DISTINCT source, lang FROM documents WHERE doc_id % 2 = 0), u AS (SELECT DISTINCT source, lang FROM documents WHERE doc_id % 3 = 0), s AS (SELECT count(*) AS n_ideal, count(u.source) AS n_shared FROM i LEFT JOIN u USING (source, lang)) SELECT n_ideal, n_shared, (SELECT count(*) FROM u) AS n_user, n_shared >= 0.8 * n_ideal AS in_sync FROM s")
def sync_stats(spark, sf):
    d = _docs(spark, sf).select("doc_id", F.concat_ws("/", "source", "lang").alias("path"))
    return P.sync_stats(d.filter("doc_id % 2 = 0").select("path").distinct(), d.filter("doc_id % 3 = 0").select("path").distinct())


@CATALOG.add("within_budget", "WITH s AS (SELECT source AS file, lang AS source, doc_id, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS rank, array_to_string(string_split(text, chr(10))[1:100], chr(10)) AS t FROM documents), r AS (SELECT *, sum(length(t)) OVER (PARTITION BY file, source ORDER BY rank) AS used FROM s WHERE rank <= 5) SELECT file, source, CAST(rank AS INTEGER) AS rank FROM r WHERE used <= 4000")
def within_budget(spark, sf):
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("source", "lang").orderBy("doc_id"))
    s = _docs(spark, sf).select(c("source").alias("file"), c("lang").alias("source"), rank.alias("rank"), c("text").alias("content"))
    return P.within_budget(s, 10_000).select("file", "source", "rank")


@CATALOG.add("truncate_context", "WITH t AS (SELECT doc_id, ceil(length(source) / 4) AS a, ceil(length(lang) / 4) AS b, ceil(length(text) / 4) AS x, ceil(length(substr(text, 1, 100)) / 4) AS y FROM documents) SELECT doc_id, CASE WHEN a + b + x + y <= 500 THEN 0 WHEN a + b + x <= 500 THEN 1 WHEN a + b <= 500 THEN 2 ELSE 3 END AS stage FROM t")
def truncate_context(spark, sf):
    d = _docs(spark, sf).select("doc_id", c("source").alias("signatures"), c("lang").alias("docs"), c("text").alias("bodies"), F.substring("text", 1, 100).alias("internals"), F.array().cast("array<string>").alias("exports"))
    return P.truncate_context(d, 500).select("doc_id", "stage")


@CATALOG.add("changed_docs", "SELECT count(*) AS total, count(*) FILTER (doc_id % 5 = 0 OR doc_id % 13 = 0) AS changed, count(*) FILTER (NOT (doc_id % 5 = 0 OR doc_id % 13 = 0)) AS cached FROM documents")
def changed_docs(spark, sf):
    d = _docs(spark, sf).select("doc_id", c("doc_id").alias("file"), c("text").alias("content"), F.md5("text").alias("hash"))
    cache = d.filter("doc_id % 13 <> 0").withColumn("hash", F.when(c("doc_id") % 5 == 0, "old").otherwise(c("hash")))
    return S.changed_docs(d, cache.select("file", "hash"), T.is_scaffold(c("content")))


@CATALOG.add("mask_axes", f"WITH {_R} SELECT name, correction, '-' AS tests, '-' AS utility FROM r")
def mask_axes(spark, sf):
    return S.mask_axes(reviews(spark, sf), ["correction", "documentation"]).select("name", "correction", "tests", "utility")


@CATALOG.add("status_counts", f"WITH {_R} SELECT count(*) FILTER (utility = 'DEAD') AS dead, count(*) FILTER (duplication = 'DUPLICATE') AS duplicate, count(*) FILTER (overengineering = 'OVER') AS over, count(*) FILTER (correction IN ('NEEDS_FIX', 'ERROR')) AS correction FROM r")
def status_counts(spark, sf):
    return D.status_counts(reviews(spark, sf))


@CATALOG.add("actions_by_category", f"WITH {_R} SELECT 'refactor' AS category, count(*) FILTER (duplication = 'DUPLICATE') + count(*) FILTER (overengineering = 'OVER') AS n, count(DISTINCT file) FILTER (duplication = 'DUPLICATE' OR overengineering = 'OVER') AS files FROM r WHERE confidence >= 30")
def actions_by_category(spark, sf):
    return D.by_category(rules.synthesize_actions(reviews(spark, sf))).filter("category = 'refactor'")


@CATALOG.add("merge_file_levels", "SELECT source AS file, count(DISTINCT lang) AS n, string_agg(lang, ' | ' ORDER BY lang) FILTER (doc_id % 50 = 0) AS note FROM documents GROUP BY source HAVING count(*) FILTER (doc_id % 50 = 0) > 0")
def merge_file_levels(spark, sf):
    rows = _docs(spark, sf).select(c("source").alias("file"), F.array("lang").alias("unused"), F.array().cast("array<string>").alias("cycles"), F.when(c("doc_id") % 50 == 0, c("lang")).alias("note"))
    return D.merge_file_levels(rows).filter("note <> ''").select("file", F.size("unused").cast("long").alias("n"), "note")


@CATALOG.add("project_tree", "SELECT DISTINCT source AS path, 1 AS depth, true AS is_dir FROM documents UNION ALL SELECT DISTINCT concat(source, '/', lang), 2, true FROM documents UNION ALL SELECT concat(source, '/', lang, '/', doc_id), 3, false FROM documents")
def project_tree(spark, sf):
    return D.tree_rows(_docs(spark, sf).select(F.concat_ws("/", "source", "lang", c("doc_id").cast("string")).alias("file")))


@CATALOG.add("extract_json", """SELECT conv_id, turn, concat('{"t": ', turn, ', "s": ["}"]}') AS payload FROM conversations""")
def extract_json(spark, sf):
    text = F.concat("text", F.lit(' -> {"t": '), c("turn").cast("string"), F.lit(', "s": ["}"]} rest }'))
    safe = F.translate("text", "{}[]", "    ")
    rows = table(spark, sf, "conversations").withColumn("text", safe)
    return rows.select("conv_id", "turn", N.extract_json(text).alias("payload"))


@CATALOG.add("checklist_actions", "SELECT doc_id, concat('ACT-', doc_id) AS id, 'high' AS severity, lang AS file, source AS description FROM documents")
def checklist_actions(spark, sf):
    line = F.concat(F.lit("# List\n- [x] <!-- ACT-0 --> done\n- [ ] <!-- ACT-"), c("doc_id").cast("string"), F.lit(" --> **[high]** "), "source", F.lit(" (`"), "lang", F.lit("`)\n"))
    return _docs(spark, sf).select("doc_id", F.explode(N.unchecked_actions(line)).alias("a")).select("doc_id", "a.*")


@CATALOG.add("stories", "SELECT lang AS axis, source AS file, count(*) AS n, min(doc_id % 9) AS priority FROM documents GROUP BY lang, source")
def stories(spark, sf):
    return D.stories(_docs(spark, sf).select(F.concat(F.lit("["), "lang", F.lit("] "), "source", F.lit(": x")).alias("text"), (c("doc_id") % 9).alias("priority")))


@CATALOG.add("sync_checked", "SELECT doc_id AS id, source AS shard, doc_id % 2 = 0 AS checked, min(doc_id % 2 = 0) OVER (PARTITION BY source) AS shard_done FROM documents")
def sync_checked(spark, sf):
    d = _docs(spark, sf).select(c("doc_id").alias("id"), c("source").alias("shard"))
    return D.sync_checked(d, d.filter("id % 2 = 0")).select("id", "shard", "checked", "shard_done")


@CATALOG.add("concept_gaps", "WITH k AS (SELECT unnest(['the', 'not there', 'en']) AS concept) SELECT concept, max(item_id) AS page FROM k LEFT JOIN benchmark ON contains(lower(text), concept) GROUP BY concept")
def concept_gaps(spark, sf):
    k = spark.createDataFrame([(x, 9) for x in ("the", "not there", "en")], "concept string, n int")
    return P.concept_gaps(k, table(spark, sf, "benchmark").select(c("item_id").alias("page"), c("text").alias("content"))).select("concept", "page")


def _gaps(spark, sf):
    e = table(spark, sf, "embeddings")
    v = F.transform("embedding", lambda x: x.cast("double"))
    fn = e.filter("label < 5").select(c("vec_id").alias("id"), F.concat(F.lit("src/m"), "label", F.lit("/f"), c("vec_id") % 3, F.lit(".ts")).alias("file"), F.concat(F.lit("f"), "vec_id").alias("name"), v.alias("doc_vector"))
    sec = e.select(c("vec_id").alias("id"), F.concat(F.lit("p"), "label").alias("page"), v.alias("vector"))
    return P.domain_gaps(fn, sec, 0.3, 0.6)


_GAPS = """WITH e AS (SELECT vec_id AS id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
m AS (SELECT *, 'm' || label AS module, count(*) OVER (PARTITION BY label) AS n FROM e WHERE label < 5),
fn AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY domain) AS size FROM (SELECT id, v, CASE WHEN n > 50 THEN module || '/f' || (id % 3) ELSE module END AS domain FROM m)) WHERE size >= 2),
x AS (SELECT domain, pos, avg(x) AS m FROM (SELECT domain, unnest(v) AS x, unnest(range(len(v))) AS pos FROM fn) GROUP BY ALL),
centre AS (SELECT domain, list(m ORDER BY pos) AS c FROM x GROUP BY domain),
near AS (SELECT domain, 'p' || e.label AS page, round(list_cosine_similarity(c, v), 6) AS score, row_number() OVER (PARTITION BY domain ORDER BY round(list_cosine_similarity(c, v), 6) DESC, id) AS n FROM centre JOIN e ON round(list_cosine_similarity(c, v), 6) >= 0),
mean AS (SELECT domain, page, avg(score) AS mean FROM near WHERE n <= 5 GROUP BY ALL),
best AS (SELECT domain, arg_max(page, (mean, page)) AS page, max(mean) AS similarity FROM mean GROUP BY domain),
domains AS (SELECT domain, count(*) AS n_functions, any_value(page) AS page, coalesce(any_value(similarity), 0) AS similarity FROM fn LEFT JOIN best USING (domain) GROUP BY domain),
classed AS (SELECT *, CASE WHEN similarity > 0.6 THEN 'COVERED' WHEN similarity > 0.3 THEN 'LOW_RELEVANCE' ELSE 'NOT_FOUND' END AS class FROM domains)"""


@CATALOG.add("domain_gaps", _GAPS + "SELECT domain, n_functions, page, round(similarity, 6) AS similarity, class FROM classed")
def domain_gaps(spark, sf):
    return _gaps(spark, sf)["domains"].withColumn("similarity", F.round("similarity", 6))


@CATALOG.add("function_gaps", _GAPS + """, hits AS (SELECT f.id, 'p' || e.label AS page, round(list_inner_product(f.v, e.v), 6) AS score, row_number() OVER (PARTITION BY f.id ORDER BY round(list_inner_product(f.v, e.v), 6) DESC, e.id) AS n FROM fn f JOIN e ON list_inner_product(f.v, e.v) >= 0),
mine AS (SELECT fn.id, fn.domain, k.page FROM fn LEFT JOIN classed k ON k.domain = fn.domain AND class <> 'NOT_FOUND')
SELECT mine.id, domain, mine.page, CASE WHEN coalesce(max(score), 0) < 0.5 THEN 'missing' WHEN max(score) < 0.75 THEN 'low_relevance' ELSE 'covered' END AS state
FROM mine LEFT JOIN hits ON hits.id = mine.id AND hits.page = mine.page AND n <= 3 GROUP BY ALL""")
def function_gaps(spark, sf):
    return _gaps(spark, sf)["functions"].select("id", "domain", "page", "state")


_F = f"f AS (SELECT file, {_MERGED} AS verdict, count(*) FILTER ({_ANY}) AS n_findings, max(confidence) AS max_confidence FROM r GROUP BY file)"


def _files(spark, sf):
    hit = F.lit(False)
    for a in rules.AXES:
        hit = hit | rules.has_finding(a)
    return reviews(spark, sf).groupBy("file").agg(rules.verdict_merged().alias("verdict"), F.count_if(hit).alias("n_findings"), F.max("confidence").alias("max_confidence"))


@CATALOG.add("report_index", f"WITH {_R}, {_F}, o AS (SELECT *, row_number() OVER (ORDER BY CASE verdict WHEN 'CRITICAL' THEN 0 WHEN 'NEEDS_REFACTOR' THEN 1 ELSE 2 END, n_findings DESC, max_confidence DESC, file) AS i FROM f) SELECT sha256(string_agg(concat('- `', file, '` — ', verdict, ', ', n_findings, ' findings'), chr(10) ORDER BY i)) AS files_hash FROM o")
def report_index(spark, sf):
    text = D.index(reviews(spark, sf), _files(spark, sf)).select(F.trim(F.regexp_replace(F.element_at(F.split("markdown", "## Files\n\n"), 2), "\n$", "")).alias("t"))
    return text.select(F.sha2("t", 256).alias("files_hash"))


@CATALOG.add("report_shards", f"WITH {_R}, h AS (" + " UNION ALL ".join(f"SELECT DISTINCT '{a}' AS axis, file FROM r WHERE {cond}" for a, cond in (_FINDING | {"utility": "utility IN ('DEAD','LOW_VALUE')"}).items()) + """)
SELECT axis, CAST(count(*) AS BIGINT) AS n_parts, CAST(ceil(count(*) / 10.0) AS BIGINT) AS n_shards, sha256(string_agg(file, ',' ORDER BY file)) AS files_hash FROM h GROUP BY axis""")
def report_shards(spark, sf):
    """Pages of the report by axis: how many there are, and the files that have a part in them."""
    part = F.explode(F.regexp_extract_all("markdown", F.lit("(?m)^## `([^`]+)`$"), 1)).alias("file")
    pages = D.axis_shards(reviews(spark, sf)).select(F.substring_index("path", "/", 1).alias("axis"), "path", part)
    return pages.groupBy("axis").agg(F.count("*").alias("n_parts"), F.count_distinct("path").alias("n_shards"), F.sha2(F.array_join(F.array_sort(F.collect_list("file")), ","), 256).alias("files_hash"))


@CATALOG.add("report_message", f"WITH {_R}, {_F}, o AS (SELECT *, row_number() OVER (ORDER BY CASE verdict WHEN 'CRITICAL' THEN 0 WHEN 'NEEDS_REFACTOR' THEN 1 ELSE 2 END, n_findings DESC, max_confidence DESC, file) AS i FROM f) SELECT string_agg(file, ', ' ORDER BY i) AS worst FROM o WHERE i <= 3")
def report_message(spark, sf):
    return D.message(reviews(spark, sf), _files(spark, sf)).select(F.element_at(F.split("text", "\n"), 2).alias("worst"))


_LINE = "concat('- **', name, '** — ', concat_ws(' · ', correction, overengineering, utility, duplication, tests, documentation), ' (', confidence, '%)', chr(10), '  ', detail)"


@CATALOG.add("review_markdown", f"WITH {_R}, l AS (SELECT file, name, {_LINE} AS line FROM r) SELECT file, concat('# Review: ', file, chr(10), chr(10), string_agg(line, chr(10) ORDER BY name, line), chr(10)) AS markdown FROM l GROUP BY file")
def review_markdown(spark, sf):
    from tessella.sources.files import render_review

    return render_review(reviews(spark, sf))


@CATALOG.add("directory_findings", f"WITH {_R} SELECT file, count(*) FILTER (tests IN ('WEAK', 'NONE')) AS n_findings FROM r GROUP BY file HAVING count(*) FILTER (tests IN ('WEAK', 'NONE')) > 0")
def directory_findings(spark, sf):
    return report.axis_files(reviews(spark, sf), "tests").select("file", "n_findings")

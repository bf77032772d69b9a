"""Text and documentation queries over `documents`, `pages`, `benchmark` and `events`."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.operators import docs as D
from tessella.plans.base import Catalog, table

CATALOG = Catalog()
c = F.col


def _docs(spark, sf):
    return table(spark, sf, "documents")


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _chain_sql(text: str, steps) -> str:
    for p, by in steps:
        text = f"regexp_replace({text}, {_quote(p.replace('(?md)', '(?m)'))}, {_quote(by.replace('$1', chr(92) + '1'))}, 'g')"
    return text


_TRIM = r"regexp_replace({}, '\A[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+\z', '', 'g')"


@CATALOG.add("doc_hash_ids", """SELECT doc_id, sha256(text) AS file_hash, sha256(text)[1:16] AS body_hash, sha256(concat(source, ':', doc_id, '-', n_chars))[1:16] AS function_id, sha256(concat('doc:', source, ':', lang))[1:16] AS section_id, concat('ACT-', sha256(source)[1:6], '-', doc_id) AS action_id FROM documents""")
def doc_hash_ids(spark, sf):
    return _docs(spark, sf).select("doc_id", F.sha2("text", 256).alias("file_hash"), T.hash16("text").alias("body_hash"), T.function_id("source", "doc_id", "n_chars").alias("function_id"), T.section_id(c("source"), c("lang")).alias("section_id"), T.action_id("source", "doc_id").alias("action_id"))


@CATALOG.add("exact_dup_groups", "SELECT sha256(text) AS hash, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_dup_groups(spark, sf):
    return _docs(spark, sf).groupBy(F.sha2("text", 256).alias("hash")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).filter("n > 1")


@CATALOG.add("strip_non_prose_html", "SELECT page_id, sha256(" + _TRIM.format(_chain_sql("html", T.PROSE_REMOVALS)) + ") AS prose_hash FROM pages")
def strip_non_prose_html(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.sha2(T.strip_non_prose(c("html")), 256).alias("prose_hash"))


@CATALOG.add("strip_non_prose_docs", "SELECT doc_id, length(" + _TRIM.format(_chain_sql("text", T.PROSE_REMOVALS)) + ") AS n FROM documents")
def strip_non_prose_docs(spark, sf):
    return _docs(spark, sf).select("doc_id", F.length(T.strip_non_prose(c("text"))).cast("long").alias("n"))


_LEFT = r"""concat('const a = ""; ', chr(10), 'c("", ""); d = a / b;', chr(10), 'e = "" + x; f = ""; g = `set ${', lang, '} in`')"""


@CATALOG.add("strip_code", f"SELECT doc_id, {_LEFT} AS code FROM documents")
def strip_code(spark, sf):
    """Sources around the languages and sources of documents; the SQL states what must stay of them, not how it is found."""
    lang, source = c("lang"), c("source")
    of = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    code = of("const a = `plain ", lang, " $5 \\` end`; // ", source, '\nc("', lang, " \\\" q\", '", source, " \\' r'); /* ", source, "\n */d = a / b;\ne = `` + x; f = 'it'; g = `set ${", lang, "} in`")
    return _docs(spark, sf).select("doc_id", T.strip_code(code).alias("code"))


@CATALOG.add("is_scaffold", "SELECT doc_id, false AS scaffold FROM documents WHERE NOT contains(text, '<!-- SCAFFOLDING') UNION ALL SELECT 1000000 + doc_id, n_chars < 180 FROM documents WHERE n_chars < 180")
def is_scaffold(spark, sf):
    d = _docs(spark, sf)
    marked = d.filter("n_chars < 180").select((c("doc_id") + 1000000).alias("doc_id"), F.concat(F.lit("<!-- SCAFFOLDING: x -->\n# Title\n"), "text").alias("text"))
    return d.select("doc_id", "text").unionAll(marked).select("doc_id", T.is_scaffold(c("text")).alias("scaffold"))


_CODE = "concat('if (a && b) { } else if (c || d) { x ? y : z } ', text, ' catch (e) ')"
_N = r"""1 + len(regexp_extract_all(t, '\bif\s*\(')) - len(regexp_extract_all(t, 'else\sif\s*\(')) + len(regexp_extract_all(t, '\belse\s+if\s*\(')) + len(regexp_extract_all(t, '\bcase\s+')) + len(regexp_extract_all(t, '&&')) + len(regexp_extract_all(t, '\|\|')) + len(regexp_extract_all(t, '\?[^?:]')) + len(regexp_extract_all(t, '\bcatch\s*\('))"""


@CATALOG.add("complexity", f"WITH b AS (SELECT doc_id, {_CODE} AS t FROM documents), n AS (SELECT doc_id, {_N} AS n FROM b) SELECT doc_id, CAST(n AS INTEGER) AS branches, CASE WHEN n <= 2 THEN 1 WHEN n <= 5 THEN 2 WHEN n <= 10 THEN 3 WHEN n <= 20 THEN 4 ELSE 5 END AS score FROM n")
def complexity(spark, sf):
    t = F.expr(_CODE)
    return _docs(spark, sf).select("doc_id", T.branches(t).alias("branches"), T.complexity(t).alias("score"))


@CATALOG.add("body_slice", r"SELECT doc_id, sha256(array_to_string(string_split(text, chr(10))[2:4], chr(10))) AS body_hash FROM documents")
def body_slice(spark, sf):
    return _docs(spark, sf).select("doc_id", F.sha2(T.body(c("text"), F.lit(2), F.lit(4)), 256).alias("body_hash"))


@CATALOG.add("token_estimate", "SELECT source, CAST(sum(ceil(length(text) / 4)) AS BIGINT) AS tokens, count(*) AS n FROM documents GROUP BY source")
def token_estimate(spark, sf):
    return _docs(spark, sf).groupBy("source").agg(F.sum(T.estimate_tokens("text")).alias("tokens"), F.count("*").alias("n"))


@CATALOG.add("embed_text_cut", r"SELECT doc_id, length(concat_ws(chr(10), source, lang, CASE WHEN length(text) > 1500 THEN concat(substr(text, 1, 1500), chr(10) || '// ... truncated') ELSE text END)) AS n FROM documents")
def embed_text_cut(spark, sf):
    return _docs(spark, sf).select("doc_id", F.length(T.embed_code(c("source"), c("lang"), c("text"))).cast("long").alias("n"))


_STOP = ",".join(_quote(w) for w in T.STOP_WORDS)


@CATALOG.add("keyword_extract", r"SELECT DISTINCT doc_id, w AS keyword FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[\s,.:;()\[\]{}''\x22`/\\|—–]+')) AS w FROM documents) WHERE length(w) > 3 AND w NOT IN (" + _STOP + ")")
def keyword_extract(spark, sf):
    return _docs(spark, sf).select("doc_id", F.explode(T.keywords(c("text"))).alias("keyword"))


@CATALOG.add("concept_topn", r"SELECT w AS concept, count(*) AS n FROM (SELECT lower(unnest(string_split(text, ' '))) AS w FROM documents) WHERE length(w) >= 2 GROUP BY 1 HAVING count(*) >= 5 ORDER BY n DESC, concept LIMIT 30")
def concept_topn(spark, sf):
    return D.concept_frequency(_docs(spark, sf).select(F.explode(F.split("text", " ")).alias("concept")))


@CATALOG.add("section_score", """WITH k AS (SELECT item_id, list_distinct(string_split(lower(text), ' '))[1:1] AS ks FROM benchmark WHERE false), q AS (SELECT unnest(['reonti', 'thonin', 'tionre']) AS w)
SELECT doc_id, CAST(sum(CASE WHEN contains(lower(source), w) THEN 3 ELSE 0 END + least(3, (length(lower(text)) - length(replace(lower(text), w, ''))) // length(w))) AS BIGINT) AS score FROM documents, q GROUP BY doc_id""")
def section_score(spark, sf):
    words = F.array(*[F.lit(w) for w in ("reonti", "thonin", "tionre")])
    return _docs(spark, sf).select("doc_id", T.section_score(c("source"), c("text"), words).alias("score"))


@CATALOG.add("language_histogram", "WITH n AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang), k AS (SELECT * FROM n WHERE n >= 0.01 * (SELECT sum(n) FROM n)) SELECT lang, n, CAST(round(100 * n / (SELECT sum(n) FROM k)) AS BIGINT) AS pct FROM k")
def language_histogram(spark, sf):
    from tessella.operators.project import language_shares

    return language_shares(_docs(spark, sf).select("lang"), "lang")


_PATH = "regexp_replace(url, '^https?://', '')"


@CATALOG.add("page_types", f"SELECT page_id, CASE WHEN contains(p, 'module') THEN 'module' WHEN contains(p, 'api-reference') OR contains(p, 'cli') OR contains(p, 'types') OR contains(p, 'schema') OR contains(p, 'endpoint') THEN 'reference' ELSE 'conceptual' END AS type FROM (SELECT page_id, lower({_PATH}) AS p FROM pages)")
def page_types(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.page_type(F.expr(_PATH)).alias("type"))


@CATALOG.add("module_names", f"SELECT page_id, string_split({_PATH}, '/')[1] AS module, concat(string_split({_PATH}, '/')[1], '/', regexp_replace(string_split({_PATH}, '/')[-1], '\\.[^.]+$', '')) AS sub_domain FROM pages WHERE len(string_split({_PATH}, '/')) >= 3")
def module_names(spark, sf):
    p = F.expr(_PATH)
    return table(spark, sf, "pages").filter(F.size(F.split(p, "/")) >= 3).select("page_id", T.module_name(p).alias("module"), T.sub_domain(p).alias("sub_domain"))


@CATALOG.add("longest_prefix_map", f"WITH p AS (SELECT DISTINCT {_PATH} AS path FROM pages), m AS (SELECT DISTINCT string_split(path, '/')[1] AS prefix, 1 AS depth FROM p UNION SELECT DISTINCT concat_ws('/', string_split(path, '/')[1], 'en'), 2 FROM p) SELECT path, arg_max(prefix, length(prefix)) AS prefix FROM p JOIN m ON path = prefix OR starts_with(path, prefix || '/') GROUP BY path")
def longest_prefix_map(spark, sf):
    p = table(spark, sf, "pages").select(F.expr(_PATH).alias("path")).distinct()
    host = F.element_at(F.split("path", "/"), 1)
    m = p.select(host.alias("prefix")).unionAll(p.select(F.concat_ws("/", host, F.lit("en")))).distinct().withColumn("target", c("prefix"))
    return D.longest_prefix(p, m).select("path", "prefix")


@CATALOG.add("interleave_sources", "WITH t AS (SELECT lang, source, doc_id, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS turn FROM documents), p AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY turn, source) AS place FROM t WHERE turn <= 3) SELECT lang, source, doc_id, CAST(place AS INTEGER) AS place FROM p WHERE place <= 3")
def interleave_sources(spark, sf):
    return D.interleave(_docs(spark, sf).select("lang", "source", "doc_id"), "lang", "source", "doc_id")


@CATALOG.add("greedy_batches", """WITH RECURSIVE o AS (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents),
g AS (SELECT source, doc_id, i, n_chars AS used, 0 AS batch FROM o WHERE i = 1 UNION ALL SELECT o.source, o.doc_id, o.i, CASE WHEN g.used + o.n_chars <= 30000 THEN g.used + o.n_chars ELSE o.n_chars END, CASE WHEN g.used + o.n_chars <= 30000 THEN g.batch ELSE g.batch + 1 END FROM g JOIN o ON o.source = g.source AND o.i = g.i + 1)
SELECT source, doc_id, batch FROM g""")
def greedy_batches(spark, sf):
    return D.greedy_batches(_docs(spark, sf).select("source", "doc_id", "n_chars"), "source", "doc_id", "n_chars")


@CATALOG.add("pack_sections", """WITH RECURSIVE o AS (SELECT source, doc_id, doc_id % 7 AS score, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id > 0, doc_id % 7 DESC, doc_id) AS i FROM documents),
g AS (SELECT source, doc_id, i, CASE WHEN doc_id <= 0 OR (score > 0 AND n_chars <= 20000) THEN n_chars ELSE 0 END AS used, doc_id <= 0 OR (score > 0 AND n_chars <= 20000) AS kept FROM o WHERE i = 1
UNION ALL SELECT o.source, o.doc_id, o.i, CASE WHEN o.doc_id <= 0 OR (o.score > 0 AND g.used + o.n_chars <= 20000) THEN g.used + o.n_chars ELSE g.used END, o.doc_id <= 0 OR (o.score > 0 AND g.used + o.n_chars <= 20000) FROM o JOIN g ON o.source = g.source AND o.i = g.i + 1)
SELECT source AS package, CAST(doc_id AS INTEGER) AS position FROM g WHERE kept""")
def pack_sections(spark, sf):
    s = _docs(spark, sf).select(c("source").alias("package"), c("doc_id").cast("int").alias("position"), (c("doc_id") % 7).alias("score"), c("n_chars").alias("size"))
    return D.pack_sections(s, 20_000)


@CATALOG.add("chunk_h2")
def chunk_h2(spark, sf):
    return D.chunk(_docs(spark, sf).select(c("doc_id").cast("string").alias("file"), c("text").alias("content")), smart=False)


@CATALOG.add("chunk_smart")
def chunk_smart(spark, sf):
    return D.chunk(_docs(spark, sf).select(c("doc_id").cast("string").alias("file"), c("text").alias("content")))


@CATALOG.add("doc_score", """WITH s AS (SELECT source, count(*) FILTER (doc_id % 3 = 0) AS ed, count(*) AS e, count(DISTINCT lang) FILTER (doc_id % 2 = 0) AS md, count(DISTINCT lang) AS m, CAST(avg(doc_id % 100) AS INTEGER) AS q FROM documents GROUP BY source),
p AS (SELECT source, CAST(round(100 * ed / e) AS INT) AS api, CAST(least(100, round(100 * md / m)) AS INT) AS module, q AS quality, CAST(round(50 + least(1.0, 3 / m) * 50) AS INT) AS navigation FROM s),
o AS (SELECT *, CAST(round((40 * 25 + api * 40 + module * 14 + quality * 11 + navigation * 10) / 100) AS BIGINT) AS overall FROM p)
SELECT source, overall, CASE WHEN overall >= 80 THEN 'DOCUMENTED' WHEN overall >= 50 THEN 'PARTIAL' ELSE 'UNDOCUMENTED' END AS verdict FROM o""")
def doc_score(spark, sf):
    d = _docs(spark, sf).groupBy("source").agg(F.count_if(c("doc_id") % 3 == 0).alias("exports_documented"), F.count("*").alias("exports"), F.count_distinct(F.when(c("doc_id") % 2 == 0, c("lang"))).alias("modules_documented"), F.count_distinct("lang").alias("modules"), F.round(F.avg(c("doc_id") % 100)).cast("int").alias("content_quality"))
    d = d.withColumns({"pages": F.array(*[F.lit(p) for p in ("index.md", "02-architecture/x.md", "notes.md")]), "types": F.array(F.lit("Library")), "ideal_pages": c("modules")})
    return D.score(d).select("source", "overall", "verdict")


@CATALOG.add("page_diff", "WITH a AS (SELECT source AS page, doc_id AS file, md5(text) AS h FROM documents WHERE source <> 'src1'), b AS (SELECT source AS page, doc_id AS file, CASE WHEN source = 'src2' THEN 'old' ELSE md5(text) END AS h FROM documents WHERE source <> 'src3') SELECT DISTINCT source AS page, CASE source WHEN 'src1' THEN 'removed' WHEN 'src3' THEN 'added' WHEN 'src2' THEN 'stale' ELSE 'fresh' END AS state FROM documents")
def page_diff(spark, sf):
    d = _docs(spark, sf).select(c("source").alias("page"), c("doc_id").alias("file"), F.md5("text").alias("hash"))
    old = d.filter("page <> 'src3'").withColumn("hash", F.when(c("page") == "src2", "old").otherwise(c("hash")))
    return D.page_diff(d.filter("page <> 'src1'"), old)


@CATALOG.add("json_array_parse", """SELECT event_id, 2 AS n, CAST(user_id AS VARCHAR) AS first FROM events""")
def json_array_parse(spark, sf):
    text = F.concat(F.lit('["'), c("user_id").cast("string"), F.lit('", 1, null, "'), "event_type", F.lit('"]'))
    return table(spark, sf, "events").select("event_id", T.json_strings(text).alias("a")).select("event_id", F.size("a").alias("n"), F.element_at("a", 1).alias("first"))


@CATALOG.add("props_extract", "SELECT event_id, CAST(props->>'$.k' AS INTEGER) AS k FROM events")
def props_extract(spark, sf):
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


@CATALOG.add("section_order", "SELECT source AS section, CAST(coalesce(try_cast(regexp_extract(source, '^(\\d+)', 1) AS INTEGER), 99) AS INTEGER) AS place, count(*) AS n FROM documents GROUP BY source")
def section_order(spark, sf):
    return D.sections_by_prefix(_docs(spark, sf).select(F.concat_ws("/", "source", c("doc_id").cast("string")).alias("file"))).select("section", "place", F.size("pages").cast("long").alias("n"))


@CATALOG.add("name_forms", """SELECT doc_id, lower(regexp_replace(regexp_replace(w, '([a-z0-9])([A-Z])', '\\1-\\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1-\\2', 'g')) AS kebab, CASE WHEN n_chars >= 1000 THEN concat(CAST(CAST(round(n_chars / 1000.0) AS BIGINT) AS VARCHAR), 'K') ELSE CAST(n_chars AS VARCHAR) END AS short,
  CASE WHEN n_chars >= 60 THEN concat('~', n_chars // 60, 'h ', n_chars % 60, 'm') ELSE concat('~', n_chars, 'm') END AS spent FROM (SELECT doc_id, n_chars, concat('HTTP', string_split(text, ' ')[1], 'Parser') AS w FROM documents)""")
def name_forms(spark, sf):
    w = F.concat(F.lit("HTTP"), F.element_at(F.split("text", " "), 1), F.lit("Parser"))
    return _docs(spark, sf).select("doc_id", T.kebab(w).alias("kebab"), T.short_count(c("n_chars")).alias("short"), T.minutes(c("n_chars")).alias("spent"))

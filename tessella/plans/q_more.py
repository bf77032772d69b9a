"""Queries for the index table, references by language, manifests, runs, names and actions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.functions import vectors as V
from tessella.operators import docs as D
from tessella.operators import graph as G
from tessella.operators import incremental as I
from tessella.operators import index as X
from tessella.operators import pages as P
from tessella.operators import project as J
from tessella.operators import refresh
from tessella.operators import rules as R
from tessella.plans.base import Catalog, folder, table
from tessella.sources import files as S
from tessella.sources.versions import Table

CATALOG = Catalog()
c = F.col


def _of(*parts):
    """Concatenation of literals, columns, and columns named after an @."""
    return F.concat(*[(c(p[1:]) if p[:1] == "@" and p[1:].isidentifier() else F.lit(p)) if isinstance(p, str) else p.cast("string") for p in parts])


def _index(spark, sf):
    """Embeddings as index rows: every fourth a section, the others functions of the file of their label."""
    v = table(spark, sf, "embeddings")
    kind = F.when(c("vec_id") % 4 == 0, "doc_section").otherwise("function")
    return v.select(
        F.substring(F.sha2(c("vec_id").cast("string"), 256), 1, 16).alias("id"), _of("f", c("label")).alias("file"), _of("Fn", c("vec_id")).alias("name"),
        F.when(c("vec_id") % 3 == 0, "").otherwise("says").alias("summary"), kind.alias("type"), F.when(c("vec_id") % 8 == 0, "user").otherwise("ideal").alias("source"),
        c("embedding").alias("vector"), c("embedding").alias("nlp_vector"), c("embedding").alias("doc_vector"), F.timestamp_seconds(c("vec_id")).alias("last_indexed"),
    )


_I = """i AS (SELECT vec_id, substr(sha256(CAST(vec_id AS VARCHAR)), 1, 16) AS id, concat('f', label) AS file, concat('Fn', vec_id) AS name,
  CASE WHEN vec_id % 3 = 0 THEN '' ELSE 'says' END AS summary, vec_id % 4 = 0 AS section, CASE WHEN vec_id % 8 = 0 THEN 'user' ELSE 'ideal' END AS source FROM embeddings)"""


@CATALOG.add("index_cards_by_file", f"WITH {_I} SELECT id, name FROM i WHERE NOT section AND file = 'f1'")
def index_cards_by_file(spark, sf):
    return X.functions(_index(spark, sf), "f1").select("id", "name")


@CATALOG.add("index_list_all", f"WITH {_I} SELECT id, file, name, summary FROM i WHERE NOT section")
def index_list_all(spark, sf):
    return X.functions(_index(spark, sf)).select("id", "file", "name", "summary")


@CATALOG.add("index_doc_vectors", f"WITH {_I} SELECT i.id, round(list_sum(embedding), 4) AS total FROM i JOIN embeddings e USING (vec_id) WHERE NOT section")
def index_doc_vectors(spark, sf):
    total = F.aggregate(F.transform("doc_vector", lambda x: x.cast("double")), F.lit(0.0), lambda a, x: a + x)
    return X.functions(_index(spark, sf), with_doc_vectors=True).select("id", F.round(total, 4).alias("total"))


@CATALOG.add("index_sections", f"WITH {_I} SELECT id, name FROM i WHERE section AND source = 'user'")
def index_sections(spark, sf):
    return X.sections(_index(spark, sf), "user").select("id", "name")


@CATALOG.add("index_files", f"WITH {_I} SELECT DISTINCT file FROM i WHERE NOT section")
def index_files(spark, sf):
    return X.indexed_files(_index(spark, sf))


@CATALOG.add("index_by_name", f"WITH {_I} SELECT id, name FROM i WHERE NOT section AND contains(lower(name), 'fn1')")
def index_by_name(spark, sf):
    return X.by_name(_index(spark, sf), "FN1").select("id", "name")


@CATALOG.add("index_stats", f"WITH {_I} SELECT count(*) FILTER (NOT section) AS n_cards, count(DISTINCT file) FILTER (NOT section) AS n_files, count(*) FILTER (section) AS n_sections, count(*) FILTER (NOT section AND summary <> '') AS n_summaries FROM i")
def index_stats(spark, sf):
    return X.stats(_index(spark, sf)).select("n_cards", "n_files", "n_sections", "n_summaries")


@CATALOG.add("index_upsert_sections", f"WITH {_I} SELECT id, name FROM i WHERE NOT (section AND file IN ('f1', 'f2')) UNION ALL SELECT id, concat('new ', name) FROM i WHERE section AND file IN ('f1', 'f2') AND vec_id % 8 = 0")
def index_upsert_sections(spark, sf):
    i = _index(spark, sf)
    new = i.filter("type = 'doc_section' and file in ('f1', 'f2') and source = 'user'").withColumn("name", _of("new ", c("name")))
    return X.upsert_sections(i, new).select("id", "name")


@CATALOG.add("index_delete_sections", f"WITH {_I} SELECT id FROM i WHERE NOT (section AND source = 'user')")
def index_delete_sections(spark, sf):
    i = _index(spark, sf)
    return X.delete_sections(i, i.filter("source = 'user'").select("id").unionAll(i.filter("type = 'function'").select("id"))).select("id")


@CATALOG.add("dimension_drift", """SELECT d AS expected, bool_or(len(embedding) <> d) AS code_drift, bool_or(len(embedding) <> 64) AS nlp_drift FROM embeddings, (SELECT unnest([64, 32]) AS d) GROUP BY d""")
def dimension_drift(spark, sf):
    i = _index(spark, sf)
    one = lambda d: X.dimension_drift(i, d, 64).select(F.lit(d).alias("expected"), "code_drift", "nlp_drift")
    return one(64).unionAll(one(32))


@CATALOG.add("cosine_dot", "SELECT a.vec_id, round(list_inner_product(list_transform(a.embedding, lambda x: CAST(x AS DOUBLE)), list_transform(b.embedding, lambda x: CAST(x AS DOUBLE))), 5) AS score FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def cosine_dot(spark, sf):
    v = table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return v.join(v.select((c("vec_id") - 1).alias("vec_id"), c("v").alias("w")), "vec_id").select("vec_id", F.round(V.dot("v", "w"), 5).alias("score"))


#: Per language: a file's text around a document's source, and what must be found in it.
_CODE = {
    "typescript": (["import { a, b as c } from './", "@source", "';\nimport '", "@lang", "/side';\nconst x = require('", "@source", "/r');\n"], [("import", "'./' || source"), ("import", "lang || '/side'"), ("require", "source || '/r'")]),
    "bash": (["#!/bin/sh\nsource ./", "@source", ".sh\n. \"lib/", "@lang", ".sh\"\necho source x\n"], [("source", "'./' || source || '.sh'"), ("source", "'lib/' || lang || '.sh'")]),
    "python": (["import ", "@source", "\nfrom .", "@lang", " import x\n    import inner\n"], [("import", "source"), ("import", "'.' || lang")]),
    "rust": (["use crate::", "@source", "::x;\npub use ", "@lang", ";\npub(crate) use a::{self, // no\n    b::{c, ", "@source", " as e}, f::*};\nfn f() { use inner; }\n"], [("import", "'crate::' || source || '::x'"), ("import", "lang"), ("import", "'a'"), ("import", "'a::b::c'"), ("import", "'a::b::' || source"), ("import", "'a::f'")]),
    "go": (["package p\nimport \"", "@source", "\"\nimport (\n  \"fmt\"\n  x \"", "@lang", "/y\"\n)\n"], [("import", "source"), ("import", "'fmt'"), ("import", "lang || '/y'")]),
    "java": (["package p;\nimport a.", "@source", ";\nimport static b.", "@lang", ".*;\nclass X {}\n"], [("import", "'a.' || source"), ("import", "'b.' || lang || '.*'")]),
    "csharp": (["using A.", "@source", ";\nusing static B.", "@lang", ";\nclass X {}\n"], [("import", "'A.' || source"), ("import", "'B.' || lang")]),
}


def _references(language):
    parts, want = _CODE[language]

    def query(spark, sf):
        files = table(spark, sf, "documents").select(_of("d", c("doc_id")).alias("file"), _of(*parts).alias("content"))
        return G.references(files, language).select("file", "source", "type")

    CATALOG.add(f"references_{language}", " UNION ALL ".join(f"SELECT 'd' || doc_id AS file, {source} AS source, '{kind}' AS type FROM documents" for kind, source in want))(query)


for _language in _CODE:
    _references(_language)


@CATALOG.add("re_exports_rows", "SELECT 'd' || doc_id || '.ts' AS file, n AS name, './' || source AS source FROM documents, (SELECT unnest(['a', 'c']) AS n)")
def re_exports_rows(spark, sf):
    from tessella.functions.scanners import re_exports

    files = table(spark, sf, "documents").select(_of("d", c("doc_id"), ".ts").alias("file"), _of("export { a, b as c } from './", c("source"), "';\n").alias("content"))
    return re_exports(files).select("file", "name", "source")


@CATALOG.add("import_edges", "SELECT 'm' || doc_id || '.ts' AS importer, 's/' || source || '.ts' AS source_file, s AS symbol FROM documents, (SELECT unnest(['a', 'b', 'default']) AS s)")
def import_edges(spark, sf):
    d = table(spark, sf, "documents")
    files = d.select(_of("m", c("doc_id"), ".ts").alias("file"), _of("import z, { a, b as q } from './s/../s/", c("source"), ".js';\nimport { x } from 'outside';\n").alias("content"))
    targets = d.select(_of("s/", c("source"), ".ts").alias("file")).distinct()
    return G.resolve(G.import_statements(files), targets).select("importer", "source_file", "symbol")


@CATALOG.add("python_targets", "SELECT 'p/m' || doc_id || '.py' AS file, '.' || source AS source, 'p/' || source || '.py' AS target FROM documents UNION ALL SELECT 'p/m' || doc_id || '.py', 'q.' || lang, 'src/q/' || lang || '/__init__.py' FROM documents")
def python_targets(spark, sf):
    d = table(spark, sf, "documents")
    at = _of("p/m", c("doc_id"), ".py").alias("file")
    refs = d.select(at, _of(".", c("source")).alias("source")).unionAll(d.select(at, _of("q.", c("lang")).alias("source"))).unionAll(d.select(at, F.lit("os").alias("source")))
    files = d.select(_of("p/", c("source"), ".py").alias("file")).unionAll(d.select(_of("src/q/", c("lang"), "/__init__.py").alias("file"))).distinct()
    return G.resolve_other(refs, files, "python").select("file", "source", "target")


@CATALOG.add("crates", "SELECT DISTINCT 'my_' || source AS crate, source || '/src' AS src FROM documents")
def crates(spark, sf):
    d = table(spark, sf, "documents").select(c("source").alias("dir"), _of("[package]\nversion = \"1\"\nname = \"my-", c("source"), "\"\n").alias("content")).distinct()
    return G.crate_map(d.unionAll(d.select(F.lit("x").alias("dir"), F.lit("[workspace]\n").alias("content")).limit(1)))


@CATALOG.add("rust_targets", "SELECT DISTINCT 'crate_' || source || '::a::B' AS path, 'crate_' || source || '/a.rs' AS file FROM documents UNION ALL SELECT DISTINCT 'crate_' || source || '::c::d::e', 'crate_' || source || '/c/d/mod.rs' FROM documents")
def rust_targets(spark, sf):
    d = table(spark, sf, "documents").select("source").distinct()
    s = c("source")
    paths = d.select(F.explode(F.array(_of("crate_", s, "::a::B"), _of("crate_", s, "::c::d::e"), _of("crate_", s, "::none"))).alias("path"))
    files = d.select(F.explode(F.array(_of("crate_", s, "/a.rs"), _of("crate_", s, "/c/mod.rs"), _of("crate_", s, "/c/d/mod.rs"))).alias("file"))
    return G.rust_modules(paths, files).select("path", "file")


@CATALOG.add("output_names", "SELECT doc_id, 'src-' || source || '-' || doc_id || '-' || substr(sha256('src/' || source || '/' || doc_id || '.tsx'), 1, 8) AS name FROM documents")
def output_names(spark, sf):
    path = _of("src/", c("source"), "/", c("doc_id"), ".tsx")
    return table(spark, sf, "documents").select("doc_id", S.output_name(path).alias("name"))


@CATALOG.add("quoted_paths", "SELECT doc_id, 'src/' || source || chr(39) || chr(39) || 's/' || doc_id || '.ts' AS path FROM documents")
def quoted_paths(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.quote_path(_of("src/", c("source"), "'s/", c("doc_id"), ".ts")).alias("path"))


@CATALOG.add("inject_badge", "SELECT doc_id, concat('# ', source, chr(10), chr(10), '<!-- badge:start -->', chr(10), 'B ', lang, chr(10), '<!-- badge:end -->', CASE WHEN doc_id % 2 = 0 THEN '' ELSE ' tail' END, CASE WHEN doc_id % 2 = 0 THEN chr(10) ELSE '' END) AS page FROM documents")
def inject_badge(spark, sf):
    """Pages without a badge get one at the end, pages with an old one get it replaced; a second time changes nothing."""
    old = F.when(c("doc_id") % 2 == 0, _of("# ", c("source"), "  ")).otherwise(_of("# ", c("source"), "\n\n<!-- badge:start -->\nold\n<!-- badge:end --> tail"))
    once = table(spark, sf, "documents").select("doc_id", "lang", S.inject_block(old, _of("B ", c("lang"))).alias("page"))
    return once.select("doc_id", S.inject_block(c("page"), _of("B ", c("lang"))).alias("page"))


@CATALOG.add("identical_actions", """WITH a AS (SELECT p_partkey % 50 AS k, p_partkey, 'f' || p_partkey % 50 AS file, 's' || p_partkey % 2 AS category FROM part),
g AS (SELECT file, category, count(*) AS n, min(p_partkey) AS id, string_agg('n' || p_partkey, ', ' ORDER BY p_partkey) AS target FROM a GROUP BY ALL)
SELECT file, category, n, id, target FROM g WHERE n >= 3 UNION ALL SELECT a.file, a.category, 1, a.p_partkey, 'n' || a.p_partkey FROM a JOIN g USING (file, category) WHERE g.n < 3""")
def identical_actions(spark, sf):
    p = table(spark, sf, "part").select(_of("f", c("p_partkey") % 50).alias("file"), F.lit("x").alias("source"), _of("s", c("p_partkey") % 2).alias("category"), c("p_partkey").alias("id"), _of("n", c("p_partkey")).alias("target"))
    return R.group_identical(p.withColumn("description", _of("Document ", c("target"), " now"))).select("file", "category", "n", "id", "target")


@CATALOG.add("detail_segments", "SELECT p_partkey, ['A', p_type] AS vals, ['one ' || p_brand, 'two'] AS texts FROM part")
def detail_segments(spark, sf):
    parts = R.parse_detail(_of("[A] one ", c("p_brand"), " | [", c("p_type"), "] two"))
    return table(spark, sf, "part").select("p_partkey", F.transform(parts, lambda x: x["value"]).alias("vals"), F.transform(parts, lambda x: x["text"]).alias("texts"))


@CATALOG.add("module_pages", """WITH f AS (SELECT source AS module, 'n' || doc_id || '.ts' AS name, n_chars % 400 AS loc FROM documents), l AS (SELECT *, count(*) OVER (PARTITION BY module) AS n FROM f WHERE loc >= 200)
SELECT DISTINCT CASE WHEN n >= 3 THEN module ELSE regexp_replace(name, '[.][^.]+$', '') END AS title, module, n >= 3 AS whole FROM l""")
def module_pages(spark, sf):
    files = table(spark, sf, "documents").select(c("source").alias("module"), _of("n", c("doc_id"), ".ts").alias("name"), (c("n_chars") % 400).alias("loc"))
    return D.module_pages(files).select("title", "module", "whole")


@CATALOG.add("page_gaps", "SELECT 'p' || source AS page, count(DISTINCT 'f' || doc_id) AS n_functions, count(DISTINCT lang) AS n_concepts FROM documents GROUP BY source")
def page_gaps(spark, sf):
    d = table(spark, sf, "documents")
    functions = d.select(F.lit("missing").alias("state"), _of("p", c("source")).alias("page"), _of("f", c("doc_id")).alias("name")).unionAll(d.select(F.lit("covered"), _of("p", c("source")), F.lit("never")))
    got = P.gaps_per_page(functions, d.select(_of("p", c("source")).alias("page"), c("lang").alias("concept")))
    of = lambda kind: F.size(F.filter("items", lambda x: x["kind"] == kind)).cast("long")
    return got.select("page", of("function").alias("n_functions"), of("concept").alias("n_concepts"))


@CATALOG.add("models_in_use", "SELECT DISTINCT m AS model FROM (SELECT p_brand AS m FROM part UNION ALL SELECT p_type FROM part)")
def models_in_use(spark, sf):
    slots = F.create_map(F.lit("fast"), c("p_brand"), F.lit("deep"), c("p_type"), F.lit("none"), F.lit(None).cast("string"))
    return J.active_models(table(spark, sf, "part").select(slots.alias("slots")))


@CATALOG.add("frameworks_found", "SELECT 'nextjs' AS id UNION ALL SELECT 'express'")
def frameworks_found(spark, sf):
    """A manifest with a framework that suppresses another one."""
    names = table(spark, sf, "region").select(F.explode(F.array(F.lit("next"), F.lit("react"), F.lit("express"), _of("x", c("r_regionkey")))).alias("name"))
    return J.detect_frameworks(names).filter("id in ('nextjs', 'react', 'express')").select("id")


@CATALOG.add("merged_dependencies", "SELECT 'd' || p_partkey AS name, CASE WHEN p_partkey % 3 = 0 THEN 'dev' ELSE 'prod' END AS version FROM part")
def merged_dependencies(spark, sf):
    p = table(spark, sf, "part")
    rows = lambda df, v: df.select(_of("d", c("p_partkey")).alias("name"), F.lit(v).alias("version"))
    return J.merge_dependencies(rows(p, "prod"), rows(p.filter("p_partkey % 3 = 0"), "dev"))


@CATALOG.add("latest_run", "SELECT max(user_id) AS run_id, true AS by_id FROM (SELECT CAST(user_id AS VARCHAR) AS user_id FROM events) UNION ALL SELECT min(CAST(user_id AS VARCHAR)), false FROM events")
def latest_run(spark, sf):
    runs = table(spark, sf, "events").select(c("user_id").cast("string").alias("run_id")).distinct()
    least = runs.agg(F.min("run_id")).first()[0]
    with_alias = runs.unionAll(runs.select(F.lit("latest")).limit(1))
    return I.resolve_latest(with_alias, "gone").withColumn("by_id", F.lit(True)).unionAll(I.resolve_latest(with_alias, least).withColumn("by_id", F.lit(False)))


@CATALOG.add("run_statuses", "SELECT user_id AS run_id, CASE WHEN user_id % 3 = 0 THEN 'done' WHEN user_id % 2 = 0 THEN 'running' ELSE 'crashed' END AS status FROM (SELECT DISTINCT user_id FROM events)")
def run_statuses(spark, sf):
    runs = table(spark, sf, "events").select(c("user_id").alias("run_id")).distinct()
    status = F.when(c("run_id") % 3 == 0, "done").otherwise("running")
    return I.repair(runs.select("run_id", status.alias("status"), (c("run_id") % 2 == 0).alias("alive"))).select("run_id", "status")


@CATALOG.add("moved_links", "SELECT doc_id, '[a](new/' || source || '.md) [b](other/x)' AS page FROM documents")
def moved_links(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.relink(_of("[a](old.d/", c("source"), ".md) [b](other/x)"), "old.d/", "new/").alias("page"))


@CATALOG.add("card_calls", "SELECT 'd' || doc_id || '.ts' AS file, n AS name, CASE n WHEN 'a' THEN ['b'] WHEN 'b' THEN [] ELSE ['a', 'b'] END AS called FROM documents, (SELECT unnest(['a', 'b', 'k']) AS n)")
def card_calls(spark, sf):
    d = table(spark, sf, "documents").select(_of("d", c("doc_id"), ".ts").alias("file"), _of("function a() { return b(1) }\nfunction b() { return b2(2) }\nfunction k() {\n  a(); b<", c("lang"), ">(x)\n}\n").alias("content"))
    lines = [("a", 1, 1), ("b", 2, 2), ("k", 3, 5)]
    symbols = d.select("file", F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit("function").alias("kind"), F.lit(a).alias("line_start"), F.lit(b).alias("line_end")) for n, a, b in lines])).alias("s")).select("file", "s.*")
    return X.cards(symbols, d).select("file", "name", "called")


def _functions(d):
    """Documents as files of one function whose body names their language."""
    files = d.select(_of("d", c("doc_id"), ".ts").alias("file"), _of("function f", c("doc_id"), "() {\n  return ", c("lang"), "\n}").alias("content"))
    symbols = files.select("file", F.regexp_extract("content", r"function (\w+)", 1).alias("name"), F.lit("function").alias("kind"), F.lit(1).alias("line_start"), F.lit(3).alias("line_end"))
    return symbols, files


@CATALOG.add("refresh_project", "SELECT 'f' || doc_id AS name, CASE WHEN doc_id % 5 = 0 OR doc_id % 3 = 0 THEN 'second' ELSE 'first' END AS embedded FROM documents WHERE doc_id % 7 <> 0")
def refresh_project(spark, sf):
    """Two runs: between them every third file is new, every fifth changes and every seventh goes."""
    d = table(spark, sf, "documents").select("doc_id", "lang")
    embed = lambda run: lambda cards: cards.withColumns({"vector": F.array_repeat(F.lit(1.0).cast("float"), 4), "nlp_vector": F.lit(None).cast("array<float>"), "doc_vector": F.lit(None).cast("array<float>"), "summary": F.lit(run)})
    one = refresh.project(None, None, *_functions(d.filter("doc_id % 3 <> 0")), embed("first"), (4, 4))
    later = d.filter("doc_id % 7 <> 0").withColumn("lang", F.when(c("doc_id") % 5 == 0, F.lit("x")).otherwise(c("lang")))
    two = refresh.project(one.index, one.cache, *_functions(later), embed("second"), (4, 4))
    return two.index.select("name", c("summary").alias("embedded"))


@CATALOG.add("refresh_sections", "SELECT 'd' || doc_id || '.md' AS file, count(*) AS n, bool_or(doc_id % 5 = 0 OR doc_id % 3 = 0) AS again FROM documents WHERE doc_id % 7 <> 0 GROUP BY ALL")
def refresh_sections(spark, sf):
    """As refresh_project, for documents of one section each."""
    d = table(spark, sf, "documents").select("doc_id", "lang")
    page = lambda x: x.select(_of("d", c("doc_id"), ".md").alias("file"), _of("## Head\n\n", F.repeat(_of("words of ", c("lang"), " "), 20)).alias("content"))
    embed = lambda value: lambda rows: rows.withColumn("nlp_vector", F.array_repeat(F.lit(value).cast("float"), 4))
    empty = spark.createDataFrame([], "id string, file string, name string, summary string, vector array<float>, nlp_vector array<float>, doc_vector array<float>, type string, source string")
    one = refresh.sections(empty, None, page(d.filter("doc_id % 3 <> 0")), "user", embed(1.0), (4, 4), smart=False)
    later = d.filter("doc_id % 7 <> 0").withColumn("lang", F.when(c("doc_id") % 5 == 0, F.lit("x")).otherwise(c("lang")))
    two = refresh.sections(one.index, one.cache, page(later), "user", embed(2.0), (4, 4), smart=False)
    return two.index.groupBy("file").agg(F.count("*").alias("n"), F.bool_or(F.get("nlp_vector", F.lit(0)) == 2.0).alias("again"))


@CATALOG.add("test_file_links", "SELECT 'src/m' || doc_id || '.ts' AS file, 'tests/m' || doc_id || '.test.ts' AS test FROM documents UNION ALL SELECT 'src/m' || doc_id || '.ts', 'tests/all' || doc_id || '.ts' FROM documents WHERE doc_id % 2 = 0")
def test_file_links(spark, sf):
    d = table(spark, sf, "documents").select("doc_id")
    none = F.array().cast("array<string>")
    tests = d.select(_of("tests/m", c("doc_id"), ".test.ts").alias("test"), none.alias("imports")).unionAll(d.filter("doc_id % 2 = 0").select(_of("tests/all", c("doc_id"), ".ts"), F.array(_of("../src/m", c("doc_id"), ".js"))))
    return G.test_files(d.select(_of("src/m", c("doc_id"), ".ts").alias("file")), tests)


@CATALOG.add("file_packages", "SELECT 'm' || doc_id AS file, '@a/' || source AS name, 'v' || source AS version, 2 AS pos FROM documents UNION ALL SELECT 'm' || doc_id, lang, 'w', 1 FROM documents")
def file_packages(spark, sf):
    d = table(spark, sf, "documents")
    refs = d.select(_of("m", c("doc_id")).alias("file"), F.explode(F.array(F.struct(_of(c("lang"), "/sub").alias("source"), F.lit(1).alias("pos")), F.struct(_of("@a/", c("source"), "/x/y").alias("source"), F.lit(2).alias("pos")), F.struct(_of("@a/", c("source")).alias("source"), F.lit(4).alias("pos")), F.struct(F.lit("./near").alias("source"), F.lit(3).alias("pos")))).alias("r")).select("file", "r.*")
    manifest = d.select(_of("@a/", c("source")).alias("name"), _of("v", c("source")).alias("version")).unionAll(d.select("lang", F.lit("w"))).distinct()
    return G.file_dependencies(refs, manifest)


@CATALOG.add("language_globs", """WITH f AS (SELECT CASE WHEN doc_id % 20 < 9 THEN 'TypeScript' WHEN doc_id % 20 < 16 THEN 'Python' WHEN doc_id % 20 < 18 AND source = 's1' THEN 'Rust' WHEN doc_id % 20 < 18 THEN 'SQL' WHEN doc_id % 400 < 398 THEN 'Go' END AS lang FROM documents),
n AS (SELECT lang, count(*) AS n FROM f WHERE lang IS NOT NULL GROUP BY lang), k AS (SELECT * FROM n WHERE n >= 0.01 * (SELECT sum(n) FROM n)), s AS (SELECT lang FROM k WHERE round(100 * n / (SELECT sum(n) FROM k)) >= 5),
x AS (SELECT unnest(['.ts', '.tsx', '.py', '.rs', '.sql', '.go']) AS ext, unnest(['TypeScript', 'TypeScript', 'Python', 'Rust', 'SQL', 'Go']) AS lang)
SELECT 'src/**/*' || ext AS glob FROM s JOIN x USING (lang)""")
def language_globs(spark, sf):
    """Globs of the languages of a tree whose files are the documents, named by id and source."""
    twentieth = c("doc_id") % 20
    ext = F.when(twentieth < 9, ".ts").when(twentieth < 16, ".py").when((twentieth < 18) & (c("source") == "s1"), ".rs").when(twentieth < 18, ".sql").when(c("doc_id") % 400 < 398, ".go").otherwise(".unknown")
    files = table(spark, sf, "documents").select(J.classify_file(_of("src/d", c("doc_id"), ext)).alias("lang"))
    return J.scan_globs(J.language_shares(files, "lang"))


@CATALOG.add("summarised_cards", "SELECT 'c' || p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN left(repeat(p_type, 60), 400) END AS summary, CASE WHEN p_partkey % 4 = 0 THEN 'async' ELSE 'utility' END AS behavioral_profile FROM part")
def summarised_cards(spark, sf):
    p = table(spark, sf, "part")
    key = _of("c", c("p_partkey")).alias("id")
    found = p.filter("p_partkey % 2 = 0").select(key, F.repeat("p_type", 60).alias("summary"), F.lit("").alias("doc_summary"), F.array(F.lit("k")).alias("key_concepts"), F.when(c("p_partkey") % 4 == 0, "async").otherwise("odd").alias("behavioral_profile"))
    done, missing = X.with_summaries(p.select(key), found)
    return done.select("id", "summary", "behavioral_profile")


@CATALOG.add("index_deltas", """WITH s AS (SELECT vec_id AS id, label, CASE WHEN vec_id % 14 = 0 THEN 'two' WHEN label % 5 = 1 THEN NULL WHEN label % 3 = 0 THEN 'one' WHEN vec_id % 7 = 0 THEN NULL ELSE 'base' END AS state
FROM embeddings WHERE vec_id % 11 <> 3) SELECT * FROM s WHERE state IS NOT NULL""")
def index_deltas(spark, sf):
    """A table of vectors changed three times and compacted between, as it is read in the end."""
    e = table(spark, sf, "embeddings").select(c("vec_id").alias("id"), "label")
    of = lambda condition, state: e.filter(condition).withColumn("state", F.lit(state))
    t = Table(spark, folder(spark, "index"), "id")
    t.write(of("true", "base"))
    t.write(of("label % 3 = 0", "one"), e.filter("id % 7 = 0"))
    t.write(of("id % 14 = 0", "two"), e.filter("label % 5 = 1"))
    t.compact(0.0)
    t.write(None, e.filter("id % 11 = 3"))
    return t.read()

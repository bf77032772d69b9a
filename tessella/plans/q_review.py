"""Review, rule and report queries: symbol reviews are derived from `documents` and `labels`, one symbol a document."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import report, rules
from tessella.plans.base import Catalog, table

CATALOG = Catalog()

#: The derivation, in SQL that both engines read alike.
REVIEWS = """SELECT concat(d.source, '/', d.lang, '.ts') AS file, concat('doc_', d.doc_id) AS name, d.doc_id % 3 <> 0 AS exported, CASE WHEN d.doc_id % 4 = 0 THEN 'class' ELSE 'function' END AS kind,
  1 AS line_start, CAST(1 + floor(d.n_chars / 120) AS INT) AS line_end,
  CASE WHEN l.toxic = 1 THEN 'ERROR' WHEN d.doc_id % 9 = 0 THEN 'NEEDS_FIX' WHEN d.doc_id % 31 = 0 THEN '-' ELSE 'OK' END AS correction,
  CASE WHEN d.n_chars > 4000 THEN 'OVER' WHEN d.doc_id % 7 = 0 THEN 'ACCEPTABLE' ELSE 'LEAN' END AS overengineering,
  CASE WHEN l.quality = 0 THEN 'DEAD' WHEN d.doc_id % 13 = 0 THEN 'LOW_VALUE' WHEN d.doc_id % 29 = 0 THEN '-' ELSE 'USED' END AS utility,
  CASE WHEN d.doc_id % 17 = 0 THEN 'DUPLICATE' ELSE 'UNIQUE' END AS duplication,
  CASE WHEN d.doc_id % 5 = 0 THEN 'WEAK' WHEN d.doc_id % 8 = 0 THEN 'NONE' WHEN d.doc_id % 23 = 0 THEN '-' ELSE 'GOOD' END AS tests,
  CASE WHEN d.doc_id % 6 = 0 THEN 'PARTIAL' WHEN d.doc_id % 10 = 1 THEN 'UNDOCUMENTED' ELSE 'DOCUMENTED' END AS documentation,
  CAST((d.doc_id * 7) % 101 AS INT) AS confidence, CASE WHEN d.doc_id % 34 = 0 THEN 'x.ts' END AS duplicate_target,
  CASE WHEN d.doc_id % 18 = 0 THEN 'possible XSS injection' WHEN d.doc_id % 27 = 0 THEN 'changes the return value' ELSE 'plain remark' END AS detail
  FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id"""
_R = "r AS (" + REVIEWS.replace("{documents}", "documents").replace("{labels}", "labels") + ")"
_COLS = "file, name, exported, line_start, line_end"


def reviews(spark, sf):
    return spark.sql(REVIEWS, documents=table(spark, sf, "documents"), labels=table(spark, sf, "labels"))


def _oracle(sql: str) -> str:
    return f"WITH {_R} {sql}"


_SMALL = "(NOT exported AND line_end - line_start + 1 < 15)"
_COHERENT = f"""k AS (SELECT * REPLACE (CASE WHEN utility = 'DEAD' AND tests <> '-' THEN 'NONE' ELSE tests END AS tests, CASE WHEN correction = 'ERROR' AND overengineering <> '-' THEN 'ACCEPTABLE' ELSE overengineering END AS overengineering,
  CASE WHEN utility = 'DEAD' AND documentation <> '-' THEN 'UNDOCUMENTED' ELSE documentation END AS documentation) FROM r)"""


@CATALOG.add("coherence_rules", f"""WITH {_R}, {_COHERENT} SELECT name, overengineering, CASE WHEN {_SMALL} AND documentation = 'UNDOCUMENTED' THEN 'DOCUMENTED' ELSE documentation END AS documentation,
  CASE WHEN {_SMALL} AND tests = 'NONE' THEN 'WEAK' ELSE tests END AS tests, CASE WHEN {_SMALL} AND (tests = 'NONE' OR documentation = 'UNDOCUMENTED') THEN least(confidence, 60) ELSE confidence END AS confidence FROM k""")
def coherence_rules(spark, sf):
    return rules.coherence(reviews(spark, sf)).select("name", "overengineering", "documentation", "tests", "confidence")


@CATALOG.add("contradictions", _oracle("""SELECT name, CASE WHEN correction = 'NEEDS_FIX' AND file IN (SELECT file FROM r WHERE kind = 'class' GROUP BY file)
  AND (lower(detail) LIKE '%injection%' OR lower(detail) LIKE '%xss%') THEN least(confidence, 55) ELSE confidence END AS confidence FROM r"""))
def contradictions(spark, sf):
    r = reviews(spark, sf)
    passed = r.filter("kind = 'class'").select("file", F.lit(13).alias("rule_id"), F.lit("PASS").alias("status")).distinct()
    return rules.contradictions(r, passed).select("name", "confidence")


_SEVERITY = """CASE WHEN correction = 'ERROR' THEN 'high' WHEN (correction = 'NEEDS_FIX' OR utility = 'DEAD' OR duplication = 'DUPLICATE') AND confidence >= 80 THEN 'high'
  WHEN correction = 'NEEDS_FIX' OR utility = 'DEAD' OR duplication = 'DUPLICATE' OR overengineering = 'OVER' THEN 'medium' ELSE 'low' END"""
_FINDING = {"correction": "correction IN ('NEEDS_FIX','ERROR')", "utility": "utility = 'DEAD'", "duplication": "duplication = 'DUPLICATE'", "overengineering": "overengineering = 'OVER'", "tests": "tests IN ('WEAK','NONE')", "documentation": "(documentation = 'PARTIAL' OR (documentation = 'UNDOCUMENTED' AND exported))"}


@CATALOG.add("symbol_severity", _oracle(f"SELECT name, {_SEVERITY} AS severity FROM r"))
def symbol_severity(spark, sf):
    return reviews(spark, sf).select("name", rules.symbol_severity().alias("severity"))


_COUNT = " UNION ALL ".join(f"SELECT '{a}' AS axis, {_SEVERITY} AS severity FROM r WHERE confidence >= 30 AND {p}" for a, p in _FINDING.items())


@CATALOG.add("axis_counts", _oracle(f"""SELECT axis, severity, count(h) AS n FROM (SELECT a.axis, s.severity FROM (SELECT unnest({list(_FINDING)}) AS axis) a, (SELECT unnest(['high','medium','low']) AS severity) s)
  LEFT JOIN (SELECT *, 1 AS h FROM ({_COUNT})) USING (axis, severity) GROUP BY ALL"""))
def axis_counts(spark, sf):
    return report.axis_counts(reviews(spark, sf))


_LONG = " UNION ALL ".join(f"SELECT '{a}' AS axis, {a} AS value, confidence, {a} IN ({','.join(repr(v) for v in rules.CLEAN_VALUES[a])}) AS ok FROM r WHERE {a} <> '-'" for a in rules.AXES)


@CATALOG.add("axis_health", _oracle(f"SELECT axis, count(*) FILTER (ok) AS n_ok, count(*) AS n_evaluated, CAST(round(100 * count(*) FILTER (ok) / count(*)) AS BIGINT) AS pct FROM ({_LONG}) WHERE confidence >= 30 GROUP BY axis"))
def axis_health(spark, sf):
    return report.axis_health(reviews(spark, sf))


@CATALOG.add("verdict_distribution", _oracle(f"SELECT axis, value, count(*) AS n, CAST(round(100 * count(*) / sum(count(*)) OVER (PARTITION BY axis)) AS BIGINT) AS pct FROM ({_LONG}) GROUP BY axis, value"))
def verdict_distribution(spark, sf):
    return report.verdict_distribution(reviews(spark, sf), 0.1)


_WORST = "(utility = 'DEAD' OR duplication = 'DUPLICATE' OR overengineering = 'OVER' OR (documentation = 'UNDOCUMENTED' AND exported))"


def _verdict_sql(critical: str, refactor: str) -> str:
    return f"CASE WHEN {critical} THEN 'CRITICAL' WHEN {refactor} THEN 'NEEDS_REFACTOR' ELSE 'CLEAN' END"


_MERGED = _verdict_sql("bool_or(confidence >= 60 AND correction = 'ERROR')", f"bool_or(confidence >= 60 AND (correction = 'NEEDS_FIX' OR {_WORST})) OR count(*) FILTER (confidence >= 60 AND documentation = 'PARTIAL') >= 3")
_TIER = _verdict_sql("bool_or(confidence >= 60 AND correction = 'ERROR')", f"bool_or(confidence >= 60 AND (correction = 'NEEDS_FIX' OR {_WORST}))")
_ANY = " OR ".join([*_FINDING.values(), "utility = 'LOW_VALUE'"])
_REPORTED = _verdict_sql("bool_or(confidence >= 60 AND correction = 'ERROR')", f"bool_or(confidence >= 60 AND ({_ANY})) OR bool_or(name = 'doc_1')")
_DELIB = """CASE WHEN bool_or(correction = 'ERROR') THEN 'CRITICAL' WHEN bool_or(correction = 'NEEDS_FIX' OR utility IN ('DEAD','LOW_VALUE') OR duplication = 'DUPLICATE' OR overengineering = 'OVER' OR tests IN ('WEAK','NONE') OR documentation IN ('UNDOCUMENTED','PARTIAL')) THEN 'NEEDS_REFACTOR' ELSE 'CLEAN' END"""


@CATALOG.add("verdict_file", _oracle(f"SELECT file, {_MERGED} AS merged, {_TIER} AS tier, {_REPORTED} AS reported, {_DELIB} AS deliberated FROM r GROUP BY file"))
def verdict_file(spark, sf):
    return reviews(spark, sf).groupBy("file").agg(rules.verdict_merged().alias("merged"), rules.verdict_merged(False).alias("tier"), rules.verdict_reported(F.col("name") == "doc_1").alias("reported"), rules.verdict_deliberated(F.lit("CLEAN")).alias("deliberated"))


@CATALOG.add("verdict_global", f"WITH {_R}, f AS (SELECT file, {_MERGED} AS verdict FROM r GROUP BY file) SELECT CASE WHEN bool_or(verdict = 'CRITICAL') THEN 'CRITICAL' WHEN bool_or(verdict = 'NEEDS_REFACTOR') THEN 'NEEDS_REFACTOR' ELSE 'CLEAN' END AS verdict FROM f")
def verdict_global(spark, sf):
    return rules.global_verdict(reviews(spark, sf).groupBy("file").agg(rules.verdict_merged().alias("verdict")))


@CATALOG.add("systemic_dead", _oracle("SELECT split_part(file, '/', 1) AS dir, count(*) AS n FROM r WHERE utility = 'DEAD' GROUP BY 1 HAVING count(*) > 2"))
def systemic_dead(spark, sf):
    return report.systemic_dead(reviews(spark, sf), 2)


_FILES = f"f AS (SELECT file, {_MERGED} AS verdict, count(*) FILTER ({_ANY}) AS n_findings, max(confidence) AS max_confidence FROM r GROUP BY file), o AS (SELECT *, row_number() OVER (ORDER BY CASE verdict WHEN 'CRITICAL' THEN 0 WHEN 'NEEDS_REFACTOR' THEN 1 ELSE 2 END, n_findings DESC, max_confidence DESC, file) AS position FROM f)"


def _ordered(spark, sf):
    finding = F.lit(False)
    for a in rules.AXES:
        finding = finding | rules.has_finding(a)
    return report.sort_findings(reviews(spark, sf).groupBy("file").agg(rules.verdict_merged().alias("verdict"), F.count_if(finding).alias("n_findings"), F.max("confidence").alias("max_confidence")))


@CATALOG.add("finding_sort", f"WITH {_R}, {_FILES} SELECT file, verdict, n_findings, max_confidence, CAST(position AS INTEGER) AS position FROM o")
def finding_sort(spark, sf):
    return _ordered(spark, sf)


@CATALOG.add("finding_shards", f"WITH {_R}, {_FILES} SELECT CAST(ceil(position / 10) AS BIGINT) AS shard, count(*) AS n_files, CAST(sum(n_findings) AS BIGINT) AS n_findings, arg_min(file, position) AS first_file FROM o GROUP BY 1")
def finding_shards(spark, sf):
    return report.shards(_ordered(spark, sf))


@CATALOG.add("dir_shards20", _oracle("SELECT file AS dir, name AS pos, CAST(floor((row_number() OVER (PARTITION BY file ORDER BY name) - 1) / 20) AS BIGINT) AS shard FROM r"))
def dir_shards20(spark, sf):
    return report.directory_shards(reviews(spark, sf).select(F.col("file").alias("dir"), F.col("name").alias("pos")))


@CATALOG.add("axis_files", _oracle("SELECT file, count(*) FILTER (tests IN ('WEAK','NONE')) AS n_findings, max(confidence) AS max_confidence FROM r GROUP BY file HAVING count(*) FILTER (tests IN ('WEAK','NONE')) > 0"))
def axis_files(spark, sf):
    return report.axis_files(reviews(spark, sf), "tests")


@CATALOG.add("tier1_rules", _oracle("""SELECT name, CASE WHEN utility = 'DEAD' AND u.n > 0 THEN 'USED' ELSE utility END AS utility,
  CASE WHEN duplication = 'DUPLICATE' AND duplicate_target IS NULL AND coalesce(s.top, 0) < 0.68 THEN 'UNIQUE' ELSE duplication END AS duplication,
  CASE WHEN overengineering = 'OVER' AND line_end <= 5 THEN 'LEAN' WHEN overengineering = 'LEAN' AND kind = 'class' AND exported AND line_end >= 15 AND coalesce(u.n, 0) <= 1 THEN 'OVER' ELSE overengineering END AS overengineering,
  CASE WHEN documentation = 'UNDOCUMENTED' AND line_end <= 2 THEN 'DOCUMENTED' ELSE documentation END AS documentation
  FROM r LEFT JOIN (SELECT doc_id, doc_id % 3 AS n FROM documents WHERE doc_id % 2 = 0) u ON r.name = concat('doc_', u.doc_id) LEFT JOIN (SELECT doc_id, (doc_id % 100) / 100 AS top FROM documents) s ON r.name = concat('doc_', s.doc_id)"""))
def tier1_rules(spark, sf):
    r = reviews(spark, sf)
    number = F.substring("name", 5, 20).cast("long")
    usage = r.filter(number % 2 == 0).select("file", "name", (number % 3).alias("n_importers"))
    near = r.select("file", "name", ((number % 100) / 100).alias("top_score"))
    return rules.tier1(r, usage, near).select("name", "utility", "duplication", "overengineering", "documentation")


_OTHERS = " AND ".join(f"({a} = '-' OR {a} IN ({','.join(repr(v) for v in rules.CLEAN_VALUES[a])}))" for a in rules.AXES[1:])


@CATALOG.add("tier2_rules", _oracle(f"""SELECT name, CASE WHEN correction = 'ERROR' THEN 'error' WHEN utility = 'DEAD' THEN NULL WHEN correction = 'NEEDS_FIX' AND {_OTHERS} AND confidence < 75 THEN 'isolated'
  WHEN correction = 'NEEDS_FIX' AND regexp_matches(lower(detail), 'behavio|return value|side effect|breaking|semantics') THEN 'behavioural' END AS escalated,
  CASE WHEN correction <> 'ERROR' AND utility = 'DEAD' AND correction = 'NEEDS_FIX' THEN 'OK' ELSE correction END AS correction,
  CASE WHEN correction <> 'ERROR' AND utility = 'DEAD' AND tests IN ('WEAK','NONE') THEN '-' ELSE tests END AS tests,
  CASE WHEN correction <> 'ERROR' AND utility IN ('DEAD','LOW_VALUE') AND documentation IN ('UNDOCUMENTED','PARTIAL') THEN '-' ELSE documentation END AS documentation FROM r"""))
def tier2_rules(spark, sf):
    return rules.tier2(reviews(spark, sf)).select("name", "escalated", "correction", "tests", "documentation")


@CATALOG.add("needs_deliberation", _oracle(f"SELECT file, bool_or(({_ANY}) AND confidence < 95) OR (NOT bool_or({_ANY}) AND min(confidence) < 70) AS needed FROM r GROUP BY file"))
def needs_deliberation(spark, sf):
    return reviews(spark, sf).groupBy("file").agg(rules.needs_deliberation().alias("needed"))


@CATALOG.add("apply_deliberation", _oracle("""SELECT name, CASE WHEN hit AND NOT (correction = 'ERROR' AND n % 100 < 95) THEN 'OK' ELSE correction END AS correction, CASE WHEN hit THEN CAST(n % 100 AS INT) ELSE confidence END AS confidence
  FROM (SELECT *, CAST(substr(name, 5) AS BIGINT) AS n, CAST(substr(name, 5) AS BIGINT) % 2 = 0 AS hit FROM r)"""))
def apply_deliberation(spark, sf):
    r = reviews(spark, sf)
    n = F.substring("name", 5, 20).cast("long")
    said = r.filter(n % 2 == 0).select("file", "name", F.lit("correction").alias("axis"), F.lit("OK").alias("value"), (n % 100).cast("int").alias("confidence"))
    return rules.apply_deliberation(r, said).select("name", "correction", "confidence")


_SYNTH = " UNION ALL ".join(f"SELECT file, name, '{a}' AS axis, {_SEVERITY} AS severity, '{k}' AS category FROM r WHERE confidence >= 30 AND {p}" for (a, p), k in zip({**_FINDING, "utility": "utility IN ('DEAD','LOW_VALUE')"}.items(), ("quickwin", "quickwin", "refactor", "refactor", "hygiene", "hygiene"), strict=True))


@CATALOG.add("synthesize_actions", _oracle(_SYNTH))
def synthesize_actions(spark, sf):
    return rules.synthesize_actions(reviews(spark, sf))


@CATALOG.add("unique_synthesized", _oracle(f"SELECT * FROM ({_SYNTH}) WHERE name NOT IN (SELECT name FROM r WHERE detail = 'plain remark')"))
def unique_synthesized(spark, sf):
    r = reviews(spark, sf)
    return rules.synthesize_actions(r).join(r.filter("detail = 'plain remark'").select("file", "name"), ["file", "name"], "left_anti")


@CATALOG.add("merge_actions", f"WITH {_R}, s AS ({_SYNTH}), n AS (SELECT file, axis, name, row_number() OVER (PARTITION BY file, axis ORDER BY name) AS id FROM s WHERE axis IN ('tests', 'utility')) SELECT file, axis AS source, name, CAST(row_number() OVER (PARTITION BY file ORDER BY axis, id) AS INTEGER) AS id FROM n")
def merge_actions(spark, sf):
    from pyspark.sql import Window

    s = rules.synthesize_actions(reviews(spark, sf)).withColumn("id", F.row_number().over(Window.partitionBy("file", "axis").orderBy("name")))
    return rules.merge_actions([(a, s.filter(F.col("axis") == a).select("file", "name", "id")) for a in ("tests", "utility")])


@CATALOG.add("duplication_invariant", _oracle("SELECT name, CASE WHEN duplicate_target IS NOT NULL AND duplication <> '-' THEN 'DUPLICATE' ELSE duplication END AS duplication FROM r"))
def duplication_invariant(spark, sf):
    return reviews(spark, sf).select("name", rules.enforce_duplication().alias("duplication"))


@CATALOG.add("review_merge_pivot", _oracle("SELECT file, name, correction, tests, '-' AS utility, CAST(CASE WHEN correction = 'ERROR' THEN confidence ELSE least(confidence, 90) END AS INT) AS confidence, CASE WHEN correction = 'ERROR' THEN concat('[ERROR] ', detail) ELSE concat('[', correction, '] ', detail, ' | [', tests, '] checked') END AS detail FROM (SELECT * REPLACE (CASE WHEN correction = 'ERROR' THEN '-' ELSE tests END AS tests) FROM r)"))
def review_merge_pivot(spark, sf):
    r = reviews(spark, sf)
    one = r.select("file", "name", F.lit("correction").alias("axis"), F.lit(1).alias("pos"), F.col("correction").alias("value"), "confidence", "detail", F.lit(False).alias("failed"))
    old = one.withColumns({"pos": F.lit(0), "value": F.lit("OLD")})
    two = r.select("file", "name", F.lit("tests").alias("axis"), F.lit(1).alias("pos"), F.col("tests").alias("value"), F.lit(90).alias("confidence"), F.lit("checked").alias("detail"), (F.col("correction") == "ERROR").alias("failed"))
    out = rules.merge_axes(r.select("file", "name"), old.unionAll(one).unionAll(two))
    return out.select("file", "name", "correction", "tests", "utility", "confidence", "detail")


@CATALOG.add("budget_prefix", "WITH o AS (SELECT o_custkey, o_orderkey, coalesce(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM orders) SELECT o_custkey, o_orderkey, round(spent, 2) AS spent FROM o WHERE spent < 300000")
def budget_prefix(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return report.budget_prefix(o, "o_orderkey", "o_totalprice", "o_custkey", 300000.0).select("o_custkey", "o_orderkey", F.round("spent", 2).alias("spent"))


@CATALOG.add("line_range_anti", "WITH a AS (SELECT l_orderkey AS file, l_partkey % 100 AS line, l_linenumber FROM lineitem), k AS (SELECT l_orderkey AS file, l_suppkey % 50 AS s, l_suppkey % 50 + 10 AS e FROM lineitem WHERE l_linenumber = 1) SELECT file, line, l_linenumber FROM a WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.file = a.file AND a.line BETWEEN k.s AND k.e)")
def line_range_anti(spark, sf):
    l = table(spark, sf, "lineitem")  # noqa: E741
    actions = l.select(F.col("l_orderkey").alias("file"), (F.col("l_partkey") % 100).alias("line"), "l_linenumber")
    ok = l.filter("l_linenumber = 1").select(F.col("l_orderkey").alias("file"), (F.col("l_suppkey") % 50).alias("start"), (F.col("l_suppkey") % 50 + 10).alias("end"))
    return rules.drop_ok_ranges(actions, ok)

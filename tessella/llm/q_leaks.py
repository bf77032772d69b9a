"""Query op3: benchmark decontamination."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import table
from tessella.llm.decontaminate import find_leaks


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


QUERIES = {"op3_benchmark_decontamination": op3_benchmark_decontamination}


def leaks_sql(documents: str = "documents") -> str:
    """CTEs up to leaks(doc_id, n_words, n_hit, n_items, items): what find_leaks gives for a table of documents."""
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
lw AS (SELECT doc_id, {words} AS w FROM {documents}),
liw AS (SELECT item_id, {words} AS w FROM benchmark),
lwin AS (SELECT DISTINCT item_id, least(10, len(w)) AS k, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM liw WHERE len(w) > 0)),
lk AS (SELECT DISTINCT k FROM lwin),
ldoc AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM lw, lk WHERE len(w) >= k)),
lhit AS (SELECT d.doc_id, d.i, d.k, n.item_id FROM ldoc d JOIN lwin n ON d.k = n.k AND d.g = n.g),
lpos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM lhit) GROUP BY doc_id),
litem AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM lhit) GROUP BY doc_id),
leaks AS (SELECT lw.doc_id, len(lw.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(items, '') AS items
  FROM lw LEFT JOIN lpos USING (doc_id) LEFT JOIN litem USING (doc_id))"""


ORACLES = {
    "op3_benchmark_decontamination": f"""WITH {leaks_sql()}
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(n_hit AS BIGINT) AS n_hit, CAST(n_items AS BIGINT) AS n_items,
  sha256(items) AS items_sha256, n_hit > 0 AS contaminated FROM leaks"""
}

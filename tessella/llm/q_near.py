"""Queries for near-duplicate work: op4."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import table
from tessella.llm.jaccard import jaccard_classes


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", F.col("class_doc").alias("class_id"), "n_links")


QUERIES = {"op4_ngram_jaccard_join": op4_ngram_jaccard_join}

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
BLANK_WORDS = r"'[^\x20\x09-\x0D]+'"

SHINGLES = f"""
words AS (SELECT doc_id, regexp_extract_all({LOWER}, {BLANK_WORDS}) AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words),
classes AS (SELECT min(doc_id) AS c, list_sort(s) AS s FROM sets WHERE len(s) > 0 GROUP BY list_sort(s)),
flat AS (SELECT c, len(s) AS n, unnest(s) AS g FROM classes),
pairs AS (SELECT a.c AS a, b.c AS b, a.n AS na, b.n AS nb, count(*) AS o FROM flat a JOIN flat b ON a.g = b.g AND a.c < b.c GROUP BY ALL),
links AS (SELECT a, b FROM pairs WHERE 100 * o >= 75 * (na + nb - o)),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT c AS a, c AS b FROM classes UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON r.b = l.a),
roots AS (SELECT a AS c, min(b) AS root FROM reach GROUP BY a),
member AS (SELECT s.doc_id, len(s.s) AS n, coalesce(r.root, s.doc_id) AS root, k.c AS class_id, coalesce(d.n_links, 0) AS n_links FROM sets s
  LEFT JOIN classes k ON list_sort(s.s) = k.s LEFT JOIN roots r ON r.c = k.c LEFT JOIN (SELECT a, count(*) AS n_links FROM both_ways GROUP BY a) d ON d.a = k.c)
"""

ORACLES = {
    "op4_ngram_jaccard_join": f"WITH RECURSIVE {SHINGLES} SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, root AS component_id, class_id, n_links FROM member",
}

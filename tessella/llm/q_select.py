"""Queries op11 (exact top-k search), op12 (importance resampling) and op13 (prefix trie of conversations)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessella.llm.common import table
from tessella.llm.prefixes import prefix_trie
from tessella.llm.resample import resample
from tessella.llm.topk import exact_topk


def op11_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return exact_topk(rows, rows.filter("vec_id % 100 = 0"), k=10)


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), seed=2024, least_words=20, percent=10)
    return out.select("doc_id", "n_features", "weight", "score", "rank")


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


QUERIES = {"op11_exact_topk": op11_exact_topk, "op12_importance_resampling": op12_importance_resampling, "op13_conversation_trie": op13_conversation_trie}

#: One row with the table of CRC-32 by byte.
_CRC_TABLE = "crc AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc)"


def _crc32(text: str) -> str:
    """SQL of the CRC-32 of a text beside the row of _CRC_TABLE."""
    octets = f"list_transform(range(1, strlen({text}) + 1), lambda i: CAST('0x' || substr(hex({text}), CAST(2 * i - 1 AS BIGINT), 2) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295, {octets}), lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295)"


def _words(table_: str) -> str:
    return rf"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM {table_}"


ORACLES = {
    "op11_exact_topk": """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score FROM e q JOIN e c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
    "op12_importance_resampling": f"""WITH {_CRC_TABLE},
dw AS (SELECT doc_id, {_words("documents")}),
words AS (SELECT unnest(w) AS x, 1 AS d, 0 AS b FROM dw UNION ALL SELECT unnest(w), 0, 1 FROM (SELECT {_words("benchmark")})),
hashed AS (SELECT x, s, t, {_crc32("x")} % 10000 AS bucket FROM (SELECT x, sum(d) AS s, sum(b) AS t FROM words GROUP BY x), crc),
filled AS (SELECT bucket, sum(s) AS s, sum(t) AS t FROM hashed GROUP BY bucket),
gains AS (SELECT bucket, CAST(floor(1000 * ln(CAST(t + 1 AS DOUBLE) * (sum(s) OVER () + 10000) / (CAST(s + 1 AS DOUBLE) * (sum(t) OVER () + 10000)))) AS BIGINT) AS gain FROM filled),
weighed AS (SELECT doc_id, sum(gain) AS weight FROM (SELECT doc_id, unnest(w) AS x FROM dw) JOIN hashed USING (x) JOIN gains USING (bucket) GROUP BY doc_id),
scored AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
  CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM dw LEFT JOIN weighed USING (doc_id)),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS n, count(*) OVER () AS many FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN n <= 10 * many // 100 THEN n END AS rank FROM scored LEFT JOIN ranked USING (doc_id)""",
    "op13_conversation_trie": f"""WITH {_CRC_TABLE},
turns AS (SELECT conv_id, k, n_chars, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, k) - 1 AS i
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, length(coalesce(text, '')) AS n_chars, md5(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) AS k FROM conversations WHERE conv_id IS NOT NULL)),
convs AS (SELECT c, {_crc32("CAST(c AS VARCHAR)")} % 6 AS h FROM (SELECT DISTINCT conv_id AS c FROM turns), crc),
built AS (SELECT c, 0 AS own, i, k, n_chars FROM convs JOIN turns ON conv_id = c - c % 100 AND i < h UNION ALL SELECT c, 1, i, k, n_chars FROM convs JOIN turns ON conv_id = c AND i >= h),
paths AS (SELECT c, coalesce(list(k ORDER BY own, i) FILTER (k IS NOT NULL), []) AS ks, coalesce(list(n_chars ORDER BY own, i) FILTER (k IS NOT NULL), []) AS ns FROM convs LEFT JOIN built USING (c) GROUP BY c),
steps AS (SELECT c, ks, ns, unnest(range(0, len(ks) + 1)) AS depth FROM paths),
nodes AS (SELECT depth, array_to_string(ks[1:depth], '') AS key, min(c) AS conv_id, count(*) AS n_convs, any_value(coalesce(ns[depth], 0)) AS n_chars,
  sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (depth = len(ks)), '')) AS ends_sha256 FROM steps GROUP BY depth, key),
families AS (SELECT n.*, p.conv_id AS parent_conv_id, coalesce(m, 0) AS n_children FROM nodes n
  LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.key = left(n.key, CAST(32 * (n.depth - 1) AS BIGINT))
  LEFT JOIN (SELECT left(key, CAST(32 * (depth - 1) AS BIGINT)) AS key, count(*) AS m FROM nodes WHERE depth > 0 GROUP BY ALL) ch ON ch.key = n.key)
SELECT v.conv_id, v.depth, v.parent_conv_id, v.n_convs, v.n_children, count(*) FILTER (w.n_children = 0) AS n_leaves,
  CAST(sum((w.n_convs - 1) * w.n_chars) AS BIGINT) AS saved_tokens, v.ends_sha256
FROM families v JOIN families w ON starts_with(w.key, v.key) GROUP BY ALL""",
}

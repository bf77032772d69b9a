"""Queries op2 (secrets) and op6 (quality rules)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import table
from tessella.llm.quality import quality_rules
from tessella.llm.secrets import scan_secrets


def _digest(spans) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"))
    of = lambda *kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex", "named", "flow")]
    return found.select("doc_id", *counts, F.sha2(_digest(of("assign", "access", "hex")), 256).alias("base_sha256"), _digest(F.col("spans")).alias("spans"))


def secret_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base of op2: spans of the fixed patterns, as columns that SQL can say."""
    return op2_secret_scan(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").filter("quality = 1")
    out = quality_rules(table(spark, sf_dir, "documents"), trusted)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("score", 6).alias("score"))


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base rules of op6, as columns that SQL can say."""
    return op6_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


QUERIES = {"op2_secret_scan": op2_secret_scan, "op6_quality_rules": op6_quality_rules, "secret_base": secret_base, "quality_base": quality_base}


def _letters(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(_letters(w) for w in ("password", "passwd", "secret", "token")) + "|" + _letters("api") + "_?" + _letters("key")
_BLANKS, _REST = r"[^\x20\x09-\x0D]+", "[A-Za-z0-9+/_.=-]+"
_PATTERNS = {"assign": f"({_NAMES})[\"\'\']?\\x20*[:=]\\x20*[\"\'\']?({_REST})", "access": "AKIA[A-Z0-9]+", "hex": "[0-9a-f]+"}


def _spans_sql(kind: str, least: int) -> str:
    """CTE of the spans of one pattern: a match starts behind all pieces and matches before it."""
    group = 2 if kind == "assign" else 0
    found = f"SELECT doc_id, regexp_split_to_array(t, '{_PATTERNS[kind]}') AS p, regexp_extract_all(t, '{_PATTERNS[kind]}') AS m, regexp_extract_all(t, '{_PATTERNS[kind]}', {group}) AS g FROM texts"
    size = lambda x: f"coalesce(list_sum(list_transform({x}, lambda s: length(s))), 0)"
    return f"""{kind}_spans AS (SELECT doc_id, '{kind}' AS kind, x.a AS a, x.b AS b FROM (SELECT doc_id, unnest(list_transform(list_filter(range(1, len(m) + 1), lambda i: length(g[i]) >= {least}),
  lambda i: {{'a': CAST({size("p[1:i]")} + {size("m[1:i - 1]")} AS BIGINT), 'b': CAST({size("p[1:i]")} + {size("m[1:i]")} AS BIGINT)}})) AS x FROM ({found})))"""


ORACLES = {
    "secret_base": f"""WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
{_spans_sql("assign", 6)},
{_spans_sql("access", 20)},
{_spans_sql("hex", 24)},
spans AS (SELECT *, list_position(['assign', 'access', 'hex'], kind) AS place FROM (FROM assign_spans UNION ALL FROM access_spans UNION ALL FROM hex_spans)),
digests AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, place) AS digest FROM spans GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(digest, '')) AS base_sha256
FROM texts LEFT JOIN digests USING (doc_id)""",
    "quality_base": f"""WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
words AS (SELECT doc_id, t, regexp_extract_all(t, '{_BLANKS}') AS w FROM texts),
lines AS (SELECT doc_id, coalesce(sum(n - 1), 0) AS n_dup_lines FROM (SELECT doc_id, line, count(*) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM texts)
  WHERE regexp_matches(line, '{_BLANKS}') GROUP BY ALL) GROUP BY doc_id),
windows AS (SELECT doc_id, i, [w[i], w[i + 1], w[i + 2]] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM words WHERE len(w) >= 3)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM windows) WHERE n > 1),
repeats AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM twice, range(3) AS r(k) GROUP BY doc_id),
base AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM words LEFT JOIN lines USING (doc_id) LEFT JOIN repeats USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base""",
}

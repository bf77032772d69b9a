"""Similarity queries over `embeddings`."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import vectors as V
from tessella.operators import similarity as S
from tessella.plans.base import Catalog, table

CATALOG = Catalog()
_QUERY = "id % 100 = 0"  # searches take every hundredth row as a query, against all rows


def _corpus(spark, sf):
    v = F.col("embedding")
    half = lambda a: V.l2_normalize(F.slice(v, a, 32))
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), v.cast("array<double>").alias("v"), half(1).alias("a"), half(33).alias("b"), "label")


_E = "e AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v, label FROM embeddings)"
_SCORES = f"{_E}, s AS (SELECT q.id AS query_id, c.id, c.label, round(list_inner_product(q.v, c.v), 6) AS score FROM e q JOIN e c ON q.id % 100 = 0)"
_RANK = "row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)"


@CATALOG.add("knn_topk", f"WITH {_SCORES}, r AS (SELECT *, {_RANK} AS rank FROM s) SELECT query_id, id, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 8")
def knn_topk(spark, sf):
    c = _corpus(spark, sf)
    return S.knn(c.filter(_QUERY), c, 8, -1.0)


@CATALOG.add("knn_by_id", f"WITH {_SCORES}, r AS (SELECT *, {_RANK} AS rank FROM s WHERE query_id <> id AND score >= 0.2) SELECT query_id, id, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 8")
def knn_by_id(spark, sf):
    c = _corpus(spark, sf)
    return S.knn(c.filter(_QUERY), c, 8, 0.2, exclude_self=True)


@CATALOG.add("knn_min_score", f"WITH {_SCORES}, r AS (SELECT *, {_RANK} AS rank FROM s WHERE score >= 0.75) SELECT query_id, id, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 8")
def knn_min_score(spark, sf):
    c = _corpus(spark, sf)
    return S.knn(c.filter(_QUERY), c)


@CATALOG.add("knn_typed_prefilter", f"WITH {_SCORES}, r AS (SELECT *, {_RANK} AS rank FROM s WHERE label % 2 = 1) SELECT query_id, id, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5")
def knn_typed_prefilter(spark, sf):
    c = _corpus(spark, sf)
    return S.knn(c.filter(_QUERY), c, 5, -1.0, keep=F.col("label") % 2 == 1)


@CATALOG.add("knn_overfetch_docs", f"WITH {_SCORES}, w AS (SELECT *, {_RANK} AS n FROM s), r AS (SELECT query_id, id, score, {_RANK} AS rank FROM w WHERE n <= 15 AND label % 2 = 1 AND score >= 0.1) SELECT query_id, id, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5")
def knn_overfetch_docs(spark, sf):
    c = _corpus(spark, sf)
    return S.knn_overfetch(c.filter(_QUERY), c, F.col("label") % 2 == 1, least=0.1)


_HALVES = """e AS (SELECT vec_id AS id, list_transform(embedding[1:32], lambda x: CAST(x AS DOUBLE)) AS a, list_transform(embedding[33:64], lambda x: CAST(x AS DOUBLE)) AS b FROM embeddings),
p AS (SELECT q.id AS query_id, c.id, round(list_cosine_similarity(q.a, c.a), 6) AS sa, round(list_cosine_similarity(q.b, c.b), 6) AS sb FROM e q JOIN e c ON q.id % 100 = 0 AND q.id <> c.id),
ra AS (SELECT query_id, id, sa, row_number() OVER (PARTITION BY query_id ORDER BY sa DESC, id) AS n FROM p WHERE sa >= 0.2),
rb AS (SELECT query_id, id, sb, row_number() OVER (PARTITION BY query_id ORDER BY sb DESC, id) AS n FROM p WHERE sb >= 0.2),
f AS (SELECT coalesce(x.query_id, y.query_id) AS query_id, coalesce(x.id, y.id) AS id, round(0.6 * coalesce(sa, 0.0) + 0.4 * coalesce(sb, 0.0), 6) AS score
  FROM (SELECT * FROM ra WHERE n <= 16) x FULL JOIN (SELECT * FROM rb WHERE n <= 16) y ON x.query_id = y.query_id AND x.id = y.id)"""


@CATALOG.add("knn_hybrid", f"WITH {_HALVES}, r AS (SELECT *, {_RANK} AS rank FROM f WHERE score >= 0.15) SELECT query_id, id, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 8")
def knn_hybrid(spark, sf):
    c = _corpus(spark, sf)
    return S.hybrid_knn(c.filter(_QUERY), c, floor=0.2, least=0.15)


@CATALOG.add("vector_centroid", f"""WITH {_E}, x AS (SELECT label, unnest(v) AS x, unnest(range(1, 65)) AS pos FROM e), m AS (SELECT label, pos, avg(x) AS m FROM x GROUP BY ALL),
n AS (SELECT label, sqrt(sum(m * m)) AS n FROM m GROUP BY label) SELECT label, CAST(pos - 1 AS INTEGER) AS pos, round(m / n, 6) AS x FROM m JOIN n USING (label)""")
def vector_centroid(spark, sf):
    c = S.centroid(_corpus(spark, sf), ["label"], "v")
    return c.select("label", F.posexplode("centroid").alias("pos", "x")).withColumn("x", F.round("x", 6))


@CATALOG.add("cosine_from_l2", f"""WITH {_E} SELECT q.id AS query_id, c.id, round(greatest(-1.0, least(1.0, 1 - list_sum(list_transform(list_zip(q.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) / 2)), 5) AS score
FROM e q JOIN e c ON q.id % 100 = 0 AND c.label = q.label""")
def cosine_from_l2(spark, sf):
    c = _corpus(spark, sf)
    q = c.filter(_QUERY).select(F.col("id").alias("query_id"), F.col("v").alias("qv"), "label")
    return c.join(q, "label").select("query_id", "id", F.round(V.cosine_from_l2(V.l2_squared("qv", "v")), 5).alias("score"))


_PAIRS = f"{_E}, p AS (SELECT x.id AS a, y.id AS b, round(list_inner_product(x.v, y.v), 6) AS score, x.label = y.label AS is_dup FROM e x JOIN e y ON x.id < y.id)"
_GRID = [0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5]


@CATALOG.add("all_pairs_floor", f"WITH {_PAIRS} SELECT a, b, score FROM p WHERE score >= 0.4")
def all_pairs_floor(spark, sf):
    return S.all_pairs(_corpus(spark, sf), 0.4)


@CATALOG.add("top_pairs", f"WITH {_PAIRS} SELECT a, b, score FROM p ORDER BY score DESC, a, b LIMIT 20")
def top_pairs(spark, sf):
    return S.top_pairs(_corpus(spark, sf), 20)


@CATALOG.add("score_histogram", f"WITH {_PAIRS} SELECT round(floor(score / 0.05) * 0.05, 2) AS bucket, is_dup, count(*) AS n FROM p GROUP BY ALL")
def score_histogram(spark, sf):
    return S.score_histogram_of_all(_corpus(spark, sf))


@CATALOG.add("pr_f1_sweep", f"""WITH {_PAIRS}, c AS (SELECT t AS threshold, count(*) FILTER (score >= t AND is_dup) AS tp, count(*) FILTER (score >= t AND NOT is_dup) AS fp,
  count(*) FILTER (score < t AND is_dup) AS fn, count(*) FILTER (score < t AND NOT is_dup) AS tn FROM p, (SELECT unnest({_GRID}::DOUBLE[]) AS t) GROUP BY t)
SELECT threshold, tp, fp, fn, tn, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall,
  round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1 FROM c""")
def pr_f1_sweep(spark, sf):
    c = S.confusion_of_all(_corpus(spark, sf), _GRID)
    return c.withColumns({x: F.round(x, 6) for x in ("precision", "recall", "f1")})


@CATALOG.add("separation_stats", f"""WITH {_PAIRS} SELECT round(min(score) FILTER (is_dup), 5) AS min_dup, round(min(score) FILTER (NOT is_dup), 5) AS min_other, round(avg(score) FILTER (is_dup), 5) AS avg_dup,
  round(avg(score) FILTER (NOT is_dup), 5) AS avg_other, round(max(score) FILTER (is_dup), 5) AS max_dup, round(max(score) FILTER (NOT is_dup), 5) AS max_other,
  (SELECT count(*) FROM p WHERE NOT is_dup AND score >= (SELECT min(score) FROM p WHERE is_dup)) AS n_overlap FROM p""")
def separation_stats(spark, sf):
    return S.separation_of_all(_corpus(spark, sf))


@CATALOG.add("ground_truth_pairs", "SELECT concat_ws('::', least(x.vec_id::VARCHAR, y.vec_id::VARCHAR), greatest(x.vec_id::VARCHAR, y.vec_id::VARCHAR)) AS pair, x.label FROM embeddings x JOIN embeddings y ON x.label = y.label AND x.vec_id < y.vec_id")
def ground_truth_pairs(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("i"), F.col("vec_id").alias("id"), "label")
    return S.labelled_pairs(e).select(V.pair_key("i", "j").alias("pair"), "label")


@CATALOG.add("vector_dimension_check", "SELECT len(embedding) AS dim, count(*) AS n, count(*) FILTER (list_sum(list_transform(embedding, lambda x: abs(x))) = 0) AS n_zero FROM embeddings GROUP BY 1")
def vector_dimension_check(spark, sf):
    """Drift: more than one row, or one whose dimension is not the expected."""
    return table(spark, sf, "embeddings").groupBy(F.size("embedding").cast("long").alias("dim")).agg(F.count("*").alias("n"), F.count_if(V.is_zero("embedding")).alias("n_zero"))


_CENTRE = f"""{_E}, x AS (SELECT label, unnest(v) AS x, unnest(range(1, 65)) AS pos FROM e), m AS (SELECT label, pos, avg(x) AS m FROM x GROUP BY ALL),
c AS (SELECT label AS domain, list(m ORDER BY pos) AS v FROM m GROUP BY label)"""


@CATALOG.add("domain_best_page", f"""WITH {_CENTRE}, s AS (SELECT domain, e.id, e.id % 20 AS page, round(list_cosine_similarity(c.v, e.v), 6) AS score FROM c JOIN e ON true),
r AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY score DESC, id) AS n FROM s), p AS (SELECT domain, page, round(avg(score), 6) AS score FROM r WHERE n <= 5 GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY score DESC, page) AS n FROM p)
SELECT domain, page, score, CASE WHEN score <= 0.55 THEN 'gap' WHEN score <= 0.75 THEN 'drift' ELSE 'covered' END AS class FROM b WHERE n = 1""")
def domain_best_page(spark, sf):
    c = _corpus(spark, sf)
    centres = S.centroid(c, ["label"], "v").select(F.col("label").cast("long").alias("id"), F.col("centroid").alias("v"))
    found = S.knn(centres, c, 5, -1.0).select(F.col("query_id").cast("int").alias("domain"), (F.col("id") % 20).alias("page"), "score")
    pages = found.groupBy("domain", "page").agg(F.round(F.avg("score"), 6).alias("score"))
    best = pages.groupBy("domain").agg(F.max_by(F.struct("page", "score"), F.struct("score", -F.col("page"))).alias("b"))
    score = F.col("b.score")
    return best.select("domain", F.col("b.page").alias("page"), score.alias("score"), F.when(score <= 0.55, "gap").when(score <= 0.75, "drift").otherwise("covered").alias("class"))

"""Exact top-k search by inner product: the three-phase uniform threshold.

A vector's components are dealt to `nodes` groups, and each group of each block of rows is a node that knows one part of
a score. First every node lists its best parts per query; the whole scores of what is listed give each query a cutoff
that its k-th best score reaches for sure. A score that reaches the cutoff has a part of at least cutoff / nodes at some
node: second, nodes collect what has, and third, the whole scores of only these are resolved and the best k kept.

Blocks of queries meet blocks of rows in cells; a node's lists live in its cell, and what travels are k scores per query
and task in the first phase, and in the last what reaches the cutoff, k per query and cell at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.store import scoped, stash
from tessella.operators.similarity import best_of_rows, cells, matrices

#: Queries of a cell that are scored at a time.
SOME = 256
_LONG = 2**63


def _parts(q: np.ndarray, m: np.ndarray, nodes: int) -> list[np.ndarray]:
    """Each node's part of the scores of all pairs, as whole numbers: doubles where these hold them, else integers."""
    most = float(np.abs(q.astype(np.float64)).max(initial=0)) * float(np.abs(m.astype(np.float64)).max(initial=0)) * max(1, q.shape[1])
    kind = np.float64 if most < 2**52 else object
    q, m = q.astype(kind), m.astype(kind)
    cuts = np.linspace(0, q.shape[1], nodes + 1).astype(int)
    return [q[:, a:b] @ m[:, a:b].T if b > a else np.zeros((len(q), len(m)), kind) for a, b in zip(cuts, cuts[1:], strict=False)]


def _whole(score: np.ndarray) -> np.ndarray:
    """Scores within a long's range; those beyond it become its ends."""
    return np.clip(score, -_LONG, _LONG - 1) if score.dtype == object else score


def _each(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        for n in range(len(batch)):
            q_ids, q, ids, m = matrices(batch, n, "int64")
            of = lambda c: batch.column(c)[n].values.to_numpy(zero_copy_only=False)  # noqa: B023, E731
            for lo in range(0, len(q), SOME):
                yield q_ids[lo : lo + SOME], q[lo : lo + SOME], ids, m, lambda c: of(c)[lo : lo + SOME]  # noqa: B023


def _rows(q_ids, ids, i, j, score) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(q_ids[i]), pa.array(ids[j]), pa.array(score.astype(np.int64))], names=["number", "vec_id", "score"])


def _first(k: int, nodes: int):
    """Whole scores of what stands on a node's list, the best k of each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for q_ids, q, ids, m, of in _each(batches):
            parts = _parts(q, m, nodes)
            other = of("own")[:, None] != ids[None, :]
            listed = np.zeros(other.shape, bool)
            for part in parts:
                if len(ids) <= k:
                    listed |= other
                    continue
                masked = np.where(other, part, -np.inf)
                top = np.argpartition(masked, len(ids) - k, axis=1)[:, len(ids) - k :]
                np.put_along_axis(listed, top, True, axis=1)
            listed &= other
            score = _whole(sum(parts[1:], parts[0]))
            i, j = best_of_rows(score, listed, k)
            yield _rows(q_ids, ids, i, j, score[i, j])

    return run


def _second(k: int, nodes: int):
    """Of what has a part that reaches the uniform threshold, the best k whole scores that reach the cutoff."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for q_ids, q, ids, m, of in _each(batches):
            parts = _parts(q, m, nodes)
            open_, cutoff = of("open"), of("cutoff")
            cutoff = cutoff.astype(object) if parts[0].dtype == object else cutoff.astype(np.float64)
            reach = np.zeros(parts[0].shape, bool)
            for part in parts:
                reach |= part * nodes >= cutoff[:, None]
            reach[open_] = True
            reach &= of("own")[:, None] != ids[None, :]
            i, j = np.nonzero(reach)
            score = _whole(sum((part[i, j] for part in parts[1:]), parts[0][i, j]))
            keep = (score >= cutoff[i]) | open_[i]
            i, j, score = i[keep], j[keep], score[keep]
            order = np.lexsort((j, -score, i))
            i, j, score = i[order], j[order], score[order]
            nth = np.arange(len(i)) - np.searchsorted(i, i)
            yield _rows(q_ids, ids, i[nth < k], j[nth < k], score[nth < k])

    return run


def _ranked(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("number").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


@scoped("topk")
def exact_topk(rows: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024, nodes: int = 4, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of queries the k highest scores among rows, ties to the smaller id.

    Components are floor(scale * component) as whole numbers, and a score is their inner product; scores beyond a long's
    range become its ends. Rows with a query's own id are no candidates for it. Vectors that are null or hold null or
    non-finite components, and rows without an id, take no part, as queries or as candidates. Vectors of different
    dimension have no score. A query has fewer than k rows where there are fewer candidates. Rows of queries that repeat
    id and vector are one query; rows that repeat as candidates are candidates each. Empty tables give no rows.
    Only the two named columns are read.
    """
    v = F.col(vector_col)
    whole = F.transform(v, lambda x: F.floor(x.cast("double") * scale))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    view = lambda df: df.filter(F.col(id_col).isNotNull() & v.isNotNull() & finite).select(F.col(id_col).cast("long").alias("id"), whole.alias("v"))
    corpus = view(rows)
    asked = view(queries).distinct().withColumnRenamed("id", "own").withColumn("id", F.monotonically_increasing_id())
    asked = stash(asked, "queries")

    listed = cells(asked, corpus, "int64", ("own",)).mapInArrow(_first(k, nodes), "number long, vec_id long, score long")
    cutoffs = _ranked(listed, k).filter(F.col("rank") == k).select(F.col("number").alias("id"), F.col("score").alias("cutoff"))
    limited = asked.join(cutoffs, "id", "left").withColumn("open", F.col("cutoff").isNull() | (F.col("cutoff") == -_LONG)).withColumn("cutoff", F.coalesce("cutoff", F.lit(0).cast("long")))
    limited = stash(limited, "cutoffs")
    found = cells(limited, corpus, "int64", ("own", "cutoff", "open")).mapInArrow(_second(k, nodes), "number long, vec_id long, score long")
    names = asked.select(F.col("id").alias("number"), F.col("own").alias("query_id"))
    return _ranked(found, k).join(names, "number").select("query_id", "rank", "vec_id", "score")

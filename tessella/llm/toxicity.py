"""Toxicity by a classifier chain of linear models over hashed words.

Categories are predicted one after another; the model of each category sees, beside the document's words, the
probabilities that earlier models give. While training, these are out-of-fold predictions, so a later model learns from
probabilities as uncertain as those it will meet. Training uses at most `max_train` labelled rows (those whose id
hashes lowest); the models are arrays of fixed size, and every document is scored as a whole, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm import kernel as K
from tessella.llm.flags import flag

BITS = 18
FOLDS = 3
MAX_TRAIN = 8_000
#: Likelihood ratio from which a feature enters a model.
LEAST_G = 15.0


def _features(words: K.Words) -> Iterator[np.ndarray]:
    """Distinct hashed words and word beginnings (five bytes) of each document."""
    shift = np.uint64(64 - BITS)
    word, head = ((h >> shift).astype(np.uint32) for h in (words.hash, words.heads(5)))
    for first, n in zip(words.first[:-1].tolist(), words.count.tolist(), strict=True):
        yield np.unique(np.concatenate((word[first : first + n], head[first : first + n])))


class Chain:
    """Weights per category: words, then earlier categories' probabilities, then the bias; and its threshold."""

    def __init__(self, names: list[str]):
        self.names, self.models, self.cuts = names, [], []

    def score(self, features: Iterator[np.ndarray], n: int) -> np.ndarray:
        out = np.zeros((n, len(self.names)))
        for i, f in enumerate(features):
            for c, (w, extra, bias) in enumerate(self.models):
                z = w[f].sum() + bias + extra @ out[i, :c]
                out[i, c] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return out


def _telling(at: np.ndarray, row: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Features whose presence depends on the label by a likelihood-ratio test (G over LEAST_G)."""
    n, pos = len(y), y.sum()
    df = np.bincount(at, minlength=1 << BITS).astype(float)
    in_pos = np.bincount(at, y[row], 1 << BITS)
    cells = ((in_pos, df * pos / n), (df - in_pos, df * (n - pos) / n), (pos - in_pos, (n - df) * pos / n), (n - df - pos + in_pos, (n - df) * (n - pos) / n))
    with np.errstate(divide="ignore", invalid="ignore"):
        g = 2 * sum(np.where(o > 0, o * np.log(o / e), 0) for o, e in cells)
    return np.flatnonzero(np.nan_to_num(g) > LEAST_G)


def _conjugate(product, goal: np.ndarray, diagonal: np.ndarray, most: int = 100) -> np.ndarray:
    """x with product(x) = goal to two digits, for a positive definite product; its diagonal is the preconditioner.

    Newton's steps correct what a step leaves, so that more digits would not be used.
    """
    x, left = np.zeros(len(goal)), goal.copy()
    near = left / diagonal
    way, size = near.copy(), left @ near
    stop = size * 1e-4
    for _ in range(most):
        if size <= stop:
            break
        turned = product(way)
        step = size / (way @ turned)
        x += step * way
        left -= step * turned
        near = left / diagonal
        new = left @ near
        way, size = near + new / size * way, new
    return x


def _fit(at, row, n, earlier, y, steps: int = 25, decay: float = 3.0):
    """Ridge logistic regression on the telling features: Newton steps by conjugate gradients, with row weights bounded below.

    Rows stay lists of their features, so memory follows the labelled words and not rows times features.
    """
    pick = _telling(at, row, y)
    place = np.full(1 << BITS, -1)
    place[pick] = np.arange(len(pick))
    use = place[at] >= 0
    of, feature, m = row[use], place[at[use]], len(pick)

    def times(b):
        return np.bincount(of, b[feature], n) + earlier @ b[m:-1] + b[-1]

    def back(u):
        return np.concatenate((np.bincount(feature, u[of], m), earlier.T @ u, [u.sum()]))

    beta = np.zeros(m + earlier.shape[1] + 1)
    beta[-1] = np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))
    ridge = np.full(len(beta), decay)
    ridge[-1] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(times(beta), -30, 30)))
        weight = np.maximum(p * (1 - p), 1e-3)
        diagonal = np.concatenate((np.bincount(feature, weight[of], m), (earlier**2).T @ weight, [weight.sum()])) + ridge
        step = _conjugate(lambda v, w=weight: back(w * times(v)) + ridge * v, back(p - y) + ridge * beta, diagonal)
        beta -= step
        if np.abs(step).max() < 1e-2:
            break
    w = np.zeros(1 << BITS)
    w[pick] = beta[: len(pick)]
    return w, beta[len(pick) : -1], float(beta[-1])


def train_chain(features: list[np.ndarray], labels: np.ndarray, names: list[str]) -> Chain:
    """Fit one model a category, in order; thresholds maximise F1 over out-of-fold predictions."""
    chain, n = Chain(names), len(features)
    fold = np.arange(n) % FOLDS
    length = np.array([len(f) for f in features], np.int64)
    at = np.concatenate([*features, np.zeros(0, np.uint32)]).astype(np.int64)
    row = np.repeat(np.arange(n), length)
    earlier = np.zeros((n, 0))
    for c in range(len(names)):
        y = labels[:, c].astype(float)
        if n == 0 or y.min() == y.max():  # nothing to tell apart: the prior
            prior = float(y.mean()) if n else 0.0
            chain.models.append((np.zeros(1 << BITS), np.zeros(c), float(np.log((prior + 1e-6) / (1 - prior + 1e-6)))))
            chain.cuts.append(0.5)
            earlier = np.column_stack([earlier, np.full(n, prior)])
            continue
        held = np.zeros(n)
        for k in range(FOLDS):
            use = fold[row] != k
            ids = np.flatnonzero(fold != k)
            new = np.zeros(n, np.int64)
            new[ids] = np.arange(len(ids))
            w, extra, bias = _fit(at[use], new[row[use]], len(ids), earlier[ids], y[ids])
            z = np.bincount(row, w[at], n) + bias + earlier @ extra
            held[fold == k] = (1 / (1 + np.exp(-np.clip(z, -30, 30))))[fold == k]
        order = np.argsort(-held, kind="stable")
        hit = np.cumsum(y[order])
        f1 = 2 * hit / (np.arange(1, n + 1) + y.sum())
        f1[:-1][held[order[1:]] == held[order[:-1]]] = 0.0  # rows with equal predictions fall on one side together
        best = int(np.argmax(f1))
        below = held[order[best + 1]] if best + 1 < n else 0.0
        chain.cuts.append(float((held[order[best]] + below) / 2))
        chain.models.append(_fit(at, row, n, earlier, y))
        earlier = np.column_stack([earlier, held])
    return chain


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offs = K.buffers(batch.column("text"))
        for lo, hi, d, o in K.slices(data, offs):
            blob = [f.tobytes() for f in _features(K.Words(d, o, K.NON_ALNUM))]
            yield pa.RecordBatch.from_arrays([batch.column("place").slice(lo, hi - lo), pa.array(blob, pa.binary()), batch.column("y").slice(lo, hi - lo)], names=["place", "blob", "y"])


def fit_toxicity(docs: DataFrame, labels: DataFrame, categories: dict[str, str], id_col: str = "doc_id", text_col: str = "text", max_train: int = MAX_TRAIN) -> Chain:
    """A chain trained on at most max_train labelled documents.

    categories: name to a SQL condition over labels, in chain order. Rows of labels whose id is null or which match no
    document are not used, nor are those where a condition is null. Of rows that label one id differently the one with
    more categories, the first first, counts; of documents that share a labelled id the text whose hash is smallest.
    Without labels, every probability is 0.
    """
    order = F.xxhash64("k")
    known = labels.select(F.col(id_col).alias("k"), F.array(*[F.expr(c).cast("double") for c in categories.values()]).alias("y"))
    known = known.filter("k is not null and not exists(y, v -> v is null)").groupBy("k").agg(F.max("y").alias("y")).orderBy(order, "k").limit(max_train)
    text = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("text is not null")
    # max_train rows at most: small enough to send to every executor
    rows = text.join(F.broadcast(known), F.col("id") == F.col("k")).groupBy("k", "y").agg(F.min(F.struct(F.xxhash64("text"), "text")).alias("one"))
    rows = rows.select(F.xxhash64("k").alias("place"), "one.text", "y").mapInArrow(_extract, "place long, blob binary, y array<double>")
    got = sorted(((r.place, bytes(r.blob), tuple(r.y)) for r in rows.toLocalIterator()), key=lambda r: r[:2])[:max_train]
    return train_chain([np.frombuffer(b, np.uint32) for _, b, _ in got], np.array([y for *_, y in got]).reshape(len(got), len(categories)), list(categories))


def _score(chain):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = chain.value
        for batch in batches:
            data, offs = K.buffers(batch.column("text"))
            for lo, hi, d, o in K.slices(data, offs):
                words = K.Words(d, o, K.NON_ALNUM)
                p = model.score(_features(words), hi - lo)
                toxic = (p[:, -1] >= model.cuts[-1]) & (words.count > 0)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(list(p), pa.list_(pa.float64())), pa.array(toxic)], names=["doc_id", "p", "toxic"])

    return run


def score_toxicity(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: (doc_id, p_<category>..., toxic): the last category's decision.

    Null or empty texts, and texts without words, get the probabilities of the models' bias and are never toxic. Null ids
    and repeated rows pass through; id_col may be a struct that
    carries a whole row along. Only the named columns are read.
    """
    spark = docs.sparkSession
    text = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = T.StructType().add(text.schema["doc_id"]).add("p", T.ArrayType(T.DoubleType())).add("toxic", T.BooleanType())
    out = text.mapInArrow(_score(spark.sparkContext.broadcast(chain)), schema)
    return out.select("doc_id", *[F.col("p")[i].alias(f"p_{n}") for i, n in enumerate(chain.names)], "toxic")


def is_toxic(spark: SparkSession, chain: Chain, text: Column) -> Column:
    """The last category's decision about a text, as score_toxicity takes it."""
    return flag(_score(spark.sparkContext.broadcast(chain)), lambda found: found.column("toxic"), text, "doc_id")


#: Chain order over the columns of `labels`: junk first, as its words explain part of what looks odd.
CATEGORIES = {"junk": "quality = 0", "toxic": "toxic = 1"}

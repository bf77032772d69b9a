"""Exact similarity search, fusion, centroids and evaluation over tables of vectors.

Searches take any number of query vectors. Both sides are packed into blocks of bounded bytes where they are read, and
blocks of queries meet blocks of the corpus in cells: one matrix product each, of which only the best k per query leave.
Few queries (by their counted bytes) are broadcast and the corpus stays where it is; otherwise both sides are dealt to
lanes, and a task takes one lane of each (Spark's Cartesian product), so blocks are shuffled once and tasks grow in
number, not in length. The driver sees no query, and no pair is materialised that cannot be among the best of its task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import vectors as V

#: Bytes of one block of vectors.
BLOCK_BYTES = 1 << 20
#: Bytes of query vectors up to which these are broadcast.
BROADCAST_BYTES = 16 << 20
#: Bytes of vectors that share a lane where queries are too many to broadcast, and lanes of a side at most.
LANE_BYTES = 8 << 20
LANES = 64
#: Rows of a table whose pairs within a label are made that share a lane.
LANE_ROWS = 20_000
DIGITS = 6
#: What rounding to DIGITS may add to a score, and more.
SLACK = 1e-6
#: Multiplications of one matrix product up to which OpenBLAS stays in the thread that calls it.
ONE_THREAD = 1 << 18


def _pack(kind: str, extra: list[str]):
    """Rows (id, v, *extra) to blocks (ids, dim, m, *extra): rows of a block are equally long and ordered by id.

    Numbers of 8 bytes that are all whole in 4 travel as these.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, column = batch.column("id").to_numpy(), batch.column("v")
            size = np.diff(column.offsets.to_numpy())
            for dim in np.unique(size).tolist():
                rows = np.flatnonzero(size == dim)
                rows = rows[np.argsort(ids[rows], kind="stable")]
                some = column.take(pa.array(rows))
                m = some.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(rows), dim)
                if kind == "float64":
                    with np.errstate(over="ignore", invalid="ignore"):
                        half = m.astype(np.float32)
                    m = half if np.array_equal(half, m) else m
                step = max(1, BLOCK_BYTES // (m.itemsize * max(1, dim)))
                step = -(-len(rows) // -(-len(rows) // step))
                one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
                for lo in range(0, len(rows), step):
                    at = rows[lo : lo + step]
                    more = [one(batch.column(c).take(pa.array(at))) for c in extra]
                    yield pa.RecordBatch.from_arrays([one(pa.array(ids[at])), pa.array([dim], pa.int32()), pa.array([m[lo : lo + step].tobytes()], pa.binary()), *more], names=["ids", "dim", "m", *extra])

    return run


def blocks(rows: DataFrame, kind: str = "float64", extra: tuple[str, ...] = ()) -> DataFrame:
    """(ids, dim, m, *extra): rows (id long, v array, *extra) as matrices of numbers of a kind, by task and Arrow batch."""
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    ddl = "ids array<long>, dim int, m binary" + "".join(f", {c} array<{types[c]}>" for c in extra)
    return rows.select("id", "v", *extra).filter("id is not null and v is not null").mapInArrow(_pack(kind, list(extra)), ddl)


def _bytes(rows: DataFrame) -> int:
    return rows.agg(F.coalesce(F.sum(F.lit(8).cast("long") * F.size("v")), F.lit(0))).first()[0]


def _lanes(n: int) -> int:
    return min(LANES, max(1, -(-n // LANE_BYTES)))


def cells(queries: DataFrame, corpus: DataFrame, kind: str = "float64", extra: tuple[str, ...] = (), half: bool = False) -> DataFrame:
    """Every block of queries beside every block of the corpus: (q_ids, dim, q, *extra of the queries, ids, m).

    Blocks of different dimension do not meet. half: of a table against itself, two blocks meet once, and the columns
    `extra` of the other side stand beside it as m_<name>.
    """
    n = _bytes(queries)
    few = n <= BROADCAST_BYTES
    other = extra if half else ()
    if few:
        q, c = blocks(queries if half else queries.repartition(_lanes(n)), kind, extra), blocks(corpus, kind, other)  # halves need equal blocks
    else:
        q, c = (blocks(rows, kind, more).repartition(_lanes(size)) for rows, more, size in ((queries, extra, n), (corpus, other, n if half else _bytes(corpus))))
    q, c = q.withColumnsRenamed({"ids": "q_ids", "m": "q"}), c.withColumnsRenamed({x: f"m_{x}" for x in other})
    if half:
        q, c = q.withColumn("q_hash", F.xxhash64("q_ids", "q")), c.withColumn("m_hash", F.xxhash64("ids", "m"))
    met = c.join(F.broadcast(q) if few else q.hint("shuffle_replicate_nl"), "dim")
    return met.filter("q_hash <= m_hash").drop("q_hash", "m_hash") if half else met


def matrices(batch: pa.RecordBatch, i: int, kind: str = "float64") -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(query ids, queries, ids, vectors) of a cell. Vectors of float64 are of float32 where that holds them whole."""
    dim = batch.column("dim")[i].as_py()
    of = lambda c: batch.column(c)[i].values.to_numpy(zero_copy_only=False)
    q_ids, ids = of("q_ids"), of("ids")

    def matrix(c: str, n: int) -> np.ndarray:
        data = batch.column(c)[i].as_buffer()
        return np.frombuffer(data, np.float32 if kind == "float64" and len(data) == 4 * n * dim else kind).reshape(n, dim)

    return q_ids, matrix("q", len(q_ids)), ids, matrix("m", len(ids))


def product(q: np.ndarray, m: np.ndarray, out: np.ndarray) -> np.ndarray:
    """q @ m.T, by tiles too small for BLAS to share among threads.

    A task has one core. Threads that every Python worker starts for all cores of the machine wait for each other most
    of the time, as soon as there are more workers than one.
    """
    dim = q.shape[1]
    t = max(8, int((ONE_THREAD / max(1, dim)) ** 0.5) // 8 * 8)
    n = len(m) // t
    tiles, rest = m[: n * t].reshape(n, t, dim).transpose(0, 2, 1), m[n * t :].T
    out = out[: len(q)]
    for lo in range(0, len(q), t):
        part, into = q[lo : lo + t], out[lo : lo + t]
        if n:
            np.matmul(part, tiles, out=into[:, : n * t].reshape(len(part), n, t).transpose(1, 0, 2))
        if rest.shape[1]:
            np.matmul(part, rest, out=into[:, n * t :])
    return out


def _single(q: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, float]:
    """(q, m, scale, error): both in single precision, no product beyond `scale`, none wrong by more than `error`.

    Vectors that single precision may not hold stay as they are, with an infinite scale and without an error.
    """
    norms = [float(np.sqrt(np.einsum("ij,ij->i", x, x, dtype=np.float64).max(initial=0.0))) for x in (q, m)]
    if not all(n < 1e18 for n in norms):
        return q.astype(np.float64, copy=False), m.astype(np.float64, copy=False), np.inf, 0.0
    scale = norms[0] * norms[1]
    return q.astype(np.float32, copy=False), m.astype(np.float32, copy=False), scale, (q.shape[1] + 8) * 2.0**-22 * scale


def _found(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """np.nonzero of a matrix with few hits: eight at a time are looked at."""
    flat = hit.reshape(-1)
    if len(flat) % 8:
        at = np.flatnonzero(flat)
    else:
        some = np.flatnonzero(flat.view(np.uint64) != 0)
        k, n = np.nonzero(flat.reshape(-1, 8)[some])
        at = some[k] * 8 + n
    return np.divmod(at, hit.shape[1])


def _exact(q: np.ndarray, m: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Rounded scores of the pairs (i, j), each summed in its own order."""
    of = lambda x, at: x[at].astype(np.float64, copy=False)
    parts = [np.round(np.einsum("ij,ij->i", of(q, i[at : at + (1 << 17)]), of(m, j[at : at + (1 << 17)])), DIGITS) for at in range(0, len(i), 1 << 17)]
    return np.concatenate(parts) if parts else np.zeros(0)


def best_of_rows(score: np.ndarray, keep: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the k best kept scores of each row; of equals the first columns."""
    i, j = np.nonzero(keep)
    order = np.lexsort((j, -score[i, j], i))
    i, j = i[order], j[order]
    nth = np.arange(len(i)) - np.searchsorted(i, i)
    return i[nth < k], j[nth < k]


def _cell(k: int, least: float):
    """The k best rows of `least` or more for each query of a task, over all of its cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for n in range(len(batch)):
                q_ids, q, ids, m = matrices(batch, n)
                key = q_ids.tobytes(), hash(q.tobytes())
                if key not in held:
                    held[key] = q_ids.copy(), np.zeros((len(q), k), np.int64), np.full((len(q), k), -np.inf)
                _, best, reached = held[key]
                q1, m1, _, error = _single(q, m)
                slack = SLACK + 2 * error
                room = np.empty((min(256, len(q)), len(m)), q1.dtype)
                for lo in range(0, len(q), 256):
                    part = product(q1[lo : lo + 256], m1, room)
                    kth = reached[lo : lo + 256, -1]
                    floor = np.maximum(kth, least)
                    hit = part >= (floor - slack).astype(part.dtype)[:, None]
                    new = np.flatnonzero(np.isneginf(kth))
                    if len(new) and len(ids) > k and np.count_nonzero(hit) > 16 * k * len(part):  # what is under the k-th best cannot be among these
                        floor[new] = np.maximum(floor[new], np.partition(part[new], len(ids) - k, axis=1)[:, len(ids) - k])
                        hit = part >= (floor - slack).astype(part.dtype)[:, None]
                    i, j = _found(hit)
                    score = _exact(q[lo : lo + 256], m, i, j)
                    some = score >= least
                    rows = np.unique(i := i[some])
                    j, score = ids[j[some]], score[some]
                    old, nth = np.nonzero(reached[lo + rows] > -np.inf)
                    i, j, score = np.concatenate([rows[old], i]), np.concatenate([best[lo + rows][old, nth], j]), np.concatenate([reached[lo + rows][old, nth], score])
                    order = np.lexsort((j, -score, i))
                    i, j, score = i[order], j[order], score[order]
                    nth = np.arange(len(i)) - np.searchsorted(i, i)
                    i, j, score, nth = (x[nth < k] for x in (i, j, score, nth))
                    best[lo + i, nth], reached[lo + i, nth] = j, score
        for q_ids, best, reached in held.values():
            i, j = np.nonzero(reached > -np.inf)
            yield pa.RecordBatch.from_arrays([pa.array(q_ids[i]), pa.array(best[i, j]), pa.array(reached[i, j])], names=["query_id", "id", "score"])

    return run


def _scored(queries: DataFrame, corpus: DataFrame, k: int, least: float) -> DataFrame:
    return cells(queries, corpus).mapInArrow(_cell(k, least), "query_id long, id long, score double")


def ranked(scored: DataFrame, k: int) -> DataFrame:
    """The k best per query: score, then smaller id."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def knn(queries: DataFrame, corpus: DataFrame, k: int = 8, least: float = 0.75, exclude_self: bool = False, keep: Column | None = None) -> DataFrame:
    """(query_id, id, score, rank) of the k most similar rows per query with a score of `least` or more.

    queries and corpus: (id long, v array of unit length, ...). keep is a filter over corpus applied before ranking.
    """
    corpus = corpus.filter(keep) if keep is not None else corpus
    found = _scored(queries, corpus, k + exclude_self, least)
    if exclude_self:
        found = found.filter("query_id <> id")
    return ranked(found, k)


def knn_overfetch(queries: DataFrame, corpus: DataFrame, keep: Column, k: int = 5, factor: int = 3, least: float = 0.5) -> DataFrame:
    """The k best among the factor * k best of all rows that pass `keep`: a filter after the limit, which may find fewer."""
    wide = ranked(_scored(queries, corpus, factor * k, -1.0), factor * k).drop("rank")
    kept = wide.join(corpus.filter(keep).select("id"), "id", "left_semi").filter(F.col("score") >= least)
    return ranked(kept.select("query_id", "id", "score"), k)


def hybrid_knn(queries: DataFrame, corpus: DataFrame, k: int = 8, weight: float = 0.6, floor: float = 0.5, least: float = 0.7) -> DataFrame:
    """Full-outer fusion of the 2k best by either of two vectors (columns a and b).

    The fused score is weight * a + (1 - weight) * b, a side that did not rank counts 0. A query whose b is all zeros
    is answered by a alone at the plain threshold of 0.75.
    """
    view = lambda df, c: df.select("id", F.col(c).alias("v"))
    both, plain = queries.filter(~V.is_zero("b")), queries.filter(V.is_zero("b"))
    one = knn(view(both, "a"), view(corpus, "a"), 2 * k, floor, True).select("query_id", "id", F.col("score").alias("s_a"))
    two = knn(view(both, "b"), view(corpus, "b"), 2 * k, floor, True).select("query_id", "id", F.col("score").alias("s_b"))
    score = F.round(weight * F.coalesce("s_a", F.lit(0.0)) + (1 - weight) * F.coalesce("s_b", F.lit(0.0)), DIGITS)
    fused = one.join(two, ["query_id", "id"], "full_outer").select("query_id", "id", score.alias("score")).filter(F.col("score") >= least)
    alone = knn(view(plain, "a"), view(corpus, "a"), k, 0.75, True).drop("rank")
    return ranked(fused.unionByName(alone), k)


def _valid(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, m: np.ndarray) -> np.ndarray | None:
    """Which pairs of a cell count: of a block with itself, or with its like, a < b, else different ids; None if all do."""
    if np.array_equal(q_ids, ids) and q.tobytes() == m.tobytes():  # such cells come in both orders
        return q_ids[:, None] < ids[None, :]
    return q_ids[:, None] != ids[None, :] if len(np.intersect1d(q_ids, ids)) else None


def _pairs(least: float, k: int | None, counted: bool):
    """Pairs of a task's cells that reach `least`, or the k best of these; or how many there are and how many are scored.

    One matrix product in single precision rules out all others by more than its error; those that remain are summed in
    double precision in their own order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floor, best = least, (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        for batch in batches:
            for n in range(len(batch)):
                q_ids, q, ids, m = matrices(batch, n)
                valid = _valid(q_ids, q, ids, m)
                q1, m1, _, error = _single(q, m)
                room = np.empty((min(256, len(q)), len(m)), q1.dtype)
                for lo in range(0, len(q), 256):
                    mine = q_ids[lo : lo + 256]
                    part = product(q1[lo : lo + 256], m1, room)
                    keep = part >= floor - SLACK - 2 * error
                    if valid is not None:
                        keep &= valid[lo : lo + 256]
                    i, j = _found(keep)
                    if counted:
                        all_ = keep.size if valid is None else np.count_nonzero(valid[lo : lo + 256])
                        yield pa.RecordBatch.from_arrays([pa.array([all_]), pa.array([len(i)])], names=["n_pairs", "n_scored"])
                        continue
                    for at in range(0, len(i), 1 << 17):
                        a, b = i[at : at + (1 << 17)], j[at : at + (1 << 17)]
                        score = _exact(q, m, lo + a, b)
                        some = score >= floor
                        one, two, score = mine[a[some]], ids[b[some]], score[some]
                        found = np.minimum(one, two), np.maximum(one, two), score
                        if k is None:
                            yield pa.RecordBatch.from_arrays([pa.array(f) for f in found], names=["a", "b", "score"])
                            continue
                        found = tuple(np.concatenate(f) for f in zip(best, found, strict=True))
                        order = np.lexsort((found[1], found[0], -found[2]))[:k]
                        best = tuple(f[order] for f in found)
                        floor = max(floor, best[2][-1]) if len(order) == k else floor
        if k is not None and not counted:
            yield pa.RecordBatch.from_arrays([pa.array(f) for f in best], names=["a", "b", "score"])

    return run


def all_pairs(corpus: DataFrame, least: float) -> DataFrame:
    """(a, b, score) of every pair a < b of rows with a score of `least` or more. corpus: (id, v of unit length).

    What leaves a task are these pairs alone; evaluations of all pairs count them in the tasks instead (`pair_counts`).
    """
    return cells(corpus, corpus, half=True).mapInArrow(_pairs(least, None, False), "a long, b long, score double")


def top_pairs(corpus: DataFrame, k: int, least: float = 0.0) -> DataFrame:
    """The k best pairs (a, b, score) with a score of `least` or more: score, then smaller ids. Each task keeps its k best,
    and the worst of them rules out what follows."""
    found = cells(corpus, corpus, half=True).mapInArrow(_pairs(least, k, False), "a long, b long, score double")
    return found.orderBy(F.desc("score"), "a", "b").limit(k)


def pairs_scored(corpus: DataFrame, least: float) -> DataFrame:
    """One row (n_pairs, n_scored): how many pairs there are, and how many `all_pairs` sums after its matrix products."""
    found = cells(corpus, corpus, half=True).mapInArrow(_pairs(least, None, True), "n_pairs long, n_scored long")
    return found.agg(F.coalesce(F.sum("n_pairs"), F.lit(0)).alias("n_pairs"), F.coalesce(F.sum("n_scored"), F.lit(0)).alias("n_scored"))


def _steps(v: np.ndarray, width: float | None, thresholds: list[float]) -> Iterator[tuple[float, int]]:
    """How many scores stand at each step: their bucket of a width, else how many ascending thresholds they reach."""
    if width is None:
        # Nothing compares with NaN here; in SQL it is the largest of all.
        nan = int(np.isnan(v).sum()) if len(v) and np.isnan(v.sum()) else 0
        reach = [len(v), *(int(np.count_nonzero(v >= t)) + nan for t in thresholds), 0]
        yield from ((float(i), a - b) for i, (a, b) in enumerate(zip(reach, reach[1:])) if a > b)  # noqa: B905
        return
    at = np.floor(v / width)
    if not np.isfinite(at.sum()) or len(at) and at.max() - at.min() > 1 << 20:  # vectors far from unit length
        yield from zip(*(x.tolist() for x in np.unique(at, return_counts=True)), strict=True)
    elif len(at):
        low = at.min()
        n = np.bincount((at - low).astype(np.int64))
        yield from ((float(low + i), int(n[i])) for i in np.flatnonzero(n).tolist())


def _room(held: dict[str, np.ndarray], name: str, shape: tuple[int, ...], kind: type) -> np.ndarray:
    """An array without values in memory that is used again: fresh memory takes longer than what is done in it."""
    size = int(np.prod(shape))
    if name not in held or len(held[name]) < size or held[name].dtype != kind:
        held[name] = np.empty(size, kind)
    return held[name][:size].reshape(shape)


def _counted(code: np.ndarray, n: int, held: dict[str, np.ndarray]) -> np.ndarray:
    """How often each of n codes occurs. Codes of a byte are counted two at a time, as pairs."""
    if code.dtype != np.uint8 or len(code) % 2:
        return np.bincount(code, minlength=n)
    two = _room(held, "two", (len(code) // 2,), np.intp)
    two[:] = code.view(np.uint16)
    pairs = np.bincount(two)
    pairs.resize(-(-len(pairs) // 256) * 256)
    pairs = pairs.reshape(-1, 256)
    counts = pairs.sum(axis=0)
    counts[: len(pairs)] += pairs.sum(axis=1)
    return counts[:n]


def _buckets(q: np.ndarray, m: np.ndarray, width: float, same: np.ndarray, unknown: np.ndarray | None, valid: np.ndarray | None, held: dict[str, np.ndarray] | None = None) -> list[tuple[float, bool | None, int]] | None:
    """(bucket, kind, count) of a cell's scores; None if single precision cannot tell them.

    A product in single precision tells the bucket unless what it may be wrong by reaches over an edge; such pairs are
    summed as pairs are. A score's code is its bucket, counted from below all scores, and a span further for each kind.
    """
    _, m1, scale, error = _single(q, m)
    far = scale / width + 2
    near = (2 * error + SLACK) / width + far * 2.0**-20
    if not far < 2000 or near > 0.05:
        return None
    half = int(far) + 1
    span = 2 * half + 1
    kind = np.uint8 if 3 * span <= 256 else np.uint16
    counts = np.zeros(3 * span, np.int64)
    q1, held = (q / width).astype(np.float32), {} if held is None else held
    for lo in range(0, len(q), 64):
        of = slice(lo, lo + 64)
        shape = len(q[of]), len(m)
        x, low, code, hit = (_room(held, n, shape, t) for n, t in (("x", np.float32), ("low", kind), ("code", kind), ("hit", bool)))
        product(q1[of], m1, x)
        x += np.float32(half - near)
        np.copyto(low, x, casting="unsafe")
        x += np.float32(2 * near)
        np.copyto(code, x, casting="unsafe")
        i, j = _found(np.not_equal(low, code, out=hit))
        code += np.multiply(same[of].view(np.uint8), kind(span), out=low)
        if unknown is not None:
            code += np.multiply(unknown[of].view(np.uint8), kind(2 * span), out=low)
        least = code[i, j] // span * span
        code[i, j] = 0  # no score is in the first bucket
        if valid is not None:
            code *= valid[of]
            some = valid[lo + i, j]
            i, j, least = i[some], j[some], least[some]
        v = np.floor(_exact(q[of], m, i, j) / width) + half + least
        counts += _counted(code.reshape(-1), len(counts), held) + np.bincount(v.astype(np.intp), minlength=len(counts))
    counts[0] = 0
    return [(float(n % span - half), (False, True, None)[n // span], int(counts[n])) for n in np.flatnonzero(counts).tolist()]


def _tally(label: str, width: float | None, thresholds: list[float], stats: bool):
    """Counts of the pairs of a task's cells by step and by whether their labels are equal."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}
        rooms: dict[str, np.ndarray] = {}
        for batch in batches:
            for n in range(len(batch)):
                q_ids, q, ids, m = matrices(batch, n)
                valid = _valid(q_ids, q, ids, m)
                names = pa.concat_arrays([batch.column(c)[n].values for c in (label, f"m_{label}")]).dictionary_encode()
                code = names.indices.fill_null(-1).to_numpy().astype(np.int16 if len(names.dictionary) < 1 << 15 else np.int32)
                mine, theirs = code[: len(q)], code[len(q) :]
                unknown = (mine < 0)[:, None] | (theirs < 0)[None, :] if names.null_count else None
                if width is not None and not stats:
                    same = np.equal(mine[:, None], theirs[None, :], out=_room(rooms, "same", (len(q), len(m)), bool))
                    told = _buckets(q, m, width, same if unknown is None else same & ~unknown, unknown, valid, rooms)
                    if told is not None:
                        for step, kind, count in told:
                            held.setdefault((str(step), kind), [step, kind, 0, np.inf, -np.inf, 0.0])[2] += count
                        continue
                q, m = q.astype(np.float64, copy=False), m.astype(np.float64, copy=False)
                room = _room(rooms, "scores", (min(128, len(q)), len(m)), np.float64)
                for lo in range(0, len(q), 128):
                    score = product(q[lo : lo + 128], m, room)
                    np.round(score, DIGITS, out=score)
                    same = mine[lo : lo + 128, None] == theirs[None, :]
                    kinds = {True: same, False: ~same}
                    if unknown is not None:
                        kinds = {k: x & ~unknown[lo : lo + 128] for k, x in kinds.items()} | {None: unknown[lo : lo + 128]}
                    for kind, which in kinds.items():
                        v = score[which if valid is None else which & valid[lo : lo + 128]]
                        if not len(v):
                            continue
                        for step, count in _steps(v, width, thresholds):
                            row = held.setdefault((str(step), kind), [step, kind, 0, np.inf, -np.inf, 0.0])
                            row[2] += count
                        if stats:
                            row[3:] = min(row[3], v.min()), max(row[4], v.max()), row[5] + v.sum()
        if held:
            kinds = pa.float64(), pa.bool_(), pa.int64(), pa.float64(), pa.float64(), pa.float64()
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held.values(), strict=True), kinds, strict=True)], names=["step", "is_dup", "n", "least", "most", "total"])

    return run


def pair_counts(corpus: DataFrame, label: str = "label", width: float | None = None, thresholds: list[float] | None = None, stats: bool = False) -> DataFrame:
    """All pairs of rows (id, v, label) counted where their scores are made: (step, is_dup, n, least, most, total).

    step is the bucket of `width`, else how many of the thresholds a score reaches. is_dup: equal labels, null if one is
    unknown. No pair leaves its task, only its counts do. stats, without steps only: minimum, maximum and sum of scores.
    """
    tally = _tally(label, width, sorted(set(thresholds or ())), stats)
    parts = cells(corpus, corpus, extra=(label,), half=True).mapInArrow(tally, "step double, is_dup boolean, n long, least double, most double, total double")
    return parts.groupBy("step", "is_dup").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"), F.sum("total").alias("total"))


def _sums(keys: list[str]):
    """Sums of the vectors of each group, a task at a time: (keys..., sums, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[np.ndarray, int]] = {}
        schema = None

        def packed():
            columns = [pa.array([k[i] for k in held], schema.field(i).type) for i in range(len(keys))]
            out = [*columns, pa.array([s.tolist() for s, _ in held.values()], pa.list_(pa.float64())), pa.array([n for _, n in held.values()], pa.int64())]
            return pa.RecordBatch.from_arrays(out, names=[*keys, "sums", "n"])

        for batch in batches:
            schema, size = batch.schema, np.diff(batch.column("v").offsets.to_numpy())
            code, names = size.astype(np.int64), [None] * len(keys)
            for i in range(len(keys)):
                coded = batch.column(i).dictionary_encode(null_encoding="encode")
                names[i] = coded.dictionary
                code = np.unique(code * max(1, len(coded.dictionary)) + coded.indices.to_numpy(zero_copy_only=False), return_inverse=True)[1]
            order = np.argsort(code, kind="stable")
            cuts = np.flatnonzero(np.diff(code[order])) + 1
            for rows in np.split(order, cuts) if len(order) else ():
                total = batch.column("v").take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1).sum(axis=0)
                key = (*(batch.column(i)[int(rows[0])].as_py() for i in range(len(keys))), len(total))
                old = held.get(key)
                held[key] = (total, len(rows)) if old is None else (old[0] + total, old[1] + len(rows))
            if len(held) > 20_000:
                yield packed()
                held.clear()
        if held:
            yield packed()

    return run


def centroid(rows: DataFrame, key: list[str], vector: str) -> DataFrame:
    """(key..., centroid, n): element-wise mean of the non-zero vectors of a group, brought to unit length.

    Groups without a non-zero vector are left out. Vectors are summed a task at a time; what is shuffled are these sums.
    """
    some = rows.filter(F.col(vector).isNotNull() & ~V.is_zero(vector)).select(*key, F.col(vector).cast("array<double>").alias("v"))
    kinds = ", ".join(f"`{k}` {some.schema[k].dataType.simpleString()}" for k in key)
    parts = some.mapInArrow(_sums(key), f"{kinds}, sums array<double>, n long")
    means = parts.select(*key, "n", F.posexplode("sums").alias("pos", "x")).groupBy(*key, "pos").agg((F.sum("x") / F.sum("n")).alias("m"), F.sum("n").alias("n"))
    lists = means.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("pos", "m"))).alias("by_pos"), F.max("n").alias("n"))
    return lists.select(*key, V.l2_normalize(F.transform("by_pos", lambda t: t["m"])).alias("centroid"), "n")


def confusion(pairs: DataFrame, thresholds: list[float]) -> DataFrame:
    """(threshold, tp, fp, fn, tn, precision, recall, f1) of pairs (score, is_dup); undefined ratios are 0."""
    # One pass: a pair is counted by how many thresholds it reaches, and only these counts meet each threshold.
    steps = sorted(set(thresholds))
    reached = sum(((F.col("score") >= t).cast("int") for t in steps), F.lit(0))
    return _confusion(pairs.groupBy(reached.alias("reached"), "is_dup").agg(F.count("*").alias("n")), steps)


def confusion_of_all(corpus: DataFrame, thresholds: list[float], label: str = "label") -> DataFrame:
    """`confusion` of all pairs of rows (id, v, label)."""
    steps = sorted(set(thresholds))
    return _confusion(pair_counts(corpus, label, thresholds=steps).select(F.col("step").alias("reached"), "is_dup", "n"), steps)


def _confusion(counts: DataFrame, steps: list[float]) -> DataFrame:
    grid = F.inline(F.array(*[F.struct(F.lit(t).alias("threshold"), F.lit(i).alias("i")) for i, t in enumerate(steps)]))
    said = F.col("reached") > F.col("i")
    of = lambda test: F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0).cast("long"))
    out = counts.select("reached", "is_dup", "n", grid).groupBy("threshold").agg(
        of(said & F.col("is_dup")).alias("tp"), of(said & ~F.col("is_dup")).alias("fp"), of(~said & F.col("is_dup")).alias("fn"), of(~said & ~F.col("is_dup")).alias("tn")
    )
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return out.withColumn("precision", ratio(tp, tp + fp)).withColumn("recall", ratio(tp, tp + fn)).withColumn("f1", ratio(2 * tp, 2 * tp + fp + fn))


def best_threshold(pairs: DataFrame, coarse: list[float], span: float = 0.05, step: float = 0.01) -> DataFrame:
    """One row (threshold, f1): the best of a coarse grid, refined around it; the smallest of equals wins."""
    top = lambda df: df.orderBy(F.desc("f1"), "threshold").limit(1)
    first = top(confusion(pairs, coarse)).first()
    if first is None:
        return confusion(pairs, coarse).select("threshold", "f1")
    steps = round(span / step)
    fine = sorted({round(first.threshold + i * step, 4) for i in range(-steps, steps + 1)})
    return top(confusion(pairs, fine)).select("threshold", F.round("f1", 6).alias("f1"))


def score_histogram(pairs: DataFrame, width: float = 0.05) -> DataFrame:
    """(bucket, is_dup, n): buckets of equal width, named by their lower edge."""
    return pairs.groupBy(F.round(F.floor(F.col("score") / width) * width, 2).alias("bucket"), "is_dup").agg(F.count("*").alias("n"))


def score_histogram_of_all(corpus: DataFrame, width: float = 0.05, label: str = "label") -> DataFrame:
    """`score_histogram` of all pairs of rows (id, v, label)."""
    counts = pair_counts(corpus, label, width=width)
    return counts.groupBy(F.round(F.col("step") * width, 2).alias("bucket"), "is_dup").agg(F.sum("n").alias("n"))


def labelled_pairs(rows: DataFrame) -> DataFrame:
    """(id, i, jd, j, label) of all pairs id < jd of rows (id, i, label) of one label.

    A label's rows are dealt to lanes, each of which meets all rows of the label: tasks grow in number with the rows.
    """
    lanes = 1 + rows.count() // LANE_ROWS
    tasks = min(4096, 16 * lanes)
    one = rows.withColumn("lane", F.pmod(F.xxhash64("id"), F.lit(lanes)).cast("long")).repartition(tasks, "label", "lane")
    two = rows.select(F.col("id").alias("jd"), F.col("i").alias("j"), "label", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(lanes - 1).cast("long"))).alias("lane")).repartition(tasks, "label", "lane")
    return one.join(two.hint("shuffle_hash"), ["label", "lane"]).filter("id < jd").select("id", "i", "jd", "j", "label")


def separation(pairs: DataFrame) -> DataFrame:
    """One row of minima, means and maxima for duplicates and others, and how many others reach the least duplicate."""
    of = lambda f, flag: f(F.when(F.col("is_dup") == flag, F.col("score")))
    stats = pairs.agg(*[F.round(of(f, flag), 5).alias(f"{n}_{'dup' if flag else 'other'}") for n, f in (("min", F.min), ("avg", F.avg), ("max", F.max)) for flag in (True, False)])
    over = pairs.filter("not is_dup").join(F.broadcast(pairs.filter("is_dup").agg(F.min("score").alias("least"))), F.col("score") >= F.col("least")).agg(F.count("*").alias("n_overlap"))
    return stats.join(F.broadcast(over))


def separation_of_all(corpus: DataFrame, label: str = "label") -> DataFrame:
    """`separation` of all pairs of rows (id, v, label): scores are made twice, as the least duplicate must be known first."""
    found = pair_counts(corpus, label, stats=True).filter("is_dup is not null")
    all_ = {r.is_dup: r for r in found.collect()}  # two rows
    of = lambda flag, f: f(all_[flag]) if flag in all_ else None
    values = {f"{n}_{'dup' if flag else 'other'}": of(flag, f) for n, f in (("min", lambda r: r.least), ("avg", lambda r: r.total / r.n), ("max", lambda r: r.most)) for flag in (True, False)}
    over = pair_counts(corpus, label, thresholds=[values["min_dup"]]).filter("not is_dup and step = 1") if True in all_ else found.filter("false")
    return over.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_overlap")).select(*[F.round(F.lit(v).cast("double"), 5).alias(k) for k, v in values.items()], "n_overlap")

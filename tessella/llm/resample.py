"""Importance resampling towards a target distribution, over an integer word dictionary.

Texts are packed into pieces of bounded size: each holds its distinct words once and its documents as numbers of these.
The pieces' words are united to one dictionary (word, id), so that an n-gram is a tuple of ids whatever piece it stands
in. Distinct tuples are counted over all pieces; the bytes of each are put together from the dictionary and hashed once,
and buckets, counts and gains are joined back to the pieces, where a document's weight is a sum of whole numbers.

What is shuffled are the distinct words and tuples of pieces, not words of documents: a word that every document holds
is one row a piece. A tuple of one id is its word's own entry in the dictionary. Gumbel keys from a hash of the id turn weights into a draw without replacement that reruns repeat.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm import kernel as K
from tessella.llm.store import BROADCAST_ROWS, scoped, stash

#: Text of one piece; a longer document is a piece of its own. An Arrow batch ends a piece as well.
PIECE_BYTES = 16 << 20
#: Text that is cut into words at a time.
CUT_BYTES = 2 << 20
#: Words or tuples up to which their table is broadcast.
FEW = BROADCAST_ROWS // 10
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: A gain beside its place in a piece, as one long: the place in the upper half, the gain and _SHIFT in the lower.
_LOW, _SHIFT = (1 << 32) - 1, 1 << 31
#: Numbers of the pieces of the target texts begin here.
_TARGET = 1 << 62


def _words(data: np.ndarray, offs: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Words of a slice in lower case, and how many each document has."""
    inside = ~K.NON_ALNUM[data]
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[offs] = True
    head = inside.copy()
    head[1:] &= ~inside[:-1] | cut[1 : len(data)]
    start = np.flatnonzero(head)
    before = np.concatenate((np.zeros(1, np.int64), np.cumsum(inside)))
    ends = np.append(before[start], before[-1])
    words = pa.Array.from_buffers(pa.large_string(), len(start), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(_LOWER[data[inside]])])
    return words, np.diff(np.searchsorted(start, offs))


def _features(word: np.ndarray, count: np.ndarray, n_words: int, most: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Distinct runs of 2 to `most` words of a piece, in numbers of its words.

    Returns their words (one matrix a length), the features of all documents in the order of documents (words, then
    runs), and the number of features of each document.
    """
    if most == 1:
        return [], word, count
    of_doc = np.repeat(np.arange(len(count)), count)
    runs, found, sizes = [], [(of_doc, word)], count
    code, at, base = word, np.arange(len(word)), n_words
    for n in range(2, most + 1):  # a run is the run before it and one word more
        inside = at + n - 1 < len(word)
        inside[inside] = of_doc[at[inside]] == of_doc[at[inside] + n - 1]
        at, code = at[inside], code[inside] * n_words + word[at[inside] + n - 1]
        distinct, first, code = np.unique(code, return_index=True, return_inverse=True)
        runs.append(word[at[first][:, None] + np.arange(n)] if len(at) else np.zeros((0, n), np.int64))
        found.append((of_doc[at], code + base))
        sizes = sizes + np.bincount(of_doc[at], minlength=len(count))
        base += len(distinct)
    doc, feature = (np.concatenate(x) for x in zip(*found, strict=True))
    return runs, feature[np.argsort(doc, kind="stable")], sizes


def _pack(most: int, first_piece: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        piece = first_piece + (TaskContext.get().partitionId() << 33)
        for batch in batches:
            if not len(batch):
                continue
            data, offs = K.buffers(batch.column("text"))
            even = len(data) // max(1, -(-len(data) // PIECE_BYTES)) + 1
            for lo, hi, part, own in K.slices(data, offs, even):
                cut = [_words(x, y) for _, _, x, y in K.slices(part, own, CUT_BYTES)]
                count = np.concatenate([n for _, n in cut])
                coded = pa.chunked_array([w for w, _ in cut], pa.large_string()).dictionary_encode().chunks  # of one dictionary
                words = coded[0].dictionary if coded else pa.array([], pa.large_string())
                number = np.concatenate([np.zeros(0, np.int64), *(x.indices.to_numpy(zero_copy_only=False).astype(np.int64) for x in coded)])
                runs, feature, sizes = _features(number, count, len(words), most)
                ends = np.cumsum(np.concatenate([np.zeros(1, np.int64), *(np.full(len(r), r.shape[1]) for r in runs)]))
                tuples = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *(r.ravel() for r in runs)]), pa.int32()))
                n = np.bincount(feature, minlength=len(words) + len(tuples))
                one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, pa.int32()) if isinstance(values, np.ndarray) else values)
                columns = [one(batch.column("doc_id").slice(lo, hi - lo)), one(count), one(sizes), one(feature), one(words.cast(pa.string())), one(n[: len(words)]), one(tuples), one(n[len(words) :])]
                yield pa.RecordBatch.from_arrays([pa.array([piece]), *columns], schema=schema)
                piece += 1

    return run


def _pieces(texts: DataFrame, most: int, first_piece: int, name: str) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_type

    kind = texts.schema["doc_id"].dataType
    many = lambda t: pa.list_(pa.field("element", t))
    schema = pa.schema([("piece", pa.int64()), ("doc_ids", many(to_arrow_type(kind))), ("n_words", many(pa.int32())), ("n_features", many(pa.int32())), ("features", many(pa.int32())), ("dict", many(pa.string())), ("counts", many(pa.int32())), ("tuples", many(many(pa.int32()))), ("tuple_counts", many(pa.int32()))])
    ddl = f"piece long, doc_ids array<{kind.simpleString()}>, n_words array<int>, n_features array<int>, features array<int>, dict array<string>, counts array<int>, tuples array<array<int>>, tuple_counts array<int>"
    return stash(texts.mapInArrow(_pack(most, first_piece, schema), ddl), name, "zstd")  # numbers of words have many zero bytes


def _side(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= FEW else df


def _in_order(place: str, value: str) -> Column:
    """Values by their places, which are all of 0 to n - 1."""
    return F.transform(F.array_sort(F.collect_list(F.struct(place, value))), lambda x: x[value])


def _weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(len(batch)):
            of = lambda c: batch.column(c).slice(i, 1).flatten()  # noqa: B023, E731
            n = of("n_features").to_numpy()
            gains = (of("gains").to_numpy() & _LOW) - _SHIFT  # in the order of places, which stand above
            gains = gains[of("features").to_numpy()] if n.sum() else np.zeros(0, np.int64)
            sums = np.concatenate((np.zeros(1, np.int64), np.cumsum(gains)))[np.concatenate((np.zeros(1, np.int64), np.cumsum(n)))]
            yield pa.RecordBatch.from_arrays([of("doc_ids"), of("n_words").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(np.diff(sums))], names=["doc_id", "n_words", "n_features", "weight"])


def log_ratio_weights(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", most: int = 1, buckets: int = 10_000) -> DataFrame:
    """(doc_id, n_words, n_features, weight) for each row of docs.

    Features are all runs of 1 to `most` words, joined by a blank, repeats counted; a feature's bucket is the CRC-32 of
    its bytes modulo `buckets`. A bucket's gain is floor(1000 * ln((t + 1) * (S + buckets) / ((s + 1) * (T + buckets)))),
    where docs hold S features and s in the bucket, and target T and t. A weight is the sum of a row's gains.
    """
    mine = _pieces(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), most, 0, "pieces")
    theirs = _pieces(target.select(F.lit(0).alias("doc_id"), F.col(target_col).alias("text")), most, _TARGET, "target-pieces")
    columns = ["piece", "dict", "counts", *(["tuples", "tuple_counts"] if most > 1 else [])]
    both = mine.select(*columns).unionAll(theirs.select(*columns))
    ours = F.col("piece") < _TARGET
    n = F.col("n").cast("long")
    counts = [F.sum(F.when(ours, n).otherwise(0)).alias("s"), F.sum(F.when(ours, 0).otherwise(n)).alias("t")]
    bucket = lambda text: F.pmod(F.crc32(text.cast("binary")), F.lit(buckets)).cast("int").alias("bucket")

    words = both.select("piece", F.posexplode(F.arrays_zip(F.col("dict").alias("word"), F.col("counts").alias("n"))).alias("place", "x")).select("piece", "place", "x.word", "x.n")
    dictionary = words.groupBy("word").agg(*counts).select(F.monotonically_increasing_id().alias("id"), "word", "s", "t", bucket(F.col("word")))
    dictionary = stash(dictionary, "dictionary")
    side = _side(dictionary)
    placed = words.filter(ours).select("piece", "place", "word").join(side.select("word", "bucket"), "word").select("piece", "place", "bucket")
    filled = dictionary.select("bucket", "s", "t")
    if most > 1:
        ids = words.join(side.select("word", "id"), "word").groupBy("piece").agg(_in_order("place", "id").alias("ids"))
        # Tuples become ids in the piece's own row: only what is exploded leaves it.
        coded = F.transform("tuples", lambda gram: F.transform(gram, lambda i: F.get("ids", i)))
        grams = both.join(ids, "piece").select("piece", F.size("dict").alias("base"), F.arrays_zip(coded.alias("gram"), F.col("tuple_counts").alias("n")).alias("grams"))
        grams = grams.select("piece", "base", F.posexplode("grams").alias("place", "x"))
        grams = stash(grams.select("piece", (F.col("base") + F.col("place")).alias("place"), "x.gram", "x.n"), "grams")
        # Each distinct tuple once: counts on both sides, its bytes, their hash.
        parts = grams.groupBy("gram").agg(*counts).select("gram", "s", "t", F.posexplode("gram").alias("nth", "id")).join(side.select("id", "word"), "id")
        spelt = parts.groupBy("gram").agg(F.first("s").alias("s"), F.first("t").alias("t"), F.array_join(_in_order("nth", "word"), " ").alias("text"))
        hashed = stash(spelt.select("gram", "s", "t", bucket(F.col("text"))), "hashed")
        placed = placed.unionAll(grams.filter(ours).join(_side(hashed.select("gram", "bucket")), "gram").select("piece", "place", "bucket"))
        filled = filled.unionAll(hashed.select("bucket", "s", "t"))

    filled = filled.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))  # `buckets` rows at most
    total = filled.agg(F.coalesce(F.sum("s"), F.lit(0)), F.coalesce(F.sum("t"), F.lit(0))).first()
    ratio = (F.col("t") + 1).cast("double") * (total[0] + buckets) / ((F.col("s") + 1).cast("double") * (total[1] + buckets))
    gain = stash(filled.select("bucket", F.floor(1000 * F.log(ratio)).alias("gain")), "gains")
    packed = F.shiftleft(F.col("place").cast("long"), 32) + F.col("gain") + _SHIFT
    gains = placed.join(F.broadcast(gain), "bucket").groupBy("piece").agg(F.sort_array(F.collect_list(packed)).alias("gains"))
    rows = mine.select("piece", "doc_ids", "n_words", "n_features", "features").join(gains, "piece", "left")  # a piece without words has no gains
    return rows.drop("piece").mapInArrow(_weigh, f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_words long, n_features long, weight long")


def in_rank_order(rows: DataFrame, *order: Column) -> DataFrame:
    """rows with `rank` (from 1, gapless) in a global order: ranges of it are sorted apart and counted, then numbered."""
    laid = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    laid = stash(laid, "laid")
    part = F.shiftright("at", 33)
    sizes = laid.groupBy(part.alias("part")).agg(F.count("*").alias("n"))  # one row a partition
    offsets = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return laid.withColumn("part", part).join(F.broadcast(offsets), "part").withColumn("rank", F.col("before") + F.col("at") - F.shiftleft("part", 33) + 1).drop("part", "at", "before")


@scoped("resampled")
def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", most: int = 1, buckets: int = 10_000, seed: int = 2024, least_words: int = 20, percent: int = 10) -> DataFrame:
    """One row per row of docs: (doc_id, n_words, n_features, weight, score, rank).

    Of the N rows with at least `least_words` words the floor(percent * N / 100) highest scores are drawn and numbered by
    rank, ties to the smaller id; rank is null elsewhere. score is weight + floor(-1000 * ln(-ln((h + 0.5) / 2^32))), h
    being the first 32 bits of SHA-256 of "seed:id".

    Null and empty texts have no words, no features and weight 0; a null id hashes as an empty one and ties last.
    Repeated rows are rows of their own with equal scores. An empty target leaves t and T at 0, an empty table of
    documents gives no rows. Texts may have any length. Only the named columns are read, whatever else the tables hold.
    """
    weighed = log_ratio_weights(docs, target, id_col, text_col, target_col, most, buckets)
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(key, 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = stash(weighed.withColumn("score", F.col("weight") + noise), "scored")
    enough = F.col("n_words") >= least_words
    ranked = in_rank_order(scored.filter(enough), F.desc("score"), F.asc_nulls_last("doc_id"))
    drawn = scored.filter(enough).count() * percent // 100
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return ranked.unionByName(scored.filter(~enough).withColumn("rank", F.lit(None).cast("long")))

"""Repeated passages by sparse suffix arrays.

Of every WINDOW neighbouring 4-gram hashes the smallest marks a position; only suffixes that start at marked positions
are kept. Every passage of LEAST words has a marked position among its first WINDOW words, with KEY words of the passage
to its right, and all documents that hold the passage mark it there. Suffixes are sorted by the hash of these KEY words
and by that of their context (all words that a passage of LEAST words around the key can reach). Suffixes of two
documents that agree in their context share all such passages. Where suffixes of one key differ in context, each
passage of LEAST words around it is hashed and looked up by itself, so that none depends on which document comes first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import kernel as K
from tessella.llm.store import discard, scoped, stash

LEAST, GRAM, WINDOW = 50, 4, 16
KEY = LEAST - WINDOW + 1
#: Words on either side of a key that a passage of LEAST words around it can reach.
BESIDE = WINDOW - 1
#: Words of 64 bits in the filter of documents that are read again.
FILTER_WORDS = 1 << 19


def _lowest(gram: np.ndarray) -> np.ndarray:
    """Position of the smallest (first of equals) hash in each window."""
    n = len(gram) - WINDOW + 1
    if n < 1:
        return np.zeros(0, np.int64)
    return np.lib.stride_tricks.sliding_window_view(gram, WINDOW).argmin(axis=1) + np.arange(n)


def marked(gram: np.ndarray) -> np.ndarray:
    """Positions of the smallest (first of equals) hash in each window."""
    return np.flatnonzero(np.bincount(_lowest(gram), minlength=1))


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document its number of words (kind 0); per marked position its key and context (kind 1).

    at is the position, and in its low byte how many words of context there are on the left and on the right.
    """
    names = ["kind", "key", "wide", "uid", "at", "doc_id"]
    for batch in batches:
        data, offs = K.buffers(batch.column("text"))
        uid = batch.column("uid").to_numpy()
        for lo, hi, d, o in K.slices(data, offs):
            words = K.Words(d, o, K.BLANKS)
            m = hi - lo
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(m, np.int8)), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), batch.column("uid").slice(lo, m), pa.array(words.count.astype(np.int64)), batch.column("doc_id").slice(lo, m)], names=names)
            p = marked(K.grams(words.hash, GRAM))
            if not len(p):
                continue
            of = np.searchsorted(words.first, p, "right") - 1
            keep = (p + KEY <= words.first[of + 1]) & (words.count[of] >= LEAST)
            p, of = p[keep], of[keep]
            ranges = K.Ranges(words.hash)
            left = np.minimum(p - words.first[of], BESIDE)
            right = np.minimum(words.first[of + 1] - p - KEY, BESIDE)
            around = left << 4 | right
            key = K.mix(ranges.sums(p, p + KEY))
            wide = K.mix(K.mix(ranges.sums(p - left, p + KEY + right)) + around.astype(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(p), np.int8)), pa.array(K.signed(key)), pa.array(K.signed(wide)), pa.array(uid[lo:hi][of]), pa.array((p - words.first[of]) << 8 | around), pa.nulls(len(p), batch.column("doc_id").type)], names=names)


def _whole(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[list[np.ndarray]]:
    """Columns of rows sorted by the first of them, so that rows of one value come together."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        cols = [batch.column(c).to_numpy() for c in names]
        if not len(cols[0]):
            continue
        cut = int(np.searchsorted(cols[0], cols[0][-1]))
        if held and (cut or held[-1][0][-1] != cols[0][0]):
            yield [np.concatenate(x) for x in zip(*held, [c[:cut] for c in cols], strict=True)]
            held = []
        elif cut:
            yield [c[:cut] for c in cols]
        held.append([c[cut:] for c in cols])
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def _starts(*cols: np.ndarray) -> np.ndarray:
    """Whether a row differs from the one before it."""
    out = np.ones(len(cols[0]), bool)
    out[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in cols])
    return out


def _others(new: np.ndarray, uid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per row its group and a row of another document in it; per group the first row of a second document (or -1)."""
    first = np.flatnonzero(new)
    of = np.cumsum(new) - 1
    other = uid != uid[first][of]
    second = np.full(len(first), -1)
    where = np.flatnonzero(other)[::-1]
    second[of[where]] = where
    return of, np.where(other, first[of], second[of]), second


_MATCH = "kind byte, key long, wide long, uid long, at long, start int, stop int, uid2 long, shift int"
_SCHEMA = pa.schema([(x.split()[0], {"byte": pa.int8(), "long": pa.int64(), "int": pa.int32()}[x.split()[1]]) for x in _MATCH.split(", ")])
_TOLD, _ASK, _LATE, _SEEN = range(4)


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Suffixes sorted by (key, wide, uid, at): those that agree with one of another document in all of their context.

    _ASK: suffixes whose key other documents hold in another context. Of a context that two documents share already a
    row of either says all; of one that stands in a single document every row does. The first and the last key of the
    partition may go on in another one: _LATE are rows that wait for what stands there, of one document at either end;
    _SEEN are a few rows that tell other partitions what stands here.
    """

    def rows(kind, mask, **cols):
        n = int(mask.sum())
        if n:
            cols["kind"] = np.full(len(mask), kind, np.int8)
            yield pa.RecordBatch.from_arrays([pa.array(cols[f.name][mask].astype(f.type.to_pandas_dtype())) if f.name in cols else pa.nulls(n, f.type) for f in _SCHEMA], schema=_SCHEMA)

    def decide(cols, opening, closing):
        key, wide, uid, at = cols
        new_key = _starts(key)
        bucket, _, second = _others(new_key, uid)
        new = new_key | _starts(wide)
        of, mate, twin = _others(new, uid)
        several = (second >= 0) & (np.bincount(bucket[new]) > 1)
        told = twin[of] >= 0
        ask = several[bucket] & (~told | new | (twin[of] == np.arange(len(key))))
        pos = at >> 8
        yield from rows(_TOLD, told, uid=uid, start=pos - (at >> 4 & 15), stop=pos + KEY + (at & 15), uid2=uid[mate], shift=pos[mate] - pos)
        yield from rows(_ASK, ask, uid=uid, at=at)
        late, seen = np.zeros(len(key), bool), np.zeros(len(key), bool)
        for k, c in [(0, 0)] * opening + [(bucket[-1], of[-1])] * closing:
            late |= ((of == c) & ~told) | ((bucket == k) & (second[k] < 0))
            here = np.flatnonzero(bucket == k)
            some = [here[0], twin[of[here[0]]], np.searchsorted(of, of[here[-1]]), twin[of[here[-1]]], second[k]]
            seen[[i for i in some if i >= 0]] = True
        yield from rows(_LATE, late, key=key, wide=wide, uid=uid, at=at)
        yield from rows(_SEEN, seen & ~late, key=key, wide=wide, uid=uid, at=at)

    held, opening = None, True
    for cols in _whole(batches, ["key", "wide", "uid", "at"]):
        if held:
            yield from decide(held, opening, False)
            opening = False
        held = cols
    if held:
        yield from decide(held, opening, True)


def _agree(suffixes: DataFrame, name: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Ranges (uid, start, stop, uid2, shift) that another document holds, suffixes (uid, at) to ask for, and their table."""
    n = int(suffixes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = suffixes.repartitionByRange(n, "key", "wide", "uid").sortWithinPartitions("key", "wide", "uid", "at")
    matched = stash(ordered.mapInArrow(_neighbours, _MATCH), name)
    edges = matched.filter(F.col("kind").isin(_LATE, _SEEN))  # a few rows and documents a partition
    row = F.struct("uid", "at")
    classes = edges.groupBy("key", "wide").agg(F.min(row).alias("lo"), F.max(row).alias("hi"))
    keys = classes.groupBy("key").agg((F.min("lo.uid") != F.max("hi.uid")).alias("met"), F.count("*").alias("n")).filter("met")
    classes = stash(classes.join(keys, "key"), f"{name}-classes")
    across = edges.filter(F.col("kind") == _LATE).select("key", "wide", "uid", "at").join(classes, ["key", "wide"])
    told = F.col("lo.uid") != F.col("hi.uid")
    mate = F.when(F.col("uid") == F.col("lo.uid"), F.col("hi")).otherwise(F.col("lo"))
    part = lambda x, by, mask: F.shiftright(x, by).bitwiseAND(F.lit(mask)).cast("int")
    pos = F.shiftright("at", 8).cast("int")
    ranges = across.filter(told).select("uid", (pos - part("at", 4, 15)).alias("start"), (pos + KEY + part("at", 0, 15)).alias("stop"), mate["uid"].alias("uid2"), (F.shiftright(mate["at"], 8).cast("int") - pos).alias("shift"))
    asks = across.filter((F.col("n") > 1) & ~told).select("uid", "at")
    for x in ("lo", "hi"):
        asks = asks.unionAll(classes.filter("n > 1").select(f"{x}.uid", f"{x}.at"))
    ranges = matched.filter(F.col("kind") == _TOLD).select("uid", "start", "stop", "uid2", "shift").unionAll(ranges)
    return ranges, matched.filter(F.col("kind") == _ASK).select("uid", "at").unionAll(asks), matched


def _passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The passages of LEAST words whose marked position is a wanted one, as suffixes with their context on the right."""
    for batch in batches:
        data, offs = K.buffers(batch.column("text"))
        wanted, uid = batch.column("wanted"), batch.column("uid").to_numpy()
        for lo, hi, d, o in K.slices(data, offs):
            words = K.Words(d, o, K.BLANKS)
            lowest, ranges = _lowest(K.grams(words.hash, GRAM)), K.Ranges(words.hash)
            part = wanted.slice(lo, hi - lo)
            of = np.repeat(np.arange(hi - lo), part.value_lengths().to_numpy())
            at = part.flatten().to_numpy()
            p, left, right = words.first[of] + (at >> 8), at >> 4 & 15, at & 15
            back = np.arange(WINDOW)
            fits = (back <= left[:, None]) & (BESIDE - back <= right[:, None])
            i, back = np.nonzero(fits)
            s = p[i] - back
            mine = lowest[s] == p[i]
            i, s = i[mine], s[mine]
            if len(s):
                yield pa.RecordBatch.from_arrays([pa.array(K.signed(K.mix(ranges.sums(s, s + LEAST)))), pa.array(uid[lo:hi][of[i]]), pa.array((s - words.first[of[i]]) << 8 | BESIDE)], names=["key", "uid", "at"])


def _reach(group: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Largest stop so far within each group of neighbouring rows."""
    step = group.astype(np.int64) << 32
    return np.maximum.accumulate(step + stop) - step


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges sorted by (uid, uid2, shift, start), merged where one document holds them in one piece.

    Runs within another run of the same document are left out.
    """
    for uid, uid2, shift, start, stop in _whole(batches, ["uid", "uid2", "shift", "start", "stop"]):
        new = _starts(uid, uid2, shift)
        far = _reach(np.cumsum(new), stop)
        new[1:] |= start[1:] > far[:-1]
        first = np.flatnonzero(new)
        uid, uid2, start, stop = uid[first], uid2[first], start[first], np.maximum.reduceat(stop, first)
        order = np.lexsort((uid2, -stop, start, uid))
        uid, uid2, start, stop = uid[order], uid2[order], start[order], stop[order]
        new = _starts(uid)
        far = _reach(np.cumsum(new), stop)
        keep = new
        keep[1:] |= stop[1:] > far[:-1]
        yield pa.RecordBatch.from_arrays([pa.array(uid[keep]), pa.array(start[keep].astype(np.int32)), pa.array(stop[keep].astype(np.int32)), pa.array(uid2[keep])], names=["uid", "start", "stop", "uid2"])


def _bucket(uid: str):
    return F.shiftrightunsigned(uid, 6).bitwiseAND(F.lit(FILTER_WORDS - 1))


@scoped("repeats")
def find_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: (doc_id, n_words, n_repeat_words, spans, partners).

    spans: word ranges (end exclusive) of LEAST words or more that also stand in another document, each in one piece;
    partners: ids of one such document for each. Spans of different partners may overlap; none lies within another.
    Words stand between ASCII blanks, ASCII case folded. n_repeat_words counts the words of all passages of LEAST words
    that stand in another document.

    Rows equal in id and text count as one document, so they do not repeat each other. Null or empty texts and texts of
    fewer than LEAST words have no spans. Ids are longs (other types are cast). Null ids are compared like others but are not listed as partners. Only the two
    named columns are read. No rows in, no rows out.
    """
    text = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    text = text.withColumn("uid", F.xxhash64("doc_id", "text"))
    found = stash(text.mapInArrow(_suffixes, "kind byte, key long, wide long, uid long, at long, doc_id long"), "suffixes")
    wide, asks, matched = _agree(found.filter("kind = 1").select("key", "wide", "uid", "at"), "matches")

    wanted = stash(asks.groupBy("uid").agg(F.collect_set("at").alias("wanted")).withColumnRenamed("uid", "w_uid"), "wanted")
    # Texts without a wanted position do not move: ids are 64 bits of a hash, so their bits make a filter of fixed size.
    bits = wanted.groupBy(_bucket("w_uid").alias("bucket")).agg(F.bit_or(F.expr("shiftleft(1L, cast(w_uid & 63 AS int))")).alias("bits"))
    near = text.join(F.broadcast(bits), _bucket("uid") == F.col("bucket")).filter("shiftrightunsigned(bits, cast(uid & 63 AS int)) & 1 = 1").select("uid", "text")
    passages = near.join(wanted.hint("merge"), F.col("uid") == F.col("w_uid")).select("uid", "wanted", "text").mapInArrow(_passages, "key long, uid long, at long")
    passages = stash(passages, "passages")
    exact, _, shared = _agree(passages.select("key", F.col("key").alias("wide"), "uid", "at"), "shared")
    discard(wanted, passages)

    every = wide.unionAll(exact)
    grown = stash(every.repartition("uid").sortWithinPartitions("uid", "uid2", "shift", "start").mapInArrow(_runs, "uid long, start int, stop int, uid2 long"), "grown")
    discard(matched, shared)

    heads = found.filter("kind = 0").select("doc_id", "uid", F.col("at").alias("n_words"))
    names = heads.filter("doc_id is not null").select(F.col("uid").alias("p_uid"), F.col("doc_id").alias("p_id")).dropDuplicates(["p_uid"])
    partners = grown.select("uid", F.col("uid2").alias("p_uid")).distinct().join(names, "p_uid").groupBy("uid").agg(F.array_sort(F.collect_set("p_id")).alias("partners"))
    spans = grown.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("spans"))
    per = spans.join(partners, "uid", "left").withColumnRenamed("uid", "s_uid")
    # Runs of different partners may overlap: count words under the running maximum of the ends.
    covered = F.aggregate("spans", F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")), lambda acc, s: F.struct((acc["n"] + F.greatest(s["stop"] - F.greatest(s["start"], acc["to"]), F.lit(0))).alias("n"), F.greatest(acc["to"], s["stop"]).alias("to")), lambda acc: acc["n"])
    out = heads.join(per, F.col("uid") == F.col("s_uid"), "left")
    return out.select("doc_id", "n_words", F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"), F.coalesce("spans", F.array().cast("array<struct<start:int,stop:int>>")).alias("spans"), F.coalesce("partners", F.array().cast("array<long>")).alias("partners"))

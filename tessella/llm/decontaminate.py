"""Benchmark decontamination by winnowing.

Of every six neighbouring 5-gram hashes the smallest is a fingerprint, in documents as in benchmark items. Ten shared
words hold six shared 5-grams, so every shared window of ten words has a shared fingerprint. Fingerprints are joined by
hash; around each hit the six windows that hold it are compared with the items' windows, and windows that overlap make
up the hit span, however long it is. Items of fewer than ten words are one window each and are looked up as a whole.

A benchmark whose text is counted to be small is broadcast as one index, and documents do not move. A larger one is
joined by shuffles: fingerprints first, then the windows of the documents with hits, and what was found goes back to the
documents by the hash of their text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm import kernel as K
from tessella.llm.flags import flag
from tessella.llm.store import BROADCAST_ROWS, scope, stash

GRAM, WINDOW = 5, 6
SPAN = GRAM + WINDOW - 1
#: Text of a benchmark up to which its index (some four times as large) is broadcast.
BROADCAST_BYTES = 8 << 20


def fingerprints(gram: np.ndarray) -> np.ndarray:
    """Positions of the smallest (first of equals) hash of each window of WINDOW grams."""
    n = len(gram) - WINDOW + 1
    if n < 1:
        return np.zeros(0, np.int64)
    low, at = gram[:n].copy(), np.arange(n)
    for j in range(1, WINDOW):
        new = gram[j : n + j]
        less = new < low
        low[less] = new[less]
        at[less] = np.flatnonzero(less) + j
    mark = np.zeros(len(gram), bool)
    mark[at] = True
    return np.flatnonzero(mark)


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are in a sorted array."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


class Grams:
    """Hashes of k neighbouring words over a slice, and which of them lie within one document."""

    def __init__(self, words: K.Words):
        self.words, self.of_word = words, np.repeat(np.arange(len(words.count)), words.count)

    def within(self, at: np.ndarray, k: int) -> np.ndarray:
        at = at[(at >= 0) & (at + k <= len(self.of_word))]
        return at[self.of_word[at] == self.of_word[at + k - 1]]

    def marked(self) -> tuple[np.ndarray, np.ndarray]:
        """Places of the fingerprints and their hashes."""
        gram = K.grams(self.words.hash, GRAM)
        at = self.within(fingerprints(gram), GRAM)
        return at, gram[at]

    def around(self, at: np.ndarray) -> np.ndarray:
        """First words of all windows of SPAN words that hold a gram at these places."""
        mark = np.zeros(len(self.of_word) + 1, bool)
        for j in range(WINDOW):
            mark[np.maximum(at - j, 0)] = True
        return self.within(np.flatnonzero(mark[:-1]), SPAN)


def item_windows(words: K.Words) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(k, hashes, items, fingerprints) of the windows of k words of a slice of items: SPAN, and the lengths of short items."""
    grams = Grams(words)
    at = grams.within(np.arange(len(words.hash)), SPAN)
    every = K.grams(words.hash, SPAN)
    yield SPAN, every[at], grams.of_word[at], grams.marked()[1]
    for n in np.unique(words.count[(words.count > 0) & (words.count < SPAN)]).tolist():
        i = np.flatnonzero(words.count == n)
        yield n, K.grams(words.hash, n)[words.first[i]], i, np.zeros(0, np.uint64)


class Index:
    """Fingerprints and windows of a small benchmark."""

    def __init__(self, ids: list[str], texts: list[str]):
        data, offs = K.buffers(pa.array(texts, pa.large_string()))
        self.ids, self.windows, self.marks = ids, {}, np.zeros(0, np.uint64)
        for k, h, item, marks in item_windows(K.Words(data, offs, K.NON_ALNUM)):
            order = np.lexsort((item, h))
            h, item = h[order], item[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (item[1:] != item[:-1])
            self.windows[k] = h[new], item[new].astype(np.int32)
            if k == SPAN:
                self.marks = np.unique(marks)

    def hits(self, words: K.Words) -> dict[int, tuple[list[tuple[int, int]], set[int]]]:
        """Per document of a slice with hits: hit spans (words, end exclusive) and items."""
        out: dict[int, tuple[list, set]] = {}
        grams = Grams(words)
        for k, (known, item) in self.windows.items():
            if not len(known):
                continue
            if k == SPAN:
                at, h = grams.marked()
                at = grams.around(at[_among(h, self.marks)])
            else:
                at = grams.within(np.arange(len(words.hash)), k)
            every = K.grams(words.hash, k)[at] if len(at) else np.zeros(0, np.uint64)
            hit = _among(every, known)
            at, every = at[hit], every[hit]
            for d in np.unique(grams.of_word[at]).tolist():
                mine = slice(*np.searchsorted(grams.of_word[at], [d, d + 1]))
                spans, items = out.setdefault(d, ([], set()))
                spans += joined(at[mine] - words.first[d], k)
                h = np.unique(every[mine])
                for lo, hi in zip(np.searchsorted(known, h, "left").tolist(), np.searchsorted(known, h, "right").tolist(), strict=True):
                    items.update(item[lo:hi].tolist())
        return out


def joined(start: np.ndarray, k: int) -> list[tuple[int, int]]:
    """Sorted windows of k words as spans: those that overlap or touch are one."""
    if not len(start):
        return []
    cut = np.flatnonzero(np.diff(start) > k) + 1
    first, last = np.concatenate(([0], cut)), np.concatenate((cut, [len(start)])) - 1
    return list(zip(start[first].tolist(), (start[last] + k).tolist(), strict=True))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
_FOUND = T.StructType().add("spans", T.ArrayType(T.StructType().add("start", T.IntegerType()).add("end", T.IntegerType()))).add("items", T.ArrayType(T.StringType()))


def _scan(index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = index.value
        for batch in batches:
            data, offs = K.buffers(batch.column("text"))
            for lo, hi, d, o in K.slices(data, offs):
                words = K.Words(d, o, K.NON_ALNUM)
                spans, items = [[] for _ in range(hi - lo)], [[] for _ in range(hi - lo)]
                for i, (new, who) in block.hits(words).items():
                    spans[i] = [{"start": s, "end": e} for s, e in merged(new)]
                    items[i] = sorted({block.ids[x] for x in who})
                yield pa.RecordBatch.from_arrays([batch.column("key").slice(lo, hi - lo), pa.array(words.count.astype(np.int64)), pa.array(spans, _SPANS), pa.array(items, pa.list_(pa.string()))], names=["key", "n_words", "spans", "items"])

    return run


def _item_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k, hash, item) of all windows of the items, and (0, hash, null) of their fingerprints."""
    for batch in batches:
        data, offs = K.buffers(batch.column("t"))
        for lo, hi, d, o in K.slices(data, offs):
            names = batch.column("i").slice(lo, hi - lo)
            for k, h, item, marks in item_windows(K.Words(d, o, K.NON_ALNUM)):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), k, np.int8)), pa.array(K.signed(h)), names.take(pa.array(item))], names=["k", "hash", "item"])
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(marks), np.int8)), pa.array(K.signed(marks)), pa.nulls(len(marks), pa.string())], names=["k", "hash", "item"])


def _probes(short: list[int]):
    """(k, hash, uid) of documents: fingerprints (k = 0), and all runs of k words where there are items of k words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = K.buffers(batch.column("text"))
            uid = batch.column("uid").to_numpy()
            for lo, hi, d, o in K.slices(data, offs):
                grams = Grams(K.Words(d, o, K.NON_ALNUM))
                for k in (0, *short):
                    at, h = grams.marked() if k == 0 else (x := grams.within(np.arange(len(grams.of_word)), k), K.grams(grams.words.hash, k)[x])
                    if not len(at):
                        continue
                    rows = np.unique(np.stack((K.signed(h), uid[lo:hi][grams.of_word[at]])), axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(rows.shape[1], k, np.int8)), pa.array(rows[0]), pa.array(rows[1])], names=["k", "hash", "uid"])

    return run


def _windows_at(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k, hash, uid, start) of the windows of documents around the hits (lists of k and hash) found in them."""
    for batch in batches:
        data, offs = K.buffers(batch.column("text"))
        uid, hit_k, hit_h = batch.column("uid").to_numpy(), batch.column("ks"), batch.column("hashes")
        for lo, hi, d, o in K.slices(data, offs):
            for i in range(lo, hi):
                grams = Grams(K.Words(d[o[i - lo] : o[i - lo + 1]], np.array([0, o[i - lo + 1] - o[i - lo]]), K.NON_ALNUM))
                ks, hs = np.array(hit_k[i].as_py()), np.sort(np.array(hit_h[i].as_py(), np.int64).view(np.uint64))
                for k in np.unique(ks).tolist():
                    if k == 0:
                        at, h = grams.marked()
                        at, k = grams.around(at[_among(h, hs)]), SPAN
                        h = K.grams(grams.words.hash, SPAN)[at] if len(at) else np.zeros(0, np.uint64)
                    else:
                        at = grams.within(np.arange(len(grams.of_word)), k)
                        h = K.grams(grams.words.hash, k)[at]
                        at, h = at[_among(h, hs)], h[_among(h, hs)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int8)), pa.array(K.signed(h)), pa.array(np.full(len(at), uid[i])), pa.array(at.astype(np.int32))], names=["k", "hash", "uid", "start"])


_N_WORDS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _shuffled(docs: DataFrame, items: DataFrame) -> DataFrame:
    """As _scan, for a benchmark of any size; docs has key, text and uid, items i and t."""
    with scope(docs.sparkSession) as tables:
        rows = stash(items.mapInArrow(_item_rows, "k byte, hash long, item string").distinct(), "items")
        short = [r.k for r in rows.filter(f"k between 1 and {SPAN - 1}").select("k").distinct().collect()]  # nine at most
        asked = rows.select(F.when(F.col("k") == SPAN, F.lit(None)).otherwise(F.col("k")).alias("k"), "hash").filter("k is not null").distinct()
        texts = docs.select("uid", "text")
        probes = texts.mapInArrow(_probes(short), "k byte, hash long, uid long").join(asked, ["k", "hash"], "left_semi")
        hits = stash(probes.groupBy("uid").agg(F.collect_set("k").alias("ks"), F.collect_set("hash").alias("hashes")).withColumnRenamed("uid", "u"), "hits")
        few = hits.count() <= BROADCAST_ROWS // 10
        known = hits.select("u")
        some = texts.join(F.broadcast(known) if few else known, F.col("uid") == F.col("u"), "left_semi").dropDuplicates(["uid"])
        at = some.join(hits, F.col("uid") == F.col("u")).select("uid", "text", "ks", "hashes").mapInArrow(_windows_at, "k byte, hash long, uid long, start int")
        at = stash(at, "windows")
        met = at.join(rows.filter("k > 0").select("k", "hash").distinct(), ["k", "hash"], "left_semi").groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("start", (F.col("start") + F.col("k")).alias("end")))).alias("spans"))
        who = at.select("k", "hash", "uid").distinct().join(rows.filter("k > 0"), ["k", "hash"]).groupBy("uid").agg(F.array_sort(F.collect_set("item")).alias("items"))
        last = lambda a: F.element_at(a, -1)
        join = lambda a, s: F.when((F.size(a) > 0) & (s["start"] <= last(a)["end"]), F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.struct(last(a)["start"].alias("start"), F.greatest(last(a)["end"], s["end"]).alias("end"))))).otherwise(F.concat(a, F.array(s)))
        empty = F.array().cast(_FOUND["spans"].dataType)
        found = met.join(who, "uid").select(F.col("uid").alias("u"), F.aggregate("spans", empty, join).alias("spans"), "items")
        found = tables.result(found, "leaks")
    few = found.count() <= BROADCAST_ROWS // 10
    out = docs.join(F.broadcast(found) if few else found, F.col("uid") == F.col("u"), "left")
    n: Column = F.coalesce(F.regexp_count("text", F.lit(_N_WORDS)), F.lit(0)).cast("long")
    return out.select("key", n.alias("n_words"), F.coalesce("spans", empty).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def _items(benchmark: DataFrame, item_col: str, item_text_col: str) -> tuple[DataFrame, int]:
    """Items (i, t) with a text, and their bytes."""
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("i"), F.col(item_text_col).alias("t")).filter("t is not null")
    return items, items.agg(F.sum(F.octet_length("t") + F.octet_length("i"))).first()[0] or 0


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", most: int = BROADCAST_BYTES) -> DataFrame:
    """Rows of docs in which find_leaks finds no window of an item, whole and as they are."""
    spark = docs.sparkSession
    items, size = _items(benchmark, item_col, item_text_col)
    text = F.col(text_col)
    if size > most:
        with scope(spark) as tables:
            found = find_leaks(docs.select(F.xxhash64(text).alias("uid"), text.alias("text")), benchmark, "uid", "text", item_col, item_text_col, most)
            leaks = tables.result(found.filter("size(spans) > 0").select(F.col("doc_id").alias("_leak")).distinct(), "leaks")
        side = F.broadcast(leaks) if leaks.count() <= BROADCAST_ROWS else leaks
        return docs.join(side, F.xxhash64(text) == F.col("_leak"), "left_anti")
    got = items.collect()  # `most` bytes at most
    index = spark.sparkContext.broadcast(Index([r.i for r in got], [r.t for r in got]))
    return docs.filter(~flag(_scan(index), lambda found: pc.greater(pc.list_value_length(found.column("spans")), 0), text, "key"))


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", most: int = BROADCAST_BYTES) -> DataFrame:
    """One row per row of docs: (doc_id, n_words, spans, items): merged hit spans in words, and ids of items found.

    Words are runs of ASCII digits and letters (case folded) and of any non-ASCII characters. Ten consecutive words of
    an item make a window; an item of one to nine words is one window. Null or empty texts have no words and no hits;
    null or empty items are never found; an item without an id is named "null"; rows that repeat an item count once.
    Repeated documents stay repeated. id_col may be a struct that carries a whole row along. Only the named columns
    are read. Empty benchmark: no hits; empty docs: no rows. A benchmark of more than `most` bytes is joined by shuffles.
    """
    spark = docs.sparkSession
    out = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"))
    items, size = _items(benchmark, item_col, item_text_col)
    if size > most:
        found = _shuffled(out.withColumn("uid", F.xxhash64("text")), items)
    else:
        got = items.collect()  # `most` bytes at most
        schema = T.StructType().add("key", out.schema["key"].dataType).add("n_words", T.LongType())
        schema = T.StructType([*schema.fields, *_FOUND.fields])
        found = out.mapInArrow(_scan(spark.sparkContext.broadcast(Index([r.i for r in got], [r.t for r in got]))), schema)
    return found.select(F.col("key").alias("doc_id"), "n_words", "spans", "items")

"""Quality rules and a hashed n-gram log-likelihood ratio.

Uni- and bigrams of all documents and of the trusted ones are counted in hashed buckets (two multinomials). A
document's score is the mean over its n-grams of log p_trusted - log p_raw; it is kept when its score is at least the
threshold and no base rule fails. The number of buckets is fixed; counts cover every text of the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import kernel as K
from tessella.llm.store import BROADCAST_ROWS, discard, stash

BITS = 18
#: Pseudo-counts per bucket of the trusted multinomial, spread as the raw one is.
SMOOTH = 2.0
#: A document is kept from this mean log ratio on.
THRESHOLD = -0.15
#: Log ratios are summed in units of 1 / ONE.
ONE = 1 << 32
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def _buckets(words: K.Words) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words, and of each word with its follower (of another document for a last word: not used)."""
    shift = np.uint64(64 - BITS)
    return (words.hash >> shift).astype(np.int64), (K.grams(words.hash, 2) >> shift).astype(np.int64)


def _in_doc_pairs(words: K.Words) -> np.ndarray:
    keep = np.ones(max(0, len(words.hash) - 1), bool)
    last = words.first[1:-1] - 1
    keep[last[(last >= 0) & (last < len(keep))]] = False
    return keep


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    raw, good = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, np.int64)
    for batch in batches:
        data, offs = K.buffers(batch.column("text"))
        trusted = batch.column("trusted").to_numpy(zero_copy_only=False).astype(bool)
        for lo, hi, d, o in K.slices(data, offs):
            words = K.Words(d, o, K.BLANKS)
            one, two = _buckets(words)
            inside = _in_doc_pairs(words)
            of = np.repeat(trusted[lo:hi], words.count)
            raw += np.bincount(one, minlength=1 << BITS) + np.bincount(two[inside], minlength=1 << BITS)
            good += np.bincount(one[of], minlength=1 << BITS) + np.bincount(two[inside & of[:-1]] if len(two) else two, minlength=1 << BITS)
    some = np.flatnonzero(raw)
    for lo in range(0, len(some), 65536):
        b = some[lo : lo + 65536]
        yield pa.RecordBatch.from_arrays([pa.array(b.astype(np.int32)), pa.array(raw[b]), pa.array(good[b])], names=["bucket", "raw", "good"])


def fit_ratio(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """Log ratio of each bucket. trusted: ids (same column name) of documents of the target; null ids match nothing.

    Without trusted documents, or without words, all ratios are 0.
    """
    ids = stash(trusted.select(F.col(id_col).alias("k")).filter("k is not null").distinct(), "trusted")
    side = F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids
    text = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(side, F.col("id") == F.col("k"), "left")
    counts = text.select("text", F.col("k").isNotNull().alias("trusted")).mapInArrow(_count, "bucket int, raw long, good long")
    raw, good = np.zeros(1 << BITS), np.zeros(1 << BITS)
    for r in counts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good")).toLocalIterator():  # 2^BITS rows at most
        raw[r.bucket], good[r.bucket] = r.raw, r.good
    discard(ids)
    if not good.sum():
        return np.zeros(1 << BITS)
    base = (raw + 1) / (raw.sum() + len(raw))
    prior = base * SMOOTH * len(raw)
    return np.log((good + prior) / (good.sum() + prior.sum())) - np.log(base)


def _repeated_words(hash3: np.ndarray, n: int) -> int:
    """Words in 3-word windows found twice or more."""
    if n < 3:
        return 0
    order = np.argsort(hash3, kind="stable")
    s = hash3[order]
    twin = np.zeros(len(s), bool)
    twin[1:] = s[1:] == s[:-1]
    twin[:-1] |= twin[1:]
    mark = np.zeros(n, bool)
    at = order[twin]
    mark[at] = mark[at + 1] = mark[at + 2] = True
    return int(mark.sum())


def _duplicate_lines(text: bytes) -> int:
    seen, n = set(), 0
    for line in text.split(b"\n"):
        if line.split():
            n += line in seen
            seen.add(line)
    return n


def _measure(ratio):
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = np.rint(ratio.value * ONE).astype(np.int64)
        for batch in batches:
            data, offs = K.buffers(batch.column("text"))
            for lo, hi, d, o in K.slices(data, offs):
                words = K.Words(d, o, K.BLANKS, fold=False)
                n = hi - lo
                per = lambda flag, o=o: np.diff(np.concatenate(([0], np.cumsum(flag)))[o])
                chars, symbols = per(~K.BLANKS[d] & ((d & 0xC0) != 0x80)), per(_SYMBOL[d])
                triple = K.grams(words.hash, 3)
                repeat, lines = np.zeros(n, np.int64), np.zeros(n, np.int64)
                for i in range(n):
                    f, c = int(words.first[i]), int(words.count[i])
                    repeat[i] = _repeated_words(triple[f : f + c - 2], c)
                    lines[i] = _duplicate_lines(d[o[i] : o[i + 1]].tobytes())
                del words, triple
                folded = K.Words(d, o, K.BLANKS)
                one, two = _buckets(folded)
                gain = np.zeros(len(one) + 1, np.int64)  # sums of whole numbers: the same wherever a slice begins
                gain[1:] = np.cumsum(weight[one] + np.append(np.where(_in_doc_pairs(folded), weight[two], 0), 0)) if len(one) else 0
                grams = np.maximum(2 * folded.count - 1, 1)
                score = np.diff(gain[folded.first]) / ONE / grams
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, n), *(pa.array(x.astype(np.int64)) for x in (folded.count, chars, symbols, lines, repeat)), pa.array(score)], names=names)

    return run


def quality_rules(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of docs: (doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, score, base_failed, kept).

    Null texts count as empty: no words, score 0, base_failed. Ids may be null or repeated; an id that repeats counts
    as trusted in each of its rows. Only the named columns are read. No documents, no rows.
    """
    spark = docs.sparkSession
    ratio = spark.sparkContext.broadcast(fit_ratio(docs, trusted, id_col, text_col))
    text = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = text.schema["doc_id"].dataType.simpleString()
    out = text.mapInArrow(_measure(ratio), f"doc_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, score double")
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("score") >= threshold))

"""Exact n-gram Jaccard join by a size-aware heavy-light split.

Sets are the distinct k-word shingles of whole texts. Equal sets collapse to one class first. Then

* small sets (up to a boundary chosen by cost) enumerate all 2-subsets of their extended prefix; two small sets of the
  asked similarity share such a subset;
* large sets put the tokens of their prefix into inverted lists, which are sorted and scanned, with position and
  count filters before any set is fetched;
* tokens found in very many sets are heavy: they are ordered last, so that passages which many documents share leave
  the prefixes, and sets that consist of heavy tokens all the same (large families of near copies) are compared in
  blocks within their family, where only a spanning forest of the links and their number per set leave a task.

Any order of tokens gives the same links, so which tokens count as heavy changes cost and never results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import kernel as K
from tessella.llm.graph import components
from tessella.llm.store import BROADCAST_ROWS, discard, scoped, stash

#: A token counts as heavy from so many sets on; the number doubles until at most MOST_HEAVY tokens are.
HEAVY_FROM, MOST_HEAVY = 16, BROADCAST_ROWS
#: Tokens a task counts at a time when it looks for heavy ones.
CHUNK_TOKENS = 4_000_000
#: An inverted list longer than this sends its token (or both of its subset) back as heavy; lists are built again.
LONGEST_LIST = 256
#: Sets of a block in a family.
BLOCK = 256
#: Cost of a posting (sorted, scanned, filtered) against that of an enumerated subset (hashed).
POSTING_COST = 4
_SUBSET = 1 << 62
_PAIR = (np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


def _need(n: int, num: int, den: int) -> int:
    """Least overlap that a set of n elements has with any set of similarity num/den or more."""
    return -(-n * num // den)


def boundary(histogram: dict[int, int], num: int, den: int) -> int:
    """Largest size at which enumerating subsets costs less than posting, over the sizes found."""

    def cost(x: int) -> int:
        total = 0
        for n, c in histogram.items():
            f = n - _need(n, num, den)
            total += c * ((f + 2) * (f + 1) // 2 if n <= x else 0)
            total += c * (POSTING_COST * (f + 1) if n > x or n * den >= x * num else 0)
        return total

    return min(range(1, 65), key=lambda x: (cost(x), x))


def _class_id(s: np.ndarray) -> np.uint64:
    """Identity of a set: an order-free hash of its sorted elements and their number."""
    at = np.arange(1, len(s) + 1, dtype=np.uint64)
    return K.mix(np.array([np.sum(K.mix(s * (at * np.uint64(2) + np.uint64(1))))], np.uint64) + np.uint64(len(s)))[0]


def _profile(k: int):
    """Per document its class and set size (kind 0), and tokens found often within a chunk of the task (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, seen, n_held = [], set(), 0

        def often() -> pa.RecordBatch:
            every = np.sort(np.concatenate(held)) if held else np.zeros(0, np.uint64)
            at = np.flatnonzero(np.concatenate((np.ones(min(1, len(every)), bool), every[1:] != every[:-1])))
            count = np.diff(np.append(at, len(every)))
            pick = count >= 2
            m = int(pick.sum())
            return pa.RecordBatch.from_arrays([pa.array(np.ones(m, np.int8)), pa.nulls(m, pa.int64()), pa.array(K.signed(every[at[pick]])), pa.array(count[pick].astype(np.int64)), pa.nulls(m, pa.int64())], names=["kind", "key", "id", "n", "mark"])

        for batch in batches:
            data, offs = K.buffers(batch.column("text"))
            keys, marks = batch.column("key"), batch.column("mark")
            for lo, hi, d, o in K.slices(data, offs):
                ids, sizes = [], []
                for s in K.shingle_sets(K.Words(d, o, K.BLANKS), k):
                    sizes.append(len(s))
                    ids.append(_class_id(s) if len(s) else np.uint64(0))
                    if len(s) and ids[-1] not in seen:
                        seen.add(ids[-1])
                        held.append(s)
                        n_held += len(s)
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(hi - lo, np.int8)), keys.slice(lo, hi - lo), pa.array(K.signed(np.array(ids, np.uint64))), pa.array(np.array(sizes, np.int64)), marks.slice(lo, hi - lo)], names=["kind", "key", "id", "n", "mark"])
                if n_held >= CHUNK_TOKENS:
                    yield often()
                    held, n_held = [], 0
        yield often()

    return run


def _ordered(s: np.ndarray, heavy: np.ndarray, prefix: int) -> tuple[np.ndarray, int]:
    """The first elements of a set, light ones first; and how many of these are light."""
    if not len(heavy):
        return s[:prefix], min(prefix, len(s))
    at = np.searchsorted(heavy, s)
    at[at == len(heavy)] = 0
    is_heavy = heavy[at] == s
    light = s[~is_heavy][:prefix]
    return np.concatenate((light, s[is_heavy][: prefix - len(light)])), len(light)


def _subsets(first: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return K.mix(first[a] * _PAIR[0] + K.mix(first[b] * _PAIR[1]))


def _postings(k: int, num: int, den: int, small: int, heavy):
    """Rows (token, sid, meta): light tokens or subsets (kind 0), and all prefix tokens of heavy sets (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = heavy.value
        seen = set()
        for batch in batches:
            data, offs = K.buffers(batch.column("text"))
            for _, _, d, o in K.slices(data, offs):
                out = []

                def put(kind, tokens, sid, meta, out=out):
                    out.append((np.full(len(tokens), kind, np.int8), tokens, np.full(len(tokens), sid, np.uint64), meta))

                for s in K.shingle_sets(K.Words(d, o, K.BLANKS), k):
                    n = len(s)
                    if not n or (sid := _class_id(s)) in seen:
                        continue
                    seen.add(sid)
                    f = n - _need(n, num, den)
                    first, light = _ordered(s, table, f + 1 + (n <= small))
                    hot = light < len(first)
                    # Up to its last light token a set is compared whole; with heavy ones behind, in all its light tokens.
                    end = 0x7FFFFFFF if hot else int(first[min(light, f + 1) - 1] >> np.uint64(33))
                    base = n << 32 | end << 1 | int(hot)
                    if hot:
                        put(1, first, sid, np.full(len(first), base, np.int64))
                    if n <= small and n > 1:
                        a, b = np.triu_indices(light, 1)
                        put(0, _subsets(first, a, b), sid, np.full(len(a), base | _SUBSET, np.int64))
                    if n > small or n * den >= small * num:
                        m = min(light, f + 1)
                        put(0, first[:m], sid, np.full(m, base, np.int64))
                if out:
                    kind, token, sid, meta = (np.concatenate(x) for x in zip(*out, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(K.signed(token)), pa.array(K.signed(sid)), pa.array(meta)], names=["kind", "token", "sid", "meta"])

    return run


def _shingles_of(k: int, num: int, den: int, small: int, heavy, late):
    """Shingles of the late 2-subsets: a subset's hash does not tell what it is made of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, wanted, seen = heavy.value, late.value, set()
        for batch in batches:
            data, offs = K.buffers(batch.column("text"))
            for _, _, d, o in K.slices(data, offs):
                out = []
                for s in K.shingle_sets(K.Words(d, o, K.BLANKS), k):
                    n = len(s)
                    if not 1 < n <= small:
                        continue
                    first, light = _ordered(s, table, n - _need(n, num, den) + 2)
                    a, b = np.triu_indices(light, 1)
                    hit = np.isin(_subsets(first, a, b), wanted)
                    out += [x for x in (*first[a[hit]].tolist(), *first[b[hit]].tolist()) if x not in seen]
                    seen.update(out)
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(K.signed(np.array(out, np.uint64)))], names=["token"])

    return run


_PAIRS = "late long, a long, b long, need int, rest int"


def _scan_lists(num: int, den: int):
    """Scan lists sorted by token: pairs whose sizes allow a link, or the token itself where a list is too long.

    need is 1 for a late token that is a 2-subset, else 0.
    rest: how much overlap a pair may still have beyond the tokens of its shared lists. The set whose prefix ends first
    has been compared in all of its prefix, so only its other elements are open.
    """
    schema = pa.schema([("late", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("need", pa.int32()), ("rest", pa.int32())])

    def pairs(token, sid, meta):
        first = np.flatnonzero(np.concatenate((np.ones(min(1, len(token)), bool), token[1:] != token[:-1])))
        length = np.diff(np.append(first, len(token)))
        long = first[length > LONGEST_LIST]
        late, of_two = token[long], (meta[long] & _SUBSET != 0).astype(np.int32)
        for g in np.unique(length):
            if not 2 <= g <= LONGEST_LIST:
                continue
            x, y = np.triu_indices(int(g), 1)
            every = first[length == g]
            step = max(1, 200_000 // len(x))
            for lo in range(0, len(every), step):
                at = every[lo : lo + step, None]
                i, j = (at + x[None, :]).ravel(), (at + y[None, :]).ravel()
                n_i, n_j = (meta[i] >> 32) & 0x3FFFFFFF, (meta[j] >> 32) & 0x3FFFFFFF
                keep = (np.minimum(n_i, n_j) * den >= np.maximum(n_i, n_j) * num) & ~((meta[i] & 1 == 1) & (meta[j] & 1 == 1))
                i, j, n_i, n_j = i[keep], j[keep], n_i[keep], n_j[keep]
                need = -((n_i + n_j) * -num // (num + den))
                e_i, e_j = meta[i] & 0xFFFFFFFE, meta[j] & 0xFFFFFFFE
                open_i, open_j = (-(n * -num // den) - 1 for n in (n_i, n_j))
                rest = np.where(e_i < e_j, open_i, np.where(e_j < e_i, open_j, np.maximum(open_i, open_j)))
                rest = np.where((meta[i] | meta[j]) & _SUBSET != 0, need, rest)
                a, b = np.minimum(sid[i], sid[j]), np.maximum(sid[i], sid[j])
                yield pa.RecordBatch.from_arrays([pa.nulls(len(i), pa.int64()), pa.array(a), pa.array(b), pa.array(need.astype(np.int32)), pa.array(rest.astype(np.int32))], schema=schema)
        if len(late):
            yield pa.RecordBatch.from_arrays([pa.array(late), *(pa.nulls(len(late), f.type) for f in list(schema)[1:3]), pa.array(of_two), pa.nulls(len(late), pa.int32())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = [np.zeros(0, np.int64)] * 3
        for batch in batches:
            token, sid, meta = (np.concatenate((r, batch.column(c).to_numpy(zero_copy_only=False))) for r, c in zip(rest, ("token", "sid", "meta"), strict=True))
            if not len(token):
                continue
            same = np.concatenate((np.zeros(1, bool), (token[1:] == token[:-1]) & (sid[1:] == sid[:-1])))
            token, sid, meta = token[~same], sid[~same], meta[~same]
            cut = int(np.searchsorted(token, token[-1]))
            yield from pairs(token[:cut], sid[:cut], meta[:cut])
            # A list that is too long already need not be held: one more row than the limit says all.
            rest = [x[cut:][: LONGEST_LIST + 1] for x in (token, sid, meta)]
        yield from pairs(*rest)

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            data, offs = K.buffers(batch.column("text"))
            for _, _, d, o in K.slices(data, offs):
                got = []
                for s in K.shingle_sets(K.Words(d, o, K.BLANKS), k):
                    if len(s) and (sid := _class_id(s)) not in seen:
                        seen.add(sid)
                        got.append((sid, len(s), s.tobytes()))
                if got:
                    ids, n, blob = zip(*got, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(K.signed(np.array(ids, np.uint64))), pa.array(n, pa.int32()), pa.array(blob, pa.binary())], names=["sid", "n", "blob"])

    return run


def _verify(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("blob_a"), batch.column("blob_b"), strict=True):
                a, b = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                at = np.searchsorted(b, a)
                at[at == len(b)] = 0
                both = int(np.count_nonzero(b[at] == a))
                keep.append(both * den >= num * (len(a) + len(b) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _block_links(num: int, den: int):
    """Links of one or two blocks of a family by products of membership matrices: a spanning forest of them (a, b), and
    how many links each set has in this pair of blocks (a, n).

    Two sets of one block meet in the cell of that block alone, so that each link counts once.
    """

    def run(pdf):
        import pandas as pd

        pdf = pdf.drop_duplicates("sid")
        sets = [np.frombuffer(x, np.uint64) for x in pdf["blob"]]
        size = np.array([len(s) for s in sets])
        row = np.repeat(np.arange(len(sets)), size)
        order = np.argsort(every := np.concatenate(sets), kind="stable")
        token, row = every[order], row[order]
        first = np.concatenate(([True], token[1:] != token[:-1]))
        column = np.cumsum(first) - 1
        shared = np.bincount(column)[column] > 1
        _, column = np.unique(column[shared], return_inverse=True)
        row = row[shared]
        both = np.zeros((len(sets), len(sets)), np.float32)
        width = 4096
        for lo in range(0, int(column.max()) + 1 if len(column) else 0, width):
            c = slice(*np.searchsorted(column, [lo, lo + width]))
            part = np.zeros((len(sets), width), np.float32)
            part[row[c], column[c] - lo] = 1
            both += part @ part.T
        side = pdf["side"].to_numpy()
        near = (both * den >= num * (size[:, None] + size[None, :] - both)) & ((side[:, None] != side[None, :]) | pdf["alone"].to_numpy()[0] & ~np.eye(len(sets), dtype=bool))
        count = near.sum(axis=1)
        near = np.argwhere(np.triu(near))
        up = list(range(len(sets)))

        def root(i):
            while up[i] != i:
                up[i] = up[up[i]]
                i = up[i]
            return i

        out, ids = [], pdf["sid"].to_numpy()
        for i, j in near.tolist():
            if (x := root(i)) != (y := root(j)):
                up[x] = y
                out.append((ids[i], ids[j], None))
        out += [(ids[i], None, int(count[i])) for i in np.flatnonzero(count)]
        return pd.DataFrame({c: pd.array([x[k] for x in out], dtype="Int64") for k, c in enumerate("abn")})

    return run


def _family_links(members: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Links (a, b) and counts (a, n) within families (node, root): blocks by size band and hash, each pair of blocks whose
    sizes allow a link."""
    band = F.floor(F.log(F.col("n")) / float(np.log(den / num))).cast("int")
    docs = members.join(sets, members.node == sets.sid).select("sid", "n", "blob", F.col("root").alias("family"), band.alias("band"))
    head = docs.select("sid", "family", "band")
    cells = head.groupBy("family", "band").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    near = cells
    for step, name in ((-1, "below"), (1, "above")):
        other = cells.select("family", (F.col("band") - step).alias("band"), F.col("blocks").alias(name))
        near = near.join(other, ["family", "band"], "left")
    near = near.fillna(0, ["below", "above"])
    block = F.pmod(F.xxhash64("sid"), "blocks").cast("int")
    near = stash(near, "bands")
    few = near.count() <= BROADCAST_ROWS // 10
    dealt = docs.join(F.broadcast(near) if few else near, ["family", "band"]).withColumn("block", block)
    some = lambda n: F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.array().cast("array<int>"))
    key = lambda band, other, i, j: F.struct(band.alias("b"), other.alias("c"), i.cast("int").alias("i"), j.cast("int").alias("j"))
    own = F.transform(some("blocks"), lambda j: key(F.col("band"), F.col("band"), F.least("block", j), F.greatest("block", j)))
    up = F.transform(some("above"), lambda j: key(F.col("band"), F.col("band") + 1, F.col("block"), j))
    down = F.transform(some("below"), lambda j: key(F.col("band") - 1, F.col("band"), j, F.col("block")))
    side = F.when(F.col("cell.b") == F.col("cell.c"), F.col("block")).otherwise(F.col("band"))
    dealt = dealt.select("sid", "blob", "family", "band", "block", F.explode(F.concat(own, up, down)).alias("cell"))
    alone = (F.col("cell.b") == F.col("cell.c")) & (F.col("cell.i") == F.col("cell.j"))
    return dealt.select("sid", "blob", "family", side.alias("side"), alone.alias("alone"), "cell").groupBy("family", "cell").applyInPandas(_block_links(num, den), "a long, b long, n long")


@scoped("jaccard")
def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 3, den: int = 4) -> DataFrame:
    """One row per row of docs: (doc_id, text_hash, n_shingles, class_id, class_doc, component_id, component, n_links).

    Two texts link when |A & B| * den >= num * |A | B| over their distinct k-word shingles (ASCII-lower-cased words
    between ASCII blanks; fewer than k words: the whole sequence is the one shingle). class_id is equal for equal sets,
    class_doc the smallest id with that set; n_links counts the other classes that link with it. component is equal
    where links reach, component_id the smallest id there, the row's own included. text_hash is that of the text.

    Null or empty texts, or texts without words, have n_shingles 0, link with nothing and are their own component (class
    and component are null).
    Ids are longs (other types must be mapped to longs before). Null ids take part with their text but are never a
    component_id; a component of null ids alone has null. Repeated
    rows stay repeated. Only the two named columns are read, so other columns may have any name. Empty in, empty out.
    """
    spark = docs.sparkSession
    text = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"))
    profile = stash(text.withColumn("mark", F.xxhash64("text")).mapInArrow(_profile(k), "kind byte, key long, id long, n long, mark long"), "profile")
    head = profile.filter("kind = 0").select("key", F.col("id").alias("sid"), "n", "mark")
    sizes = {r.n: r["count"] for r in head.filter("n between 1 and 64").groupBy("n").count().collect()}  # 64 rows at most
    small = boundary(sizes, num, den)
    often = stash(profile.filter("kind = 1").groupBy("id").agg(F.sum("n").alias("n")).filter(F.col("n") >= HEAVY_FROM), "often")
    least = HEAVY_FROM
    while often.filter(F.col("n") >= least).count() > MOST_HEAVY:
        least *= 2
    found = often.filter(F.col("n") >= least).select("id").toArrow()["id"].to_numpy()  # MOST_HEAVY at most
    discard(often)

    light = None
    while True:
        heavy = spark.sparkContext.broadcast(np.sort(found.view(np.uint64)))
        posted = stash(text.select("text").mapInArrow(_postings(k, num, den, small, heavy), "kind byte, token long, sid long, meta long"), "postings")
        lists = posted.filter("kind = 0").select("token", "sid", "meta").repartition("token").sortWithinPartitions("token", "sid")
        discard(light)
        light = stash(lists.mapInArrow(_scan_lists(num, den), _PAIRS), "pairs")
        late = light.filter("late is not null").select("late", "need").distinct().limit(MOST_HEAVY).toArrow()
        if not len(late):
            break
        token, of_two = late["late"].to_numpy(), late["need"].to_numpy() > 0
        found = np.union1d(found, token[~of_two])
        if of_two.any():
            subsets = spark.sparkContext.broadcast(np.sort(token[of_two].view(np.uint64)))
            parts = text.select("text").mapInArrow(_shingles_of(k, num, den, small, heavy, subsets), "token long").distinct()
            found = np.union1d(found, parts.toArrow()["token"].to_numpy())  # two a subset at most
        discard(posted)
    pairs = light.filter("a is not null").groupBy("a", "b").agg(F.count("*").alias("o"), F.max("need").alias("need"), F.max("rest").alias("rest")).filter("o + rest >= need").select("a", "b")
    pairs = stash(pairs, "candidates")
    discard(light)
    tied = posted.filter("kind = 1").select("sid", F.col("token").bitwiseXOR(F.lit(0x5A5A5A5A5A5A5A5A)).alias("token")).distinct()
    families = components(tied, "sid", "token")
    families = families.join(tied.select(F.col("sid").alias("node")).distinct(), "node", "left_semi")
    families = stash(families, "families")
    discard(posted)

    wanted = pairs.select(F.col("a").alias("sid")).unionAll(pairs.select(F.col("b").alias("sid"))).unionAll(families.select(F.col("node").alias("sid"))).distinct()
    place = F.coalesce(F.col("key"), F.xxhash64(F.col("sid")))
    keys = stash(head.withColumn("place", place).groupBy("sid").agg(F.min("place").alias("place"), F.max(F.col("key").isNull()).alias("bare")).join(wanted, "sid", "left_semi").select("place", "bare", "sid"), "wanted")
    few = keys.count() <= BROADCAST_ROWS
    pick = keys.select("place").distinct()
    known = text.filter("key is not null").join(F.broadcast(pick) if few else pick, F.col("key") == F.col("place"), "left_semi").select("text")
    if keys.filter("bare").limit(1).count():  # classes with rows without an id are looked up by their text
        known = known.unionAll(text.filter("key is null").select("text"))
    sets = stash(known.mapInArrow(_sets(k), "sid long, n int, blob binary").filter(F.length("blob") > 0), "sets")
    one, two = (sets.select(F.col("sid").alias(x), F.col("blob").alias(f"blob_{x}")) for x in "ab")
    links = pairs.join(one, "a").join(two, "b").select("a", "b", "blob_a", "blob_b").mapInArrow(_verify(num, den), "a long, b long")
    links = links.withColumns({"n": F.lit(None).cast("long"), "told": F.lit(True)})
    links = stash(links.unionAll(_family_links(families, sets, num, den).withColumn("told", F.col("n").isNotNull())), "links")
    discard(pairs, families, keys, sets)
    roots = components(links.filter("b is not null"), "a", "b")
    told = links.filter("told")  # links of lists one by one, those of families as numbers
    ends = told.select(F.col("a").alias("sid"), F.coalesce("n", F.lit(1)).alias("n")).unionAll(told.filter("b is not null").select(F.col("b").alias("sid"), F.lit(1).cast("long"))).groupBy("sid").agg(F.sum("n").alias("n_links"))
    tree = roots.join(ends, roots.node == ends.sid, "left").select("node", "root", "n_links")
    classes = head.groupBy("sid").agg(F.min("key").alias("low"))
    classes = classes.join(tree, F.col("sid") == F.col("node"), "left").select("sid", "low", F.coalesce("root", "sid").alias("root"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    lowest = classes.groupBy("root").agg(F.min("low").alias("component_id"))
    classes = classes.join(lowest, "root").select("sid", F.col("low").alias("class_doc"), "component_id", F.col("root").alias("component"), "n_links")
    own = [F.col("key").alias("doc_id"), F.col("mark").alias("text_hash"), F.col("n").alias("n_shingles")]
    some = head.filter("n > 0").join(classes, "sid").select(*own, F.col("sid").alias("class_id"), "class_doc", "component_id", "component", "n_links")
    no = F.lit(None).cast("long")
    none = head.filter("n = 0").select(*own, no.alias("class_id"), no.alias("class_doc"), F.col("key").alias("component_id"), no.alias("component"), F.lit(0).cast("long").alias("n_links"))
    return some.unionAll(none)

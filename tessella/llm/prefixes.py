"""Prefix tries of conversations, merged from partial tries.

A node is a distinct sequence of first turns. It is named by 128 bits: the sum, over its turns, of a hash of each turn
and its place, so names of all prefixes of a conversation are running sums. Each partition emits a table of its nodes,
combined locally; tables are merged by name, adding members. Then subtrees are rolled up from the ends to the root: each
node belongs to the smallest conversation that reaches it, so a conversation owns the last stretch of its path; what it
owns is summed along that stretch from its end up, and its total counts for every node above the stretch.

No conversation needs to fit a task: order and sums along one are taken over ranges of sorted rows, and what the
rows before a range add is carried over by a table of one row a range.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm import kernel as K
from tessella.llm.store import BROADCAST_ROWS, discard, scoped, stash

#: Turns that a conversation may take from another one; the number it takes is below PERIOD.
PERIOD, BLOCK = 6, 100
_ONE, _TWO = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _sums(new: np.ndarray, values: np.ndarray, carry: int) -> np.ndarray:
    """Running sums (modulo 2^64) that begin again where `new` is set; the first run goes on from carry."""
    total = np.cumsum(values)
    at = np.flatnonzero(new)
    before = np.full(len(values), np.uint64(-carry % (1 << 64)), np.uint64)
    if len(at):
        before[at[0] :] = np.repeat((total - values)[at], np.diff(np.append(at, len(values))))
    return total - before


def _running(key: str, columns: list[str]):
    """Adds `part` (of the sorted rows) and, for each of the columns, its running sum within key and part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, last, carry = TaskContext.get().partitionId(), None, [0] * len(columns)
        for batch in batches:
            if not len(batch):
                continue
            keys = batch.column(key).to_numpy(zero_copy_only=False)
            new = np.concatenate(([last is None or keys[0] != last], keys[1:] != keys[:-1]))
            sums = [_sums(new, batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), old) for c, old in zip(columns, carry, strict=True)]
            last, carry = keys[-1], [int(s[-1]) for s in sums]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(batch), part, np.int32)), *(pa.array(K.signed(s)) for s in sums)], names=[*batch.schema.names, "part", *(f"sum_{c}" for c in columns)])

    return run


def _carried(key: str, columns: list[str], carry: dict[int, dict[int, list[int]]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, parts = batch.column(key).to_numpy(zero_copy_only=False), batch.column("part").to_numpy(zero_copy_only=False)
            sums = [batch.column(f"sum_{c}").to_numpy(zero_copy_only=False).view(np.uint64).copy() for c in columns]
            for p in np.unique(parts).tolist() if carry else ():
                for k, more in carry.get(p, {}).items():
                    some = (parts == p) & (keys == k)
                    for s, m in zip(sums, more, strict=True):
                        s[some] += np.uint64(m)
            rest = [n for n in batch.schema.names if n != "part" and not n.startswith("sum_")]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in rest), *(pa.array(K.signed(s)) for s in sums)], names=[*rest, *(f"sum_{c}" for c in columns)])

    return run


def running_sums(rows: DataFrame, key: str, order: list[Column], columns: list[str], name: str) -> DataFrame:
    """rows with sum_<column>, modulo 2^64: the sum over the rows of the same key (long) up to each row, in order.

    Rows are sorted in ranges over key and order together, so a key may spread over any number of them. Only the first
    and the last key of a range can have rows in another one: their sums, two rows a range at most, pass the driver.
    """
    order = [F.col(key), *order]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    sums = ", ".join(f"sum_{c} long" for c in columns)
    laid = rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_running(key, columns), f"{kinds}, part int, {sums}")
    laid = stash(laid, name)
    ends = laid.groupBy("part").agg(F.min(key).alias("first"), F.max(key).alias("last")).orderBy("part").collect()
    shared = {a.last for a, b in zip(ends, ends[1:], strict=False) if a.last == b.first}
    carry: dict[int, dict[int, list[int]]] = {}
    if shared:
        wanted = rows.sparkSession.createDataFrame([(k,) for k in sorted(shared)], f"{key} long")
        # A part's own sums of a key: those of its last row, where the count is largest.
        last = laid.join(F.broadcast(wanted), key).groupBy("part", key).agg(*[F.sum(_half(c, high)).alias(f"{c}_{high}") for c in columns for high in (True, False)])
        sofar: dict[int, list[int]] = {}
        for r in last.orderBy("part", key).collect():
            if r[key] in sofar:
                carry.setdefault(r.part, {})[r[key]] = [x % (1 << 64) for x in sofar[r[key]]]
            own = [(r[f"{c}_True"] << 32) + r[f"{c}_False"] for c in columns]
            sofar[r[key]] = [a + b for a, b in zip(sofar.get(r[key], [0] * len(columns)), own, strict=True)]
    return laid.mapInArrow(_carried(key, columns, carry), f"{kinds}, {sums}")


def _half(column: str, high: bool) -> Column:
    """The upper (signed) or lower 32 bits of a long, whose sums do not overflow."""
    return F.shiftright(column, 32) if high else F.col(column).bitwiseAND(F.lit(0xFFFFFFFF))


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Terms of the names: two hashes of a turn (its digest as two longs) and its place; the root adds nothing."""
    for batch in batches:
        of = lambda c: batch.column(c).to_numpy(zero_copy_only=False).view(np.uint64)  # noqa: B023, E731
        depth, a, b = of("depth"), of("a"), of("b")
        one, two = K.mix(K.mix(a + depth * _ONE) ^ b), K.mix(K.mix(b + depth * _TWO) + a)
        top = depth == 0
        one[top] = two[top] = np.uint64(0)
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("depth"), batch.column("chars"), pa.array(K.signed(one)), pa.array(K.signed(two))], names=["conv_id", "depth", "chars", "x", "y"])


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partial trie of each batch: its nodes, with members, the smallest of them, their parent and their last text."""
    for batch in batches:
        nodes = pa.Table.from_batches([batch]).group_by(["x", "y"], use_threads=False).aggregate([("conv_id", "count"), ("conv_id", "min"), ("depth", "min"), ("chars", "min"), ("px", "min"), ("py", "min")])
        nodes = nodes.select(["x", "y", "conv_id_count", "conv_id_min", "depth_min", "chars_min", "px_min", "py_min"]).rename_columns(["x", "y", "n", "owner", "depth", "chars", "px", "py"])
        yield from nodes.combine_chunks().to_batches()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the ids of each node, which come sorted by node and id and are never held."""
    node, sha, some = None, None, False
    done: list[tuple[int, int, str]] = []
    pack = lambda: pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done])], names=["x", "y", "sha"])
    for batch in batches:
        x, y = batch.column("x").to_numpy(), batch.column("y").to_numpy()
        ids = pc.cast(batch.column("conv_id"), pa.string()).to_pylist()
        cuts = np.flatnonzero((x[1:] != x[:-1]) | (y[1:] != y[:-1])) + 1 if len(x) else []
        for lo, hi in zip([0, *cuts], [*cuts, len(x)], strict=True) if len(x) else ():
            at = (int(x[lo]), int(y[lo]))
            if at != node:
                if node is not None:
                    done.append((*node, sha.hexdigest()))
                node, sha, some = at, hashlib.sha256(), False
            sha.update((("," if some else "") + ",".join(ids[lo:hi])).encode())
            some = True
        if len(done) >= 1000:
            yield pack()
            done.clear()
    if node is not None:
        done.append((*node, sha.hexdigest()))
    if done:
        yield pack()


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows (conv_id, depth, a, b, chars) of rebuilt conversations with a row of depth 0 each, (conv_id, n) of these).

    turns: (conv_id, turn, role, text). A conversation c takes the first h turns of conversation c - c % BLOCK, h being
    the CRC-32 of c's digits modulo PERIOD, and then its own turns behind its first h.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    long = lambda at: (F.conv(F.substring(digest, at, 8), 16, 10).cast("long") * 2**31 + F.shiftright(F.conv(F.substring(digest, at + 8, 8), 16, 10).cast("long"), 1)) - 2**62
    rows = turns.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), digest.alias("digest"), long(1).alias("a"), long(17).alias("b"), F.length(text).cast("long").alias("chars"), F.lit(1).cast("long").alias("one"))
    # Equal rows are told apart by where they are read, so that a range never has to take all of them.
    rows = rows.withColumn("at", F.monotonically_increasing_id())
    order = [F.asc_nulls_first("turn"), F.col("role"), F.col("digest"), F.col("at")]
    ranked = running_sums(rows, "conv_id", order, ["one"], "turns").select("conv_id", (F.col("sum_one") - 1).alias("place"), "a", "b", "chars")
    ranked = stash(ranked, "ranked")
    heads = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(PERIOD)).cast("long")
    sizes = ranked.groupBy("conv_id").agg(F.count("*").alias("n"))
    first = F.col("conv_id") - F.col("conv_id") % BLOCK
    bases = sizes.filter(F.col("conv_id") % BLOCK == 0).select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    convs = sizes.select("conv_id", "n", heads.alias("h"), first.alias("base")).join(bases, "base", "left")
    convs = stash(convs.withColumn("taken", F.least("h", F.coalesce("n_base", F.lit(0).cast("long")))).drop("n_base"), "conversations")
    few = convs.count() <= BROADCAST_ROWS
    side = lambda df: F.broadcast(df) if few else df
    top = convs.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), F.lit(0).cast("long").alias("chars"))
    templates = ranked.filter((F.col("conv_id") % BLOCK == 0) & (F.col("place") < PERIOD - 1)).withColumnRenamed("conv_id", "base")  # few rows a template
    head = convs.filter("taken > 0").select("conv_id", "base", "h").join(templates, "base").filter("place < h").select("conv_id", (F.col("place") + 1).alias("depth"), "a", "b", "chars")
    tail = ranked.join(side(convs.select("conv_id", "h", "taken")), "conv_id").filter("place >= h").select("conv_id", (F.col("taken") + F.col("place") - F.col("h") + 1).alias("depth"), "a", "b", "chars")
    count = F.col("taken") + F.greatest(F.lit(0).cast("long"), F.col("n") - F.col("h"))
    return top.unionAll(head).unionAll(tail), convs.select("conv_id", count.alias("n"))


@scoped("trie")
def prefix_trie(turns: DataFrame) -> DataFrame:
    """One row per node: (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256).

    turns: (conv_id, turn, role, text), ordered by turn, null first; turns of the same number are ordered by role and
    then by the MD5 of role and text. A null role or text counts as empty. Rows without a conv_id take no part. A
    conversation that ends up without turns is a member of the root, which is there whenever there is a conversation;
    an empty table gives no rows. Repeated rows are turns of their own. Other columns are not read.

    conv_id is the smallest member of a node, depth its number of turns, parent_conv_id its parent's conv_id (null for the
    root), n_convs its members, n_children its children, n_leaves the childless nodes of its subtree, saved_tokens the sum
    over its subtree of (members - 1) times the code points of the node's last text, ends_sha256 the hash of the ids of
    members that end in it, ascending, joined by commas. A node's ids stream through one task, sorted on disk.
    """
    rows, convs = rebuilt(turns)
    terms = rows.select("conv_id", "depth", "a", "b", "chars").mapInArrow(_named, "conv_id long, depth long, chars long, x long, y long")
    summed = running_sums(terms, "conv_id", [F.col("depth")], ["x", "y"], "paths")
    # The name before a row's own term is that of its parent.
    path = stash(summed.mapInArrow(_parents, "conv_id long, depth long, chars long, x long, y long, px long, py long"), "named")

    partial = path.select("conv_id", "depth", "chars", "x", "y", "px", "py").mapInArrow(_partial, "x long, y long, n long, owner long, depth long, chars long, px long, py long")
    # Merged twice: first what a few tasks hold of a node, then what is left of it.
    some = [F.min(c).alias(c) for c in ("owner", "depth", "chars", "px", "py")]
    merged = partial.withColumn("lane", F.pmod(F.spark_partition_id(), F.lit(16))).groupBy("x", "y", "lane").agg(F.sum("n").alias("n"), *some)
    nodes = merged.groupBy("x", "y").agg(F.sum("n").alias("n"), *some)
    nodes = stash(nodes, "nodes")
    children = nodes.filter("depth > 0").groupBy(F.col("px").alias("x"), F.col("py").alias("y")).agg(F.count("*").alias("n_children"))
    counted = nodes.join(children, ["x", "y"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    worth = (F.col("n") - 1) * F.col("chars")
    leaf = (F.col("n_children") == 0).cast("long")
    tree = stash(counted.withColumns({"worth": worth, "leaf": leaf, "up": -F.col("depth")}), "tree")
    discard(nodes)

    # From the end of each owner's stretch up to where it begins; its top row holds the total.
    own = running_sums(tree.select("owner", "up", "x", "y", "worth", "leaf"), "owner", [F.col("up")], ["worth", "leaf"], "stretches")
    own = stash(own.select("owner", "up", "x", "y", "sum_worth", "sum_leaf"), "owned")
    totals = own.groupBy("owner").agg(F.max("up").alias("up"), F.max_by("sum_worth", "up").alias("more_worth"), F.max_by("sum_leaf", "up").alias("more_leaf"))
    totals = totals.select(F.col("owner").alias("conv_id"), (-F.col("up")).alias("begins"), "more_worth", "more_leaf")
    above = path.select("conv_id", "depth", "x", "y").join(totals, "conv_id").filter("depth < begins")
    above = above.groupBy("x", "y").agg(F.sum("more_worth").alias("more_worth"), F.sum("more_leaf").alias("more_leaf"))

    ends = path.select("conv_id", "depth", "x", "y").join(convs.withColumnRenamed("n", "end"), "conv_id").filter("depth = end")
    ends = ends.select("x", "y", "conv_id").repartition("x", "y").sortWithinPartitions("x", "y", "conv_id").mapInArrow(_digests, "x long, y long, sha string")

    both = tree.join(own.select("x", "y", "sum_worth", "sum_leaf"), ["x", "y"]).join(above, ["x", "y"], "left").join(ends, ["x", "y"], "left")
    parents = tree.select(F.col("x").alias("px"), F.col("y").alias("py"), F.col("owner").alias("parent_owner"))
    both = both.join(parents, ["px", "py"], "left")
    zero = F.lit(0).cast("long")
    return both.select(
        F.col("owner").alias("conv_id"), "depth", F.when(F.col("depth") > 0, F.col("parent_owner")).alias("parent_conv_id"), F.col("n").alias("n_convs"), "n_children",
        (F.col("sum_leaf") + F.coalesce("more_leaf", zero)).alias("n_leaves"), (F.col("sum_worth") + F.coalesce("more_worth", zero)).alias("saved_tokens"),
        F.coalesce("sha", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )


def _parents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        of = lambda c: batch.column(c).to_numpy(zero_copy_only=False).view(np.uint64)  # noqa: B023, E731
        x, y, one, two = of("sum_x"), of("sum_y"), of("x"), of("y")
        keep = [batch.column(c) for c in ("conv_id", "depth", "chars")]
        yield pa.RecordBatch.from_arrays([*keep, *(pa.array(K.signed(v)) for v in (x, y, x - one, y - two))], names=["conv_id", "depth", "chars", "x", "y", "px", "py"])

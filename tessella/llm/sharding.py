"""Balanced sharding by label propagation. DataFrame expressions only.

Rows that belong together (equal texts) form groups. Every row starts in a shard by hash; in each round groups elect
the shards where most of their rows are (as many shards as the group fills), and rows move there under quotas: a shard
admits the share of its applicants that its capacity beside other linked rows allows, drawn by hash. Rounds go on while
the number of rows that want to move falls. A last pass makes counts exact: rows beyond a shard's quota, rows without links first, go to the shards that still lack some.

Groups enter as (group, shard) counts, aggregated before any shuffle, so a group with a third of all rows costs one
row a shard. Ranks come from counts of small cells, never from one task that sorts a shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.store import BROADCAST_ROWS, discard, scoped, stash

CELL_ROWS = 20_000
#: Rounds of propagation at most; each writes the rows with links that are not settled. Results keep the law whenever they end.
MOST_ROUNDS = 40


def _unit(*of) -> Column:
    """A number in [0, 1) that follows from the given columns alone."""
    return F.shiftrightunsigned(F.xxhash64(*of), 11).cast("double") / float(1 << 53)


def _pick(values: list, at: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), at.cast("int") + 1)


def _loads(state: DataFrame, shards: int) -> list[int]:
    """Rows of each shard: as many numbers as there are shards."""
    got = {r.shard: r["count"] for r in state.groupBy("shard").count().collect()}
    return [got.get(s, 0) for s in range(shards)]


def _propagate(state: DataFrame, shards: int, cap: int, turn: int, base: list[int], few: bool) -> tuple[DataFrame, int]:
    """One round over rows with links, and how many of them wanted to move; base is what rows of higher rank fill of each shard."""
    load = [a + b for a, b in zip(base, _loads(state, shards), strict=True)]
    votes = state.groupBy("g", "shard").agg(F.count("*").alias("n"))
    ranked = votes.groupBy("g").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), F.xxhash64("g", "shard").alias("tie"), "shard"))).alias("by"))  # one entry a shard at most; ties fall evenly
    elected = ranked.select(F.col("g").alias("g_"), F.transform("by", lambda x: x["shard"]).alias("by"), (-F.get("by", F.lit(0))["n"]).alias("top"))
    wanted = F.greatest(F.ceil(F.col("rows") / cap), F.lit(1)).cast("int")
    asked = state.join(F.broadcast(elected) if few else elected, F.col("g") == F.col("g_")).withColumn("to", F.slice("by", 1, wanted)).drop("by")
    moves = ~F.array_contains("to", F.col("shard"))
    target = F.element_at("to", (F.pmod(F.xxhash64("place", F.lit(turn)), F.size("to")) + 1).cast("int"))
    full, open_ = [s for s in range(shards) if base[s] >= cap], [s for s in range(shards) if load[s] < cap]
    crowded = [s for s in range(shards) if load[s] >= cap]
    if crowded and open_:  # a group whose shard belongs to large ones, or has no room for all of it, moves as a whole
        torn = F.element_at("to", 1).isin(crowded) & (F.col("top") < F.col("rows"))
        lost = (F.size("to") == 1) & (F.element_at("to", 1).isin(full) | torn) if full else (F.size("to") == 1) & torn
        target = F.when(lost, _pick(open_, F.pmod(F.xxhash64("g", F.lit(turn)), F.lit(len(open_))))).otherwise(target)
        moves = moves | lost
    target = F.when(moves & (target != F.col("shard")), target)
    draw = F.when(F.size("to") == 1, _unit("g", F.lit(turn + 100))).otherwise(_unit("place", F.lit(turn + 100)))  # small groups go together
    asked = stash(asked.withColumns({"target": target, "draw": draw}).drop("g_", "to", "top"), "asked")
    flow = {r.target: r["count"] for r in asked.filter("target is not null").groupBy("target").count().collect()}
    leave = {r.shard: r["count"] for r in asked.filter("target is not null").groupBy("shard").count().collect()}
    admit = [min(1.0, max(0, cap - load[s] + leave.get(s, 0)) / flow[s]) if flow.get(s) else 0.0 for s in range(shards)]
    goes = F.col("target").isNotNull() & (F.col("draw") < _pick(admit, F.coalesce("target", F.lit(0))))
    return asked.withColumn("shard", F.when(goes, F.col("target")).otherwise(F.col("shard"))).drop("target", "draw"), sum(leave.values())


def _ranked(state: DataFrame, total: int, shards: int) -> DataFrame:
    """rank: gapless from 0 within each shard; large groups first, then small ones, each together, then rows without links."""
    cells = max(1, total // shards // CELL_ROWS)
    linked, large = F.col("rows").isNotNull(), F.col("rows") * 2 * shards > total
    spread = F.pmod(F.xxhash64("place", F.lit(7)), F.greatest(F.ceil(F.col("rows") / CELL_ROWS), F.lit(1)))
    by_group = F.pmod(F.xxhash64("g"), F.lit(cells))
    cell = F.when(large, by_group).when(linked, cells + by_group).otherwise(2 * cells + F.pmod(F.xxhash64("place"), F.lit(cells)))
    laid = state.select("place", "g", "shard", "doc_id", "size", "text_crc32", "text_hash", cell.alias("cell"), F.when(linked, spread).otherwise(F.lit(0)).alias("part"))
    laid = stash(laid, "laid")
    count = laid.groupBy("shard", "cell", "part").agg(F.count("*").alias("n"))
    before = count.withColumn("before", F.sum("n").over(Window.partitionBy("shard").orderBy("cell", "part")) - F.col("n")).drop("n")
    own = F.row_number().over(Window.partitionBy("shard", "cell", "part").orderBy("g", "place", "doc_id")) - 1
    return laid.withColumn("own", own).join(before, ["shard", "cell", "part"]).withColumn("rank", F.col("own") + F.col("before")).drop("own", "before", "cell", "part")


@scoped("shards")
def shard_documents(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", overhead: int = 16) -> DataFrame:
    """One row per row of docs: (doc_id, size, text_crc32, law, shard, slot, grown_shard, group, text_hash).

    Law `rows`: counts of any two shards differ by one at most. size is the UTF-8 length of the text plus overhead,
    text_crc32 its unsigned CRC-32, slot runs gapless from 0 in every shard, grown_shard is null under this law. Rows of
    a group (equal texts) share a shard where it has room; a group larger than a shard fills several.

    Null texts count as empty, and are one group with empty ones; null ids and repeated rows are rows like any other
    (which of equal rows gets which slot is arbitrary). Only the two named columns are read. No rows, no shards.
    """
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    state = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + overhead).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text, F.crc32(text)).alias("g"), F.xxhash64(F.col(text_col)).alias("text_hash"))
    state = state.withColumn("place", F.xxhash64("doc_id", "g")).withColumn("shard", F.pmod("place", F.lit(shards)).cast("int"))
    state = stash(state, "state")
    total = state.count()
    size = state.groupBy("g").agg(F.count("*").alias("rows")).filter("rows > 1").withColumnRenamed("g", "g_")
    size = stash(size, "groups")
    few = size.count() <= BROADCAST_ROWS // 10  # an elected group lists a shard or some
    state = stash(state.join(F.broadcast(size) if few else size, F.col("g") == F.col("g_"), "left").drop("g_"), "state")
    cap = -(-total // shards)
    base = [0] * shards
    settled = [state.filter("rows is null")]
    # Groups of half a shard and more settle first and see only each other; small ones settle around them.
    turn = 0
    for part in (state.filter(F.col("rows") * 2 > cap), state.filter(F.col("rows") * 2 <= cap)):
        before = part.count() + 1
        while before > 1 and turn < MOST_ROUNDS:
            moved, wanted = _propagate(part, shards, cap, turn, base, few)
            turn += 1
            if not 0 < wanted < before:  # settled: none wants to move, or no fewer than before
                break
            new = stash(moved, "linked")
            discard(part)
            part, before = new, wanted
        base = [a + b for a, b in zip(base, _loads(part, shards), strict=True)]
        settled.append(part)
    state = settled[0].unionByName(settled[1]).unionByName(settled[2])
    load = _loads(state, shards)
    quota = [(s + 1) * total // shards - s * total // shards for s in range(shards)]
    shed, lack, at, to = [], [], 0, 0
    for s in range(shards):
        shed.append(at - quota[s] if load[s] > quota[s] else 0)
        at += max(0, load[s] - quota[s])
        if quota[s] > load[s]:
            lack.append((to, s, load[s]))
            to += quota[s] - load[s]
    lack = lack or [(0, 0, load[0] if load else 0)]
    ranked = _ranked(state, total, shards)
    over = F.col("rank") >= _pick(quota, F.col("shard"))
    index = F.col("rank") + _pick(shed, F.col("shard"))  # running number of the shed row
    hole = F.size(F.filter(F.array(*[F.lit(x[0]) for x in lack]), lambda x: x <= F.col("index"))) - 1
    out = ranked.withColumn("index", F.when(over, index)).withColumn("hole", F.when(over, hole))
    slot = F.when(over, F.col("index") - _pick([x[0] for x in lack], F.col("hole")) + _pick([x[2] for x in lack], F.col("hole"))).otherwise(F.col("rank"))
    shard = F.when(over, _pick([x[1] for x in lack], F.col("hole"))).otherwise(F.col("shard"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), shard.cast("int").alias("shard"), slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.col("g").alias("group"), "text_hash")

"""Mixing sources to target weights by entropy balancing. DataFrame expressions only.

Of all document rates between 0 and `cap` whose expected tokens meet the target of every source, entropy balancing
takes the one closest (in Kullback-Leibler divergence, a document at a time) to the corpus as it is. Its dual is convex
with one multiplier per source, and a document's rate is the exponential of the multiplier times its own tokens, cut at
`cap`: where a source must shrink its longest documents go first, where it must grow they are repeated first, and as
many documents as possible stay as they are.

Documents of a source that are equally long have the same rate, so (source, size) with the number of documents is all
that the dual needs: the corpus is aggregated once, and each Newton step is a distributed sum of gradient and Hessian
over that table, for all sources at once. Sums are decimals, so that reruns agree to the last digit. Rates become whole
copies by systematic rounding along the sizes; then exchanges of a few documents close what a source still lacks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from tessella.llm.store import BROADCAST_ROWS, discard, scoped, stash

#: Newton stops when every source's expected tokens are so near its target (relative), or after so many steps: each
#: halves the bracket of the multiplier at least.
TOLERANCE, MOST_STEPS = 1e-8, 100
#: Sources up to which the multipliers (a row each) stay in the plan as literals and one small job makes a step; with more
#: of them a step is a job that writes their table. Both take the same steps.
FEW_SOURCES = 500
#: Documents of one source and size are laid out along [0, 1) by hash, in cells of about so many rows.
CELL_ROWS = 500
#: Exchanges look at one size per 1/PER_OCTAVE of an octave; three documents at a time up to FEW sizes, else two.
PER_OCTAVE, FEW, EXCHANGES = 3, 14, 2
_EXACT = "decimal(38,12)"


def n_words(text: Column) -> Column:
    """Number of runs of characters other than ASCII blanks; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, cycle: int = 3, cap: int = 3) -> DataFrame:
    """(source, source_size, weight, target) of sizes (source, size).

    Sources in code-point order, null last, weigh 1 to cycle, again and again. Targets share the total by weight, stop
    at cap times the source's size, and the excess is shared again by weight until no target is above.
    """
    # One row a source: the only global orders here are over the table of sources.
    table = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source"))) - 1
    table = stash(table.select("source", "source_size", (F.pmod(place, F.lit(cycle)) + 1).cast("long").alias("weight")), "sources")
    # Sources stop in order of limit / weight. The level of the rest is that of the first source which it does not stop.
    limit = F.col("source_size") * cap
    order = Window.orderBy(limit / F.col("weight"), F.col("source").isNull(), "source")
    every = Window.partitionBy()
    rest = order.rowsBetween(0, Window.unboundedFollowing)
    level = (F.sum("source_size").over(every) - F.sum(limit).over(every) + F.sum(limit).over(rest)) / F.sum("weight").over(rest)
    ranked = table.select((limit / F.col("weight")).alias("stop"), level.alias("level"))
    level = ranked.filter("level <= stop").agg(F.min_by("level", "stop")).first()[0] or 0.0
    return table.withColumn("target", F.least(limit.cast("double"), F.col("weight") * level))


def _tilted(multiplier: Column, x: Column, cap: int) -> Column:
    """exp(multiplier * x), cut at cap."""
    return F.least(F.exp(F.least(multiplier * x, F.lit(math.log(cap)))), F.lit(float(cap)))


def _matched(left: DataFrame, right: DataFrame, *on: str, few: bool, how: str = "inner") -> DataFrame:
    """Join by columns where null matches null; the right side is broadcast if it has few rows."""
    r = right.withColumnsRenamed({c: f"_{c}" for c in on})
    test = F.lit(True)
    for c in on:
        test = test & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return left.join(F.broadcast(r) if few else r, test, how).drop(*[f"_{c}" for c in on])


def solve_dual(sizes: DataFrame, sources: DataFrame, cap: int = 3, few: bool = False) -> DataFrame:
    """(source, multiplier, mean) where Newton steps on the dual end, from sizes (source, size, n) with size > 0.

    The multiplier counts in units of the source's mean size. Sources whose target is all they may give (cap times
    their size) have no finite multiplier and are left out, as are sources without words. few: there are so few sources
    that their table may be broadcast.
    """
    mean = sizes.groupBy("source").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"))
    now = sources.filter(F.col("target") < F.col("source_size") * cap * (1 - 1e-12)).select("source", "source_size", "target")
    now = _matched(now, mean, "source", few=few)
    # At `low` a document of one word has a rate of exp(-60), at `high` all have the cap.
    # The first guess is right where all documents are equally long.
    guess = F.least(F.log(F.col("target") / F.col("source_size")), F.lit(math.log(cap)))
    if few and sources.limit(FEW_SOURCES + 1).count() <= FEW_SOURCES:
        return _solved_in_plan(sizes, now.withColumn("multiplier", guess), cap)
    now = stash(now.withColumns({"multiplier": guess, "low": -60.0 * F.col("mean"), "high": math.log(cap) * F.col("mean")}), "dual")
    x = F.col("size") / F.col("mean")
    for _ in range(MOST_STEPS):
        rate = _tilted(F.col("multiplier"), x, cap)
        tokens = F.col("size") * F.col("n") * rate
        sums = _matched(sizes, now, "source", few=few).groupBy("source").agg(
            F.sum(tokens.cast(_EXACT)).cast("double").alias("got"),
            F.sum(F.when(rate < cap, tokens * x).otherwise(0.0).cast(_EXACT)).cast("double").alias("slope"),
        )
        off = F.col("got") - F.col("target")
        low, high = F.when(off < 0, F.col("multiplier")).otherwise(F.col("low")), F.when(off > 0, F.col("multiplier")).otherwise(F.col("high"))
        step = F.when(F.col("slope") > 0, F.col("multiplier") - off / F.col("slope"))
        inside = step.between(F.col("low"), F.col("high"))
        new = _matched(now, sums, "source", few=few).withColumns({"low": low, "high": high})
        new = new.withColumn("miss", F.abs(off) / F.col("source_size"))
        multiplier = F.when(F.col("miss") <= TOLERANCE, F.col("multiplier")).when(inside, step).otherwise((F.col("low") + F.col("high")) / 2)
        seen = Observation()
        new = stash(new.withColumn("multiplier", multiplier).drop("got", "slope").observe(seen, F.max("miss").alias("most")), "dual")
        discard(now)
        miss = seen.get["most"]
        now = new.drop("miss")
        now._stash_path = new._stash_path
        if miss is None or miss <= TOLERANCE:
            break
    return now.select("source", "multiplier", "mean")


def _solved_in_plan(sizes: DataFrame, start: DataFrame, cap: int) -> DataFrame:
    """solve_dual for few sources: each step sends their multipliers out as literals and brings two sums a source back."""
    kind = start.schema["source"].dataType
    rows = {r.source: dict(r.asDict(), low=-60.0 * r.mean, high=math.log(cap) * r.mean) for r in start.collect()}  # FEW_SOURCES at most

    def table() -> DataFrame:
        each = [F.struct(F.lit(s).cast(kind).alias("source"), F.lit(r["multiplier"]).alias("multiplier"), F.lit(r["mean"]).alias("mean")) for s, r in rows.items()]
        none = F.array().cast(f"array<struct<source:{kind.simpleString()},multiplier:double,mean:double>>")
        return sizes.sparkSession.range(1, numPartitions=1).select(F.inline(F.array(*each) if each else none))

    x = F.col("size") / F.col("mean")
    rate = _tilted(F.col("multiplier"), x, cap)
    tokens = F.col("size") * F.col("n") * rate
    for _ in range(MOST_STEPS if rows else 0):
        sums = _matched(sizes, table(), "source", few=True).groupBy("source").agg(
            F.sum(tokens.cast(_EXACT)).cast("double").alias("got"),
            F.sum(F.when(rate < cap, tokens * x).otherwise(0.0).cast(_EXACT)).cast("double").alias("slope"),
        )
        most = 0.0
        for got in sums.collect():
            r = rows[got.source]
            off = got.got - r["target"]
            r["low"], r["high"] = r["multiplier"] if off < 0 else r["low"], r["multiplier"] if off > 0 else r["high"]
            miss = abs(off) / r["source_size"]
            most = max(most, miss)
            if miss > TOLERANCE:
                step = r["multiplier"] - off / got.slope if got.slope > 0 else math.nan
                r["multiplier"] = step if r["low"] <= step <= r["high"] else (r["low"] + r["high"]) / 2
        if most <= TOLERANCE:
            break
    return table()


def _rounded(plan: DataFrame) -> DataFrame:
    """plan with `copies`, those that all documents of a source and size get together: systematic along the sizes.

    Sizes rise along the order, so a source misses its tokens by less than its longest document.
    """
    share = F.col("rate") * F.col("n")
    until = F.sum(share).over(Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, 0))
    plan = plan.withColumn("until", F.floor(until + 0.5))
    before = F.lag("until", 1, 0).over(Window.partitionBy("source").orderBy("size"))
    return plan.withColumn("copies", (F.col("until") - before).cast("long")).drop("until")


def _exchanged(plan: DataFrame, cap: int, few: bool) -> DataFrame:
    """plan after the best exchange in each source: two (of few sizes three) documents get a copy more or less."""
    octave = F.floor(F.log2("size") * PER_OCTAVE)
    more, less = (F.col("copies") < F.col("n") * cap).cast("long"), (F.col("copies") > 0).cast("long")
    lacks = plan.groupBy("source").agg((F.first("target") - F.sum(F.col("copies") * F.col("size"))).alias("lacks"), F.count("*").alias("sizes"))
    # Every size of a source of few sizes; of others one size an octave's part, so that the list is bounded.
    each = plan.withColumns({"more": more, "less": less, "octave": octave})
    each = _matched(each, lacks, "source", few=few)
    part = F.when(F.col("sizes") <= FEW, F.col("size")).otherwise(F.col("octave"))
    some = each.groupBy("source", "lacks", part.alias("part")).agg(F.min(F.struct("size", "more", "less")).alias("at"))
    steps = F.flatten(F.transform("ats", lambda a: F.filter(F.array(F.when(a["more"] > 0, a["size"]), F.when(a["less"] > 0, -a["size"])), lambda v: v.isNotNull())))
    some = some.groupBy("source", "lacks").agg(F.array_sort(F.collect_list("at")).alias("ats")).withColumn("few", F.size("ats") <= FEW)
    some = some.withColumn("steps", F.concat(F.array(F.lit(0).cast("long")), steps))
    miss = lambda *s: F.struct(F.abs(F.col("lacks") - sum(s[1:], s[0])).alias("miss"), sum((F.abs(F.signum(x)) for x in s[1:]), F.abs(F.signum(s[0]))).alias("moves"), F.array(*s).alias("steps"))
    best = lambda outer, inner: F.array_min(F.transform(outer, inner))
    two = best(F.col("steps"), lambda a: best(F.filter("steps", lambda b: (b != a) & (b != -a) | (b == 0)), lambda b: miss(a, b, F.lit(0).cast("long"))))
    three = best(F.col("steps"), lambda a: best(F.filter("steps", lambda b: (b != a) & (b != -a) | (b == 0)), lambda b: best(F.filter("steps", lambda c: (c != a) & (c != -a) & (c != b) & (c != -b) | (c == 0)), lambda c: miss(a, b, c))))
    moves = some.withColumn("best", F.when(F.col("few"), three).otherwise(two)).select("source", F.explode("best.steps").alias("step")).filter("step <> 0")
    moves = moves.select("source", F.abs("step").alias("size"), F.signum("step").cast("long").alias("change"))  # three a source at most
    return _matched(plan, moves, "source", "size", few=few, how="left").withColumn("copies", F.col("copies") + F.coalesce("change", F.lit(0))).drop("change")


@scoped("mix")
def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cycle: int = 3, cap: int = 3) -> DataFrame:
    """One row per row of docs: (doc_id, text_hash, size, source, source_size, target, rate, copies, taken).

    rate is the tilted rate of the document, copies its rounding (at most cap), taken is copies * size. Which of equally
    long documents of a source take one copy more follows from hashes of id and text alone, so reruns agree; rows equal
    in both are told apart by a running number.

    Null texts have size 0 and take none; null sources are a source of their own, ordered last; null ids are hashed by
    their text. Only the named columns are read. An empty table gives no rows; a corpus without words takes nothing.
    """
    text = F.col(text_col)
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(text).alias("size"), F.xxhash64(text).alias("text_hash"))
    base = stash(base, "sizes")
    sizes = stash(base.groupBy("source", "size").agg(F.count("*").alias("n")), "by-size")
    sources = source_targets(sizes.select("source", (F.col("size") * F.col("n")).alias("size")), cycle, cap)
    few = sources.count() <= BROADCAST_ROWS // 10
    some = sizes.filter("size > 0")
    dual = solve_dual(some, sources, cap, few)

    plan = _matched(_matched(some, sources.drop("weight"), "source", few=few), dual, "source", few=few, how="left")
    rate = F.coalesce(_tilted(F.col("multiplier"), F.col("size") / F.col("mean"), cap), F.lit(float(cap)))
    plan = stash(_rounded(plan.withColumn("rate", rate).drop("multiplier", "mean")), "plan")
    for _ in range(EXCHANGES):
        new = stash(_exchanged(plan, cap, few), "plan")
        discard(plan)
        plan = new
    whole = F.floor(F.col("copies") / F.col("n")).cast("long")
    told = plan.withColumns({"whole": whole, "extra": F.col("copies") - whole * F.col("n")}).select("source", "size", "n", "rate", "whole", "extra")

    rows = _matched(base, told, "source", "size", few=told.count() <= BROADCAST_ROWS // 10, how="left")
    rows = _matched(rows, sources.select("source", "source_size", "target"), "source", few=few)
    key = F.xxhash64("doc_id", "text_hash", F.lit(17))
    unit = F.shiftrightunsigned(key, 11).cast("double") / float(1 << 53)
    cells = F.greatest(F.ceil(F.col("n") / CELL_ROWS), F.lit(1)).cast("long")
    rows = stash(rows.withColumn("key", key).withColumn("cell", F.least(F.floor(unit * cells), cells - 1)), "laid")
    open_ = rows.filter("extra > 0")
    filled = open_.groupBy("source", "size", "cell").agg(F.count("*").alias("in_cell"))
    filled = stash(filled.withColumn("before", F.sum("in_cell").over(Window.partitionBy("source", "size").orderBy("cell")) - F.col("in_cell")), "cells")
    open_ = _matched(open_, filled, "source", "size", "cell", few=filled.count() <= BROADCAST_ROWS // 10)
    # Cells before the one where the extra copies end take one each, cells behind it none; in it rows are ordered.
    left = F.col("extra") - F.col("before")
    cut = (left > 0) & (left < F.col("in_cell"))
    nth = F.row_number().over(Window.partitionBy("source", "size").orderBy("key")) - 1
    open_ = open_.filter(~cut).withColumn("more", (left > 0).cast("long")).unionByName(open_.filter(cut).withColumn("more", (nth < left).cast("long"))).drop("before", "in_cell")
    out = open_.unionByName(rows.filter("extra is null or extra = 0").withColumn("more", F.lit(0).cast("long")))
    out = out.withColumn("copies", F.coalesce(F.col("whole") + F.col("more"), F.lit(0).cast("long"))).withColumn("rate", F.coalesce("rate", F.lit(1.0)))
    return out.select("doc_id", "text_hash", "size", "source", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))

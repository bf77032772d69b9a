"""Streams: file changes settled by session windows and folded into keyed state, event windows and de-duplication."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.operators.incremental import latest
from tessella.sources.versions import Lease, Table, vacuum

c = F.col

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Microseconds from year 1 to 1970.
_SHIFT = 62_135_596_800_000_000
#: Batches after which versions that nobody reads any more are deleted.
VACUUM_EVERY = 50


def fold_changes(state: DataFrame | None, changes: DataFrame) -> DataFrame:
    """State (file, hash, status, at) after a batch of changes (file, hash, action, at).

    Of several changes of a file the last one by its time counts, whatever batch it comes in: one that is older than what
    the state holds changes nothing. `unlink` makes a file REMOVED (kept, so that older changes do not bring it back),
    another hash makes it PENDING, the same hash leaves it as it is.
    """
    last = latest(changes, ["file"], F.struct("at", "action"))
    removed = c("action") == "unlink"
    if state is None:
        return last.select("file", F.when(~removed, c("hash")).alias("hash"), F.when(removed, "REMOVED").otherwise("PENDING").alias("status"), "at")
    s = state.select("file", c("hash").alias("old_hash"), c("status").alias("old_status"), c("at").alias("old_at"))
    both = s.join(last, "file", "full_outer")
    late = c("action").isNull() | (c("at") < c("old_at"))
    same = ~removed & c("hash").eqNullSafe(c("old_hash")) & (c("old_status") != "REMOVED")
    hash_ = F.when(late, c("old_hash")).when(~removed, c("hash"))
    status = F.when(late | F.coalesce(same, F.lit(False)), c("old_status")).when(removed, "REMOVED").otherwise("PENDING")
    return both.select("file", hash_.alias("hash"), status.alias("status"), F.when(late, c("old_at")).otherwise(c("at")).alias("at"))


def present(state: DataFrame) -> DataFrame:
    """Files that are there."""
    return state.filter("status <> 'REMOVED'")


def read_state(spark: SparkSession, root: str) -> DataFrame | None:
    """The whole state; None if there is none."""
    return Table(spark, root, "file").read()


def advance(state: DataFrame, done: DataFrame) -> DataFrame:
    """PENDING files whose work (file, error) is through become DONE or ERROR."""
    d = done.select("file", "error", F.lit(True).alias("through"))
    status = F.when(c("through") & c("error").isNull(), "DONE").when(c("through"), "ERROR").otherwise(c("status"))
    return state.join(d, "file", "left").withColumn("status", status).drop("through", "error")


def settled(changes: DataFrame, quiet: float, lateness: str = "10 minutes") -> DataFrame:
    """Of a stream of changes (file, hash, action, at) those that no other change of the file followed within `quiet` seconds.

    They are the last ones of session windows, to which a change at the very end of the quiet time still belongs. A change
    is passed on once the watermark (the newest time less the lateness) is past its quiet time, however the stream is cut
    into batches and ordered within the lateness; of changes at the same time the one of the largest hash counts. What was
    passed on is not passed on again: by then its repetition is behind the watermark. The state is a row per session that
    is not yet passed on, kept on disk; `settled_in_state` tells which of them settled by what a drained stream has seen.
    """
    spark = changes.sparkSession
    if spark.conf.get(_PROVIDER, "") != _ROCKS:
        spark.conf.set(_PROVIDER, _ROCKS)
    # The watermark begins at 1970, so that older changes would be late: time is shifted by _SHIFT.
    time = F.timestamp_micros(F.unix_micros("at") + _SHIFT)
    session = F.session_window("time", f"{round(quiet * 1_000_000)} microseconds")
    last = F.max(F.struct("at", "hash", "action"))
    held = changes.select("file", "hash", "action", "at", time.alias("time")).withWatermark("time", lateness).groupBy("file", session)
    return held.agg(last.alias("last")).select("file", "last.hash", "last.action", "last.at")


def settled_in_state(spark: SparkSession, checkpoint: str, quiet: float, lateness: str = "10 minutes") -> DataFrame:
    """Changes that `settled` still holds, below the checkpoint of a drained stream, though their quiet time is over.

    Another session of the file began after them, which only counts once nothing can come between; or the newest time, of
    which the watermark lacks the microseconds, is past their quiet time and the lateness.
    """
    held = spark.read.format("statestore").load(checkpoint).select("value.file", "value.max.*")
    newest = held.agg(F.max("at").alias("newest"))
    after = F.max("at").over(Window.partitionBy("file")) > c("at")
    over = F.unix_micros("at") + round(quiet * 1_000_000) <= F.unix_micros(c("newest") - F.expr(f"INTERVAL {lateness}"))
    return held.withColumn("after", after).join(F.broadcast(newest)).filter(c("after") | over).select("file", "hash", "action", "at")


def watch(changes: DataFrame, root: str, checkpoint: str, after: Callable[[DataFrame, int], None] | None = None, available_now: bool = True, lease: Lease | None = None):
    """Start a query that folds a stream of changes into the state below root, one micro-batch at a time.

    The state is a table of versions: a batch reads the rows of the files that it touches and writes their new rows, and
    every now and then the table is compacted and old versions go. A batch that is run again after a failure folds the
    same changes again, which gives the same state. With a lease, a query whose lease was taken over stops.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        table = Table(spark, root, "file")
        state = table.read()
        mine = batch.persist()
        try:
            known = None if state is None else state.join(F.broadcast(mine.select("file").distinct()) if mine.count() <= 1_000_000 else mine.select("file").distinct(), "file", "left_semi")
            table.write(fold_changes(known, mine), lease=lease)
        finally:
            mine.unpersist()
        table.compact(lease=lease)
        if number % VACUUM_EVERY == VACUUM_EVERY - 1:
            vacuum(spark, root)
        if after is not None:
            after(table.read(), number)

    q = changes.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (q.trigger(availableNow=True) if available_now else q).start()


def file_stream(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """Changes (file, hash, action, at) of files that appear in a folder."""
    raw = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", glob).load(folder)
    return raw.select(c("path").alias("file"), F.sha2("content", 256).alias("hash"), F.lit("change").alias("action"), c("modificationTime").alias("at"))


def once(events: DataFrame, key: str, time: str, lateness: str = "10 minutes") -> DataFrame:
    """The first row per key within the lateness; state is bounded by the watermark."""
    return events.withWatermark(time, lateness).dropDuplicatesWithinWatermark([key])


def windowed(events: DataFrame, time: str, dims: list[str], value: str, width: str = "10 minutes", lateness: str = "10 minutes") -> DataFrame:
    """(start, dims..., n, total) per tumbling window; rows later than the watermark are dropped by Spark and counted there."""
    w = F.window(time, width)
    return events.withWatermark(time, lateness).groupBy(w.alias("w"), *dims).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(c("w.start").alias("start"), *dims, "n", "total")

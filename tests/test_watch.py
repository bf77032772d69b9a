"""Changes that settle, whatever batches they come in, and a state of versions."""

from __future__ import annotations

import datetime

import pytest

from tessella.sources import versions
from tessella.sources.versions import Conflict, Log, Table
from tessella.streaming import watch as W

SCHEMA = "file string, hash string, action string, at timestamp"
T0 = datetime.datetime(2025, 1, 1)


def at(seconds):
    return T0 + datetime.timedelta(seconds=seconds)


def stream(spark, path, batches):
    for n, rows in enumerate(batches):
        spark.createDataFrame([(f, h, a, at(s)) for f, h, a, s in rows], SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/{n}")
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(path)


def passed_on(spark, tmp_path, batches, quiet=60):
    changes = stream(spark, f"{tmp_path}/in", batches)
    q = W.settled(changes, quiet, "0 seconds").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").outputMode("append")
    q.trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(SCHEMA).parquet(f"{tmp_path}/out").collect()
    return sorted((r.file, r.hash, r.action, int((r.at - T0).total_seconds())) for r in rows)


END = [("end", "e", "change", 10_000)]


def test_late_repeated_and_quick_changes(spark, tmp_path):
    batches = [
        [("a", "1", "change", 0), ("a", "2", "change", 10), ("b", "1", "add", 0)],
        [("a", "3", "change", 50), ("b", "1", "add", 0), ("c", "1", "change", 55)],  # a goes on, b is repeated
        [("c", None, "unlink", 70), ("a", "0", "change", 20), ("d", "1", "change", 300)],  # a's is late; the watermark passes a, b and c
        [("a", "4", "change", 400), ("a", "5", "change", 1000)],
        END,
    ]
    want = [("a", "3", "change", 50), ("a", "4", "change", 400), ("a", "5", "change", 1000), ("b", "1", "add", 0), ("c", None, "unlink", 70), ("d", "1", "change", 300)]
    assert passed_on(spark, tmp_path, batches) == want


def test_one_batch_gives_the_same_as_many(spark, tmp_path):
    rows = [(f"f{i % 3}", str(i), "change", (i * i) % 2000 + i // 7 * 400) for i in range(60)]
    rows.sort(key=lambda r: r[3])
    many, one = tmp_path / "many", tmp_path / "one"
    got = passed_on(spark, many, [rows[i : i + 9] for i in range(0, 60, 9)] + [END])
    assert got == passed_on(spark, one, [rows, END]) and len(got) > 6


def test_changes_out_of_order_within_the_lateness(spark, tmp_path):
    """A change that comes after a much newer one of its file still settled; nothing runs a row at a time in Python."""
    rows = [(f"f{i % 2}", str(i), "change", i * 7919 % 2000) for i in range(40)]
    changes = stream(spark, f"{tmp_path}/in", [rows[i : i + 8] for i in range(0, 40, 8)] + [END])
    settled = W.settled(changes, 60, "1 hour")
    assert "Python" not in settled._jdf.queryExecution().analyzed().toString()
    q = settled.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").outputMode("append")
    q.trigger(availableNow=True).start().awaitTermination()
    times = {f: sorted(s for g, _, _, s in rows if g == f) for f in ("f0", "f1")}
    want = {(f, s) for f, ts in times.items() for s, after in zip(ts, [*ts[1:], 10**6], strict=True) if after - s > 60 and s + 60 <= 10_000 - 3600}
    got = [(r.file, int((r.at - T0).total_seconds())) for r in spark.read.schema(SCHEMA).parquet(f"{tmp_path}/out").collect()]
    assert len(got) == len(want) and set(got) == want


def test_a_batch_writes_the_rows_it_touches(spark, tmp_path):
    root = f"file://{tmp_path}/state"
    many = [(f"f{i}", "0", "add", i) for i in range(200)]
    changes = stream(spark, f"{tmp_path}/in", [many, [("f3", "1", "change", 500), ("new", "1", "add", 501)], [("f4", None, "unlink", 600)]])
    W.watch(changes, root, f"{root}-cp").awaitTermination()
    entry = Log(spark, f"{root}/log").last()[1]
    assert entry["rows"] == 3 and len(entry["deltas"]) == 2
    state = {r.file: (r.hash, r.status) for r in W.present(W.read_state(spark, root)).collect()}
    assert len(state) == 200 and state["f3"] == ("1", "PENDING") and state["new"] == ("1", "PENDING") and "f4" not in state


def test_a_query_whose_lease_was_taken_over_stops(spark, tmp_path):
    root = f"file://{tmp_path}/state"
    old = versions.acquire(spark, root, "old", seconds=0, now=0)
    versions.acquire(spark, root, "new")
    changes = stream(spark, f"{tmp_path}/in", [[("a", "1", "add", 0)]])
    with pytest.raises(Exception, match="followed by another one"):
        W.watch(changes, root, f"{root}-cp", lease=old).awaitTermination()
    assert Table(spark, root, "file").read() is None and issubclass(Conflict, Exception)

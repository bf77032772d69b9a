"""stream_settled gives the rows of its SQL at the edges of the quiet time, the lateness and the time range."""

from __future__ import annotations

import os

import duckdb
import pytest

from __spark_entry__ import oracle_sql, queries

NOW, QUIET = "TIMESTAMP '2024-01-05 12:00:00.000500'", "INTERVAL 6 HOUR"
DUE = f"{NOW} - {QUIET} - INTERVAL 10 MINUTE"
END = f"(99, {NOW}, 9, 'e')"
CASES = {
    "followed, but not yet behind the watermark": f"(1, {NOW} - {QUIET} - INTERVAL 5 MINUTE, 1, 'a'), (2, {NOW} - INTERVAL 2 MINUTE, 1, 'b'), {END}",
    "due to the microsecond": f"(1, {DUE}, 1, 'a'), (2, {DUE} - INTERVAL 1 MICROSECOND, 2, 'b'), (3, {DUE} + INTERVAL 1 MICROSECOND, 3, 'c'), {END}",
    "followed just after the quiet time": f"(1, {DUE} - INTERVAL 1 DAY, 1, 'a'), (2, {DUE} - INTERVAL 1 DAY + {QUIET} + INTERVAL 1 MICROSECOND, 1, 'b'), {END}",
    "followed at the end of the quiet time": f"(1, {DUE} - INTERVAL 1 DAY, 1, 'a'), (2, {DUE} - INTERVAL 1 DAY + {QUIET}, 1, 'b'), {END}",
    "before 1970": f"(1, TIMESTAMP '1960-01-01', 1, 'a'), (2, TIMESTAMP '1965-01-01', 1, 'b'), {END}",
    "no value": f"(1, NULL, 1, 'a'), (2, {NOW} - INTERVAL 2 DAY, 1, NULL), (3, {NOW} - INTERVAL 2 DAY, NULL, 'c'), {END}",
}


@pytest.mark.parametrize("case", [*CASES, "a folder of files"])
def test_rows_of_the_sql(spark, tmp_path, case):
    con = duckdb.connect()
    con.execute(f"CREATE TABLE events AS SELECT * FROM (VALUES {CASES.get(case) or CASES['before 1970']}) v(event_id, ts, user_id, event_type)")
    if case in CASES:
        con.execute(f"COPY events TO '{tmp_path}/events.parquet'")
    else:
        os.mkdir(tmp_path / "events.parquet")
        for part in range(2):
            con.execute(f"COPY (SELECT * FROM events WHERE event_id % 2 = {part}) TO '{tmp_path}/events.parquet/part-{part}.parquet'")
    got = sorted((tuple(r) for r in queries()["stream_settled"](spark, str(tmp_path)).collect()), key=str)
    want = sorted(con.execute(oracle_sql()["stream_settled"]).fetchall(), key=str)
    assert want and got == want

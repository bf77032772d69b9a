"""Intact records beside damaged ones."""

from __future__ import annotations

import gzip
import os
import time
from pathlib import Path

from tessella.llm import warc

PARTS = [warc.record(i, f"http://h/{i}", f"<p>{i}</p>".encode() * 50, None) for i in range(6)]


def good(found):
    return sorted(x.headers["warc-record-id"][12:-1] for x in found if x.headers)


def test_the_record_behind_a_cut_payload_is_kept():
    assert good(warc.salvage(PARTS[0] + PARTS[1][:-40] + b"".join(PARTS[2:]))) == list("02345")


def test_members_behind_damaged_first_bytes_are_kept():
    broken = bytearray(b"".join(gzip.compress(p, mtime=0) for p in PARTS))
    broken[:2] = b"??"
    assert good(warc.salvage(bytes(broken))) == list("12345")


def test_one_bad_byte_in_a_written_archive_costs_one_record(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://h/{i}", f"<p>page {i}</p>" * 40) for i in range(30)], "page_id long, url string, html string").coalesce(1)
    warc.write_warc(pages, f"file://{tmp_path}/w")
    data = b"".join(p.read_bytes() for p in sorted(Path(tmp_path, "w").glob("part-*")))
    assert len(good(warc.salvage(data))) == 30
    broken = bytearray(data)
    broken[len(data) // 3] ^= 0xFF
    assert len(good(warc.salvage(bytes(broken)))) >= 29
    assert warc._member(b"x" * (1 << 24))[-1] == 0


def test_a_damaged_member_of_many_records_gives_those_before_the_damage_and_the_gap_begins_behind_them():
    broken = bytearray(gzip.compress(b"".join(warc.record(i, f"http://h/{i}", (b"a%d " % i) * 900, None) for i in range(200)), mtime=0))
    at = len(broken) // 4
    broken[at : at + 8] = bytes(b ^ 0x5A for b in broken[at : at + 8])
    found = list(warc.salvage(bytes(broken)))
    gaps = [x for x in found if x.headers is None]
    assert 40 <= len(good(found)) < 200 and good(found)[:2] == ["0", "1"]
    assert 0 < gaps[-1].start <= len(broken) and gaps[-1].end == len(broken) and all(x.end <= gaps[-1].start for x in found if x.headers)


def test_reading_takes_time_in_proportion():
    def seconds(n):
        data = b"".join(warc._member(warc.record(i, None, os.urandom(9000), None)) for i in range(n))
        lines = b"WARC/1.1\r\nWARC-Type: x\r\n" * n
        one = bytearray(gzip.compress(b"".join(warc.record(i, None, b"a%d " % i * 2000, None) for i in range(n)), mtime=0))
        one[len(one) * 3 // 4] ^= 0xFF
        began = time.perf_counter()
        assert len(good(warc.salvage(data))) == n
        assert not good(warc.salvage(lines)) and len(good(warc.salvage(bytes(one)))) > n // 2
        return time.perf_counter() - began

    seconds(200)
    few, many = seconds(1000), seconds(4000)
    assert many < 3 and many < 8 * few


def test_null_ids_and_repeated_smallest_ids(spark, tmp_path):
    rows = [(None, "u", "same"), (3, "u", "same"), (3, "v", "same"), (7, "u", "same"), (None, "u", "bare"), (None, "v", "bare"), (9, None, None), (10, "u", "")]
    warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string"), f"file://{tmp_path}/w")
    got = warc.read_warc(spark, f"file://{tmp_path}/w").collect()
    name = lambda s: s and s[12:-1]
    same = sorted(((name(r.record_id), r.warc_type, name(r.refers_to)) for r in got if r.payload_digest == warc.digest(b"same")), key=str)
    assert same == sorted([("", "revisit", "3"), ("3", "response", None), ("3", "response", None), ("7", "revisit", "3")], key=str)
    assert [r.warc_type for r in got if r.payload_digest == warc.digest(b"bare")] == ["response"] * 2
    assert sorted(((name(r.record_id), r.warc_type, name(r.refers_to)) for r in got if r.payload_digest == warc.digest(b"")), key=str) == [("10", "revisit", "9"), ("9", "response", None)]


def test_lengths_that_are_no_numbers_are_gaps():
    for length in ("²", "9" * 5000, "-1", "+5", "1_0", "٣", "", "1e3", " "):
        head, _, rest = PARTS[1].partition(b"\r\nContent-Length: ")
        broken = head + f"\r\nContent-Length: {length}".encode() + rest[rest.index(b"\r\n") :]
        assert broken != PARTS[1]
        assert good(warc.salvage(PARTS[0] + broken + PARTS[2])) == list("02"), length


def test_a_revisit_with_a_length_that_is_no_number_is_read(spark, tmp_path):
    odd = warc.record(7, "http://h/7", b"payload", 3).replace(b"X-Payload-Length: 7", "X-Payload-Length: ²".encode())
    Path(tmp_path, "a.warc").write_bytes(PARTS[0] + odd)
    got = {r.record_id: r.payload_bytes for r in warc.read_warc(spark, f"file://{tmp_path}").filter("warc_type is not null").collect()}
    assert got == {"<urn:x-page:0>": 400, "<urn:x-page:7>": None}


def _damaged(data: bytes, r) -> tuple[bytes, int, int]:
    """data with one part changed, cut out or put in, and where that part begins and ends in the original."""
    at = r.randrange(len(data))
    n = r.choice((1, 1, 2, 7, 60))
    end = min(len(data), at + n)
    kind = r.randrange(4)
    if kind == 0:
        return data[:at] + bytes(r.randrange(256) for _ in range(end - at)) + data[end:], at, end
    if kind == 1:
        return data[:at] + data[end:], at, end
    if kind == 2:
        put = r.choice((b"\r\n", b"\r\n\r\n", b"WARC/1.1\r\n", "²".encode(), b"\xff\xfe", b"9" * 30, b"\x1f\x8b\x08", bytes(r.randrange(256) for _ in range(n))))
        return data[:at] + put + data[at:], at, at
    return data[:at], at, len(data)


def test_any_damage_costs_the_records_that_it_touches_and_nothing_raises():
    import random

    r = random.Random(11)
    for packed in (False, True):
        parts = [warc._member(p) for p in PARTS] if packed else PARTS
        data, ends, at = b"".join(parts), [], 0
        for p in parts:
            ends.append((at, at + len(p)))
            at += len(p)
        for _ in range(1000):
            broken, lo, hi = _damaged(data, r)
            found = list(warc.salvage(broken))
            untouched = {str(i) for i, (a, b) in enumerate(ends) if b <= lo or a >= max(hi, lo + (hi == lo))}
            assert untouched <= set(good(found)), (packed, lo, hi)
            for x in found:
                assert 0 <= x.start <= x.end <= len(broken)

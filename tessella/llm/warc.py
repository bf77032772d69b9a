"""WARC archives: a deduplicating writer, and a salvage reader.

The writer turns each page into one WARC/1.1 record: a `response` with the payload, or a `revisit` that refers to the
record of the same payload with the smallest id. Each record is a gzip member of its own, so that damage to one leaves
the others. Archives are written by Spark's text writer, so they can go to any file system that Spark reaches.

The reader checks every record (version line, header block, length, closing blank lines, payload digest). After a
failed check it searches for the next version line, or in a compressed archive for the next gzip member that opens,
goes on from there, and logs the bytes between as a quarantined gap.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.store import BROADCAST_ROWS, discard, stash

DATE = "2024-01-01T00:00:00Z"
RECORDS_PER_FILE = 2_000
#: Compressed bytes of a damaged member that are read at a time.
STEP = 512
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"
_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_MEMBER = b"\x1f\x8b\x08"
_LENGTH = re.compile(r"[0-9]{1,18}")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _one_line(s: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m.group()):02X}", s)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A whole record. refers_to is None for a response."""
    name = lambda i: "<urn:x-page:>" if i is None else f"<urn:x-page:{i}>"
    head = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", name(page_id)), ("WARC-Date", DATE)]
    if url is not None:
        head.append(("WARC-Target-URI", _one_line(url)))
    head += [("WARC-Payload-Digest", f"sha1:{digest(payload)}"), ("X-Payload-Length", str(len(payload)))]
    block = _HTTP.format(len(payload)).encode()
    if refers_to is None:
        block += payload
    else:
        head += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", name(refers_to))]
    head += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


class Found(NamedTuple):
    """A record that passed its checks, or a gap (headers None) with the reason."""

    start: int
    end: int
    headers: dict[str, str] | None
    payload: bytes
    reason: str


def _length(headers: dict[str, str], name: str) -> int | None:
    """A length as a field gives it: ASCII digits that fit a long, else None."""
    told = headers.get(name, "")
    return int(told) if _LENGTH.fullmatch(told) else None


def _record_at(data: bytes, at: int) -> Found | str:
    version = _VERSION.match(data, at)
    if not version:
        return "no version line"
    stop = data.find(b"\r\n\r\n", at, at + 65536)
    if stop < 0:  # a longer header ends before the next version line at the latest
        after = _VERSION.search(data, version.end())
        stop = data.find(b"\r\n\r\n", at, after.start() if after else len(data))
    if stop < 0:
        return "header without end"
    headers: dict[str, str] = {}
    last = None
    for line in data[version.end() : stop].split(b"\r\n"):
        text = line.decode("utf-8", "replace")
        if text[:1] in " \t" and last:  # a folded line
            headers[last] += " " + text.strip()
            continue
        k, sep, v = text.partition(":")
        if not sep:
            return "header line without a colon"
        last = k.strip().lower()
        headers[last] = v.strip()
    if not all(headers.get(k) for k in ("warc-type", "warc-record-id", "warc-date")):
        return "a required field is missing"
    length = _length(headers, "content-length")
    if length is None:
        return "no content length"
    begin = stop + 4
    end = begin + length
    if end > len(data):
        return "block is cut short"
    if data[end : end + 4] != b"\r\n\r\n":
        return "record does not end where its length says"
    block = data[begin:end]
    http = headers.get("content-type", "").startswith("application/http")
    payload = block.partition(b"\r\n\r\n")[2] if http else block
    want = headers.get("warc-payload-digest", "")
    if headers.get("warc-type") != "revisit" and want.startswith("sha1:") and want[5:] != digest(payload):
        return "payload digest differs"
    return Found(at, end + 4, headers, payload, "")


def _records(data: bytes) -> Iterator[Found]:
    at = 0
    while at < len(data):
        got = _record_at(data, at)
        if isinstance(got, Found):
            yield got
            at = got.end
            continue
        found = _VERSION.search(data, at + 1)
        to = found.start() if found else len(data)
        yield Found(at, to, None, b"", got)
        at = to


def _opens(data: bytes, at: int) -> tuple[bytes, int] | None:
    """Content and end of the gzip member at a position, or None."""
    z, out, view = zlib.decompressobj(31), [], memoryview(data)
    try:
        while not z.eof and at < len(data):
            out.append(z.decompress(view[at : at + 65536]))
            at = min(at + 65536, len(data))
    except zlib.error:
        return None
    return (b"".join(out), at - len(z.unused_data)) if z.eof else None


def salvage(data: bytes) -> Iterator[Found]:
    """Records and gaps of a plain or gzip archive. Positions in a member are those of the member's first byte.

    Where the first bytes are damaged, the archive is what gives more records.
    """
    if data[:2] == _MEMBER[:2]:
        yield from _members(data)
    elif _VERSION.match(data) or _MEMBER not in data:
        yield from _records(data)
    else:
        either = list(_records(data)), list(_members(data))
        yield from max(either, key=lambda found: sum(x.headers is not None for x in found))


def _members(data: bytes) -> Iterator[Found]:
    at = 0
    while at < len(data):
        got = _opens(data, at)
        if got:
            for x in _records(got[0]):
                yield x._replace(start=at, end=got[1])
            at = got[1]
            continue
        to = data.find(_MEMBER, at + 1)
        while to >= 0 and not _opens(data, to):
            to = data.find(_MEMBER, to + 1)
        to = to if to >= 0 else len(data)
        # What the broken member still gives before its first fault may hold whole records. The gap begins at the last
        # of the steps in which it is read that gives nothing beyond the last whole record.
        z, head, size, steps = zlib.decompressobj(31), [], 0, [(at, 0)]
        try:
            for i in range(at, to, STEP):
                head.append(z.decompress(data[i : min(i + STEP, to)]))
                size += len(head[-1])
                steps.append((min(i + STEP, to), size))
        except zlib.error:
            pass
        found = list(_records(b"".join(head)))
        whole = max((x.end for x in found if x.headers is not None), default=0)
        given = max(place for place, n in steps if n <= whole)
        for x in found:
            if x.end <= whole:
                yield x._replace(start=at, end=given)
        yield Found(given, to, None, b"", "gzip member is damaged")
        at = to


def _member(content: bytes) -> bytes:
    """A gzip member that ends in a zero byte (its length's highest); after 16 MB and more an empty one follows."""
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    got = z.compress(content) + z.flush()
    return got if got[-1] == 0 else got + _member(b"")


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, len(batch), 64):
            out = []
            for page, url, html, first in zip(*(batch.column(c).slice(lo, 64).to_pylist() for c in ("page_id", "url", "html", "first")), strict=True):
                got = record(page, url, (html or "").encode(), None if first is None or first == page else first)
                out.append(_member(got)[:-1])  # the text writer ends each row with the last byte
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", text_col: str = "html", least: int = 0) -> None:
    """Write one record per row of pages under path, as gzip archives of RECORDS_PER_FILE records at most.

    Of rows with equal payloads of at least `least` bytes the smallest id is the response, the others revisit it. Null
    payloads are empty. A null id never is the one referred to; where all ids are null every row is a response. Rows
    that repeat the smallest id are responses each. Other columns are not read. No rows: an archive without records.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(text_col), F.lit("")).alias("html"))
    rows = rows.withColumn("sha", F.unhex(F.sha1(F.col("html").cast("binary"))))
    # Only payloads that occur more than once need the join, and pages move only if these are very many.
    twice = rows.filter(F.octet_length("html") >= least).groupBy("sha").agg(F.count("*").alias("n"), F.min("page_id").alias("first")).filter("n > 1").select(F.col("sha").alias("k"), "first")
    twice = stash(twice, "twice")
    side = F.broadcast(twice) if twice.count() <= BROADCAST_ROWS else twice
    rows = rows.join(side, F.col("sha") == F.col("k"), "left").select("page_id", "url", "html", "first")
    members = rows.mapInArrow(_build, "value binary").select(F.col("value").cast("string"))  # bytes stay as they are
    members.write.option("compression", "none").option("lineSep", "\0").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)
    discard(twice)


_OUT = "archive string, start long, end long, warc_type string, record_id string, target_uri string, refers_to string, payload_digest string, payload_bytes long, reason string, payload binary"


def _parse(with_payload: bool):
    names = [x.split()[0] for x in _OUT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
                rows, size = [], 0
                for x in salvage(content.as_py()):
                    h = x.headers or {}
                    revisit = h.get("warc-type") == "revisit"
                    length = _length(h, "x-payload-length") if revisit else len(x.payload)
                    sha = h.get("warc-payload-digest", "").removeprefix("sha1:") if revisit else digest(x.payload)
                    rows.append((path.as_py(), x.start, x.end, h.get("warc-type"), h.get("warc-record-id"), h.get("warc-target-uri"), h.get("warc-refers-to"), sha if x.headers else None, length if x.headers else None, x.reason or None, x.payload if with_payload else None))
                    size += len(x.payload)
                    if len(rows) >= 2000 or size >= 1 << 23:
                        yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], SCHEMA)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], SCHEMA)

    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    SCHEMA = pa.schema([(n, kinds[x.split()[1]]) for n, x in zip(names, _OUT.split(", "), strict=True)])
    return run


def read_warc(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """Records and quarantined gaps (warc_type null, reason set) of the archives under path.

    Each archive is read by one task as a whole; write archives of some ten MB, as write_warc does. An archive without
    a single valid record is one gap; an empty one gives nothing.
    """
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(_parse(with_payload), _OUT)

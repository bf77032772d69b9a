"""Queries op7 (WARC), op1 (repeated passages) and op10 (licenses)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import table
from tessella.llm.licenses import scan_licenses
from tessella.llm.repeats import find_repeats
from tessella.llm.store import new_path, scope
from tessella.llm.warc import read_warc, write_warc


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_repeats(table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = lambda c: F.try_element_at(F.split(F.regexp_replace(c, "[<>]", ""), ":"), F.lit(3)).try_cast("long")
    with scope(spark) as tables:
        path = new_path(spark, "warc")
        write_warc(table(spark, sf_dir, "pages"), path)
        records = read_warc(spark, path).filter("warc_type is not null")
        out = records.select(page(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", F.col("warc_type").alias("record_type"), page(F.col("refers_to")).alias("refers_to"))
        return tables.result(out, "warc-records")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of a source tree: ten to a directory, of which the tenth is the LICENSE; ten directories to one
    above, whose LICENSE is the hundredth document."""
    id_, top = F.col("doc_id"), F.floor(F.col("doc_id") / 100)
    inner = F.floor(F.col("doc_id") / 10)
    path = F.when(F.pmod(id_, F.lit(100)) == 0, F.concat_ws("/", F.lit("src"), top, F.lit("LICENSE"))).when(F.pmod(id_, F.lit(10)) == 0, F.concat_ws("/", F.lit("src"), top, inner, F.lit("LICENSE"))).otherwise(F.concat_ws("/", F.lit("src"), top, inner, id_.cast("string")))
    return scan_licenses(table(spark, sf_dir, "documents"), path)


QUERIES = {"op10_license_scan": op10_license_scan, "op1_suffix_array_dedup": op1_suffix_array_dedup, "op7_warc": op7_warc}

ORACLES = {
    "op7_warc": """WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT h, min(page_id) AS first FROM p GROUP BY h)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST((CAST('0x' || substr(p.h, CAST(i // 4 AS BIGINT) * 5 + 1, 5) AS BIGINT) >> (5 * (3 - i % 4))) & 31 AS INTEGER) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to FROM p JOIN f USING (h)"""
}

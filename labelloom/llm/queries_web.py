"""Queries over ``pages``: URL filter and archives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import url_filter, warc
from .common import table


def op6_url_filter(spark: SparkSession, d: str) -> DataFrame:
    return url_filter.judge(table(spark, d, "pages"))


def op8_warc(spark: SparkSession, d: str) -> DataFrame:
    listing = warc.write_archives(warc.deduplicated(table(spark, d, "pages")))
    number = lambda name: F.expr(f"try_cast(substring({name}, {len('urn:page:') + 1}) AS BIGINT)")
    return warc.read_archives(listing, payloads=False).select(
        number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to")
    )


# Base32 in SQL: the digest's 160 bits in groups of five.
_BITS = "list_reduce(list_transform(regexp_extract_all(lower(sha1(coalesce(html, ''))), '.'), lambda c: bin(CAST('0x' || c AS UTINYINT)).lpad(4, '0')), lambda x, y: x || y)"
OP8_SQL = f"""
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes,
    list_reduce(list_transform(regexp_extract_all({_BITS}, '.....'),
      lambda b: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + CAST(CAST(b AS BITSTRING) AS INTEGER)]), lambda x, y: x || y) AS payload_digest
  FROM pages
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN first IS NULL OR page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
"""

QUERIES = {"op6_url_filter": op6_url_filter, "op8_warc": op8_warc}
ORACLES = {"op6_url_filter": url_filter.judge_sql(), "op8_warc": OP8_SQL}

"""The registered queries of the ten operators: thin callers over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import quality
from .common import read_table
from .decontam import leaks
from .html import extract
from .license import scan_licenses
from .packing import pack
from .pii import pii_report
from .simhash import simhash_components
from .suffix import remove_repeats
from .toxicity import toxicity
from .warc import archive_round_trip


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(read_table(spark, sf_dir, "documents"))


def op2_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(quality.ledger(read_table(spark, sf_dir, "documents")))


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read_table(spark, sf_dir, "pages"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(read_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read_table(spark, sf_dir, "documents"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_report(read_table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"))


def op10_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read_table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_decontam": op2_decontam,
    "op3_quality": op3_quality,
    "op4_html": op4_html,
    "op5_warc": op5_warc,
    "op6_license": op6_license,
    "op7_pii": op7_pii,
    "op8_toxicity": op8_toxicity,
    "op9_packing": op9_packing,
    "op10_suffix": op10_suffix,
}

#: The base-32 form of a SHA-1 digest is written out from its hexadecimal digits, five bits at a time.
_WARC = """WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) || '0' AS h FROM pages),
  f AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS low FROM p)
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((
    (256 * (instr('0123456789abcdef', substr(h, 1 + CAST(5 * i // 4 AS BIGINT), 1)) - 1) + 16 * (instr('0123456789abcdef', substr(h, 2 + CAST(5 * i // 4 AS BIGINT), 1)) - 1)
     + greatest(0, instr('0123456789abcdef', substr(h, 3 + CAST(5 * i // 4 AS BIGINT), 1)) - 1)) >> (7 - 5 * i % 4)) & 31) AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN page_id > low THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id > low THEN low END AS refers_to
FROM f"""

#: Every 50-byte string with the smallest document it starts in; strings of later documents are merged into runs.
_SUFFIX = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
  c AS (SELECT doc_id, b, substr(h, 2 * b + 1, 8192 + 98) AS part FROM (SELECT doc_id, h, unnest(range(0, greatest(1, length(h) // 2), 4096)) AS b FROM d)),
  s AS (SELECT doc_id, b + o AS p, substr(part, 2 * o + 1, 100) AS g FROM (SELECT doc_id, b, part, unnest(range(0, least(4096, length(part) // 2 - 49))) AS o FROM c)),
  f AS (SELECT g, min(doc_id) AS low FROM s GROUP BY g),
  m AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER w + 50 THEN 0 ELSE 1 END AS fresh FROM s JOIN f USING (g) WHERE low < doc_id WINDOW w AS (PARTITION BY doc_id ORDER BY p)),
  r AS (SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM m),
  runs AS (SELECT doc_id, min(p) AS b, max(p) + 50 AS e FROM r GROUP BY doc_id, run),
  gaps AS (SELECT doc_id, b, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY b), 0) AS a FROM runs),
  k AS (SELECT doc_id, sum(e - b) AS n_removed, count(*) AS n_spans, max(e) AS last, string_agg(substr(h, 2 * a + 1, 2 * (b - a)), '' ORDER BY b) AS head FROM gaps JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)"""

ORACLES: dict[str, str] = {"op3_quality": quality.ORACLE, "op5_warc": _WARC, "op10_suffix": _SUFFIX}

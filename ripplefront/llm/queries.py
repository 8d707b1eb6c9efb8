"""The registered queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    common,
    decontaminate,
    fingerprint,
    language,
    lines,
    mixing,
    simhash,
    token_counts,
    token_files,
    toxicity,
    warc,
)

ORACLE: dict[str, str] = {}


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edit_report(common.table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = token_counts.token_counts(docs, "text", public_tokenizers.path("piece_bpe_32k.model"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 4096)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(common.table(spark, sf_dir, "documents"), "doc_id", "text")
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = common.table(spark, sf_dir, "documents"), common.scratch_path(spark, "token-files")
    path = public_tokenizers.path("byte_bpe_50k.json")
    manifest = token_files.write_token_files(docs, "doc_id", "text", path, 2, folder, slice_bytes=4 << 20)

    def digest(ids):
        return len(ids), zlib.crc32(ids.astype("<u4").tobytes())

    read = token_files.read_token_files(manifest, folder, digest, "n_tokens long, ids_crc32 long")
    return read.select("doc_id", "start", "n_tokens", "ids_crc32")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, common.table(spark, sf_dir, "labels"))
    rows = docs.select("doc_id", common.held_out("doc_id").alias("held_out"), "text")
    return toxicity.scored(rows, "text", model, ["doc_id", "held_out"])


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    model = language.fit(docs)
    rows = docs.select("doc_id", common.held_out("doc_id").alias("held_out"), "text")
    return language.identify(rows, "text", model, ["doc_id", "held_out"])


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return lines.LineStore(spark, common.scratch_path(spark, "lines")).add(docs).rewrite(docs, report=True)


ORACLE["op7_line_dedup"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS row_id, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), l AS (
  SELECT row_id, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d
), k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), g AS (
  SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT row_id) >= 3
), m AS (
  SELECT k.*, g.last IS NOT NULL AND k.doc_id IS DISTINCT FROM g.last AS lost FROM k LEFT JOIN g ON k.key = g.key
)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE lost) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT lost), '')) AS kept_sha256
FROM m GROUP BY row_id, doc_id
"""


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(common.table(spark, sf_dir, "documents"))


ORACLE["op8_mixing"] = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT source, source_size, source_size * 2.0::DOUBLE AS cap, k,
         CAST([5, 2, 1][CAST(k % 3 AS BIGINT) + 1] AS DOUBLE) AS w
  FROM (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM s)
), l AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE
             - coalesce(sum(cap) OVER (ORDER BY cap / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / (sum(w) OVER ()
               - coalesce(sum(w) OVER (ORDER BY cap / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM w
), cut AS (
  SELECT level AS lv FROM l WHERE level * w <= cap ORDER BY cap / w, k LIMIT 1
), t AS (
  SELECT source, source_size, least(cap, coalesce((SELECT lv FROM cut) * w, cap)) AS target,
         CAST(CAST('0x' || substr(md5('7:' || coalesce('=' || source, 'null')), 1, 8) AS BIGINT) AS DOUBLE)
         / 4294967296.0::DOUBLE AS u
  FROM l
), p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.u,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
         row_number() OVER (PARTITION BY d.source
           ORDER BY length(bin(d.size)) * 8 + (d.size >> greatest(length(bin(d.size)) - 3, 0)) DESC,
                    d.doc_id NULLS FIRST, d.size) AS place
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST((floor(u + place * rate) - floor(u + (place - 1) * rate)) * size AS BIGINT) AS taken
FROM p
"""


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = common.scratch_path(spark, "warc")
    index = warc.write(common.table(spark, sf_dir, "pages"), folder)
    return warc.read(index, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE["op10_warc"] = """
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest
  FROM pages
), g AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS first FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> first THEN first END AS refers_to
FROM g
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_fingerprints": op1_fingerprints,
        "op2_token_counts": op2_token_counts,
        "op3_simhash": op3_simhash,
        "op4_token_files": op4_token_files,
        "op5_toxicity": op5_toxicity,
        "op6_language": op6_language,
        "op7_line_dedup": op7_line_dedup,
        "op8_mixing": op8_mixing,
        "op9_decontamination": op9_decontamination,
        "op10_warc": op10_warc,
    }


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)

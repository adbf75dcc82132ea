"""The queries of this subpackage: each operator over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import op1_quality_crf, op10_decontamination, op2_language_id, op3_token_output, op4_sharding, op5_jaccard_join, op6_warc, op7_mixing, op8_token_counts, op9_license_scan

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_crf_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return op1_quality_crf.rate(docs, op1_quality_crf.fit(docs, table(spark, sf_dir, "labels"))).drop("content_lines")


def op2_language_id_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_language_id.identify(table(spark, sf_dir, "documents"))


def op3_token_output_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3_token_output.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_sharding_minimax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_sharding.assign(table(spark, sf_dir, "documents"))


def op5_jaccard_join_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_jaccard_join.join(table(spark, sf_dir, "documents"))


def op6_warc_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_warc.archive(table(spark, sf_dir, "pages")).drop("file", "offset", "record_id")


def op7_mixing_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_mixing.mix(table(spark, sf_dir, "documents"))


def op8_token_counts_two_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op9_license_scan_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_license_scan.scan(table(spark, sf_dir, "documents"))


def op10_decontamination_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_decontamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (
        op1_quality_crf_lines, op2_language_id_bayes, op3_token_output_orc, op4_sharding_minimax, op5_jaccard_join_trie, op6_warc_chain, op7_mixing_entropy, op8_token_counts_two_tier, op9_license_scan_paragraphs, op10_decontamination_align,
    )}


def _warc_sql() -> str:
    """op6 in SQL: digests in base32 from the hex of SHA-1, five hex digits (20 bits) at a time."""
    bits = [(f"('0x' || substr(h, {5 * g + 1}, 5))::BIGINT", s) for g in range(8) for s in (15, 10, 5, 0)]
    digest = " || ".join(f"substr('{op6_warc.BASE32}', (({v} >> {s}) & 31)::INT + 1, 1)" for v, s in bits)
    return f"""WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages), q AS (SELECT page_id, strlen(t) AS payload_bytes, sha1(t) AS h, min(page_id) OVER (PARTITION BY t) AS first_id FROM p)
SELECT page_id, payload_bytes, {digest} AS payload_digest, CASE WHEN page_id = first_id OR first_id IS NULL THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first_id THEN first_id END AS refers_to, true AS intact FROM q"""


def oracle_sql() -> dict[str, str]:
    """The other operators train, hash, tokenize, align or iterate: tests hold them against brute force."""
    return {"op6_warc_chain": _warc_sql()}

"""The queries of this subpackage and their SQL, for the entry module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rowsieve.llm import byte_bpe, language_id, licenses, mixing, pii, quality, secrets, simhash, sst, topk

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix": mixing.query,
    "op2_secret_scan": secrets.query,
    "op3_byte_bpe": byte_bpe.query,
    "op4_topk_search": topk.query,
    "op5_simhash_dedup": simhash.query,
    "op6_license_scan": licenses.query,
    "op7_token_shards": sst.query,
    "op8_language_id": language_id.query,
    "op9_pii": pii.query,
    "op10_quality_rules": quality.query,
}

ORACLE_SQL: dict[str, str] = {
    "op4_topk_search": topk.ORACLE,
    "op6_license_scan": licenses.ORACLE,
}

"""Queries of this package and their SQL, by name, for the entry module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from keylake.llm import op1_topk, op10_html, op2_quality, op3_warc, op4_simhash, op5_token_counts, op6_mix, op7_lm, op8_langid, op9_bpe

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_topk_search": op1_topk.query,
    "op2_quality_rules": op2_quality.query,
    "op3_warc_archive": op3_warc.query,
    "op4_simhash_dedup": op4_simhash.query,
    "op5_token_counts": op5_token_counts.query,
    "op6_mix_sources": op6_mix.query,
    "op7_lm_score": op7_lm.query,
    "op8_language_id": op8_langid.query,
    "op9_bpe_codec": op9_bpe.query,
    "op10_html_extraction": op10_html.query,
}

ORACLE_SQL: dict[str, str] = {
    "op1_topk_search": op1_topk.ORACLE_SQL,
    "op3_warc_archive": op3_warc.ORACLE_SQL,
}

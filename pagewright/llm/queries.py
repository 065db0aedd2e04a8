"""The registered queries of this subpackage and, where SQL expresses one, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import boosting, bpe, html, langid, packing, quality, simhash, toxicity, urls, vectors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_extraction": html.op1_html_extraction,
    "op2_url_filters": urls.op2_url_filters,
    "op3_quality_rules": quality.op3_quality_rules,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_byte_bpe": bpe.op5_byte_bpe,
    "op6_quality_classifier": boosting.op6_quality_classifier,
    "op7_packing": packing.op7_packing,
    "op8_simhash_near_dedup": simhash.op8_simhash_near_dedup,
    "op9_embedding_near_dedup": vectors.op9_embedding_near_dedup,
    "op10_language_id": langid.op10_language_id,
    "quality_base_counts": quality.quality_base_counts,
}

ORACLE_SQL: dict[str, str] = {"op2_url_filters": urls.oracle_sql(), "quality_base_counts": quality.BASE_SQL}

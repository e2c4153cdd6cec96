"""The corpus operators' queries and SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from . import html_text, imatch, language_id, mixing, near_dup, pu_quality, quality_rules, secret_scan, sentencepiece_bpe, toxicity

MODULES = (quality_rules, sentencepiece_bpe, imatch, mixing, near_dup, language_id, toxicity, pu_quality, secret_scan, html_text)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    found = {k: q for m in MODULES for k, q in m.ORACLE.items()}
    return found | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})

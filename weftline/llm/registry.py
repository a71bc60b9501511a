"""Queries of the training-data operators and their oracle SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_MODULES = ("warc", "secret_scan", "sstable", "topk", "html_text", "bpe", "near_dedup", "toxicity", "mixing", "quality_rules", "spelling", "exact_dedup", "collocations")


def _modules():
    return [importlib.import_module(f"weftline.llm.{name}") for name in _MODULES]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    return {m.QUERY: m.query for m in _modules()} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    found = {m.QUERY: m.ORACLE_SQL for m in _modules() if getattr(m, "ORACLE_SQL", None)}
    return found | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})

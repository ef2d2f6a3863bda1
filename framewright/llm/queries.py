"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Modules that have QUERIES, and ORACLE_SQL where SQL can express the query.
MODULES = ("q01_bpe", "q02_sharding", "q03_toxicity", "q04_fingerprints", "q05_media", "q06_jaccard", "q07_warc", "q08_substrings", "q09_packing", "q10_chat", "q11_topk", "q12_codes", "q13_clusters")


def _modules() -> list:
    return [importlib.import_module(f"framewright.llm.{name}") for name in MODULES]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for module in _modules() for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _modules() for name, sql in getattr(module, "ORACLE_SQL", {}).items()}

"""Queries over the given tables, one for each operator of this folder, with their SQL where SQL can express them."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
MODULES = ("token_files", "decontaminate", "packing", "chat", "url_rules", "main_text", "jaccard_join",
           "ngram_ratio", "neighbour_vote", "byte_shards", "best_fit", "importance", "alignment")


def _modules() -> list:
    return [importlib.import_module(f"wattmill.llm.{m}") for m in MODULES]


def queries() -> dict[str, Query]:
    return {m.NAME: m.query for m in _modules()}


def oracle_sql() -> dict[str, str]:
    return {m.NAME: m.SQL for m in _modules() if m.SQL is not None}

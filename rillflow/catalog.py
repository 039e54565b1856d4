"""All queries of the core and their SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rillflow.plans.registry import QUERIES, SQL

#: Modules of plans whose queries are offered.
MODULES = ("answering", "batches", "corpus", "evaluations", "further", "grouped", "questions", "scorers", "selecting", "streams", "texts", "tokens")
for _name in MODULES:
    importlib.import_module(f"rillflow.plans.{_name}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)

"""Registry of queries over the star-schema tables with their SQL oracles.

Each query module exposes ``QUERIES``: name -> (function of a Model, SQL or None).
"""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from lodegraph.adapters.star_schema import Model

MODULES = ("document_queries", "graph_queries", "join_queries", "layer_queries", "reader_queries", "reference_queries", "rollup_queries", "score_queries", "text_queries", "token_queries")


def _all() -> dict:
    found: dict = {}
    for name in MODULES:
        found.update(import_module(f"lodegraph.plans.{name}").QUERIES)
    return found


def _bound(build: Callable[[Model], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: build(Model(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _bound(build) for name, (build, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _all().items() if sql}

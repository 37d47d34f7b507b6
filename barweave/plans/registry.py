"""All registered queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
BLOCKS = (
    "feature_queries",
    "research_queries",
    "portfolio_queries",
    "risk_queries",
    "store_queries",
    "scale_queries",
)


def _merged(what: str) -> dict:
    out: dict = {}
    for block in BLOCKS:
        out |= getattr(import_module(f"barweave.plans.{block}"), what)
    return out


def queries() -> dict[str, Query]:
    return _merged("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _merged("ORACLES")

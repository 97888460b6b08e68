"""Registered queries over the test tables, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _load() -> None:
    from lodestone.plans import audit_plans, graph_plans, io_plans, ranking_plans, text_plans, vector_plans  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from lodestone.plans.registry import QUERIES

    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from lodestone.plans.registry import SQL

    _load()
    return dict(SQL)

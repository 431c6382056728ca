"""Registry of the runnable queries and the SQL each is compared with."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Check:
    query: Query
    sql: str | None = None


CHECKS: dict[str, Check] = {}


def check(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; without SQL only its rows are checked here, its values in tests/."""

    def keep(query: Query) -> Query:
        CHECKS[name] = Check(query, sql)
        return query

    return keep


def load_all() -> dict[str, Check]:
    from . import cleaning, decisions, features, models, selection  # noqa: F401

    return CHECKS

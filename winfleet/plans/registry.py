"""Registry of queries: a callable over (session, folder of tables) and, where SQL can say it, the same question in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from winfleet.plans.views import VIEWS

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def with_views(body: str, *names: str) -> str:
    """SQL text with the named views in front as common table expressions."""
    views = ", ".join(f"{name} AS ({VIEWS[name].sql()})" for name in names)
    joiner = ", " if body.startswith("WITH ") else " "
    return f"WITH {views}{joiner}{body.removeprefix('WITH ')}" if joiner == ", " else f"WITH {views} {body}"

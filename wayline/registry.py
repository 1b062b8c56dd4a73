"""Where queries are named: a function of (spark, sf_dir), and DuckDB SQL of the same result where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its own name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def load() -> None:
    from wayline.plans import boards, details, journey_plans, live_plans, live_tables, places, progress, rankings, riders, roads, services, texts  # noqa: F401

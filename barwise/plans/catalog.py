"""Registry of named queries over the driver tables, each with its SQL oracle.

Every entry reads the given tables (through the adapters) so its work grows with them.
Spark side: DataFrame operators from ``barwise.operators``; SQL side: the independent
DuckDB text from ``oracle_sql``. Doubles are rounded to 6 decimals on both sides.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from .oracle_sql import r6
from .output import round_doubles


@dataclass
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    doubles: list[str]
    note: str = ""


REGISTRY: dict[str, Query] = {}


def register(name: str, sql: str | None, doubles: list[str] | None = None, note: str = ""):
    def deco(fn: Callable[[SparkSession, str], DataFrame]):
        def build(spark: SparkSession, sf_dir: str) -> DataFrame:
            return round_doubles(fn(spark, sf_dir))
        text = r6(sql, list(doubles)) if (sql and doubles) else sql
        REGISTRY[name] = Query(name, build, text, list(doubles or []), note)
        return fn
    return deco


def load_all() -> dict[str, Query]:
    from . import queries  # noqa: F401  (registers on import)
    return REGISTRY

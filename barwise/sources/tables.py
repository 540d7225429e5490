"""Scans of landed parquet tables.

Every read goes through ``spark.read.parquet`` so Catalyst prunes columns and pushes
filters into the scan; nothing is loaded into the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def read_bars(spark: SparkSession, path: str, schema: T.StructType | None = None,
              fmt: str = "parquet", **options) -> DataFrame:
    """Batch scan of landed bar files (parquet, csv or json) with a declared schema.

    One distributed read for all symbols replaces a fetch loop per symbol.
    """
    r = spark.read.format(fmt).options(**options)
    if schema is not None:
        r = r.schema(schema)
    return r.load(path)


def scan_ticker(df: DataFrame, ticker: str, order: str | None = "timestamp",
                not_null: str | None = None) -> DataFrame:
    """Rows of one ticker (bound as a literal, never spliced into SQL text), by time.

    ``not_null`` adds an ``IS NOT NULL`` guard, e.g. ``rsi`` for the indicator panel.
    Both predicates reach the parquet reader as pushed filters.
    """
    cond: Column = F.col("ticker") == F.lit(ticker)
    if not_null:
        cond = cond & F.col(not_null).isNotNull()
    out = df.where(cond)
    return out.orderBy(order) if order else out

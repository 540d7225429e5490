"""SNK-1/6/8: table layout, retry-safe appends and the guarded reset of transient layers.

Tables are parquet directories under one root. Bars and indicators are versioned tables
(``versions``: upserts write the touched dates beside the old ones and publish them at
once); signals, the trade log, the DQ log and the
portfolio's versions are partitioned by the writing batch, so a retried batch overwrites its
own directory instead of appending twice. A batch key is a run's number or, where several
kinds of run write one table, ``kind-number``.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..session import path_exists
from . import versions

# fixed values: table names of the medallion layout
LAYERS: dict[str, T.StructType] = {
    "raw_market_data": schemas.BARS,
    "technical_indicators": schemas.INDICATORS,
    "trade_signals": schemas.SIGNALS,
    "portfolio_state": schemas.PORTFOLIO,
    "trade_log": schemas.TRADE_LOG,
    "data_quality_events": schemas.DQ_EVENTS,
}
TRANSIENT = ["raw_market_data", "technical_indicators", "trade_signals", "portfolio_state"]
DATED = ["raw_market_data", "technical_indicators"]
#: Run bookkeeping, not a layer: what a first attempt found out and a retry must not recount.
RUN_FACTS = "_run_facts"


def table_path(root: str, name: str) -> str:
    if name not in LAYERS:
        raise KeyError(name)
    return f"{root.rstrip('/')}/{name}"


def read_if_present(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame | None:
    """The parquet folder read with its declared schema; None only if the path is absent.
    Any other error (storage, permissions, damaged files) is the caller's."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def append_batch(df: DataFrame, root: str, name: str, batch_id: int | str) -> None:
    """SNK-1: append one batch's rows, keyed by batch id (idempotent on retry)."""
    if name in DATED:
        raise ValueError(f"{name} is a versioned table: use versions.merge")
    out = schemas.conform(df, LAYERS[name])
    out.write.mode("overwrite").parquet(f"{table_path(root, name)}/batch_id={batch_id}")


def read_batch(spark: SparkSession, root: str, name: str, batch_id: int | str) -> DataFrame:
    return spark.read.schema(LAYERS[name]).parquet(f"{table_path(root, name)}/batch_id={batch_id}")


def read_layer(spark: SparkSession, root: str, name: str, but_batch: int | str | None = None) -> DataFrame:
    """All rows of a layer, typed and empty if it was never written; without the batch
    ``but_batch``, so that a retried run sees what its first attempt saw."""
    if name in DATED:
        return versions.read(spark, table_path(root, name), LAYERS[name])
    df = read_if_present(spark, table_path(root, name),
                         T.StructType([*LAYERS[name].fields, T.StructField("batch_id", T.StringType())]))
    if df is None:
        return schemas.empty(spark, LAYERS[name])
    if but_batch is not None:
        df = df.where(F.col("batch_id") != str(but_batch))
    return schemas.conform(df, LAYERS[name])


def read_version(spark: SparkSession, root: str, name: str, before: int | None = None) -> DataFrame:
    """The newest batch of a versioned layer (below ``before``): each batch is a whole state."""
    df = read_if_present(spark, table_path(root, name),
                         T.StructType([*LAYERS[name].fields, T.StructField("batch_id", T.LongType())]))
    if df is None:
        return schemas.empty(spark, LAYERS[name])
    if before is not None:
        df = df.where(F.col("batch_id") < before)
    newest = df.agg(F.max("batch_id").alias("v")).first()["v"]
    return schemas.conform(df.where(F.col("batch_id") == F.lit(newest)), LAYERS[name])


def run_fact(spark: SparkSession, root: str, name: str, run_id: int, schema: str,
             first: DataFrame | None = None) -> DataFrame | None:
    """What the first attempt of a run stored under ``name``; stores ``first`` if there is
    nothing yet. None if there is nothing and nothing to store."""
    path = f"{root.rstrip('/')}/{RUN_FACTS}/{name}/run_id={run_id}"
    types = T._parse_datatype_string(schema)
    if not path_exists(spark, f"{path}/_SUCCESS"):  # a broken attempt leaves no marker
        if first is None:
            return None
        schemas.conform(first, types).write.mode("overwrite").parquet(path)
    return spark.read.schema(types).parquet(path)


def reset_layers(spark: SparkSession, root: str, confirm: bool = False) -> list[str]:
    """SNK-8: empty the four transient layers (typed, zero rows; the versioned ones by a version
    without rows); the trade log and the DQ log are audit tables and stay. Needs ``confirm=True``. A stream
    reading these layers must also start from a new checkpoint path."""
    if not confirm:
        raise PermissionError("reset_layers needs confirm=True")
    for name in TRANSIENT:
        if name in DATED:
            versions.clear(spark, table_path(root, name))
            continue
        (schemas.empty(spark, LAYERS[name]).withColumn("batch_id", F.lit(None).cast("string"))
         .write.mode("overwrite").partitionBy("batch_id").parquet(table_path(root, name)))
    return TRANSIENT

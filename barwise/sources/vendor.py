"""SRC-2/3/4/8: conform landed vendor bars to the bar layout.

Vendor files carry capitalised names (``Datetime`` or ``Date``, ``Open`` .. ``Volume``),
a vendor symbol and, for text formats, numbers as strings. One distributed pass renames,
decodes with ``try_cast`` (a bad value becomes null instead of failing the job), drops
the zone (exchange wall time, TIMESTAMP_NTZ) and maps the vendor symbol to the display
ticker through a small dimension.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..functions.broadcast import checked_broadcast

# Layout of landed vendor rows in text formats (csv / json): numbers stay text until
# ``typed_decode`` so one bad value becomes a null instead of failing the read.
VENDOR_RAW = T.StructType([T.StructField(n, t, True) for n, t in [
    ("symbol", T.StringType()), ("Datetime", T.TimestampNTZType()), ("Open", T.StringType()),
    ("High", T.StringType()), ("Low", T.StringType()), ("Close", T.StringType()),
    ("Volume", T.StringType())]])

VENDOR_NAMES = {"Datetime": "timestamp", "Date": "timestamp", "Open": "open", "High": "high",
                "Low": "low", "Close": "close", "Volume": "volume"}


def typed_decode(df: DataFrame, schema: T.StructType) -> DataFrame:
    """SRC-8: per-column ``try_cast`` to the target type; unknown columns pass through."""
    types = {f.name: f.dataType for f in schema.fields}
    out = []
    for c in df.columns:
        t = types.get(c)
        if t is None:
            out.append(F.col(c))
        elif isinstance(t, (T.TimestampNTZType, T.TimestampType)):
            out.append(F.col(c).cast("string").try_cast(t).alias(c)
                       if not isinstance(df.schema[c].dataType, (T.TimestampNTZType, T.TimestampType))
                       else F.col(c).cast(t).alias(c))
        else:
            out.append(F.col(c).try_cast(t).alias(c))
    return df.select(*out)


#: A manifest has a row for each column of a result.
MAX_COLUMNS = 2_000


def decode_rows(rows: DataFrame, manifest: DataFrame, cells: str = "cells") -> DataFrame:
    """SRC-8 for results that come as arrays of strings with a manifest (position, name, type):
    one typed column for each manifest row, by position. A value that can't be read as its
    type, and one that a row is too short for, is null. Types are Spark SQL type names."""
    columns = manifest.orderBy("position").select("position", "name", "type").limit(MAX_COLUMNS + 1).collect()
    if len(columns) > MAX_COLUMNS:
        raise ValueError(f"a manifest of more than {MAX_COLUMNS} columns")
    names = [c["name"] for c in columns]
    if len(set(names)) < len(names):
        raise ValueError("a manifest names a column twice")
    return rows.select(*[F.get(cells, F.lit(c["position"])).try_cast(c["type"].lower()).alias(c["name"])
                         for c in columns])


#: Symbol dimensions up to this size are broadcast; their rows are counted first.
MAX_SYMBOLS = 20_000


def _decoded(raw: DataFrame) -> DataFrame:
    renamed = raw.withColumnsRenamed({k: v for k, v in VENDOR_NAMES.items() if k in raw.columns})
    return typed_decode(renamed, schemas.BARS)


def conform_vendor(raw: DataFrame, symbol_dim: DataFrame, symbol_col: str = "symbol") -> DataFrame:
    """Rename, decode and map vendor rows to (ticker, timestamp, open..volume).

    Rows whose symbol is not in the dimension or whose time can't be decoded have no place
    in the bar table; ``rejected_rows`` reports them. The landed rows are not shuffled: the
    dimension (one row per tracked symbol) is broadcast if it has ``MAX_SYMBOLS`` rows or
    fewer, which is checked, and joined by the planner's choice otherwise.
    """
    mapped = _decoded(raw).where(F.col("timestamp").isNotNull()) \
        .join(checked_broadcast(symbol_dim, MAX_SYMBOLS), symbol_col, "inner")
    return schemas.conform(mapped, schemas.BARS)


def missing_sources(raw: DataFrame, symbol_dim: DataFrame, symbol_col: str = "symbol") -> DataFrame:
    """SRC-4: a MISSING_BARS event (count 0) for each tracked symbol with no rows."""
    seen = raw.groupBy(symbol_col).agg(F.count(F.lit(1)).alias("_rows"))
    absent = symbol_dim.join(seen, symbol_col, "left").where(F.col("_rows").isNull())
    return absent.select(
        F.lit("MISSING_BARS").alias("event_type"), "ticker",
        F.format_string("No data returned for %s", F.col(symbol_col)).alias("message"),
        F.lit(0).alias("bar_count"))


def rejected_rows(raw: DataFrame, symbol_dim: DataFrame, symbol_col: str = "symbol") -> DataFrame:
    """One event for each tracked symbol with rows whose time can't be decoded
    (UNDECODED_TIME), and one for each symbol outside the dimension (UNMAPPED_SYMBOL)."""
    counts = _decoded(raw).groupBy(symbol_col).agg(
        F.count(F.lit(1)).alias("_rows"), F.count_if(F.col("timestamp").isNull()).alias("_undecoded"))
    dim = symbol_dim.select(F.col(symbol_col).alias("_symbol"), "ticker")
    j = counts.join(dim, F.col(symbol_col) == F.col("_symbol"), "left")
    unmapped = F.col("_symbol").isNull()
    name = F.coalesce(F.col(symbol_col), F.lit("<none>"))
    return j.where(unmapped | (F.col("_undecoded") > 0)).select(
        F.when(unmapped, "UNMAPPED_SYMBOL").otherwise("UNDECODED_TIME").alias("event_type"),
        F.when(unmapped, name).otherwise(F.col("ticker")).alias("ticker"),
        F.when(unmapped, F.format_string("%d rows of a symbol that is not tracked", "_rows"))
        .otherwise(F.format_string("%d rows without a readable time", "_undecoded")).alias("message"),
        F.when(unmapped, F.col("_rows")).otherwise(F.col("_undecoded")).cast("int").alias("bar_count"))

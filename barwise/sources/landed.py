"""SRC-1: a landing zone with a folder for each symbol, where a broken source stays one event.

The files are read as they are (``binaryFile``, so any store that Spark reads works, and files
spread over tasks) and decoded in the task, each by itself: a file that can't be decoded gives
one error row instead of failing the job, and all others load. A vendor's file holds one
request for one symbol; a file is decoded in memory, so a single one should stay well
below an executor's memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv
import pyarrow.json
import pyarrow.parquet
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.broadcast import checked_broadcast
from .vendor import MAX_SYMBOLS, VENDOR_RAW

FIELDS = [f.name for f in VENDOR_RAW.fields if f.name != "symbol"]
DECODED = ", ".join(["symbol string", "error string", *(f"{c} string" for c in FIELDS)])


def _csv(raw: bytes) -> pa.Table:
    as_text = pa.csv.ConvertOptions(column_types={c: pa.string() for c in FIELDS}, strings_can_be_null=True)
    return pa.csv.read_csv(pa.BufferReader(raw), convert_options=as_text)


DECODERS: dict[str, Callable[[bytes], pa.Table]] = {
    "parquet": lambda raw: pa.parquet.read_table(pa.BufferReader(raw)),
    "csv": _csv,
    "json": lambda raw: pa.json.read_json(pa.BufferReader(raw)),
}


def _text(table: pa.Table, name: str) -> pa.Array:
    if name not in table.column_names:
        return pa.nulls(len(table), pa.string())
    column = table.column(name)
    if pa.types.is_timestamp(column.type):  # without a zone: exchange wall time
        column = column.cast(pa.timestamp("us"))
    return pc.cast(column, pa.string()).combine_chunks()


def _decoder(fmt: str):
    decode = DECODERS[fmt]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["symbol", "error", *FIELDS]
        for batch in batches:
            for symbol, raw in zip(batch.column("symbol").to_pylist(), batch.column("content")):
                try:
                    table = decode(raw.as_py())
                    columns = [_text(table, c) for c in FIELDS]
                    n, error = len(table), None
                except (pa.ArrowException, ValueError, OSError, KeyError) as e:
                    columns, n, error = [pa.nulls(1, pa.string()) for _ in FIELDS], 1, f"{type(e).__name__}: {e}"[:500]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([symbol] * n, pa.string()), pa.array([error] * n, pa.string()),
                     *(c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns)], names=names)
    return task


def load_symbols(spark: SparkSession, path: str, fmt: str = "parquet", files: str | None = None) -> DataFrame:
    """Rows of ``<path>/symbol=<symbol>/<files>`` (``*.<fmt>`` by default): the vendor's columns as text, ``symbol`` from
    the folder, and ``error``, set on the one row of a file that can't be decoded."""
    given = spark.read.format("binaryFile").option("recursiveFileLookup", "true") \
        .option("pathGlobFilter", files or f"*.{fmt}").load(path)
    symbol = F.url_decode(F.regexp_extract("path", "/symbol=([^/]+)/", 1))
    return given.select(symbol.alias("symbol"), "content").mapInArrow(_decoder(fmt), DECODED)


def loaded_rows(loaded: DataFrame) -> DataFrame:
    """The rows of the files that could be decoded, for ``vendor.conform_vendor``."""
    return loaded.where(F.col("error").isNull()).drop("error")


def load_errors(loaded: DataFrame, symbol_dim: DataFrame) -> DataFrame:
    """One API_ERROR event for each symbol with files that can't be decoded."""
    failed = loaded.where(F.col("error").isNotNull()).groupBy("symbol").agg(F.count("*").alias("_files"))
    named = failed.join(checked_broadcast(symbol_dim.select("symbol", "ticker"), MAX_SYMBOLS), "symbol", "left")
    return named.select(
        F.lit("API_ERROR").alias("event_type"), F.coalesce("ticker", "symbol").alias("ticker"),
        F.format_string("%d delivered files of %s can't be read", "_files", "symbol").alias("message"),
        F.lit(0).alias("bar_count"))

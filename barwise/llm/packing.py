"""Texts compressed for a shuffle or a scratch table, and back."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    squeeze = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([squeeze.compress(t.as_buffer()) for t in part.column(1)], pa.binary())],
                names=["id", "packed"])


def packed(texts: DataFrame) -> DataFrame:
    """(id long, packed binary) of (id long, text string without nulls)."""
    return texts.mapInArrow(_pack, "id long, packed binary")


def unpacked(column: pa.Array) -> pa.Array:
    unzip = zstandard.ZstdDecompressor()
    return pa.array([unzip.decompress(x.as_buffer()) for x in column], pa.large_binary()).cast(pa.large_string())

"""Groups of any size as pairs of bounded blocks, and the rows of a block pair in a task.

A group (all rows of one key) is dealt into blocks of about ``rows`` rows by a hash of the row;
each pair of its blocks is a cell. A row goes to every cell of its block, so that a task holds
two blocks at most, and rows written grow with the group's members times its blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import linking
from .textarrays import runs


def sorted_cells(met: DataFrame, key: list[str], ident: list[str], rows: int, payload: DataFrame) -> DataFrame:
    """``met`` has the columns ``key`` and ``ident`` (a row of ``payload``). Every row of a key
    that two rows or more have, with its ``block``, once for each cell (p, q) of the key, with
    p <= q; partitioned by cell and sorted."""
    sizes = linking.landed(
        met.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")
        .select(*key, F.ceil(F.col("n") / rows).cast("int").alias("blocks")), "sizes")
    block = F.pmod(F.xxhash64(*ident), "blocks").cast("int").alias("block")
    dealt = met.join(sizes, key).select(*key, *ident, block, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    cells = dealt.select(*key, F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), *ident, "block")
    return cells.join(payload, ident).select(*cells.columns, *[c for c in payload.columns if c not in ident]) \
        .repartition(*key, "p", "q").sortWithinPartitions(*key, "p", "q", *ident)


def cell_rows(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """(values of ``names``, rows) for each run of equal values; the rows come sorted."""
    held: list[pa.RecordBatch] = []
    key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(x).to_numpy(zero_copy_only=False) for x in names]
        begin = runs(*columns)
        for a, b in zip(begin.tolist(), [*begin[1:].tolist(), batch.num_rows]):
            now = tuple(c[a] for c in columns)
            if held and now != key:
                yield key, pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            key = now
    if held:
        yield key, pa.Table.from_batches(held)


def matrix(column: pa.Array | pa.ChunkedArray, kind=np.float64) -> np.ndarray:
    """A list column whose lists all have one length, as rows of a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(kind)

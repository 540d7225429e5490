"""SNK-2/3/4: keyed upsert without a MERGE-capable table format.

``merge_frames`` is the relational core: the source is first reduced to one row per
key (a MERGE with two source rows for one target row is ambiguous), then a full outer
join on the key takes the source side where present. Counting matched and unmatched
source rows on the same join gives the merge metrics.

``operators.versions`` writes the result to a table: it merges the touched dates only and
publishes them as the table's next version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dedup_by_key(source: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """One row per key, partially aggregated before the shuffle: the row with the largest
    ``order`` column (the last delivered; it isn't part of the result), ties and no order
    by the largest row."""
    rest = [c for c in source.columns if c not in keys and c != order]
    ranked = ([order] if order else []) + rest
    if not ranked:
        return source.dropDuplicates(keys)
    best = F.max(F.struct(*[F.col(c) for c in ranked])).alias("_row")
    return source.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def joined(target: DataFrame, source: DataFrame, keys: list[str],
            order: str | None = None) -> tuple[DataFrame, list[str]]:
    """(full outer join, value columns): the target's values as ``_t_*``, the source's as
    ``_s_*``, and which side a row stands in."""
    src = dedup_by_key(source, keys, order)
    cols = [c for c in target.columns if c not in keys]
    t = target.select(*keys, *[F.col(c).alias(f"_t_{c}") for c in cols], F.lit(True).alias("_in_t"))
    s = src.select(*keys, *[F.col(c).alias(f"_s_{c}") for c in cols], F.lit(True).alias("_in_s"))
    return t.join(s, keys, "full_outer"), cols


def counts() -> list:
    """Inserted and updated rows of a ``joined`` frame."""
    s, t = F.col("_in_s").isNotNull(), F.col("_in_t").isNotNull()
    return [F.count_if(s & ~t).alias("num_inserted_rows"), F.count_if(s & t).alias("num_updated_rows")]


def taken(keys: list[str], cols: list[str]) -> list:
    """The merged columns of a ``joined`` frame: the source's values where it has the key."""
    from_s = F.col("_in_s").isNotNull()
    return [*keys, *[F.when(from_s, F.col(f"_s_{c}")).otherwise(F.col(f"_t_{c}")).alias(c) for c in cols]]


def merge_frames(target: DataFrame, source: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """Matched keys take all non-key values from the source; unmatched source rows are
    inserted; other target rows are kept."""
    j, cols = joined(target, source, keys, order)
    return j.select(*taken(keys, cols))


def merge_metrics(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """One row: inserted and updated source-row counts of the merge."""
    j, _ = joined(target, source, keys)
    return j.agg(*counts())


def duplicate_merge_event(metrics: DataFrame) -> DataFrame:
    """SNK-3: DUPLICATE_DETECTED (ticker ALL) when the merge updated existing rows."""
    u = F.col("num_updated_rows")
    return metrics.where(u > 0).select(
        F.lit("DUPLICATE_DETECTED").alias("event_type"), F.lit("ALL").alias("ticker"),
        F.format_string("%d delivered bars were already stored and replaced them", u).alias("message"),
        u.cast("int").alias("bar_count"))

"""Versioned tables: immutable files of a date, and a manifest that names them.

A version of a table is a small manifest: for each date, the write that holds its rows. A write
puts whole dates into a folder of its own (``data/commit=<id>/date=<date>``), which nothing
changes afterwards, and then publishes the next manifest. A manifest is written beside its
place and renamed to its number, refusing an existing one, so

* a reader has one version, whole, from the moment it took the manifest: it never sees half of
  a write, and an older version can be read for as long as it is kept;
* of two writers that started from one version, one is refused (``CommitConflict``). If the
  other's dates are none of its own, its files stay right and only the manifest is rebuilt
  on the newer version; otherwise the merge is repeated on it.

The rename is as atomic as the file system's (on HDFS it is; on object stores without a
conditional put there may be one writer at a time). A manifest grows with the dates, one a
calendar day, not with rows. ``changes`` compares two versions over the dates whose files
differ, so its cost follows what was written between them.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import drop_path, path_exists
from .upsert import counts, joined, taken

NO_DATE = "__HIVE_DEFAULT_PARTITION__"
BUCKET = "_bucket"


class CommitConflict(RuntimeError):
    """Another writer published this version first."""


@dataclass(frozen=True)
class Manifest:
    """A version of a table: for each date (as in the folder's name) the write that holds it."""
    version: int
    parts: dict[str, str] = field(default_factory=dict)
    operation: str = "create"
    inserted: int = 0
    updated: int = 0
    deleted: int = 0
    #: Of a derived table: the source's parts that this version was made from.
    source: dict[str, str] = field(default_factory=dict)
    #: Folders that a date is dealt over by the hash of ``bucket_by``; 0: none.
    buckets: int = 0
    bucket_by: str = ""

    def bucket(self, value: Column) -> Column:
        return F.pmod(F.xxhash64(value), F.lit(self.buckets)).cast("int")


@dataclass(frozen=True)
class Staged:
    """A write whose files are there and that no version names yet."""
    path: str
    base: Manifest
    commit: str
    parts: dict[str, str | None]  # None: the date has no rows any more
    operation: str
    inserted: int
    updated: int
    deleted: int


def _folder(spark: SparkSession, path: str):
    jvm = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm, jvm.getFileSystem(spark._jsc.hadoopConfiguration())


def _names(spark: SparkSession, path: str) -> list[str]:
    folder, fs = _folder(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []


def versions(spark: SparkSession, path: str) -> list[int]:
    """The versions that are kept, oldest first."""
    return sorted(int(n[:-5]) for n in _names(spark, f"{path}/_versions") if n.endswith(".json") and n[0] != ".")


def manifest(spark: SparkSession, path: str, version: int | None = None) -> Manifest:
    """The newest version or that one; an absent table is version 0, without rows."""
    if version is None:
        version = max(versions(spark, path), default=0)
    if version == 0:
        return Manifest(0)
    file, fs = _folder(spark, f"{path}/_versions/{version:012d}.json")
    stream = fs.open(file)
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return Manifest(**json.loads(text))


def _publish(spark: SparkSession, path: str, new: Manifest) -> Manifest:
    target, fs = _folder(spark, f"{path}/_versions/{new.version:012d}.json")
    beside, _ = _folder(spark, f"{path}/_versions/.{uuid.uuid4().hex}")
    stream = fs.create(beside, False)
    try:
        stream.write(bytearray(json.dumps(new.__dict__).encode()))
    finally:
        stream.close()
    hadoop = spark._jvm.org.apache.hadoop.fs
    keep = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 1)
    keep[0] = getattr(hadoop, "Options$Rename").NONE
    try:
        hadoop.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(beside, target, keep)
    except Py4JJavaError as e:
        fs.delete(beside, False)
        if "FileAlreadyExists" in e.java_exception.getClass().getName():
            raise CommitConflict(f"version {new.version} of {path} was published by another writer") from e
        raise
    return new


def _with_date(schema: T.StructType, date_col: str) -> T.StructType:
    return T.StructType([f for f in schema.fields if f.name != date_col] + [T.StructField(date_col, T.DateType())])


def _read(spark: SparkSession, path: str, schema: T.StructType, date_col: str, parts: dict[str, str]) -> DataFrame:
    """The rows of these dates' files, with the date column (a partition column)."""
    full = _with_date(schema, date_col)
    if not parts:
        return spark.createDataFrame([], full)
    data = f"{path}/data"
    folders = [f"{data}/commit={commit}/{date_col}={date}" for date, commit in sorted(parts.items())]
    return spark.read.schema(full).option("basePath", data).parquet(*folders).select(full.names)


def read_key(spark: SparkSession, path: str, schema: T.StructType, value: str, version: int | None = None,
             date_col: str = "date") -> DataFrame:
    """A version's rows of one value of the column that the table is dealt by. The bucket is a
    literal of a partition filter, so other buckets' files aren't read; files are sorted by
    key, so their statistics skip most of the bucket's other rows."""
    of = manifest(spark, path, version)
    if not of.buckets:
        raise ValueError(f"{path} is not dealt into buckets")
    stored = T.StructType([*schema.fields, T.StructField(BUCKET, T.IntegerType())])
    return _read(spark, path, stored, date_col, of.parts) \
        .where((F.col(BUCKET) == of.bucket(F.lit(value))) & (F.col(of.bucket_by) == F.lit(value))).select(schema.names)


def read(spark: SparkSession, path: str, schema: T.StructType, version: int | None = None,
         date_col: str = "date") -> DataFrame:
    """A version's rows (the newest by default) with the columns of ``schema``."""
    return _read(spark, path, schema, date_col, manifest(spark, path, version).parts).select(schema.names)


def _dates(df: DataFrame, date_col: str) -> list[str]:
    return [NO_DATE if r[0] is None else str(r[0]) for r in df.select(date_col).distinct().collect()]


def stage(spark: SparkSession, path: str, source: DataFrame | None, keys: list[str], order: str | None = None,
          remove: DataFrame | None = None, schema: T.StructType | None = None, date_col: str = "date",
          ts_col: str = "timestamp", base: Manifest | None = None, buckets: int = 0) -> Staged:
    """Merge ``source`` into the newest version: matched keys take the source's values, others
    are inserted; the keys of ``remove`` that the source doesn't have are dropped. Among source
    rows of one key the last by ``order`` wins. Writes the touched dates whole, and nothing
    that a reader sees. A new table may be dealt into ``buckets`` by its first key (for
    ``read_key``); it stays so."""
    base = base or manifest(spark, path)
    if buckets and not base.version:
        base = replace(base, buckets=buckets, bucket_by=keys[0])
    if source is None:
        source = spark.createDataFrame([], schema)
    src = source.withColumn(date_col, F.to_date(ts_col))
    columns = [c for c in src.columns if c != order]
    merge_keys = [*keys, date_col]
    dates = _dates(src, date_col)
    if remove is not None:
        remove = remove.select(*keys).distinct().withColumn(date_col, F.to_date(ts_col))
        dates = sorted({*dates, *_dates(remove, date_col)})
    schema = T.StructType([f for f in src.schema.fields if f.name in columns and f.name != date_col])
    target = _read(spark, path, schema, date_col, {d: base.parts[d] for d in dates if d in base.parts}) \
        .select(*columns)
    both, cols = joined(target, src, merge_keys, order)
    gone = F.lit(False)
    if remove is not None:
        both = both.join(remove.withColumn("_gone", F.lit(True)), merge_keys, "left")
        gone = F.col("_gone").isNotNull() & F.col("_in_s").isNull()
    commit = uuid.uuid4().hex
    counted = Observation()
    merged = both.observe(counted, *counts(), F.count_if(gone).alias("num_deleted_rows")).where(~gone) \
        .select(*taken(merge_keys, cols)).select(*columns)
    folders = [date_col]
    if base.buckets:
        folders = [date_col, BUCKET]
        merged = merged.withColumn(BUCKET, base.bucket(F.col(base.bucket_by))) \
            .repartition(*folders).sortWithinPartitions(*folders, *keys)
    merged.write.partitionBy(*folders).parquet(f"{path}/data/commit={commit}")
    n = counted.get
    written = {x.partition("=")[2] for x in _names(spark, f"{path}/data/commit={commit}") if x.startswith(f"{date_col}=")}
    return Staged(path, base, commit, {d: commit if d in written else None for d in dates}, "merge",
                  n["num_inserted_rows"], n["num_updated_rows"], n["num_deleted_rows"])


def publish(spark: SparkSession, staged: Staged) -> Manifest:
    """Make a staged write the next version. Raises ``CommitConflict`` if other writers have
    published versions since its base that touch a date of it."""
    base = staged.base
    while True:
        parts = {d: c for d, c in {**base.parts, **staged.parts}.items() if c}
        new = Manifest(base.version + 1, parts, staged.operation, staged.inserted, staged.updated, staged.deleted,
                       buckets=staged.base.buckets, bucket_by=staged.base.bucket_by)
        try:
            return _publish(spark, staged.path, new)
        except CommitConflict:
            newer = manifest(spark, staged.path)
            if newer.buckets != staged.base.buckets or any(
                    newer.parts.get(d) != staged.base.parts.get(d) for d in staged.parts):
                raise
            base = newer


def merge(spark: SparkSession, path: str, source: DataFrame | None, keys: list[str], attempts: int = 5,
          **options) -> Manifest:
    """``stage`` and ``publish``, repeated on the newer version where another writer was first."""
    for attempt in range(attempts):
        staged = stage(spark, path, source, keys, **options)
        try:
            return publish(spark, staged)
        except CommitConflict:
            drop_path(spark, f"{path}/data/commit={staged.commit}")
            if attempt == attempts - 1:
                raise
    raise ValueError("attempts must be 1 or more")


def clear(spark: SparkSession, path: str) -> Manifest:
    """A version without rows; older ones stay readable."""
    base = manifest(spark, path)
    return _publish(spark, path, replace(Manifest(base.version + 1, {}, "clear"), buckets=base.buckets,
                                         bucket_by=base.bucket_by))


def changes(spark: SparkSession, path: str, schema: T.StructType, keys: list[str], since: int,
            until: int | None = None, date_col: str = "date") -> DataFrame:
    """The rows that differ between two versions: the columns of ``schema`` (a deleted row's
    last values), ``change`` (insert, update or delete) and ``version`` (``until``). Only dates
    whose files differ are read."""
    old = manifest(spark, path, since)
    new = manifest(spark, path, until)
    dates = {d for d in {*old.parts, *new.parts} if old.parts.get(d) != new.parts.get(d)}
    cols = [c for c in schema.names if c not in keys]
    sides = [_read(spark, path, schema, date_col, {d: m.parts[d] for d in dates if d in m.parts})
             .select(*[F.col(k).alias(f"{side}_{k}") for k in keys],
                     F.struct(*cols).alias(f"{side}_row"), F.lit(True).alias(f"{side}_in"))
             for side, m in (("o", old), ("n", new))]
    same_key = [F.col(f"o_{k}").eqNullSafe(F.col(f"n_{k}")) for k in keys]
    both = sides[0].join(sides[1], same_key, "full_outer")
    change = F.when(F.col("o_in").isNull(), "insert").when(F.col("n_in").isNull(), "delete").otherwise("update")
    row = F.when(F.col("n_in").isNull(), F.col("o_row")).otherwise(F.col("n_row"))
    moved = both.where(F.col("o_in").isNull() | F.col("n_in").isNull() | ~F.col("o_row").eqNullSafe(F.col("n_row")))
    found = moved.select(*[F.coalesce(f"n_{k}", f"o_{k}").alias(k) for k in keys], row.alias("_row"),
                         change.alias("change"))
    return found.select(*[F.col(k) if k in keys else F.col(f"_row.{k}") for k in schema.names], "change",
                        F.lit(new.version).cast("long").alias("version"))


def land_changes(spark: SparkSession, path: str, feed: str, schema: T.StructType, keys: list[str]) -> list[int]:
    """Write the changes of every version that ``feed`` doesn't have yet to ``feed``, a folder
    for each version, and return their numbers. It can be repeated."""
    have = {int(n.partition("=")[2]) for n in _names(spark, feed)
            if n.startswith("version=") and path_exists(spark, f"{feed}/{n}/_SUCCESS")}
    kept = versions(spark, path)
    todo = [v for v in kept if v not in have]
    for v in todo:
        before = max((k for k in kept if k < v), default=0)
        changes(spark, path, schema, keys, before, v).drop("version") \
            .write.mode("overwrite").parquet(f"{feed}/version={v}")
    return todo


def derive(spark: SparkSession, source_path: str, path: str, schema: T.StructType,
           rows_of: Callable[[DataFrame], DataFrame], date_col: str = "date") -> Manifest:
    """Bring the table at ``path`` in step with the newest version of its source: the dates
    whose source files differ from those that it was last made from are made anew by ``rows_of``
    (from the source's rows, with the date column, to rows with the date column), others
    aren't read. Nothing is written where none differ."""
    base, source = manifest(spark, path), manifest(spark, source_path)
    dates = [d for d in {*base.source, *source.parts} if base.source.get(d) != source.parts.get(d)]
    if not dates:
        return base
    commit = uuid.uuid4().hex
    rows_of(_read(spark, source_path, schema, date_col, {d: source.parts[d] for d in dates if d in source.parts})) \
        .write.partitionBy(date_col).parquet(f"{path}/data/commit={commit}")
    written = {x.partition("=")[2] for x in _names(spark, f"{path}/data/commit={commit}")}
    parts = {d: commit if d in written else base.parts.get(d) for d in {*base.parts, *dates}
             if d in written or d not in dates}
    return _publish(spark, path, Manifest(base.version + 1, parts, "derive", source=source.parts))


def vacuum(spark: SparkSession, path: str, keep: int) -> None:
    """Drop all but the newest ``keep`` versions, and the files that none of these names. Not
    for a table that a slower reader or an unfinished writer still needs."""
    kept = versions(spark, path)
    old, kept = kept[:-keep], kept[-keep:]
    named = {c for v in kept for c in manifest(spark, path, v).parts.values()}
    for v in old:
        drop_path(spark, f"{path}/_versions/{v:012d}.json")
    for name in _names(spark, f"{path}/data"):
        if name.partition("=")[2] not in named:
            drop_path(spark, f"{path}/data/{name}")


def rolled_back(spark: SparkSession, path: str, version: int) -> Manifest:
    """The rows of an older version as the next one."""
    base = manifest(spark, path)
    return _publish(spark, path, replace(manifest(spark, path, version), version=base.version + 1,
                                         operation=f"restore {version}"))

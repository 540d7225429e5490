"""Structured Streaming jobs: bar stream -> stateful indicators -> foreachBatch sinks.

SRC-6/7: the stream reads the append-only landing zone of bar files (upserts go to a
derived table, so no rewritten file is ever re-read). STR-1..3/5/6: per-ticker state via
``transformWithStateInPandas`` (RocksDB state store), run to completion with
``availableNow``, recovered from ``checkpointLocation``. SNK-1/5: each micro-batch is
persisted once and written to directories keyed by batch id with overwrite, so a retried
batch replaces its own output instead of appending twice. STR-7/8: streaming resample
and re-delivery dedup with watermarks.
"""

from __future__ import annotations

import json
from collections import deque
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from .. import schemas
from ..config import DEFAULT, Params
from ..operators import indicators as IND
from ..operators import resample as RS
from ..operators import signals as SIG
from ..operators import sinks as K
from ..operators import upsert as U
from ..operators import versions as VT
from ..operators.sinks import read_if_present
from ..session import child_versions, drop_path, ensure_checkpoint_dir, path_exists, scratch_path
from .processor import OUTPUT, STATE_BUCKETS, RollingIndicatorProcessor, state_bucket
from .reorder import CLOSE, ReorderingProcessor

COOLDOWN = T.StructType([T.StructField("ticker", T.StringType()), T.StructField("signal", T.StringType()),
                         T.StructField("last_signal_time", T.TimestampNTZType())])
#: What a feed of ``versions.land_changes`` holds of a bar table.
BAR_CHANGES = T.StructType([*schemas.BARS.fields, T.StructField("change", T.StringType()),
                            T.StructField("version", T.LongType())])
METRIC_COLS = ["batch_id", "indicators", "signals", "buy", "sell"]
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Rows of a landed file at least, where a slice is dealt over several.
FILE_ROWS = 50_000


def land(df: DataFrame, path: str, files: int, ts_col: str = "timestamp") -> None:
    """Append ``df`` as ``files`` files (fewer if it is small), dealt by key and time."""
    df.repartition(files, "ticker", ts_col).write.mode("append").parquet(path)


def land_in_time_order(df: DataFrame, path: str, chunks: int, ts_col: str = "timestamp",
                       files_per_chunk: int | None = None, empty_after: int | None = None,
                       repeat_last: str | None = None) -> int:
    """Write ``df`` as ``chunks`` consecutive time slices, one append each, so file
    modification order equals time order (the file source reads files in that order). Each
    slice is dealt over as many files (the session's parallelism, fewer if a slice would have
    less than ``FILE_ROWS`` rows a file). ``empty_after`` adds empty files after that slice,
    ``repeat_last`` lands each slice's last rows (an interval up to its newest) again. Returns
    the number of files per slice (for ``maxFilesPerTrigger``)."""
    df = df.persist()
    span = df.agg(F.min(ts_col).alias("lo"), F.max(ts_col).alias("hi")).first()
    lo, hi = span["lo"], span["hi"]
    if lo is None:
        df.unpersist()
        return files_per_chunk or 1
    step = (hi - lo) / chunks
    edges = [lo + step * i for i in range(1, chunks)]
    bounds = [None] + edges + [None]
    slices = []
    for i in range(chunks):
        cond = F.lit(True)
        if bounds[i] is not None:
            cond = cond & (F.col(ts_col) >= F.lit(bounds[i]))
        if bounds[i + 1] is not None:
            cond = cond & (F.col(ts_col) < F.lit(bounds[i + 1]))
        slices.append(cond)
    if files_per_chunk is None:
        counts = df.agg(*[F.count_if(c).alias(f"n{i}") for i, c in enumerate(slices)]).first()
        files_per_chunk = max(1, min(df.sparkSession.sparkContext.defaultParallelism, min(counts) // FILE_ROWS))
    for i, cond in enumerate(slices):
        part = df.where(cond)
        land(part, path, files_per_chunk, ts_col)
        if i == empty_after:
            for _ in range(files_per_chunk):
                df.limit(0).coalesce(1).write.mode("append").parquet(path)
        if repeat_last:
            newest = part.agg(F.max(ts_col).alias("t")).first()["t"]
            again = F.col(ts_col) > F.lit(newest) - F.expr(f"INTERVAL {repeat_last}")
            land(part.where(again), path, files_per_chunk, ts_col)
    df.unpersist()
    return files_per_chunk


#: Bytes of landed files that a micro-batch takes (about 60 bytes a bar before compression).
DEFAULT_MAX_BYTES = 128 << 20


def bar_stream(spark: SparkSession, landing: str, max_files: int | None = None,
               max_bytes: int = DEFAULT_MAX_BYTES) -> DataFrame:
    """The landing zone as a stream. A micro-batch is always bounded, by bytes or, where
    ``max_files`` is given, by files: this bounds the rows that one ticker hands to the state
    update at once, also for ``availableNow`` runs over a large backlog."""
    bound = ("maxFilesPerTrigger", max_files) if max_files else ("maxBytesPerTrigger", max_bytes)
    return spark.readStream.schema(schemas.BARS).option(*bound).parquet(landing)


def indicator_stream(bars: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """STR-1: keyed stateful map in append mode (no timers)."""
    spark = bars.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    dealt = bars.select("ticker", "timestamp", "high", "low", "close", state_bucket().alias("bucket"))
    return dealt.groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=RollingIndicatorProcessor(p), outputStructType=OUTPUT,
        outputMode="append", timeMode="None")


def reordered_indicator_stream(bars: DataFrame, delay: str, p: Params = DEFAULT) -> DataFrame:
    """The stateful map behind a watermark: bars up to ``delay`` late are put in order inside
    the state, and rows come out once the watermark has passed them."""
    spark = bars.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    # the names reach Python as fields of a tuple, which can't begin with an underscore
    timed = bars.withColumn("event_time", F.col("timestamp").cast("timestamp")) \
        .withColumn("event_ms", F.unix_millis("event_time"))
    return timed.withWatermark("event_time", delay).groupBy("ticker").transformWithStateInPandas(
        statefulProcessor=ReorderingProcessor(p), outputStructType=OUTPUT, outputMode="append", timeMode="EventTime")


def land_close(spark: SparkSession, landing: str, delay: str) -> None:
    """Say that no bar up to now is outstanding (the end of a session): one row without prices,
    ``delay`` after the newest landed bar, moves the watermark past all of them."""
    newest = spark.read.schema(schemas.BARS).parquet(landing).agg(F.max("timestamp").alias("t"))
    row = newest.where("t is not null").select(
        F.lit(CLOSE).alias("ticker"), (F.col("t") + F.expr(f"INTERVAL {delay}") + F.expr("INTERVAL 1 second")).alias("timestamp"))
    schemas.conform(row, schemas.BARS).coalesce(1).write.mode("append").parquet(landing)


def _nan_to_null(df: DataFrame) -> DataFrame:
    return df.select(*[F.nanvl(F.col(c), F.lit(None).cast("double")).alias(c)
                       if c in IND.OUT_COLS[2:] else F.col(c) for c in df.columns])


@dataclass
class BatchSinks:
    """SNK-5: one micro-batch -> indicators (silver), signals after cooldown (gold),
    late bars, and the per-key latest stored signal time used by the next cooldown."""
    out: str
    p: Params = DEFAULT
    cooldown: bool = True
    #: The latest micro-batches' counts; a continuous stream keeps no longer history.
    metrics: deque = field(default_factory=lambda: deque(maxlen=1000))
    query: object = None

    def _kept(self, spark, name: str, batch_id: int, schema: T.StructType) -> DataFrame | None:
        """A small state table as of the newest version before this batch; empty micro-batches
        write no version, so its number may be any smaller one."""
        earlier = [v for v in child_versions(spark, f"{self.out}/{name}") if v < batch_id]
        return spark.read.schema(schema).parquet(f"{self.out}/{name}/v={max(earlier)}") if earlier else None

    def _keep(self, spark, name: str, batch_id: int, df: DataFrame) -> None:
        """Write this batch's version. The one before stays for a retry, older ones go."""
        df.write.mode("overwrite").parquet(f"{self.out}/{name}/v={batch_id}")
        for v in [v for v in child_versions(spark, f"{self.out}/{name}") if v < batch_id][:-1]:
            drop_path(spark, f"{self.out}/{name}/v={v}")

    def indicators(self, batch: DataFrame, batch_id: int) -> DataFrame:
        """The micro-batch's rows of ``OUTPUT``."""
        return _nan_to_null(batch)

    def finish(self, batch: DataFrame, batch_id: int) -> None:
        """What else is to be stored before the micro-batch counts as done."""

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        # persist first: every action on ``batch`` itself would re-run the stateful
        # operator of this micro-batch
        b = self.indicators(batch, batch_id).persist()
        try:
            if b.isEmpty():          # FLT-8: nothing to write for an empty micro-batch
                return
            ind = b.where(~F.col("is_late")).drop("is_late")
            late = b.where(F.col("is_late")).select("ticker", "timestamp", "close")
            obs_i = Observation(f"ind-{batch_id}")
            (ind.observe(obs_i, F.count(F.lit(1)).alias("indicators"))
             .write.mode("overwrite").parquet(f"{self.out}/silver/batch_id={batch_id}"))
            late.write.mode("overwrite").parquet(f"{self.out}/late/batch_id={batch_id}")

            sig = SIG.signals(ind, self.p)
            prev = self._kept(spark, "cooldown", batch_id, COOLDOWN) if self.cooldown else None
            if prev is not None:
                sig = SIG.apply_cooldown(sig, prev.withColumnRenamed("last_signal_time", "timestamp"),
                                         self.p).select(*SIG.SIGNAL_COLS)
            obs_s = Observation(f"sig-{batch_id}")
            gold_path = f"{self.out}/gold/batch_id={batch_id}"
            (sig.observe(obs_s, F.count(F.lit(1)).alias("signals"),
                         F.count_if(F.col("signal") == "BUY").alias("buy"),
                         F.count_if(F.col("signal") == "SELL").alias("sell"))
             .write.mode("overwrite").parquet(gold_path))
            if self.cooldown:
                stored = spark.read.parquet(gold_path).select("ticker", "signal", "timestamp")
                if prev is not None:
                    stored = stored.unionByName(prev.withColumnRenamed("last_signal_time", "timestamp"))
                self._keep(spark, "cooldown", batch_id, SIG.last_signal_times(stored))
            self.finish(batch, batch_id)
            self.metrics.append({"batch_id": batch_id, **obs_i.get, **obs_s.get})
        finally:
            b.unpersist()


@dataclass
class ChunkedSinks(BatchSinks):
    """The same outputs from a stream of plain bars, with the rolling state as a small table (a
    ticker's last ``state_rows`` bars and how many it has seen) in place of a Python state.

    A micro-batch and the stored tails go through the chunked indicator plan, so one ticker's
    bars are spread over tasks and no Python process ever holds them. Bars not newer than
    the stored tail, and repeats within the micro-batch but one, come out as late."""

    def _tails(self, batch: DataFrame, batch_id: int) -> tuple[DataFrame, DataFrame]:
        """(tail rows, last and seen of each ticker) as of the batch before."""
        tail = self._kept(batch.sparkSession, "tail", batch_id, schemas.ROLLING_TAIL)
        if tail is None:
            tail = schemas.empty(batch.sparkSession, schemas.ROLLING_TAIL)
        return tail, tail.groupBy("ticker").agg(F.max("timestamp").alias("_last"), F.max("seen").alias("_seen"),
                                                F.count("*").alias("_held"))

    def _fresh(self, batch: DataFrame, last: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(new bars, one for each key; late ones)"""
        rows = batch.select("ticker", "timestamp", "high", "low", "close")
        per_key = rows.groupBy("ticker", "timestamp").agg(F.count("*").alias("_n"),
                                                          F.max(F.struct("high", "low", "close")).alias("_row"))
        known = per_key.join(last.select("ticker", "_last"), "ticker", "left") \
            .withColumn("_old", F.coalesce(F.col("timestamp") <= F.col("_last"), F.lit(False)))
        fresh = known.where(~F.col("_old")).select("ticker", "timestamp", "_row.high", "_row.low", "_row.close")
        late = known.where(F.col("_old") | (F.col("_n") > 1)).select("ticker", "timestamp", "_row.close")
        return fresh, late

    def indicators(self, batch: DataFrame, batch_id: int) -> DataFrame:
        tail, last = self._tails(batch, batch_id)
        fresh, late = self._fresh(batch, last)
        rows = tail.drop("seen").unionByName(fresh)
        before = last.select("ticker", (F.col("_seen") - F.col("_held")).alias("_before"))
        out = IND.indicators_chunked(rows, self.p, self.p.chunk_rows, before=before)
        out = out.join(last.select("ticker", "_last"), "ticker", "left") \
            .where(F.col("_last").isNull() | (F.col("timestamp") > F.col("_last"))).drop("_last")
        nulls = [F.lit(None).cast("double").alias(c) for c in IND.OUT_COLS[3:]]
        return out.withColumn("is_late", F.lit(False)).select(OUTPUT.names).unionByName(
            late.select("ticker", "timestamp", "close", *nulls, F.lit(True).alias("is_late")).select(OUTPUT.names))

    def finish(self, batch: DataFrame, batch_id: int) -> None:
        tail, last = self._tails(batch, batch_id)
        fresh, _ = self._fresh(batch, last)
        new = fresh.groupBy("ticker").agg(F.count("*").alias("_new"))
        seen = last.select("ticker", "_seen").join(new, "ticker", "full_outer").select(
            "ticker", (F.coalesce("_seen", F.lit(0)) + F.coalesce("_new", F.lit(0))).alias("seen"))
        kept = IND.last_rows(tail.drop("seen").unionByName(fresh), self.p.state_rows)
        self._keep(batch.sparkSession, "tail", batch_id, kept.join(seen, "ticker").select(schemas.ROLLING_TAIL.names))


def run_chunked_stream(spark: SparkSession, landing: str, out: str, p: Params = DEFAULT, max_files: int | None = None,
                       cooldown: bool = True, checkpoint: str | None = None) -> BatchSinks:
    """Drain the landing zone through ``ChunkedSinks``."""
    ensure_checkpoint_dir(spark)
    sinks = ChunkedSinks(out, p, cooldown)
    sinks.query = (bar_stream(spark, landing, max_files).writeStream.foreachBatch(sinks)
                   .option("checkpointLocation", checkpoint or f"{out}/_checkpoint")
                   .trigger(availableNow=True).start())
    sinks.query.awaitTermination()
    return sinks


@dataclass
class TableCorrections:
    """SRC-7: changes of a versioned bar table -> corrected rows of a versioned indicator table.

    Each micro-batch of change rows names, for every ticker, its first changed time; from there
    on the ticker's indicators are recomputed over the bar table's newest version, and the
    rows of deleted bars go, in one version of the indicator table. It can be repeated."""
    bars: str
    indicators: str
    p: Params = DEFAULT

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        changed = batch.persist()
        try:
            if changed.isEmpty():
                return
            touched = changed.groupBy("ticker").agg(F.min("timestamp").alias("first_new"))
            fixed = IND.indicators_from(VT.read(spark, self.bars, schemas.BARS), touched, self.p, self.p.chunk_rows)
            gone = changed.where(F.col("change") == "delete").select(*schemas.BAR_KEY)
            VT.merge(spark, self.indicators, fixed.checkpoint(eager=True), schemas.BAR_KEY, remove=gone)
        finally:
            changed.unpersist()


def run_corrections(spark: SparkSession, bars: str, feed: str, indicators: str, checkpoint: str, p: Params = DEFAULT,
                    max_files: int | None = None) -> None:
    """Land the changes of the versions of ``bars`` that ``feed`` doesn't have, and drain the feed."""
    ensure_checkpoint_dir(spark)
    VT.land_changes(spark, bars, feed, schemas.BARS, schemas.BAR_KEY)
    bound = ("maxFilesPerTrigger", max_files) if max_files else ("maxBytesPerTrigger", DEFAULT_MAX_BYTES)
    (spark.readStream.schema(BAR_CHANGES).option(*bound).parquet(feed)
     .writeStream.foreachBatch(TableCorrections(bars, indicators, p))
     .option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination())


#: The parameters that a stored rolling state depends on.
STATE_PARAMS = ("sma_short", "sma_long", "rsi_period", "vortex_period", "vortex_min_rows", "warmup", "state_rows")


def check_state_params(spark: SparkSession, checkpoint: str, p: Params) -> None:
    """Refuse to resume a checkpoint whose state was kept under other windows; a new one
    notes its own."""
    noted, now = f"{checkpoint}_params", {name: getattr(p, name) for name in STATE_PARAMS}
    now["state_buckets"] = STATE_BUCKETS
    if not path_exists(spark, f"{noted}/_SUCCESS"):
        spark.createDataFrame([(json.dumps(now),)], "value string").coalesce(1).write.mode("overwrite").text(noted)
        return
    then = json.loads(spark.read.text(noted).first()[0])
    changed = sorted(name for name in now if then.get(name) != now[name])
    if changed:
        raise ValueError(f"the state in {checkpoint} was kept under other values of {', '.join(changed)}")


def stored_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """STR-5: what a checkpoint's rolling state holds for each ticker, read back from the state
    store: bars seen, bars kept, oldest and newest kept time."""
    state = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "tail").load()
    # a stream that puts bars in order keeps a value for each ticker, the plain one a map for each group
    key, value = ("key", "value") if "value" in state.columns else ("user_map_key", "user_map_value")
    at = lambda i: F.timestamp_micros(F.element_at(f"{value}.ts_us", i)).cast("timestamp_ntz")
    return state.select(F.col(f"{key}.ticker").alias("ticker"), F.col(f"{value}.n").alias("bars_seen"),
                        F.size(f"{value}.ts_us").alias("bars_kept"), at(1).alias("oldest_kept"), at(-1).alias("newest"))


def run_indicator_stream(spark: SparkSession, landing: str, out: str, p: Params = DEFAULT,
                         max_files: int | None = None, cooldown: bool = True,
                         checkpoint: str | None = None, trigger: dict | None = None,
                         state_partitions: int | None = None, late_delay: str | None = None) -> BatchSinks:
    """Start the stream, run until the landing zone is drained (availableNow), return
    the sink object (its ``metrics`` hold one dict per micro-batch).

    ``trigger`` defaults to ``{"availableNow": True}``; ``{"processingTime": "60 seconds"}``
    runs it continuously (STR-4). ``state_partitions`` sets the number of state-store
    partitions (the stateful operator's parallelism) for a new checkpoint; Spark keeps
    the number recorded in an existing checkpoint. With ``late_delay`` bars up to so late are
    put in order (``reordered_indicator_stream``); ``land_close`` lets the last ones out.
    """
    ensure_checkpoint_dir(spark)
    ckpt = checkpoint or f"{out}/_checkpoint"
    check_state_params(spark, ckpt, p)
    sinks = BatchSinks(out, p, cooldown)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    if state_partitions:
        spark.conf.set("spark.sql.shuffle.partitions", str(state_partitions))
    try:
        bars = bar_stream(spark, landing, max_files)
        q = ((reordered_indicator_stream(bars, late_delay, p) if late_delay else indicator_stream(bars, p))
             .writeStream.foreachBatch(sinks).outputMode("append")
             .option("checkpointLocation", ckpt)
             .trigger(**(trigger or {"availableNow": True}))
             .start())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    sinks.query = q
    if (trigger or {}).get("processingTime") is None:
        q.awaitTermination()
    return sinks


OUTPUTS = {"silver": schemas.INDICATORS, "gold": schemas.SIGNALS,
           "late": T.StructType([f for f in schemas.INDICATORS.fields if f.name in ("ticker", "timestamp", "close")])}


def read_output(spark: SparkSession, out: str, layer: str) -> DataFrame:
    """One sink layer (silver / gold / late) across all batches; empty before the first."""
    df = read_if_present(spark, f"{out}/{layer}", OUTPUTS[layer])
    return schemas.empty(spark, OUTPUTS[layer]) if df is None else df.select(OUTPUTS[layer].names)


def reconcile_late(bars: DataFrame, late: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Recompute, in batch, the indicators of every ticker that received a late bar
    (semi join on ticker), for an upsert into the indicator table."""
    touched = late.select("ticker").distinct()
    return IND.indicators_chunked(bars.join(touched, "ticker", "left_semi"), p, p.chunk_rows)


def corrected_indicators(spark: SparkSession, out: str, bars: DataFrame,
                         p: Params = DEFAULT) -> DataFrame:
    """The stream's indicator output with every ticker that received a late bar replaced
    by a batch recomputation over ``bars`` (the bar table, late bars included). Tickers
    without late bars keep the streamed rows; only the touched tickers are recomputed."""
    silver, late = read_output(spark, out, "silver"), read_output(spark, out, "late")
    touched = late.select("ticker").distinct()
    kept = silver.join(touched, "ticker", "left_anti")
    return kept.unionByName(reconcile_late(bars, late, p))


def publish_stream(spark: SparkSession, out: str, bars: DataFrame, root: str, run_id: int,
                   p: Params = DEFAULT) -> None:
    """Land a drained stream in the tables that the portfolio reads: its bars and indicators
    are upserted, its signals appended under ``run_id``. Where late bars came, a ticker's
    rows from its first late bar on are recomputed over the bar table first, indicators and
    signals both (the signals against the cooldown of what was stored before). ``bars`` are
    the landed bars. It can be repeated with its ``run_id``."""
    key = schemas.BAR_KEY
    VT.merge(spark, K.table_path(root, "raw_market_data"), bars, key)
    first_late = read_output(spark, out, "late").groupBy("ticker").agg(F.min("timestamp").alias("first_new"))
    stage = scratch_path(spark, "late-tickers")
    first_late.write.parquet(stage)
    first_late = spark.read.schema(first_late.schema).parquet(stage)

    def before_late(df: DataFrame) -> DataFrame:
        late = first_late.withColumnRenamed("ticker", "_t")
        return df.join(late, df["ticker"] == late["_t"], "left") \
            .where(F.col("first_new").isNull() | (F.col("timestamp") < F.col("first_new"))).drop("_t", "first_new")

    repaired = IND.indicators_from(K.read_layer(spark, root, "raw_market_data"), first_late, p, p.chunk_rows)
    silver = before_late(read_output(spark, out, "silver")).unionByName(repaired)
    VT.merge(spark, K.table_path(root, "technical_indicators"), silver, key)
    kept = before_late(read_output(spark, out, "gold"))
    stored = K.read_layer(spark, root, "trade_signals", but_batch=run_id).unionByName(kept)
    again = SIG.apply_cooldown(SIG.signals(repaired, p), stored, p).select(*SIG.SIGNAL_COLS)
    signals = kept.unionByName(again).checkpoint(eager=True)
    K.append_batch(signals, root, "trade_signals", run_id)
    drop_path(spark, stage)


# ---- STR-7 / STR-8 -------------------------------------------------------------------

def stream_resample(bars: DataFrame, minutes: int = 10, delay: str = "10 minutes") -> DataFrame:
    """Resample a bar stream; a window is emitted once the watermark (max event time
    minus ``delay``) passes its end. Watermarks need TIMESTAMP, so time is cast and the
    window start is cast back to wall time."""
    ts = bars.withColumn("_ts", F.col("timestamp").cast("timestamp"))
    agg = (ts.withWatermark("_ts", delay)
           .groupBy("ticker", F.window("_ts", f"{minutes} minutes").alias("_w"))
           .agg(*[a for a in RS.ohlcv_aggs("_ts")]))
    return agg.where(F.col("close").isNotNull()).select(
        "ticker", F.col("_w.start").cast("timestamp_ntz").alias("timestamp"),
        "open", "high", "low", "close", "volume")


def closing_windows(emitted: DataFrame, bars: DataFrame, minutes: int = 10) -> DataFrame:
    """The windows of a drained resample stream that no watermark has closed: the bars'
    windows without an emitted row, resampled in batch. With ``emitted`` they are complete."""
    start = F.window("timestamp", f"{minutes} minutes")["start"]
    open_bars = bars.withColumn("_w", start.cast("timestamp_ntz")) \
        .join(emitted.select("ticker", F.col("timestamp").alias("_w")), ["ticker", "_w"], "left_anti")
    return RS.resample(open_bars.drop("_w"), minutes)


def late_new_bars(kept: DataFrame, landed: DataFrame) -> DataFrame:
    """Bars that a drained dedup stream dropped as older than its watermark though their key
    was never delivered before: one row for each landed key without a kept row."""
    missing = landed.join(kept.select(*schemas.BAR_KEY), schemas.BAR_KEY, "left_anti")
    return U.dedup_by_key(missing, schemas.BAR_KEY).select(*landed.columns)


def stream_dedup(bars: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Drop re-delivered bars (same ticker and time) seen within the watermark delay. Bars
    older than the watermark are dropped too, repeated or not: ``late_new_bars`` finds the
    new ones among them."""
    ts = bars.withColumn("_ts", F.col("timestamp").cast("timestamp"))
    return (ts.withWatermark("_ts", delay)
            .dropDuplicatesWithinWatermark(["ticker", "_ts"]).drop("_ts"))


def run_to_parquet(df: DataFrame, out: str, checkpoint: str | None = None,
                   state_partitions: int | None = None) -> StreamingQuery:
    """Drain a streaming DataFrame into parquet with availableNow (``state_partitions``
    as in ``run_indicator_stream``); the ended query, for its progress."""
    spark = df.sparkSession
    before = spark.conf.get("spark.sql.shuffle.partitions")
    if state_partitions:
        spark.conf.set("spark.sql.shuffle.partitions", str(state_partitions))
    try:
        q = (df.writeStream.format("parquet").option("path", out)
             .option("checkpointLocation", checkpoint or f"{out}_checkpoint")
             .outputMode("append").trigger(availableNow=True).start())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    q.awaitTermination()
    return q

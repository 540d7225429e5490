"""Batch runs over the table layout of ``operators.sinks`` (bronze -> silver -> gold).

``ingest_bars``: conform landed vendor rows, resample, validate, upsert into the bar
table, append DQ events (also when every symbol fails). ``quality_checks``: DQ events over
the stored bars. ``refresh_signals``: indicators from the first new bar of each touched
ticker, upsert into the indicator table, signals after the cooldown against the stored
signals, appended. ``refresh_portfolio``: one portfolio step; the per-ticker frame is
checkpointed once, a new version of the portfolio is written and the trade rows appended.

Each run takes ``run_id`` (a number that grows from run to run) and ``as_of`` (detection /
trade time). Every step can be repeated with its ``run_id``, after a failure or after
success, and leaves the tables as one run does: it reads prior state without its own batch
(older portfolio version, signals, trade log, events), replaces its own batch, and facts
that its first attempt found before it changed a table (merge counts, touched tickers) are
kept under ``_run_facts`` and reused. Bars and indicators are published as one version each:
a reader sees none or all of a run's rows. A run that another writer's version refuses
(``versions.CommitConflict``) is repeated with its ``run_id``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT, Params
from ..operators import indicators as IND
from ..operators import portfolio as PF
from ..operators import quality as Q
from ..operators import resample as RS
from ..operators import signals as SIG
from ..operators import sinks as K
from ..operators import upsert as U
from ..operators import validate as V
from ..operators import versions as VT
from ..session import drop_path, scratch_path
from ..sources import vendor as VD

KEY = ["ticker", "timestamp"]


METRICS = "num_inserted_rows long, num_updated_rows long"
TOUCHED = "ticker string, first_new timestamp_ntz"


def ingest_bars(spark: SparkSession, raw: DataFrame, symbol_dim: DataFrame, root: str,
                run_id: int, as_of: Column, minutes: int = 10, p: Params = DEFAULT) -> DataFrame:
    """Returns the DQ events of the run (already appended)."""
    bars = RS.resample(VD.conform_vendor(raw, symbol_dim), minutes)
    classified = V.classify(bars, p).checkpoint(eager=True)
    clean = V.clean(classified)
    staged = VT.stage(spark, K.table_path(root, "raw_market_data"), clean, KEY)
    # what a repeated attempt could no longer count, as its own rows are stored by then
    counted = spark.createDataFrame([(staged.inserted, staged.updated)], METRICS)
    metrics = K.run_fact(spark, root, "merge_metrics", run_id, METRICS, counted)
    first = clean.groupBy("ticker").agg(F.min("timestamp").alias("first_new"))
    K.run_fact(spark, root, "touched", run_id, TOUCHED, first)
    events = Q.union_events(V.events(classified, p), VD.missing_sources(raw, symbol_dim),
                            VD.rejected_rows(raw, symbol_dim), U.duplicate_merge_event(metrics))
    K.append_batch(Q.to_event_log(events, as_of), root, "data_quality_events", f"ingest-{run_id}")
    VT.publish(spark, staged)
    return K.read_batch(spark, root, "data_quality_events", f"ingest-{run_id}")


def quality_checks(spark: SparkSession, root: str, run_id: int, as_of: Column,
                   p: Params = DEFAULT) -> DataFrame:
    """DQ-1..4 over the stored bars, appended to the DQ log."""
    bars = K.read_layer(spark, root, "raw_market_data")
    ev = Q.union_events(Q.low_bar_count(bars, p), Q.gap_events(bars, p),
                        Q.freshness(bars, as_of, p), Q.duplicate_events(bars))
    K.append_batch(Q.to_event_log(ev, as_of), root, "data_quality_events", f"checks-{run_id}")
    return K.read_batch(spark, root, "data_quality_events", f"checks-{run_id}")


def refresh_signals(spark: SparkSession, root: str, run_id: int, touched: DataFrame | None = None,
                    p: Params = DEFAULT) -> DataFrame:
    """Indicators of the touched tickers from their first new bar on, upserted; new signals
    after the cooldown against stored signals, appended. Returns the signals.

    ``touched`` (ticker, first_new) defaults to what ``ingest_bars`` noted under this run
    id; without either, everything is recomputed. A ticker's stored rows before its first
    new bar don't change, so what is read and written follows the new bars."""
    bars = K.read_layer(spark, root, "raw_market_data")
    if touched is None:
        touched = K.run_fact(spark, root, "touched", run_id, TOUCHED)
    # chunked plan: a ticker with a long history is split over several tasks
    if touched is None:
        ind = IND.indicators_chunked(bars, p, chunk_rows=p.chunk_rows)
    else:
        ind = IND.indicators_from(bars, touched, p, chunk_rows=p.chunk_rows)
    stage = scratch_path(spark, "indicators")
    ind.write.parquet(stage)
    ind = spark.read.schema(ind.schema).parquet(stage)
    VT.merge(spark, K.table_path(root, "technical_indicators"), ind, KEY)
    stored = K.read_layer(spark, root, "trade_signals", but_batch=run_id)
    last = SIG.last_signal_times(stored)
    cands = SIG.signals(ind, p).join(
        last.withColumnRenamed("last_signal_time", "_stored_max"), ["ticker", "signal"], "left")
    fresh = cands.where(F.col("_stored_max").isNull() | (F.col("timestamp") > F.col("_stored_max")))
    new = SIG.apply_cooldown(fresh.drop("_stored_max"), stored, p).select(*SIG.SIGNAL_COLS)
    new = new.checkpoint(eager=True)  # the write below replaces a directory of the table read
    K.append_batch(new, root, "trade_signals", run_id)
    drop_path(spark, stage)
    return K.read_batch(spark, root, "trade_signals", run_id)


def refresh_portfolio(spark: SparkSession, root: str, run_id: int, as_of: Column,
                      p: Params = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """The new portfolio version and the trade rows, both written under ``run_id``."""
    port = K.read_version(spark, root, "portfolio_state", before=run_id)
    bars = K.read_layer(spark, root, "raw_market_data")
    sig = K.read_layer(spark, root, "trade_signals")
    log = K.read_layer(spark, root, "trade_log", but_batch=run_id)
    new_port, rows = PF.portfolio_step(port, bars, sig, log, as_of, p, materialize=True)
    K.append_batch(rows, root, "trade_log", run_id)
    K.append_batch(new_port, root, "portfolio_state", run_id)
    return K.read_batch(spark, root, "portfolio_state", run_id), K.read_batch(spark, root, "trade_log", run_id)

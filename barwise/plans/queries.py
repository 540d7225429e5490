"""Registered queries (see SURVEY §7.4 for the map to operator IDs)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schemas as SC
from ..config import DEFAULT, GEN1
from ..operators import bar_stats as BS
from ..operators import indicators as IND
from ..operators import portfolio as PF
from ..operators import quality as Q
from ..operators import resample as RS
from ..operators import serving as SV
from ..operators import signals as SIG
from ..operators import sinks as K
from ..operators import upsert as U
from ..operators import validate as V
from ..operators import versions as VT
from ..session import scratch_path
from ..sources import adapters as A
from ..sources import landed as LD
from ..sources import tables as TB
from ..sources import vendor as VD
from ..streaming import jobs as J
from . import medallion as M
from . import oracle_sql as O
from . import portfolio_sql as PS
from .catalog import register

P = DEFAULT
W = O.with_ctes


# ---- flagship: events -> hourly bars -> indicators -> scored signals -----------

def _ind(bars):
    """Indicators with the skew-safe chunked plan (same values as the plain window): for
    tables of few tickers with long histories. Tables of many short tickers (user ticks)
    take ``IND.indicators``, whose single shuffle spreads over the tickers."""
    return IND.indicators_chunked(bars, P, chunk_rows=P.chunk_rows)


def _stored(df, name):
    """The frame written to scratch and read again: a table that several branches of a
    query read, derived once."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def flagship(spark, sf_dir):
    return SIG.signals(_ind(A.bars_1h(spark, sf_dir)), P)


register("all_signals_scored",
         W([O.EV, O.BARS_1H, *O.indicator_ctes("bars_1h"), *O.signal_ctes()],
           f"SELECT {O.SIG_SELECT} FROM sig"),
         O.SIG_DOUBLES)(flagship)


@register("buy_signals",
          W([O.EV, O.BARS_1H, *O.indicator_ctes("bars_1h"), *O.signal_ctes()],
            f"SELECT {O.SIG_SELECT} FROM sig WHERE signal = 'BUY'"),
          O.SIG_DOUBLES)
def buy_signals(spark, sf_dir):
    buy, _ = SIG.split_buy_sell(flagship(spark, sf_dir))
    return buy


@register("sell_signals",
          W([O.EV, O.BARS_1H, *O.indicator_ctes("bars_1h"), *O.signal_ctes()],
            f"SELECT {O.SIG_SELECT} FROM sig WHERE signal = 'SELL'"),
          O.SIG_DOUBLES)
def sell_signals(spark, sf_dir):
    _, sell = SIG.split_buy_sell(flagship(spark, sf_dir))
    return sell


# ---- indicators -----------------------------------------------------------------

IND_SQL = W([O.EV, O.BARS_1H, *O.indicator_ctes("bars_1h")], "SELECT * FROM ind")


@register("indicators", IND_SQL, O.IND_COLS)
def indicators(spark, sf_dir):
    return IND.indicators(A.bars_1h(spark, sf_dir), P)


@register("indicators_chunked", IND_SQL, O.IND_COLS,
          note="chunked form, 60-row chunks so every ticker spans many chunks")
def indicators_chunked(spark, sf_dir):
    return IND.indicators_chunked(A.bars_1h(spark, sf_dir), P, chunk_rows=60)


@register("indicators_many_keys",
          W([O.EV, O.USER_TICKS, *O.indicator_ctes("user_ticks")], "SELECT * FROM ind"),
          O.IND_COLS)
def indicators_many_keys(spark, sf_dir):
    return IND.indicators(A.user_ticks(spark, sf_dir), P)


@register("indicators_gen1_tail",
          W([O.EV, O.BARS_1H, *O.indicator_ctes("bars_1h", p=GEN1)], "SELECT * FROM ind"),
          O.IND_COLS)
def indicators_gen1_tail(spark, sf_dir):
    return IND.indicators_tail(A.bars_1h(spark, sf_dir), GEN1)


@register("rsi_zones",
          W([O.EV, O.BARS_1H, *O.indicator_ctes("bars_1h")],
            f"""SELECT ticker, timestamp, rsi,
                       CASE WHEN rsi > {O.dbl(P.rsi_overbought)} THEN 'overbought'
                            WHEN rsi < {O.dbl(P.rsi_oversold)} THEN 'oversold'
                            WHEN rsi IS NOT NULL THEN 'neutral' END AS rsi_zone
                FROM ind"""),
          ["rsi"])
def rsi_zones(spark, sf_dir):
    ind = IND.with_rsi_zone(_ind(A.bars_1h(spark, sf_dir)), P)
    return ind.select("ticker", "timestamp", "rsi", "rsi_zone")


@register("signals_gen1",
          W([O.EV, O.BARS_1H, *O.indicator_ctes("bars_1h", p=GEN1)],
            f"""SELECT ticker, timestamp, 'BUY' AS signal, close, sma20, sma50, rsi,
                       vortex_positive, vortex_negative
                FROM ind WHERE {O.buy_sql(GEN1)}"""),
          O.IND_COLS)
def signals_gen1(spark, sf_dir):
    return SIG.signals_gen1(IND.indicators_chunked(A.bars_1h(spark, sf_dir), GEN1, GEN1.chunk_rows), GEN1)


# ---- resample -----------------------------------------------------------------------

RESAMPLE_BODY = """SELECT ticker, time_bucket(INTERVAL '10 minutes', timestamp) AS timestamp,
                      arg_min(open, timestamp) FILTER (WHERE open IS NOT NULL) AS open,
                      max(high) AS high, min(low) AS low,
                      arg_max(close, timestamp) FILTER (WHERE close IS NOT NULL) AS close,
                      CAST(sum(volume) AS BIGINT) AS volume
               FROM bars_5m GROUP BY 1, 2 HAVING count(close) > 0"""
RESAMPLE_SQL = W([O.EV, O.BARS_5M], RESAMPLE_BODY)


@register("resample_10m", RESAMPLE_SQL, ["open", "high", "low", "close"])
def resample_10m(spark, sf_dir):
    return RS.resample(A.bars_5m(spark, sf_dir), 10)


@register("resample_dirty_1h",
          W([O.EV, O.BARS_10M, O.DIRTY_BARS],
            """SELECT ticker, time_bucket(INTERVAL '60 minutes', timestamp) AS timestamp,
                      arg_min(open, timestamp) FILTER (WHERE open IS NOT NULL) AS open,
                      max(high) AS high, min(low) AS low,
                      arg_max(close, timestamp) FILTER (WHERE close IS NOT NULL) AS close,
                      CAST(sum(volume) AS BIGINT) AS volume
               FROM dirty_bars GROUP BY 1, 2 HAVING count(close) > 0"""),
          ["open", "high", "low", "close"],
          note="null closes inside a window: last non-null close wins; all-null windows drop")
def resample_dirty(spark, sf_dir):
    return RS.resample(A.dirty_bars(spark, sf_dir), 60)


# ---- validation (circuit breaker) ---------------------------------------------------


CLASSIFIED = [
    O.EV, O.BARS_10M, O.DIRTY_BARS,
    ("ruled", f"""
      SELECT *, CASE
          WHEN open IS NULL OR isnan(open) OR high IS NULL OR isnan(high)
            OR low IS NULL OR isnan(low) OR close IS NULL OR isnan(close) THEN 1
          WHEN least(open, high, low, close) <= {O.dbl(P.min_valid_price)} THEN 2
          WHEN volume IS NULL OR volume < 0 THEN 3
          WHEN high < low THEN 4 END AS rule
      FROM dirty_bars"""),
    ("surv", """
      SELECT ticker, timestamp, open, high, low, close, volume,
             abs(close / lag(close) OVER (PARTITION BY ticker ORDER BY timestamp) - 1) AS pct_change
      FROM ruled WHERE rule IS NULL"""),
    ("cls", f"""
      SELECT *, CASE WHEN pct_change > {O.dbl(P.extreme_bar_pct_change)} THEN 5
                     WHEN pct_change > {O.dbl(P.max_bar_pct_change)} THEN 6 END AS rule FROM surv
      UNION ALL BY NAME
      SELECT ticker, timestamp, open, high, low, close, volume,
             CAST(NULL AS DOUBLE) AS pct_change, rule FROM ruled WHERE rule IS NOT NULL"""),
]

VALIDATE_EVENTS = [
    ("per_rule", """
      SELECT ticker, rule, count(*) AS n, max(pct_change) AS rule_max
      FROM cls WHERE rule IS NOT NULL GROUP BY ticker, rule"""),
    ("val_events", """
      SELECT CASE rule WHEN 1 THEN 'INVALID_PRICE' WHEN 2 THEN 'INVALID_PRICE'
                       WHEN 3 THEN 'INVALID_VOLUME' WHEN 4 THEN 'OHLC_INCONSISTENCY'
                       WHEN 5 THEN 'EXTREME_SPIKE_REMOVED' ELSE 'PRICE_SPIKE_FLAGGED' END AS event_type,
             ticker,
             CASE rule
               WHEN 1 THEN printf('%d bars dropped: a price is missing', n)
               WHEN 2 THEN printf('%d bars dropped: a price is not above 0.01', n)
               WHEN 3 THEN printf('%d bars dropped: the volume is below zero', n)
               WHEN 4 THEN printf('%d bars dropped: the high lies under the low', n)
               WHEN 5 THEN printf('%d bars dropped: the close moved over 50%% (at most %.1f%%)', n,
                                  round(worst * 1000) / 10)
               ELSE printf('%d bars kept though the close moved 20%% to 50%%, the ticker''s largest move being %.1f%%', n,
                           round(worst * 1000) / 10) END AS message,
             CAST(n AS INTEGER) AS bar_count
      FROM (SELECT *, max(rule_max) OVER (PARTITION BY ticker) AS worst FROM per_rule)"""),
]


@register("validate_clean",
          W(CLASSIFIED, "SELECT ticker, timestamp, open, high, low, close, volume FROM cls "
                        "WHERE rule IS NULL OR rule = 6"),
          ["open", "high", "low", "close"])
def validate_clean(spark, sf_dir):
    return V.clean(V.classify(A.dirty_bars(spark, sf_dir), P))


@register("validate_events", W(CLASSIFIED + VALIDATE_EVENTS, "SELECT * FROM val_events"))
def validate_events(spark, sf_dir):
    return V.events(V.classify(A.dirty_bars(spark, sf_dir), P), P)


# ---- data-quality checks ---------------------------------------------------------------

@register("bar_profile",
          W([O.EV, O.BARS_10M], "SELECT ticker, count(*) AS bar_count, min(timestamp) AS first_bar, "
                                "max(timestamp) AS last_bar FROM bars_10m GROUP BY ticker"))
def bar_profile(spark, sf_dir):
    return Q.bar_profile(A.bars_10m(spark, sf_dir))


LOW_BARS_SQL = (f"SELECT 'MISSING_BARS' AS event_type, ticker, "
                f"printf('%d bars stored, at least {P.min_expected_bars} wanted', count(*)) AS message, "
                f"CAST(count(*) AS INTEGER) AS bar_count FROM user_ticks GROUP BY ticker "
                f"HAVING count(*) < {P.min_expected_bars}")


@register("low_bar_count", W([O.EV, O.USER_TICKS], LOW_BARS_SQL))
def low_bar_count(spark, sf_dir):
    return Q.low_bar_count(A.user_ticks(spark, sf_dir), P)


GAPS = [("gaps", f"""
  SELECT ticker, prev_ts, timestamp,
         (epoch_us(timestamp) - epoch_us(prev_ts)) // 60000000 AS gap_minutes
  FROM (SELECT ticker, timestamp,
               lag(timestamp) OVER (PARTITION BY ticker ORDER BY timestamp) AS prev_ts
        FROM bars_10m)
  WHERE prev_ts IS NOT NULL
    AND (epoch_us(timestamp) - epoch_us(prev_ts)) // 60000000 > {P.gap_threshold_minutes}
    AND CAST(prev_ts AS DATE) = CAST(timestamp AS DATE)""")]


@register("intraday_gaps_top20",
          W([O.EV, O.BARS_10M, *GAPS],
            f"SELECT * FROM gaps ORDER BY gap_minutes DESC, ticker, timestamp LIMIT {P.gap_report_limit}"))
def intraday_gaps_top20(spark, sf_dir):
    return Q.top_gaps(A.bars_10m(spark, sf_dir), P)


GAP_EVENTS_SQL = (f"SELECT 'GAP_DETECTED' AS event_type, ticker, "
                  f"printf('%d minutes without a bar from %s to %s', gap_minutes, CAST(prev_ts AS VARCHAR), "
                  f"CAST(timestamp AS VARCHAR)) AS message, CAST(gap_minutes AS INTEGER) AS bar_count "
                  f"FROM gaps")


@register("gap_events", W([O.EV, O.BARS_10M, *GAPS], GAP_EVENTS_SQL))
def gap_events(spark, sf_dir):
    return Q.gap_events(A.bars_10m(spark, sf_dir), P)


FRESH_SQL = f"""
  SELECT 'STALE_DATA' AS event_type, 'ALL' AS ticker,
         printf('newest bar is %.1f hours old (%s)', round(h * 10) / 10, CAST(latest AS VARCHAR)) AS message,
         0 AS bar_count
  FROM (SELECT latest,
               CAST(epoch_us({O.ts(A.AS_OF)}) // 1000000 - epoch_us(latest) // 1000000 AS DOUBLE) / 3600.0 AS h
        FROM (SELECT max(timestamp) AS latest FROM bars_10m))
  WHERE latest IS NOT NULL AND h > {O.dbl(P.stale_hours)}"""


@register("freshness", W([O.EV, O.BARS_10M], FRESH_SQL))
def freshness(spark, sf_dir):
    return Q.freshness(A.bars_10m(spark, sf_dir), A.as_of_lit(), P)


DUP_SRC = ("dup_src", f"""
  SELECT * FROM bars_10m
  UNION ALL
  SELECT * FROM bars_10m WHERE CAST(timestamp AS DATE) = DATE '{A.REDELIVERED_DAY}'""")


def _redelivered(b):
    return b.unionByName(b.where(F.to_date("timestamp") == F.lit(A.REDELIVERED_DAY).cast("date")))


@register("duplicate_bars",
          W([O.EV, O.BARS_10M, DUP_SRC],
            "SELECT ticker, timestamp, count(*) AS cnt FROM dup_src GROUP BY 1, 2 HAVING count(*) > 1"))
def duplicate_bars(spark, sf_dir):
    return Q.duplicate_keys(_redelivered(A.bars_10m(spark, sf_dir)))


DUP_EVENT_SQL = """
  SELECT 'DUPLICATE_DETECTED' AS event_type, 'ALL' AS ticker,
         printf('%d bar keys are stored more than once', n) AS message,
         CAST(n AS INTEGER) AS bar_count
  FROM (SELECT count(*) AS n FROM (SELECT 1 FROM dup_src GROUP BY ticker, timestamp HAVING count(*) > 1))
  WHERE n > 0"""


@register("duplicate_events", W([O.EV, O.BARS_10M, DUP_SRC], DUP_EVENT_SQL))
def duplicate_events(spark, sf_dir):
    return Q.duplicate_events(_redelivered(A.bars_10m(spark, sf_dir)))


# ---- vendor landing: conform + missing sources ---------------------------------------

@register("conform_bars",
          W([O.EV, O.BARS_5M, O.SYMBOL_DIM, O.VENDOR_BARS], """
            SELECT d.ticker, v."Datetime" AS timestamp,
                   TRY_CAST(v."Open" AS DOUBLE) AS open, TRY_CAST(v."High" AS DOUBLE) AS high,
                   TRY_CAST(v."Low" AS DOUBLE) AS low, TRY_CAST(v."Close" AS DOUBLE) AS close,
                   TRY_CAST(v."Volume" AS BIGINT) AS volume
            FROM vendor_bars v JOIN symbol_dim d ON v.symbol = d.symbol"""),
          ["open", "high", "low", "close"])
def conform_bars(spark, sf_dir):
    return VD.conform_vendor(A.vendor_bars(spark, sf_dir), A.symbol_dim(spark, sf_dir))


def _text_rows(spark, sf_dir):
    """Bars as a SQL endpoint returns them: arrays of strings, and a manifest of their columns."""
    b = A.bars_5m(spark, sf_dir)
    slot = F.floor(F.unix_timestamp("timestamp") / 300).cast("long")
    cells = [F.col("ticker"), F.col("timestamp").cast("string"), F.when(slot % 97 == 0, "n/a").otherwise(F.col("close").cast("string")),
             F.col("volume").cast("string")]
    rows = b.select(F.array(*cells).alias("cells"))
    manifest = spark.createDataFrame([(2, "close", "DOUBLE"), (0, "ticker", "STRING"), (3, "volume", "BIGINT"),
                                      (1, "timestamp", "TIMESTAMP_NTZ"), (4, "note", "DATE")],
                                     "position int, name string, type string")
    return rows, manifest


@register("decode_by_manifest",
          W([O.EV, O.BARS_5M, O.VENDOR_BARS], """
            SELECT split_part(lower(symbol), '.', 1) AS ticker, "Datetime" AS timestamp,
                   TRY_CAST("Close" AS DOUBLE) AS close, TRY_CAST("Volume" AS BIGINT) AS volume, CAST(NULL AS DATE) AS note
            FROM vendor_bars"""),
          ["close"], note="rows of strings typed by a manifest that is data; bad and absent values are null")
def decode_by_manifest(spark, sf_dir):
    rows, manifest = _text_rows(spark, sf_dir)
    return VD.decode_rows(rows, manifest)


BROKEN = "click"


def _loaded_symbols(spark, sf_dir):
    """Vendor files landed in a folder for each symbol; those of one symbol hold no table."""
    path, broken = scratch_path(spark, "landed-symbols"), f"{BROKEN.upper()}.EV"
    raw = A.vendor_bars(spark, sf_dir)
    raw.where(F.col("symbol") != broken).write.partitionBy("symbol").parquet(path)
    raw.where(F.col("symbol") == broken).select(F.concat_ws(",", "Datetime", "Close").alias("value")) \
        .coalesce(1).write.text(f"{path}/symbol={broken}")
    return LD.load_symbols(spark, path, "parquet", files="part-*")


@register("load_symbols_bars",
          W([O.EV, O.BARS_5M, O.SYMBOL_DIM, O.VENDOR_BARS], f"""
            SELECT d.ticker, v."Datetime" AS timestamp,
                   TRY_CAST(v."Open" AS DOUBLE) AS open, TRY_CAST(v."High" AS DOUBLE) AS high,
                   TRY_CAST(v."Low" AS DOUBLE) AS low, TRY_CAST(v."Close" AS DOUBLE) AS close,
                   TRY_CAST(v."Volume" AS BIGINT) AS volume
            FROM vendor_bars v JOIN symbol_dim d ON v.symbol = d.symbol WHERE d.ticker <> '{BROKEN}'"""),
          ["open", "high", "low", "close"],
          note="a folder for each symbol, one of them unreadable: the others load")
def load_symbols_bars(spark, sf_dir):
    return VD.conform_vendor(LD.loaded_rows(_loaded_symbols(spark, sf_dir)), A.symbol_dim(spark, sf_dir))


@register("load_symbols_events",
          W([O.EV, O.BARS_5M, O.SYMBOL_DIM, O.VENDOR_BARS], f"""
            SELECT 'API_ERROR' AS event_type, ticker,
                   printf('1 delivered files of %s can''t be read', symbol) AS message, 0 AS bar_count
            FROM symbol_dim WHERE ticker = '{BROKEN}'
            UNION ALL
            SELECT 'MISSING_BARS', ticker, printf('No data returned for %s', symbol), 0
            FROM symbol_dim WHERE symbol NOT IN (SELECT DISTINCT symbol FROM vendor_bars) OR ticker = '{BROKEN}'"""),
          note="the unreadable symbol is one API_ERROR event, it and the absent one have no bars")
def load_symbols_events(spark, sf_dir):
    loaded, dim = _loaded_symbols(spark, sf_dir), A.symbol_dim(spark, sf_dir)
    return Q.union_events(LD.load_errors(loaded, dim), VD.missing_sources(LD.loaded_rows(loaded), dim))


MISSING_SQL = """
  SELECT 'MISSING_BARS' AS event_type, ticker, printf('No data returned for %s', symbol) AS message,
         0 AS bar_count
  FROM symbol_dim WHERE symbol NOT IN (SELECT DISTINCT symbol FROM vendor_bars)"""


@register("missing_sources", W([O.EV, O.BARS_5M, O.SYMBOL_DIM, O.VENDOR_BARS], MISSING_SQL))
def missing_sources(spark, sf_dir):
    return VD.missing_sources(A.vendor_bars(spark, sf_dir), A.symbol_dim(spark, sf_dir))


# ---- upsert ------------------------------------------------------------------------------

UPSERT_CTES = [
    O.EV, O.BARS_10M,
    ("tgt", f"SELECT * FROM bars_10m WHERE timestamp < {O.ts(A.UPSERT_TARGET_END)}"),
    ("src_raw", f"""
      SELECT ticker, timestamp, open, high, low, close + 0.5 AS close, volume
      FROM bars_10m WHERE timestamp >= {O.ts(A.UPSERT_SOURCE_START)}
      UNION ALL
      SELECT ticker, timestamp, open, high, low, close + 0.5 AS close, volume
      FROM bars_10m WHERE CAST(timestamp AS DATE) = DATE '{A.REDELIVERED_DAY}'"""),
    ("src", "SELECT DISTINCT * FROM src_raw"),
]


def _upsert_inputs(spark, sf_dir):
    b = A.bars_10m(spark, sf_dir)
    tgt = b.where(F.col("timestamp") < F.lit(A.UPSERT_TARGET_END).cast("timestamp_ntz"))
    src = (b.where(F.col("timestamp") >= F.lit(A.UPSERT_SOURCE_START).cast("timestamp_ntz"))
           .withColumn("close", F.col("close") + 0.5))
    src = src.unionByName(src.where(F.to_date("timestamp") == F.lit(A.REDELIVERED_DAY).cast("date")))
    return tgt, src


UPSERT_BODY = """
            SELECT coalesce(s.ticker, t.ticker) AS ticker, coalesce(s.timestamp, t.timestamp) AS timestamp,
                   CASE WHEN s.ticker IS NOT NULL THEN s.open ELSE t.open END AS open,
                   CASE WHEN s.ticker IS NOT NULL THEN s.high ELSE t.high END AS high,
                   CASE WHEN s.ticker IS NOT NULL THEN s.low ELSE t.low END AS low,
                   CASE WHEN s.ticker IS NOT NULL THEN s.close ELSE t.close END AS close,
                   CASE WHEN s.ticker IS NOT NULL THEN s.volume ELSE t.volume END AS volume
            FROM tgt t FULL OUTER JOIN src s ON t.ticker = s.ticker AND t.timestamp = s.timestamp"""
UPSERT_SQL = W(UPSERT_CTES, UPSERT_BODY)


@register("upsert_bars", UPSERT_SQL, ["open", "high", "low", "close"])
def upsert_bars(spark, sf_dir):
    tgt, src = _upsert_inputs(spark, sf_dir)
    return U.merge_frames(tgt, src, ["ticker", "timestamp"])


@register("upsert_path_table", UPSERT_SQL,
          ["open", "high", "low", "close"],
          note="two upserts into a versioned table on disk, the first with repeated keys, "
               "then read back")
def upsert_path_table(spark, sf_dir):
    tgt, src = _upsert_inputs(spark, sf_dir)
    path = scratch_path(spark, "upsert-table")
    VT.merge(spark, path, tgt.unionByName(tgt), SC.BAR_KEY)
    VT.merge(spark, path, src, SC.BAR_KEY)
    return VT.read(spark, path, SC.BARS)


def _two_versions(spark, sf_dir):
    """A bar table of three versions: a first load, an upsert, and a deletion of one day."""
    tgt, src = _upsert_inputs(spark, sf_dir)
    path = scratch_path(spark, "versioned")
    VT.merge(spark, path, tgt, SC.BAR_KEY)
    VT.merge(spark, path, src, SC.BAR_KEY)
    day = VT.read(spark, path, SC.BARS).where(F.to_date("timestamp") == F.lit(A.REDELIVERED_DAY).cast("date"))
    VT.merge(spark, path, None, SC.BAR_KEY, remove=day, schema=SC.BARS)
    return path


@register("table_versions",
          W(UPSERT_CTES, f"""
            SELECT 1 AS version, * FROM tgt
            UNION ALL SELECT 2, * FROM ({UPSERT_BODY})
            UNION ALL SELECT 3, * FROM ({UPSERT_BODY}) WHERE CAST(timestamp AS DATE) <> DATE '{A.REDELIVERED_DAY}'"""),
          ["open", "high", "low", "close"],
          note="every version of a table that was loaded, upserted and partly deleted, read after all of it")
def table_versions(spark, sf_dir):
    path = _two_versions(spark, sf_dir)
    read = [VT.read(spark, path, SC.BARS, v).select(F.lit(v).alias("version"), "*") for v in VT.versions(spark, path)]
    return read[0].unionByName(read[1]).unionByName(read[2])


@register("table_changes",
          W(UPSERT_CTES, f"""
            SELECT n.*, CASE WHEN t.ticker IS NULL THEN 'insert' ELSE 'update' END AS change, 2 AS version
            FROM ({UPSERT_BODY}) n LEFT JOIN tgt t ON t.ticker = n.ticker AND t.timestamp = n.timestamp
            WHERE t.ticker IS NULL OR t.open <> n.open OR t.high <> n.high OR t.low <> n.low
               OR t.close <> n.close OR t.volume <> n.volume
            UNION ALL
            SELECT n.*, 'delete', 3 FROM ({UPSERT_BODY}) n WHERE CAST(timestamp AS DATE) = DATE '{A.REDELIVERED_DAY}'"""),
          ["open", "high", "low", "close"],
          note="rows that the second and the third version inserted, updated or deleted")
def table_changes(spark, sf_dir):
    path = _two_versions(spark, sf_dir)
    return VT.changes(spark, path, SC.BARS, SC.BAR_KEY, 1, 2).unionByName(
        VT.changes(spark, path, SC.BARS, SC.BAR_KEY, 2, 3))


LAST_VERSION = [*UPSERT_CTES, ("last_bars", f"""
  SELECT * FROM ({UPSERT_BODY}) WHERE CAST(timestamp AS DATE) <> DATE '{A.REDELIVERED_DAY}'""")]


@register("stream_table_corrections",
          W([*LAST_VERSION, *O.indicator_ctes("last_bars")], "SELECT * FROM ind"), O.IND_COLS,
          note="a stream over a bar table that is rewritten: after its first load, and again after an "
               "upsert and a deletion, the changes correct the indicator table")
def stream_table_corrections(spark, sf_dir):
    tgt, src = _upsert_inputs(spark, sf_dir)
    bars, feed, ind, checkpoint = (scratch_path(spark, f"corrected-{x}") for x in ("bars", "feed", "ind", "offsets"))
    VT.merge(spark, bars, tgt, SC.BAR_KEY)
    J.run_corrections(spark, bars, feed, ind, checkpoint, P)
    VT.merge(spark, bars, src, SC.BAR_KEY)
    day = VT.read(spark, bars, SC.BARS).where(F.to_date("timestamp") == F.lit(A.REDELIVERED_DAY).cast("date"))
    VT.merge(spark, bars, None, SC.BAR_KEY, remove=day, schema=SC.BARS)
    J.run_corrections(spark, bars, feed, ind, checkpoint, P)
    return VT.read(spark, ind, SC.INDICATORS)


def _stats_in_step(spark, sf_dir):
    """Daily statistics refreshed after each of the table's three versions; both paths."""
    tgt, src = _upsert_inputs(spark, sf_dir)
    bars, stats = scratch_path(spark, "stats-bars"), scratch_path(spark, "stats")
    VT.merge(spark, bars, tgt, SC.BAR_KEY)
    BS.refresh(spark, bars, stats)
    VT.merge(spark, bars, src, SC.BAR_KEY)
    BS.refresh(spark, bars, stats)
    day = VT.read(spark, bars, SC.BARS).where(F.to_date("timestamp") == F.lit(A.REDELIVERED_DAY).cast("date"))
    VT.merge(spark, bars, None, SC.BAR_KEY, remove=day, schema=SC.BARS)
    BS.refresh(spark, bars, stats)
    return BS.read(spark, stats)


@register("stored_bar_profile",
          W(LAST_VERSION, """SELECT ticker, count(*) AS bar_count, min(timestamp) AS first_bar,
                             max(timestamp) AS last_bar FROM last_bars GROUP BY ticker"""),
          note="from daily statistics kept in step by touched dates")
def stored_bar_profile(spark, sf_dir):
    return BS.bar_profile(_stats_in_step(spark, sf_dir))


@register("stored_checks",
          W(LAST_VERSION, f"""
            SELECT 'MISSING_BARS' AS event_type, ticker,
                   printf('%d bars stored, at least {P.min_expected_bars} wanted', n) AS message,
                   CAST(n AS INTEGER) AS bar_count
            FROM (SELECT ticker, count(*) AS n FROM last_bars GROUP BY ticker) WHERE n < {P.min_expected_bars}
            UNION ALL {FRESH_SQL.replace("bars_10m", "last_bars")}"""),
          note="low counts, freshness and repeated keys from the daily statistics")
def stored_checks(spark, sf_dir):
    return BS.checks(_stats_in_step(spark, sf_dir), A.as_of_lit(), P)


@register("upsert_metrics",
          W(UPSERT_CTES, """
            SELECT count(*) FILTER (WHERE t.ticker IS NULL) AS num_inserted_rows,
                   count(*) FILTER (WHERE t.ticker IS NOT NULL) AS num_updated_rows
            FROM src s LEFT JOIN tgt t ON t.ticker = s.ticker AND t.timestamp = s.timestamp"""))
def upsert_metrics(spark, sf_dir):
    tgt, src = _upsert_inputs(spark, sf_dir)
    return U.merge_metrics(tgt, src, ["ticker", "timestamp"])


@register("upsert_event",
          W(UPSERT_CTES, """
            SELECT 'DUPLICATE_DETECTED' AS event_type, 'ALL' AS ticker,
                   printf('%d delivered bars were already stored and replaced them', n) AS message,
                   CAST(n AS INTEGER) AS bar_count
            FROM (SELECT count(*) AS n FROM src s JOIN tgt t
                  ON t.ticker = s.ticker AND t.timestamp = s.timestamp) WHERE n > 0"""))
def upsert_event(spark, sf_dir):
    tgt, src = _upsert_inputs(spark, sf_dir)
    return U.duplicate_merge_event(U.merge_metrics(tgt, src, ["ticker", "timestamp"]))


# ---- DQ event feed: every check, unioned, newest 15 with severity mark ---------------

def _mark_sql() -> str:
    arms = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in Q.EVENT_MARKS.items())
    return f"CASE event_type {arms} ELSE '{Q.UNKNOWN_MARK}' END"


FEED_CTES = ([O.EV, O.BARS_10M, O.BARS_5M, O.USER_TICKS] + CLASSIFIED[2:] + VALIDATE_EVENTS
             + GAPS + [DUP_SRC, O.SYMBOL_DIM, O.VENDOR_BARS] + UPSERT_CTES[2:])
FEED_UNION = " UNION ALL ".join(f"({s})" for s in [
    "SELECT * FROM val_events", LOW_BARS_SQL, GAP_EVENTS_SQL, FRESH_SQL, DUP_EVENT_SQL, MISSING_SQL])


def _all_events(spark, sf_dir):
    dirty = A.dirty_bars(spark, sf_dir)
    b10 = _stored(A.bars_10m(spark, sf_dir), "bars-10m")
    vendor, dim = A.vendor_bars(spark, sf_dir), A.symbol_dim(spark, sf_dir)
    return Q.union_events(V.events(V.classify(dirty, P), P),
                          Q.low_bar_count(A.user_ticks(spark, sf_dir), P),
                          Q.gap_events(b10, P),
                          Q.freshness(b10, A.as_of_lit(), P),
                          Q.duplicate_events(_redelivered(b10)),
                          VD.missing_sources(vendor, dim))


@register("dq_event_feed",
          W(FEED_CTES, f"""
            SELECT event_type, ticker, message, {O.ts(A.AS_OF)} AS detected_at, {_mark_sql()} AS mark
            FROM ({FEED_UNION}) ORDER BY detected_at DESC, event_type, ticker, message LIMIT 15"""))
def dq_event_feed(spark, sf_dir):
    return Q.recent_events(Q.to_event_log(_all_events(spark, sf_dir), A.as_of_lit()), 15)


@register("dq_event_counts",
          W(FEED_CTES, f"""
            SELECT event_type, count(*) AS events, CAST(sum(bar_count) AS BIGINT) AS bars
            FROM ({FEED_UNION}) GROUP BY event_type"""))
def dq_event_counts(spark, sf_dir):
    return _all_events(spark, sf_dir).groupBy("event_type").agg(
        F.count(F.lit(1)).alias("events"), F.sum("bar_count").alias("bars"))


@register("surrogate_ids",
          W(FEED_CTES, f"SELECT count(*) AS rows, count(*) AS ids, count(*) AS rebuilt FROM ({FEED_UNION})"),
          note="event rows, their distinct ids, and the ids found again in a second build")
def surrogate_ids(spark, sf_dir):
    first, second = (Q.to_event_log(_all_events(spark, sf_dir), A.as_of_lit()).select("event_id") for _ in range(2))
    again = second.distinct().withColumn("again", F.lit(1))
    return first.join(again, "event_id", "left").agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("event_id").alias("ids"), F.count("again").alias("rebuilt"))


# ---- portfolio and trade log (user tickers: thousands of keys) ----------------------


PORT = PS.port_ctes(P)
PORT_DOUBLES = ["avg_entry_price", "current_price", "unrealized_pnl", "realized_pnl"]
TRADE_DOUBLES = ["signal_score", "price", "pnl_realized", "stop_loss", "take_profit"]
TRIG_DOUBLES = ["avg_entry_price", "realized_pnl", "current_price", "exit_pnl"]


def _port_inputs(spark, sf_dir):
    bars = A.user_ticks(spark, sf_dir)
    sig = _stored(SIG.signals(IND.indicators(bars, P), P), "signals")
    return bars, sig, A.portfolio_prev(spark, sf_dir)


def _log_hist(sig):
    h = sig.where(F.col("timestamp") < F.lit(A.SPLIT_TS).cast("timestamp_ntz"))
    return h.select("ticker", "signal", "signal_score", F.col("close").alias("price"),
                    F.lit(P.buy_shares).cast("long").alias("quantity"),
                    F.lit(0.0).alias("pnl_realized"), "stop_loss", "take_profit", "timestamp")


@register("latest_price", W(PORT, "SELECT * FROM cp"), ["current_price"])
def latest_price(spark, sf_dir):
    return PF.current_prices(A.user_ticks(spark, sf_dir))


@register("latest_signal", W(PORT, "SELECT * FROM lv"), ["stop_loss", "take_profit"])
def latest_signal(spark, sf_dir):
    _, sig, _ = _port_inputs(spark, sf_dir)
    return PF.latest_buy_levels(sig)


@register("exit_triggers", W(PORT, "SELECT * FROM trig"), TRIG_DOUBLES)
def exit_triggers(spark, sf_dir):
    bars, sig, prev = _port_inputs(spark, sf_dir)
    return PF.exit_triggers(prev, bars, sig, P)


@register("exit_trades", W(PORT, "SELECT * FROM exits"), TRADE_DOUBLES)
def exit_trades(spark, sf_dir):
    bars, sig, prev = _port_inputs(spark, sf_dir)
    return PF.exit_trades(PF.exit_triggers(prev, bars, sig, P), A.as_of_lit())


@register("closed_positions", W(PORT, "SELECT * FROM pa"), PORT_DOUBLES)
def closed_positions(spark, sf_dir):
    bars, sig, prev = _port_inputs(spark, sf_dir)
    return PF.close_positions(prev, PF.exit_triggers(prev, bars, sig, P), A.as_of_lit())


@register("portfolio_updates", W(PORT, "SELECT * FROM upd"),
          ["current_price", "signal_score", "signal_price", "stop_loss", "take_profit"])
def portfolio_updates(spark, sf_dir):
    bars, sig, _ = _port_inputs(spark, sf_dir)
    return PF.portfolio_updates(bars, sig)


@register("new_trades", W(PORT, "SELECT * FROM nt"),
          ["current_price", "signal_score", "signal_price", "stop_loss", "take_profit"])
def new_trades(spark, sf_dir):
    bars, sig, prev = _port_inputs(spark, sf_dir)
    return PF.step_new_trades(PF.step_frame(prev, bars, sig, _log_hist(sig), A.as_of_lit(), P))


@register("trade_entries", W(PORT, "SELECT * FROM entries"), TRADE_DOUBLES)
def trade_entries(spark, sf_dir):
    bars, sig, prev = _port_inputs(spark, sf_dir)
    frame = PF.step_frame(prev, bars, sig, _log_hist(sig), A.as_of_lit(), P)
    return PF.step_trade_rows(frame, A.as_of_lit(), P).where(F.col("signal").isin("BUY", "SELL")) \
        .drop("trade_id", "created_at")


@register("portfolio_merge",
          W(PORT + PS.merge_ctes("portfolio_prev", "upd"), PS.merge_sql("mc_j", P)), PORT_DOUBLES)
def portfolio_merge(spark, sf_dir):
    bars, sig, prev = _port_inputs(spark, sf_dir)
    return PF.merge_portfolio(prev, PF.portfolio_updates(bars, sig), P)


@register("portfolio_merge_gen1",
          W(PORT + PS.merge_ctes("portfolio_prev", "upd"), PS.merge_gen1_sql("mc_j", P)),
          ["avg_entry_price", "current_price", "unrealized_pnl"])
def portfolio_merge_gen1(spark, sf_dir):
    bars, sig, prev = _port_inputs(spark, sf_dir)
    prev1 = SC.conform(prev, SC.PORTFOLIO_GEN1)
    return PF.merge_portfolio(prev1, PF.portfolio_updates(bars, sig), P, gen="gen1")


@register("merge_clause_counts",
          W(PORT + PS.merge_ctes("portfolio_prev", "upd"),
            f"SELECT clause, count(*) AS rows FROM (SELECT {PS.clause_sql()} AS clause FROM mc_j) "
            f"GROUP BY clause"))
def merge_clause_counts(spark, sf_dir):
    bars, sig, prev = _port_inputs(spark, sf_dir)
    return PF.merge_clause_counts(prev, PF.portfolio_updates(bars, sig))


@register("portfolio_step",
          W(PORT + PS.merge_ctes("pa", "upd"), PS.merge_sql("mc_j", P)), PORT_DOUBLES)
def portfolio_step(spark, sf_dir):
    bars, sig, prev = _port_inputs(spark, sf_dir)
    port, _ = PF.portfolio_step(prev, bars, sig, _log_hist(sig), A.as_of_lit(), P)
    return port


@register("step_trade_rows",
          W(PORT, "SELECT * FROM exits UNION ALL BY NAME SELECT * FROM entries"), TRADE_DOUBLES)
def step_trade_rows(spark, sf_dir):
    bars, sig, prev = _port_inputs(spark, sf_dir)
    _, rows = PF.portfolio_step(prev, bars, sig, _log_hist(sig), A.as_of_lit(), P)
    return rows.drop("trade_id", "created_at")


# ---- serving reads ---------------------------------------------------------------------


SIG_1H = [O.EV, O.BARS_1H, *O.indicator_ctes("bars_1h"), *O.signal_ctes()]
R2 = "CAST(100.0 AS DOUBLE)"


def _perf_sql(where: str = "") -> str:
    return f"""
        SELECT total_trades, buy_count, sell_count, auto_exits,
               round(pnl * {R2}) / {R2} AS total_pnl, round(win * {R2}) / {R2} AS avg_win,
               round(loss * {R2}) / {R2} AS avg_loss,
               CASE WHEN nz > 0 THEN CAST((wins * 2000 + nz) // (2 * nz) AS DOUBLE) / {O.dbl(10.0)}
               END AS win_rate
        FROM (SELECT count(*) AS total_trades,
                     count(*) FILTER (WHERE signal = 'BUY') AS buy_count,
                     count(*) FILTER (WHERE signal = 'SELL') AS sell_count,
                     count(*) FILTER (WHERE signal IN ('STOP_LOSS', 'TAKE_PROFIT')) AS auto_exits,
                     sum(coalesce(pnl_realized, 0.0)) AS pnl,
                     avg(CASE WHEN pnl_realized > 0 THEN pnl_realized END) AS win,
                     avg(CASE WHEN pnl_realized < 0 THEN pnl_realized END) AS loss,
                     count(*) FILTER (WHERE pnl_realized > 0) AS wins,
                     count(*) FILTER (WHERE pnl_realized <> 0) AS nz
              FROM trade_log {where})"""


@register("performance_summary", W([O.TRADE_LOG], _perf_sql()),
          ["total_pnl", "avg_win", "avg_loss", "win_rate"])
def performance_summary(spark, sf_dir):
    return SV.performance_summary(A.trade_log(spark, sf_dir))


def _perf_text_sql(where: str = "") -> str:
    return W([O.TRADE_LOG, ("perf", _perf_sql(where))], """
        SELECT CAST(total_trades AS VARCHAR) AS total_trades,
               coalesce(printf('$%.2f', total_pnl), 'N/A') AS realized_pnl,
               coalesce(printf('%.1f%%', win_rate), 'N/A') AS win_rate,
               coalesce(printf('$%.2f', avg_win), 'N/A') AS avg_win,
               coalesce(printf('$%.2f', avg_loss), 'N/A') AS avg_loss
        FROM perf""")


@register("performance_text", _perf_text_sql())
def performance_text(spark, sf_dir):
    return SV.performance_text(SV.performance_summary(A.trade_log(spark, sf_dir)))


@register("performance_text_buys", _perf_text_sql("WHERE signal = 'BUY'"),
          note="BUY trades only: no realized PnL, so averages and win rate show N/A")
def performance_text_buys(spark, sf_dir):
    log = A.trade_log(spark, sf_dir).where(F.col("signal") == "BUY")
    return SV.performance_text(SV.performance_summary(log))


@register("equity_curve",
          W([O.TRADE_LOG], """
            SELECT timestamp, pnl_realized,
                   sum(coalesce(pnl_realized, 0.0)) OVER (ORDER BY timestamp) AS cumulative_pnl
            FROM trade_log WHERE pnl_realized IS NOT NULL AND pnl_realized <> 0"""),
          ["pnl_realized", "cumulative_pnl"])
def equity_curve(spark, sf_dir):
    return SV.equity_curve(A.trade_log(spark, sf_dir))


@register("recent_trades",
          W([O.TRADE_LOG], """
            SELECT trade_id, ticker, signal, signal_score, price, quantity, pnl_realized, stop_loss,
                   take_profit, timestamp
            FROM trade_log ORDER BY timestamp DESC, trade_id DESC LIMIT 50"""),
          TRADE_DOUBLES)
def recent_trades(spark, sf_dir):
    return SV.recent_trades(A.trade_log(spark, sf_dir), 50)


@register("recent_signals",
          W(SIG_1H, """
            SELECT timestamp, signal, signal_score, close, sma20, sma50, rsi, vortex_positive,
                   vortex_negative, stop_loss, take_profit
            FROM (SELECT * FROM sig WHERE ticker = 'click'
                  ORDER BY timestamp DESC, signal DESC LIMIT 30)"""),
          O.SIG_DOUBLES)
def recent_signals(spark, sf_dir):
    return SV.recent_signals(flagship(spark, sf_dir), "click", 30)


@register("recent_indicators",
          W([O.EV, O.BARS_1H, *O.indicator_ctes("bars_1h")],
            "SELECT * FROM ind WHERE rsi IS NOT NULL ORDER BY timestamp DESC, ticker LIMIT 15"),
          O.IND_COLS)
def recent_indicators(spark, sf_dir):
    return SV.recent_indicators(_ind(A.bars_1h(spark, sf_dir)), 15)


@register("tickers", W([O.EV, O.BARS_10M], "SELECT DISTINCT ticker FROM bars_10m"))
def tickers(spark, sf_dir):
    return SV.tickers(A.bars_10m(spark, sf_dir))


@register("signal_counts",
          W(SIG_1H, "SELECT ticker, signal, count(*) AS count FROM sig GROUP BY ticker, signal"))
def signal_counts(spark, sf_dir):
    return SV.signal_counts(flagship(spark, sf_dir))


@register("layer_counts",
          W(SIG_1H + [O.BARS_10M, O.TRADE_LOG] + CLASSIFIED[2:] + VALIDATE_EVENTS, """
            SELECT 'raw_market_data' AS tbl, count(*) AS rows FROM bars_10m
            UNION ALL SELECT 'technical_indicators', count(*) FROM ind
            UNION ALL SELECT 'trade_signals', count(*) FROM sig
            UNION ALL SELECT 'trade_log', count(*) FROM trade_log
            UNION ALL SELECT 'data_quality_events', count(*) FROM val_events"""))
def layer_counts(spark, sf_dir):
    ind = _stored(_ind(A.bars_1h(spark, sf_dir)), "indicators")
    return SV.layer_counts(raw_market_data=A.bars_10m(spark, sf_dir), technical_indicators=ind,
                           trade_signals=SIG.signals(ind, P), trade_log=A.trade_log(spark, sf_dir),
                           data_quality_events=V.events(V.classify(A.dirty_bars(spark, sf_dir), P), P))


@register("active_positions",
          W(PORT + PS.merge_ctes("pa", "upd") + [("step", PS.merge_sql("mc_j", P))], """
            SELECT ticker, holdings, coalesce(avg_entry_price, 0.0) AS avg_entry_price,
                   coalesce(current_price, 0.0) AS current_price,
                   coalesce(unrealized_pnl, 0.0) AS unrealized_pnl,
                   coalesce(realized_pnl, 0.0) AS realized_pnl,
                   coalesce(total_trades, 0) AS total_trades
            FROM step WHERE holdings > 0"""),
          PORT_DOUBLES)
def active_positions(spark, sf_dir):
    bars, sig, prev = _port_inputs(spark, sf_dir)
    port, _ = PF.portfolio_step(prev, bars, sig, _log_hist(sig), A.as_of_lit(), P)
    return SV.active_positions(port)


def _label_sql(prefix: str = "") -> str:
    c = prefix
    return f"""concat_ws('<br>',
        printf('%s @ $%.2f', {c}signal, round({c}close * {R2}) / {R2}),
        CASE WHEN {c}signal_score IS NOT NULL AND NOT isnan({c}signal_score)
             THEN printf('Score: %.0f/100', round({c}signal_score)) END,
        CASE WHEN {c}stop_loss IS NOT NULL THEN printf('SL: $%.2f', round({c}stop_loss * {R2}) / {R2}) END,
        CASE WHEN {c}take_profit IS NOT NULL THEN printf('TP: $%.2f', round({c}take_profit * {R2}) / {R2}) END)"""


@register("signal_labels",
          W(SIG_1H, f"SELECT ticker, timestamp, signal, {_label_sql()} AS marker_text FROM sig"))
def signal_labels(spark, sf_dir):
    s = flagship(spark, sf_dir)
    return s.select("ticker", "timestamp", "signal", SIG.annotation(P).alias("marker_text"))


@register("chart_feed",
          W(SIG_1H, f"""
            SELECT b.ticker, b.timestamp, b.open, b.high, b.low, b.close, b.volume,
                   i.sma20, i.sma50, i.rsi, i.vortex_positive, i.vortex_negative,
                   s.signal, s.signal_score, s.stop_loss, s.take_profit,
                   CASE WHEN s.ticker IS NOT NULL THEN {_label_sql('s.')} END AS marker_text
            FROM bars_1h b
            LEFT JOIN ind i ON b.ticker = i.ticker AND b.timestamp = i.timestamp
            LEFT JOIN sig s ON b.ticker = s.ticker AND b.timestamp = s.timestamp
            WHERE b.ticker = 'view'"""),
          ["open", "high", "low", "close", "sma20", "sma50", "rsi", "vortex_positive",
           "vortex_negative", "signal_score", "stop_loss", "take_profit"])
def chart_feed(spark, sf_dir):
    return SV.chart_feed_from_bars(A.bars_1h(spark, sf_dir), "view", P)


@register("conform_evolved",
          W([O.EV, O.BARS_1H, *O.indicator_ctes("bars_1h", p=GEN1)], f"""
            SELECT ticker, timestamp, 'BUY' AS signal, CAST(NULL AS DOUBLE) AS signal_score, close,
                   sma20, sma50, rsi, vortex_positive, vortex_negative,
                   CAST(NULL AS DOUBLE) AS stop_loss, CAST(NULL AS DOUBLE) AS take_profit
            FROM ind WHERE {O.buy_sql(GEN1)}"""),
          O.SIG_DOUBLES)
def conform_evolved(spark, sf_dir):
    gen1 = SIG.signals_gen1(IND.indicators_chunked(A.bars_1h(spark, sf_dir), GEN1, GEN1.chunk_rows), GEN1)
    return SC.conform(gen1, SC.SIGNALS)


# ---- cooldown: candidates after a split vs stored history before it ------------------

def _cooldown_sql(bars: int) -> str:
    secs = bars * P.bar_interval_min * 60
    return W([O.EV, O.BARS_10M, *O.indicator_ctes("bars_10m", "ind10"), *O.signal_ctes("ind10", "sig10"),
              ("hist", f"SELECT * FROM sig10 WHERE timestamp < {O.ts(A.SPLIT_TS)}"),
              ("cand", f"SELECT * FROM sig10 WHERE timestamp >= {O.ts(A.SPLIT_TS)}"),
              ("last", "SELECT ticker, signal, max(timestamp) AS last_signal_time FROM hist GROUP BY 1, 2")],
             f"""SELECT c.* FROM cand c LEFT JOIN last l ON c.ticker = l.ticker AND c.signal = l.signal
                 WHERE l.last_signal_time IS NULL
                    OR epoch_us(c.timestamp) // 1000000 - epoch_us(l.last_signal_time) // 1000000 > {secs}""")


def _cooldown(spark, sf_dir, bars: int):
    sig = _stored(SIG.signals(_ind(A.bars_10m(spark, sf_dir)), P), "signals-10m")
    split = F.lit(A.SPLIT_TS).cast("timestamp_ntz")
    hist, cand = sig.where(F.col("timestamp") < split), sig.where(F.col("timestamp") >= split)
    return SIG.apply_cooldown(cand, hist, P.with_(cooldown_bars=bars)).select(*SIG.SIGNAL_COLS)


@register("signals_after_cooldown", _cooldown_sql(3), O.SIG_DOUBLES)
def signals_after_cooldown(spark, sf_dir):
    return _cooldown(spark, sf_dir, 3)


@register("signals_after_cooldown_36", _cooldown_sql(36), O.SIG_DOUBLES)
def signals_after_cooldown_36(spark, sf_dir):
    return _cooldown(spark, sf_dir, 36)


# ---- streaming (bars landed as time-ordered files, drained with availableNow) ----------


STREAM_CHUNKS = 4


def _state_parts(spark) -> int:
    """State-store partitions for a fresh stream checkpoint: the cluster's parallelism
    (not spark.sql.shuffle.partitions, which may be a batch-sized 200)."""
    return spark.sparkContext.defaultParallelism


def _stream_out(spark, sf_dir, cooldown: bool):
    bars = A.bars_1h(spark, sf_dir)
    landing = scratch_path(spark, "landing-1h")
    files = J.land_in_time_order(bars, landing, STREAM_CHUNKS, files_per_chunk=2)
    out = scratch_path(spark, "stream-out")
    J.run_indicator_stream(spark, landing, out, P, max_files=files, cooldown=cooldown,
                           state_partitions=_state_parts(spark))
    return out


@register("stream_indicators", IND_SQL, O.IND_COLS,
          note="stateful stream over bars_1h in 4 time-ordered file slices")
def stream_indicators(spark, sf_dir):
    return J.read_output(spark, _stream_out(spark, sf_dir, False), "silver")


@register("stream_indicators_many_keys",
          W([O.EV, O.USER_TICKS, *O.indicator_ctes("user_ticks")], "SELECT * FROM ind"),
          O.IND_COLS, note="one state entry per user ticker (thousands of keys), 4 slices")
def stream_indicators_many_keys(spark, sf_dir):
    ticks = A.user_ticks(spark, sf_dir)
    landing = scratch_path(spark, "landing-ticks")
    files = J.land_in_time_order(ticks, landing, STREAM_CHUNKS, files_per_chunk=4)
    out = scratch_path(spark, "stream-ticks-out")
    J.run_indicator_stream(spark, landing, out, P, max_files=files, cooldown=False,
                           state_partitions=_state_parts(spark))
    return J.read_output(spark, out, "silver")


@register("stream_signals",
          W([O.EV, O.BARS_1H, *O.indicator_ctes("bars_1h"), *O.signal_ctes()],
            f"SELECT {O.SIG_SELECT} FROM sig"),
          O.SIG_DOUBLES, note="per-batch signals before the cross-batch cooldown")
def stream_signals(spark, sf_dir):
    return J.read_output(spark, _stream_out(spark, sf_dir, False), "gold")


def _cooldown_slices_sql() -> str:
    """The cooldown slice by slice, as the stream applies it: a slice's candidates against
    the signals kept from the slices before it."""
    secs = P.cooldown_seconds
    ctes = [O.EV, O.BARS_10M, *O.indicator_ctes("bars_10m", "ind10"), *O.signal_ctes("ind10", "sig10"),
            ("edges", "SELECT min(epoch_us(timestamp)) AS lo, max(epoch_us(timestamp)) AS hi FROM bars_10m"),
            ("cut", f"""SELECT s.*, least({STREAM_CHUNKS - 1}, (epoch_us(timestamp) - lo) * {STREAM_CHUNKS} // (hi - lo))
                    AS slice FROM sig10 s, edges"""),
            ("kept0", f"SELECT {O.SIG_SELECT} FROM cut WHERE slice = 0")]
    for k in range(1, STREAM_CHUNKS):
        ctes.append((f"kept{k}", f"""
          SELECT * FROM kept{k - 1} UNION ALL
          SELECT {O.SIG_SELECT} FROM (
            SELECT c.*, l.last FROM cut c
            LEFT JOIN (SELECT ticker, signal, max(timestamp) AS last FROM kept{k - 1} GROUP BY 1, 2) l
            ON c.ticker = l.ticker AND c.signal = l.signal WHERE c.slice = {k})
          WHERE last IS NULL OR epoch_us(timestamp) // 1000000 - epoch_us(last) // 1000000 > {secs}"""))
    return W(ctes, f"SELECT * FROM kept{STREAM_CHUNKS - 1}")


def _land_with_empty_file(spark, bars, name):
    """Four time slices, and an empty delivery after the second; the folder and the files of a
    slice."""
    landing = scratch_path(spark, name)
    return landing, J.land_in_time_order(bars, landing, STREAM_CHUNKS, empty_after=1)


@register("stream_signals_cooldown", _cooldown_slices_sql(), O.SIG_DOUBLES,
          note="10-minute bars in 4 micro-batches and an empty one between them: signals within "
               "the cooldown of one stored by an earlier micro-batch are dropped")
def stream_signals_cooldown(spark, sf_dir):
    landing, files = _land_with_empty_file(spark, A.bars_10m(spark, sf_dir), "landing-cooldown")
    out = scratch_path(spark, "stream-cooldown")
    J.run_indicator_stream(spark, landing, out, P, max_files=files, cooldown=True,
                           state_partitions=_state_parts(spark))
    return J.read_output(spark, out, "gold")


@register("stream_batch_metrics",
          W([O.EV, O.BARS_10M, *O.indicator_ctes("bars_10m", "ind10"), *O.signal_ctes("ind10", "sig10"),
             ("edges", "SELECT min(epoch_us(timestamp)) AS lo, max(epoch_us(timestamp)) AS hi FROM bars_10m")], f"""
            SELECT slice + CASE WHEN slice >= 2 THEN 1 ELSE 0 END AS batch_id, count(*) AS indicators,
                   count(s.signal) AS signals, count(*) FILTER (WHERE s.signal = 'BUY') AS buy,
                   count(*) FILTER (WHERE s.signal = 'SELL') AS sell
            FROM (SELECT b.*, least({4 - 1}, (epoch_us(timestamp) - lo) * {4} // (hi - lo)) AS slice
                  FROM bars_10m b, edges) b
            LEFT JOIN sig10 s ON s.ticker = b.ticker AND s.timestamp = b.timestamp
            GROUP BY slice"""),
          note="counts of each micro-batch; the empty one writes nothing and has no row")
def stream_batch_metrics(spark, sf_dir):
    landing, files = _land_with_empty_file(spark, A.bars_10m(spark, sf_dir), "landing-metrics")
    out = scratch_path(spark, "stream-metrics")
    sinks = J.run_indicator_stream(spark, landing, out, P, max_files=files, cooldown=False,
                                   state_partitions=_state_parts(spark))
    return spark.createDataFrame([tuple(m[c] for c in J.METRIC_COLS) for m in sinks.metrics],
                                 ", ".join(f"{c} long" for c in J.METRIC_COLS))


@register("stream_processing_time", IND_SQL, O.IND_COLS,
          note="the same stream under a processing-time trigger, stopped once all is processed")
def stream_processing_time(spark, sf_dir):
    landing = scratch_path(spark, "landing-pt")
    files = J.land_in_time_order(A.bars_1h(spark, sf_dir), landing, STREAM_CHUNKS)
    out = scratch_path(spark, "stream-pt")
    sinks = J.run_indicator_stream(spark, landing, out, P, max_files=files, cooldown=False,
                                   trigger={"processingTime": "1 second"}, state_partitions=_state_parts(spark))
    try:
        sinks.query.processAllAvailable()
    finally:
        sinks.query.stop()
    return J.read_output(spark, out, "silver")


@register("stream_recovered", IND_SQL, O.IND_COLS,
          note="half of the bars drained, then a new query over the other half from the same "
               "checkpoint: state and file log are recovered")
def stream_recovered(spark, sf_dir):
    bars = A.bars_1h(spark, sf_dir)
    split = F.lit(A.SPLIT_TS).cast("timestamp_ntz")
    landing, out = scratch_path(spark, "landing-rec"), scratch_path(spark, "stream-rec")
    for part in (bars.where(F.col("timestamp") < split), bars.where(F.col("timestamp") >= split)):
        part.repartition(2, "ticker").write.mode("append").parquet(landing)
        J.run_indicator_stream(spark, landing, out, P, cooldown=False, checkpoint=f"{out}/_checkpoint",
                               state_partitions=_state_parts(spark))
    return J.read_output(spark, out, "silver")


@register("stream_state_check",
          W([O.EV, O.BARS_1H, ("ranked", """
              SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY timestamp DESC) AS r FROM bars_1h""")], f"""
            SELECT ticker, count(*) AS bars_seen, CAST(least(count(*), {P.state_rows}) AS INTEGER) AS bars_kept,
                   min(timestamp) FILTER (WHERE r <= {P.state_rows}) AS oldest_kept, max(timestamp) AS newest
            FROM ranked GROUP BY ticker"""),
          note="the rolling state read back from the state store after a restart, against the bars")
def stream_state_check(spark, sf_dir):
    bars = A.bars_1h(spark, sf_dir)
    split = F.lit(A.SPLIT_TS).cast("timestamp_ntz")
    landing, out = scratch_path(spark, "landing-state"), scratch_path(spark, "stream-state")
    for part in (bars.where(F.col("timestamp") < split), bars.where(F.col("timestamp") >= split)):
        J.land(part, landing, 2)
        J.run_indicator_stream(spark, landing, out, P, cooldown=False, state_partitions=_state_parts(spark))
    return J.stored_state(spark, f"{out}/_checkpoint")


@register("stream_indicators_late_repaired",
          W([O.EV, O.USER_TICKS, *O.indicator_ctes("user_ticks")], "SELECT * FROM ind"), O.IND_COLS,
          note="user ticks streamed without one day of some tickers, which arrives last: those "
               "bars are diverted as late and only their tickers are recomputed in batch")
def stream_indicators_late_repaired(spark, sf_dir):
    ticks = A.user_ticks(spark, sf_dir)
    held_back = F.col("ticker").endswith("3") & (F.to_date("timestamp") == F.lit(A.REDELIVERED_DAY).cast("date"))
    landing = scratch_path(spark, "landing-late")
    files = J.land_in_time_order(ticks.where(~held_back), landing, STREAM_CHUNKS)
    J.land(ticks.where(held_back), landing, files)
    out = scratch_path(spark, "stream-late-out")
    J.run_indicator_stream(spark, landing, out, P, max_files=files, cooldown=False,
                           state_partitions=_state_parts(spark))
    return J.corrected_indicators(spark, out, ticks, P)


@register("stream_dedup", W([O.EV, O.BARS_10M], "SELECT * FROM bars_10m"),
          ["open", "high", "low", "close"],
          note="bars_10m with repeats inside the watermark (dropped as duplicates), a day repeated "
               "after it, and new bars that arrive after it (found by the reconciliation)")
def stream_dedup(spark, sf_dir):
    landing = scratch_path(spark, "landing-dup")
    b = A.bars_10m(spark, sf_dir)
    slot = F.floor(F.unix_timestamp("timestamp") / 600)
    day = F.to_date("timestamp") == F.lit(A.REDELIVERED_DAY).cast("date")
    held_back = day & (slot % 7 == 0)
    sent = b.where(~held_back)
    files = J.land_in_time_order(sent, landing, 2, repeat_last="1 hour")
    J.land(b.where(day), landing, files)
    out = scratch_path(spark, "dedup-out")
    J.run_to_parquet(J.stream_dedup(J.bar_stream(spark, landing, files), "2 hours"), out,
                     state_partitions=_state_parts(spark))
    landed = spark.read.schema(SC.BARS).parquet(landing)
    kept = spark.read.schema(SC.BARS).parquet(out)
    return kept.unionByName(J.late_new_bars(kept, landed))


@register("stream_resample", RESAMPLE_SQL, ["open", "high", "low", "close"],
          note="windows closed by the watermark, and after the drain the rest resampled in batch")
def stream_resample(spark, sf_dir):
    landing = scratch_path(spark, "landing-5m")
    J.land_in_time_order(A.bars_5m(spark, sf_dir), landing, 4, files_per_chunk=2)
    out = scratch_path(spark, "resample-out")
    J.run_to_parquet(J.stream_resample(J.bar_stream(spark, landing, 2), 10, "10 minutes"), out,
                     state_partitions=_state_parts(spark))
    emitted = spark.read.schema(SC.BARS).parquet(out)
    landed = spark.read.schema(SC.BARS).parquet(landing)
    return emitted.unionByName(J.closing_windows(emitted, landed, 10).select(*SC.BARS.names))


@register("stream_indicators_hot_ticker", IND_SQL, O.IND_COLS,
          note="the rolling state as a table and the chunked plan in each micro-batch: no Python holds a "
               "ticker's bars (here in chunks of 500 rows)")
def stream_indicators_hot_ticker(spark, sf_dir):
    landing, out = scratch_path(spark, "landing-hot"), scratch_path(spark, "stream-hot")
    files = J.land_in_time_order(A.bars_1h(spark, sf_dir), landing, STREAM_CHUNKS)
    J.run_chunked_stream(spark, landing, out, P.with_(chunk_rows=500), max_files=files, cooldown=False)
    return J.read_output(spark, out, "silver")


@register("stream_indicators_reordered", IND_SQL, O.IND_COLS,
          note="bars arrive up to five hours late, out of order, within a watermark of six: the state "
               "puts them in order, none is diverted as late")
def stream_indicators_reordered(spark, sf_dir):
    landing, out = scratch_path(spark, "landing-shuffled"), scratch_path(spark, "stream-shuffled")
    late = F.make_dt_interval(hours=F.pmod(F.xxhash64("ticker", "timestamp"), F.lit(6)).cast("int"))
    arriving = A.bars_1h(spark, sf_dir).withColumn("_arrival", F.col("timestamp") + late)
    files = J.land_in_time_order(arriving, landing, STREAM_CHUNKS, ts_col="_arrival")
    J.land_close(spark, landing, "6 hours")
    J.run_indicator_stream(spark, landing, out, P, max_files=files, cooldown=False,
                           state_partitions=_state_parts(spark), late_delay="6 hours")
    return J.read_output(spark, out, "silver")


# ---- runs over the table layout ------------------------------------------------------

@register("stream_to_portfolio",
          W(PORT + PS.merge_ctes("pa", "upd"), PS.merge_sql("mc_j", P)), PORT_DOUBLES,
          note="user ticks streamed, one day of some tickers late; bars, indicators and signals "
               "land in the tables, late tickers repaired, and the portfolio step reads them")
def stream_to_portfolio(spark, sf_dir):
    root = scratch_path(spark, "layers-stream")
    ticks = A.user_ticks(spark, sf_dir)
    held_back = F.col("ticker").endswith("3") & (F.to_date("timestamp") == F.lit(A.REDELIVERED_DAY).cast("date"))
    landing, out = scratch_path(spark, "landing-tables"), scratch_path(spark, "stream-tables")
    files = J.land_in_time_order(ticks.where(~held_back), landing, STREAM_CHUNKS)
    J.land(ticks.where(held_back), landing, files)
    no_cooldown = P.with_(cooldown_bars=-10**9)
    J.run_indicator_stream(spark, landing, out, no_cooldown, max_files=files, cooldown=False,
                           state_partitions=_state_parts(spark))
    J.publish_stream(spark, out, spark.read.schema(SC.BARS).parquet(landing), root, 2, no_cooldown)
    K.append_batch(A.portfolio_prev(spark, sf_dir), root, "portfolio_state", 1)
    K.append_batch(_log_hist(K.read_layer(spark, root, "trade_signals")), root, "trade_log", 1)
    port, _ = M.refresh_portfolio(spark, root, 2, A.as_of_lit(), P)
    return port


RUN_CTES = [O.EV, O.BARS_5M, O.SYMBOL_DIM, O.VENDOR_BARS,
            ("landed", """
              SELECT d.ticker, v."Datetime" AS timestamp, TRY_CAST(v."Open" AS DOUBLE) AS open,
                     TRY_CAST(v."High" AS DOUBLE) AS high, TRY_CAST(v."Low" AS DOUBLE) AS low,
                     TRY_CAST(v."Close" AS DOUBLE) AS close, TRY_CAST(v."Volume" AS BIGINT) AS volume
              FROM vendor_bars v JOIN symbol_dim d ON v.symbol = d.symbol"""),
            ("dirty_bars", RESAMPLE_BODY.replace("bars_5m", "landed")), *CLASSIFIED[3:],
            ("run_bars", "SELECT ticker, timestamp, open, high, low, close, volume FROM cls WHERE rule IS NULL OR rule = 6"),
            *O.indicator_ctes("run_bars"), *O.signal_ctes()]


def _run_all(spark, sf_dir, root, run_id):
    M.ingest_bars(spark, A.vendor_bars(spark, sf_dir), A.symbol_dim(spark, sf_dir), root, run_id, A.as_of_lit())
    M.quality_checks(spark, root, run_id, A.as_of_lit())
    M.refresh_signals(spark, root, run_id)
    M.refresh_portfolio(spark, root, run_id, A.as_of_lit())


@register("medallion_retry",
          W(RUN_CTES, f"""
            SELECT ticker, signal, signal_score, close AS price,
                   CAST(CASE WHEN signal = 'BUY' THEN {P.buy_shares} ELSE 0 END AS BIGINT) AS quantity,
                   CAST(0 AS DOUBLE) AS pnl_realized, stop_loss, take_profit, timestamp
            FROM sig QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY timestamp DESC, signal DESC) = 1"""),
          TRADE_DOUBLES, note="all four steps run twice with one run id: the trade log is that of one run")
def medallion_retry(spark, sf_dir):
    root = scratch_path(spark, "layers-retry")
    for _ in range(2):
        _run_all(spark, sf_dir, root, 1)
    return K.read_layer(spark, root, "trade_log").drop("trade_id", "created_at")


@register("reset_then_ingest",
          W(RUN_CTES, """
            SELECT 'raw_market_data' AS tbl, count(*) AS rows FROM run_bars
            UNION ALL SELECT 'technical_indicators', 0 UNION ALL SELECT 'trade_signals', 0
            UNION ALL SELECT 'portfolio_state', 0
            UNION ALL SELECT 'trade_log', count(DISTINCT ticker) FROM sig"""),
          note="a full run, the guarded reset, and an ingest into the emptied layers")
def reset_then_ingest(spark, sf_dir):
    root = scratch_path(spark, "layers-reset")
    _run_all(spark, sf_dir, root, 1)
    K.reset_layers(spark, root, confirm=True)
    M.ingest_bars(spark, A.vendor_bars(spark, sf_dir), A.symbol_dim(spark, sf_dir), root, 2, A.as_of_lit())
    names = ["raw_market_data", "technical_indicators", "trade_signals", "portfolio_state", "trade_log"]
    return SV.layer_counts(**{n: K.read_layer(spark, root, n) for n in names})


# ---- SNK-4: keyed upsert of indicators (a recomputation over a later window) ---------

UPSERT_IND_CTES = [
    O.EV, O.BARS_1H, *O.indicator_ctes("bars_1h"),
    ("late_bars", f"SELECT * FROM bars_1h WHERE timestamp >= {O.ts(A.UPSERT_SOURCE_START)}"),
    *O.indicator_ctes("late_bars", "rind"),
    ("itgt", f"SELECT * FROM ind WHERE timestamp < {O.ts(A.UPSERT_TARGET_END)}"),
]


@register("upsert_indicators",
          W(UPSERT_IND_CTES, """
            SELECT coalesce(s.ticker, t.ticker) AS ticker, coalesce(s.timestamp, t.timestamp) AS timestamp,
                   CASE WHEN s.ticker IS NOT NULL THEN s.close ELSE t.close END AS close,
                   CASE WHEN s.ticker IS NOT NULL THEN s.sma20 ELSE t.sma20 END AS sma20,
                   CASE WHEN s.ticker IS NOT NULL THEN s.sma50 ELSE t.sma50 END AS sma50,
                   CASE WHEN s.ticker IS NOT NULL THEN s.rsi ELSE t.rsi END AS rsi,
                   CASE WHEN s.ticker IS NOT NULL THEN s.vortex_positive ELSE t.vortex_positive END
                     AS vortex_positive,
                   CASE WHEN s.ticker IS NOT NULL THEN s.vortex_negative ELSE t.vortex_negative END
                     AS vortex_negative
            FROM itgt t FULL OUTER JOIN rind s ON t.ticker = s.ticker AND t.timestamp = s.timestamp"""),
          O.IND_COLS,
          note="indicators up to a cut, overwritten by a recomputation that starts later "
               "(its warm-up rows replace the stored values, as a re-run would)")
def upsert_indicators(spark, sf_dir):
    bars = A.bars_1h(spark, sf_dir)
    stored = _ind(bars).where(
        F.col("timestamp") < F.lit(A.UPSERT_TARGET_END).cast("timestamp_ntz"))
    recomputed = _ind(bars.where(
        F.col("timestamp") >= F.lit(A.UPSERT_SOURCE_START).cast("timestamp_ntz")))
    return U.merge_frames(stored, recomputed, ["ticker", "timestamp"])


# ---- SRV-2 / SRC-5 / FLT-1/2: one ticker's bars, non-null indicators, signals ---------


TICKER = "purchase"


@register("ticker_bars",
          W([O.EV, O.BARS_1H], f"SELECT * FROM bars_1h WHERE ticker = '{TICKER}'"),
          ["open", "high", "low", "close"])
def ticker_bars(spark, sf_dir):
    return TB.scan_ticker(A.bars_1h(spark, sf_dir), TICKER)


@register("ticker_bars_stored",
          W(UPSERT_CTES, f"SELECT * FROM ({UPSERT_BODY}) WHERE ticker = '{TICKER}'"),
          ["open", "high", "low", "close"],
          note="one ticker of a versioned table whose dates are dealt into buckets by ticker: only its "
               "bucket's files are read")
def ticker_bars_stored(spark, sf_dir):
    tgt, src = _upsert_inputs(spark, sf_dir)
    path = scratch_path(spark, "bucketed")
    VT.merge(spark, path, tgt, SC.BAR_KEY, buckets=8)
    VT.merge(spark, path, src, SC.BAR_KEY)
    return VT.read_key(spark, path, SC.BARS, TICKER)


@register("ticker_indicators",
          W([O.EV, O.BARS_1H, *O.indicator_ctes("bars_1h")],
            f"SELECT * FROM ind WHERE ticker = '{TICKER}' AND rsi IS NOT NULL"),
          O.IND_COLS)
def ticker_indicators(spark, sf_dir):
    return TB.scan_ticker(_ind(A.bars_1h(spark, sf_dir)), TICKER, not_null="rsi")


@register("ticker_signals", W(SIG_1H, f"SELECT {O.SIG_SELECT} FROM sig WHERE ticker = '{TICKER}'"),
          O.SIG_DOUBLES)
def ticker_signals(spark, sf_dir):
    return TB.scan_ticker(flagship(spark, sf_dir), TICKER)

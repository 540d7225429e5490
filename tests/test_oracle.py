"""Every registered query against its SQL oracle (DuckDB) on the smallest tables."""

import duckdb
import pytest

from barwise.plans.catalog import load_all

TABLES = ["orders", "events"]
REG = load_all()


def _canon(rows):
    return sorted(tuple("<null>" if v is None else (repr(round(v, 6)) if isinstance(v, float) else str(v))
                        for v in r) for r in rows)


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(n for n, q in REG.items() if q.sql))
def test_query_matches_oracle(spark, con, sf_dir, name):
    q = REG[name]
    df = q.build(spark, sf_dir)
    cols = sorted(df.columns)
    got = [tuple(r[c] for c in cols) for r in df.collect()]
    rel = con.sql(q.sql)
    assert sorted(rel.columns) == cols
    idx = [rel.columns.index(c) for c in cols]
    want = [tuple(r[i] for i in idx) for r in rel.fetchall()]
    assert _canon(got) == _canon(want)


def test_entry_runs(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert set(E.queries()) >= set(E.oracle_sql())
    assert df.count() > 0
    assert df.columns == ["ticker", "timestamp", "signal", "signal_score", "close", "sma20", "sma50",
                          "rsi", "vortex_positive", "vortex_negative", "stop_loss", "take_profit"]


@pytest.mark.parametrize("name", ["validate_events", "intraday_gaps_top20", "freshness",
                                  "equity_curve", "indicators_chunked", "stream_resample"])
def test_results_do_not_depend_on_session_time_zone(spark, con, sf_dir, name):
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        test_query_matches_oracle(spark, con, sf_dir, name)
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)

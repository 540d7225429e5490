"""Benchmark the headline queries; prints ONE JSON line.

env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
     BENCH_RUNS (timed runs per query, default 3), BENCH_QUERIES (comma list, optional).
Each query is executed in full through the ``noop`` sink (no collect); a query's time
is the median of the timed runs after one warm-up run.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "all_signals_scored", "indicators", "indicators_chunked", "indicators_many_keys",
    "resample_10m", "validate_clean", "validate_events", "intraday_gaps_top20",
    "upsert_bars", "portfolio_step", "step_trade_rows", "signals_after_cooldown",
    "performance_summary", "equity_curve", "dq_event_feed", "chart_feed",
]
STREAMING = ["stream_indicators"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]

    from barwise.plans.catalog import load_all
    from barwise.session import build_session

    spark = build_session(f"local[{cpus}]", shuffle_partitions=max(cpus, 8), app_name="barwise-bench")
    reg = load_all()
    names = only or HEADLINE + STREAMING
    times: dict[str, float] = {}
    for name in names:
        q = reg[name]
        # streaming queries start a stateful stream per run: one warm-up, one timed run
        n_runs = 1 if name in STREAMING else runs
        samples = []
        for i in range(n_runs + 1):
            t0 = time.perf_counter()
            q.build(spark, sf_dir).write.format("noop").mode("overwrite").save()
            dt = time.perf_counter() - t0
            if i > 0:
                samples.append(dt)
        times[name] = round(statistics.median(samples), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({
        "metric": "sum_of_median_query_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": sf,
        "cpus": cpus,
        "spark": spark.version,
    }))
    spark.stop()


if __name__ == "__main__":
    main()

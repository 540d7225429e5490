"""Summarise the executed physical plan of every registered query (after AQE).

usage: python tools/plan_report.py [sf_dir] > PLANS.md; further arguments: only these queries
Counts shuffles, scans, window and sort operators, and lists steps that run in a
single partition, so plan regressions show up as a diff.
"""

from __future__ import annotations

import re
import sys

sys.path.insert(0, ".")

STREAMING = ("stream_",)


def summarise(plan: str) -> dict:
    lines = plan.splitlines()
    single = sorted({re.sub(r"^[\s:+\-*()]*", "", ln).split(",")[0][:60]
                     for ln in lines if "SinglePartition" in ln})
    return {
        "exchanges": sum("Exchange hashpartitioning" in ln or "Exchange rangepartitioning" in ln for ln in lines),
        "single": sum("Exchange SinglePartition" in ln for ln in lines),
        "broadcast": sum("BroadcastExchange" in ln for ln in lines),
        "scans": sum("FileScan parquet" in ln or "Scan parquet" in ln for ln in lines),
        "windows": sum(re.search(r"\bWindow\b", ln) is not None for ln in lines),
        "python": sum("ArrowEvalPython" in ln or "BatchEvalPython" in ln or "FlatMapGroupsInPandas" in ln
                      for ln in lines),
    }


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    from barwise.plans.catalog import load_all
    from barwise.session import build_session
    spark = build_session("local[8]", 8)
    print("# Physical plans of the registered queries\n")
    print(f"Generated by `python tools/plan_report.py {sf_dir}` (executed plans after AQE, "
          "local[8]). Streaming queries are listed by their read-back of the sink output; "
          "their stateful plan is described in the README.\n")
    print("| query | hash/range exchanges | single-partition exchanges | broadcasts | parquet scans | window ops | python ops |")
    print("|---|---|---|---|---|---|---|")
    for name, q in load_all().items():
        if sys.argv[2:] and name not in sys.argv[2:]:
            continue
        df = q.build(spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        s = summarise(df._jdf.queryExecution().executedPlan().toString())
        print(f"| {name} | {s['exchanges']} | {s['single']} | {s['broadcast']} | {s['scans']} | "
              f"{s['windows']} | {s['python']} |")
    spark.stop()


if __name__ == "__main__":
    main()

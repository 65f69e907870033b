"""Summarise the final (adaptive) physical plan of every registered query as markdown.

Usage: python tests/plan_report.py [sf_dir] > PLANS.md
Each query is executed once (collect at small scale) so the adaptive plan is final.
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SKIP = {"ingest_readings", "assign_ids", "stream_validate", "stream_alerts", "stream_alert_windows",
        "stream_lockouts", "cascade_delete_counts", "cascade_delete_readings", "cascade_delete_notifications",
        "cascade_delete_maintenance"}


def summarise(plan: str) -> dict:
    return {
        "shuffle": len(re.findall(r"Exchange (hashpartitioning|rangepartitioning|SinglePartition|RoundRobin)", plan)),
        "reused": plan.count("ReusedExchange"),
        "bhj": plan.count("BroadcastHashJoin"),
        "smj": plan.count("SortMergeJoin"),
        "shj": plan.count("ShuffledHashJoin"),
        "nlj": plan.count("BroadcastNestedLoopJoin") + plan.count("CartesianProduct"),
        "hashagg": plan.count("HashAggregate("),
        "sortagg": plan.count("SortAggregate("),
        "python": sum(plan.count(k) for k in ("MapInPandas", "FlatMapGroupsInPandas", "ArrowEvalPython",
                                              "BatchEvalPython")),
        "pushed": sorted({m for m in re.findall(r"PushedFilters: \[([^\]]+)\]", plan)}),
        "scans": len(re.findall(r"FileScan parquet", plan)),
    }


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    from envmon.session import get_session
    import __spark_entry__ as E
    conf = {"spark.ui.enabled": "false"}
    if os.environ.get("NO_BROADCAST"):  # the large-table plans: no size-based broadcasts
        conf.update({"spark.sql.autoBroadcastJoinThreshold": "-1",
                     "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"})
    spark = get_session("local[8]", shuffle_partitions=8, conf=conf)
    spark.sparkContext.setLogLevel("ERROR")
    print(f"# Final physical plans ({os.path.basename(sf_dir)}, local[8], AQE on)\n")
    print("Generated by `tests/plan_report.py`: each query is run once, then its adaptive plan (final) is "
          "summarised. shuffle = exchanges (hash/range), BHJ/SMJ = broadcast-hash / sort-merge joins, "
          "NLJ = nested-loop or cartesian joins (none expected), agg = hash / sort aggregates, py = Python "
          "operators.\n")
    print("| key | shuffle | BHJ | SMJ | NLJ | agg (hash/sort) | py | pushed filters (parquet) |")
    print("|---|---|---|---|---|---|---|---|")
    for k, fn in E.queries().items():
        if k in SKIP or k == "pipeline" or re.match(r"op\d+_", k):
            continue
        df = fn(spark, sf_dir)
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
        plan = plan.split("== Initial Plan ==")[0]  # adaptive plans print the final plan first
        s = summarise(plan)
        pushed = "; ".join(s["pushed"]).replace("|", "/") or "-"
        print(f"| {k} | {s['shuffle']} | {s['bhj']} | {s['smj']} | {s['nlj']} | {s['hashagg']}/{s['sortagg']} "
              f"| {s['python']} | {pushed} |")


if __name__ == "__main__":
    main(sys.argv)

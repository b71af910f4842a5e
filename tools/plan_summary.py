"""Summarise the physical plans of registered queries: exchanges, joins,
windows, Python stages and what reaches each parquet scan.

usage: python tools/plan_summary.py [sf_dir] [name ...]  (markdown on stdout)
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from parley.plans import catalog  # noqa: E402
from parley.session import get_spark  # noqa: E402

OPS = ["Exchange hashpartitioning", "Exchange rangepartitioning", "Exchange SinglePartition",
       "BroadcastExchange", "BroadcastHashJoin", "SortMergeJoin", "Window", "Generate",
       "HashAggregate", "ObjectHashAggregate", "ArrowEvalPython", "MapInPandas", "FlatMapCoGroupsInPandas"]


def summarise(df) -> tuple[dict, list]:
    plan = df._jdf.queryExecution().executedPlan().toString()
    counts = {op: len(re.findall(re.escape(op) + r"\b", plan)) for op in OPS}
    scans = []
    for m in re.finditer(r"FileScan parquet [^\n]*", plan):
        line = m.group(0)
        src = re.search(r"Location: [^\[]*\[([^\]]*)\]", line)
        pushed = re.search(r"PushedFilters: (\[[^\]]*\])", line)
        schema = re.search(r"ReadSchema: (struct<[^>]*>)", line)
        scans.append((src.group(1).rstrip("/").split("/")[-1] if src else "?", pushed.group(1) if pushed else "[]",
                      schema.group(1) if schema else "?"))
    return counts, scans


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    spark = get_spark("local[8]", shuffle_partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    qs = catalog.queries()
    for name in names or list(qs):
        counts, scans = summarise(qs[name](spark, sf))
        ops = ", ".join(f"{k} ×{v}" for k, v in counts.items() if v)
        print(f"### `{name}`\n\n- operators: {ops or 'none'}")
        for src, pushed, schema in sorted(set(scans)):
            print(f"- scan `{src}`: pushed {pushed}; reads `{schema}`")
        print()
    spark.stop()


if __name__ == "__main__":
    main()

"""Benchmark: run the headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]
and print one JSON line.

Each query is executed to the end with the ``noop`` sink (every row is
produced, nothing is collected to the driver).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from parley.plans import catalog  # noqa: E402
from parley.session import get_spark  # noqa: E402

HEADLINE = [
    "clean_all", "clean_docs", "mention_names", "package_context", "package_session",
    "package_target", "split_train", "extrapolate", "vocab", "encode", "padded",
    "rouge1", "rouge2", "rouge_l", "rouge_mid", "perplexity", "prompts", "payload",
    "link_members", "replay", "ngram_model", "ngram_perplexity", "decode_candidates",
    "generate_replies", "stream_prompts",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = sys.argv[1:]
    spark = get_spark(f"local[{cpus}]", app="parley-bench", shuffle_partitions=int(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    qs = catalog.queries()
    names = [n for n in HEADLINE if n in qs and (not only or n in only)]
    times: dict[str, float] = {}
    # warm the JVM (class loading, regex and codegen paths) outside the timings
    warm_dir = os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.001")
    if os.path.isdir(warm_dir):
        for name in ("clean_all", "package_context"):
            qs[name](spark, warm_dir).write.format("noop").mode("overwrite").save()
    for name in names:
        t0 = time.perf_counter()
        df = qs[name](spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
        print(f"{name}: {times[name]}s", file=sys.stderr)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": float(m.group(1)) if m else sf_dir,
    }))
    spark.stop()


if __name__ == "__main__":
    main()

"""Time the queries at one scale and print a single JSON line.

Each query runs twice over its whole tables into a sink that discards the rows; the
second, warm run counts. Before the first one a few queries run untimed, so that the first
names do not pay for a cold JVM. ``BENCH_SF_DIR`` names the data, ``BENCH_CPUS`` the threads.
"""

from __future__ import annotations

import json
import os
import sys
import time

from turnloom.plans.queries import QUERIES
from turnloom.session import local_session

WARM_UP = ["sft_filter", "turn_reward", "sft_samples", "word_count"]


def run(query, spark, sf: str) -> float:
    started = time.perf_counter()
    query(spark, sf).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 4))
    spark = local_session(cpus, "bench")
    names = sys.argv[1:] or list(QUERIES)
    seconds = {}
    for name in WARM_UP:
        run(QUERIES[name], spark, sf)
    for name in names:
        run(QUERIES[name], spark, sf)
        seconds[name] = round(run(QUERIES[name], spark, sf), 3)
    print(
        json.dumps(
            {
                "metric": "total warm query time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf.rstrip("/")),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()

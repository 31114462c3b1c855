"""Benchmark: build the stage tables once, then time every named query.

Prints one JSON line:
  {"metric": "total_sec", "value": N, "unit": "sec", "queries": {...}, "stages": {...}, "sf": ...}

env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
     BENCH_QUERIES (comma list, default all).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    from shopflow.session import get_spark
    from shopflow.plans import catalog
    from shopflow.plans.context import ShopContext

    spark = get_spark(master=f"local[{cpus}]", shuffle_partitions=cpus * 2)
    wall0 = time.time()
    ctx = ShopContext.for_source(spark, sf_dir, "orders")
    stages = {}
    for name in ["events", "sessions", "users", "brands", "categories", "events_clean"]:
        t0 = time.time()
        getattr(ctx, name)
        stages[name] = round(time.time() - t0, 3)

    catalog.spark_queries()
    wanted = os.environ.get("BENCH_QUERIES")
    names = [n for n in catalog.REGISTRY if catalog.REGISTRY[n].source == "orders"]
    if wanted:
        names = [n for n in names if n in wanted.split(",")]
    queries = {}
    for name in names:
        t0 = time.time()
        df = catalog.run(name, spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        queries[name] = round(time.time() - t0, 3)
    total = round(time.time() - wall0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "total_sec", "value": total, "unit": "sec",
                      "queries": queries, "stages": stages,
                      "stage_sec": round(sum(stages.values()), 3),
                      "query_sec": round(sum(queries.values()), 3),
                      "sf": float(m.group(1)) if m else sf_dir, "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()

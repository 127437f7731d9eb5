"""Time every registered query; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from varcost.session import get_spark  # noqa: E402
from workload.local import ensure_scratch  # noqa: E402
from workload.queries import QUERIES  # noqa: E402


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "1"))
    only = [name for name in os.environ.get("BENCH_QUERIES", "").split(",") if name]
    spark = get_spark("bench", {
        "spark.master": f"local[{cpus}]",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.shuffle.partitions": cpus,
        "spark.driver.memory": "20g",
    })
    spark.sparkContext.setLogLevel("ERROR")
    ensure_scratch(spark)

    def run(name: str) -> float:
        start = time.perf_counter()
        # The noop sink computes every row and column, and collects none.
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    names = only or list(QUERIES)
    for name in ("variance_full", "fact_star"):
        run(name)  # start the JVM's compilers and the page cache
    seconds = {name: round(statistics.median(run(name) for _ in range(repeats)), 3) for name in names}
    print(json.dumps({
        "metric": "total_query_seconds",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "cpus": int(cpus),
    }))
    spark.stop()


if __name__ == "__main__":
    main()

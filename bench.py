"""Time every query: one JSON line with seconds per query and their sum.

BENCH_SF_DIR   folder of the test tables (default /root/testdata/sf0.1)
BENCH_CPUS     local cores (default 8)
BENCH_QUERIES  comma-separated names (default all)
BENCH_RUNS     timed runs per query, the best one counts (default 1)

Each query runs once before on the smallest tables next to the folder, if there
are any, so that the times do not hold the compilation of its code.
"""

from __future__ import annotations

import json
import os
import sys
import time

from wardlake.catalogue.queries import QUERIES
from wardlake.session import local_session


def seconds(spark, name: str, folder: str) -> float:
    begun = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - begun


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or list(QUERIES)
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    spark = local_session(cpus, shuffle_partitions=int(cpus) * 2, memory="16g")
    small = f"{folder.rsplit('/', 1)[0]}/sf0.001"
    small = small if os.path.isdir(small) else None
    seconds(spark, "response_tallies", small or folder)  # starts the executor threads
    taken, failed = {}, {}
    for name in names:
        try:
            if small:
                seconds(spark, name, small)
            taken[name] = round(min(seconds(spark, name, folder) for _ in range(runs)), 3)
        except Exception as error:
            failed[name] = str(error)[:200]
        print(f"{name}: {taken.get(name, 'failed')}", file=sys.stderr, flush=True)
    line = {
        "metric": "total query time",
        "value": round(sum(taken.values()), 3),
        "unit": "sec",
        "queries": taken,
        "sf": folder.rsplit("sf", 1)[-1],
        "cpus": cpus,
        "spark": spark.version,
    }
    print(json.dumps(line | ({"failed": failed} if failed else {})))
    spark.stop()


if __name__ == "__main__":
    main()

"""Times the registered queries of the platform and prints one JSON line.

BENCH_SF_DIR names the folder of parquet tables, BENCH_CPUS the local cores, BENCH_RUNS the
timed runs per query (the median counts) and BENCH_QUERIES a comma-separated choice.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from tradewind.registry.queries import REGISTERED  # noqa: E402
from tradewind.session import build_session  # noqa: E402

HEADLINE = list(REGISTERED)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    spark = build_session(
        "bench",
        master=f"local[{cpus}]",
        shuffle_partitions=8 if cpus == "*" else int(cpus),
        extra={"spark.driver.memory": "12g", "spark.ui.enabled": "false"},
    )
    spark.sparkContext.setLogLevel("OFF")

    def run(name: str) -> float:
        started = time.perf_counter()
        REGISTERED[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - started

    seconds = {}
    for name in names:
        run(name)
        seconds[name] = round(statistics.median(run(name) for _ in range(runs)), 4)
    spark.stop()
    print(json.dumps({
        "metric": "total of the median seconds per query",
        "value": round(sum(seconds.values()), 4),
        "unit": "sec",
        "queries": seconds,
        "sf": Path(folder).name.removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()

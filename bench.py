"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR names the tables (default sf0.1), BENCH_CPUS the local cores.
Each query runs to a full result through the no-op sink, after one short
warm-up query that starts the JVM and compiles the sales view. A query that
takes longer than BENCH_LIMIT seconds (default 600) is stopped, its time is
null and the others go on; each time is also told on stderr as it is known.
"""

from __future__ import annotations

import json
import os
import sys
import threading
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ledgerloom.plans.catalog import QUERIES  # noqa: E402
from ledgerloom.session import local_session  # noqa: E402

HEADLINE = (
    "demand_cells_train",
    "demand_cells_serve",
    "segment_profile",
    "value_frequency",
    "option_lists",
    "median_margin_by_category",
    "cumulative_weights",
    "weighted_pick",
    "parse_requests",
    "tiered_stats_lookup",
    "forecast_sales",
    "expand_sales",
    "model_ridge",
    "model_gbt",
    "knn_join",
    "model_random_forest",
)


def run(spark, name: str, folder: str, limit: float) -> float | None:
    """Seconds, or None for a query that was stopped at the limit."""
    stopped = threading.Event()

    def stop() -> None:
        # Queries that go on with further jobs are stopped again.
        while not stopped.wait(1):
            spark.sparkContext.cancelAllJobs()

    timer = threading.Timer(limit, stop)
    timer.daemon = True
    timer.start()
    begin = time.perf_counter()
    try:
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        took = time.perf_counter() - begin
        return took if took < limit else None
    except Exception as e:  # told, and the other queries still run
        print(f"{name}: {type(e).__name__}: {str(e)[:200]}", file=sys.stderr, flush=True)
        return None
    finally:
        stopped.set()
        timer.cancel()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cores, shuffle_partitions=int(cores) if cores.isdigit() else 8, memory="16g")
    limit = float(os.environ.get("BENCH_LIMIT", "600"))
    run(spark, "calendar_features", folder, limit)
    seconds: dict[str, float | None] = {}
    for name in names:
        took = run(spark, name, folder, limit)
        seconds[name] = None if took is None else round(took, 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline query time",
                "value": round(sum(s for s in seconds.values() if s is not None), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
                "cpus": cores,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()

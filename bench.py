"""Headline queries at one scale: ``BENCH_SF_DIR``, on ``local[BENCH_CPUS]``. Prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from cohortloom.session import get_session  # noqa: E402
from workload import QUERIES  # noqa: E402

HEADLINE = [
    "first_per_group_priority", "latest_per_group", "group_any_flag", "left_join_fill", "key_semi_join", "freq_multi",
    "crosstab", "describe_numeric", "profile_table", "min_date_ties", "baseline_diff", "trajectory_multi",
    "trajectory_score", "weekly_mean", "local_trend", "chi_square", "fisher_exact", "multi_select_flags",
    "cohort_requests", "cohort_treatment", "cohort_scoring", "indicator_assembly",
]


def run(df) -> None:
    """Evaluate every column of the result without bringing it to the driver."""
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    chosen = sys.argv[1:] or HEADLINE
    spark = get_session(
        "bench", f"local[{cpus}]",
        **{"spark.ui.enabled": "false", "spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g"),
           "spark.sql.shuffle.partitions": cpus},
    )
    spark.sparkContext.setLogLevel("ERROR")
    run(QUERIES["first_per_group_priority"](spark, folder))  # JVM warm-up
    times = {}
    for name in chosen:
        best = None
        for _ in range(2):
            start = time.perf_counter()
            run(QUERIES[name](spark, folder))
            took = time.perf_counter() - start
            best = took if best is None else min(best, took)
        times[name] = round(best, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": Path(folder).name.removeprefix("sf"),
                "cpus": int(cpus),
            }
        )
    )


if __name__ == "__main__":
    main()

"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from airlake import catalog, session

HEADLINE = [
    "engineer_features",
    "engineer_features_many_stations",
    "engineer_features_sliced",
    "centered_mean_years",
    "merge_current",
    "override_nearest",
    "fill_forward_back",
    "rolling_features",
    "decompose",
    "correlation_matrix",
    "box_stats",
    "resample_daily",
    "daily_summary",
    "chrono_split_many_stations",
    "fallback_chain",
    "recursive_forecast",
    "recursive_forecast_many_stations",
    "current_conditions",
    "model_board",
    "backfill_to_store",
    "hourly_refresh",
    "stream_hourly",
    "train_leaderboard",
    "explain_trees",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session.build(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "8g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    known = catalog.all_queries()
    spark.read.parquet(f"{folder}/events.parquet").groupBy("event_type").count().collect()  # start the executors
    times: dict[str, float] = {}
    for name in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(","):
        start = time.perf_counter()
        known[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline queries, total wall time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()

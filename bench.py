"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8) and
BENCH_RUNS (default 3) set the data, the cores and the runs per query. Each
query is planned anew for every run and written to a sink that keeps nothing;
the first run is not counted.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

from gridcast.queries import QUERIES
from gridcast.session import local_session, release

HEADLINE = (
    "resample_mean",
    "resample_diff",
    "grid_lead",
    "dataset_build",
    "submission_hours",
    "join_daily_to_fine",
    "corr_long",
    "histogram_positive",
    "minmax_scale",
    "log_demean",
    "chrono_split",
    "row_ordinal",
    "shuffle_batches",
    "sliding_frames",
    "analog_day",
    "many_series_encode",
    "recursive_ar_forecast",
    "knn_regress",
    "random_windows",
    "linear_cv",
    "cart_stump",
    "direct_forecast_one_lag",
    "forecast_day_linear",
    "early_stop_stump",
    "recursive_stump_forecast",
    "random_search_ridge",
    "direct_forecast_all_steps",
    "shuffle_epochs",
    "frame_batches",
)


def run(spark, name: str, sf: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
    took = time.perf_counter() - start
    release(spark)
    return took


def main(names: list[str]) -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = local_session("bench", cores=os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in names or HEADLINE:
        run(spark, name, sf)
        seconds[name] = round(statistics.median(run(spark, name, sf) for _ in range(runs)), 3)
    spark.stop()
    scale = Path(sf).name.removeprefix("sf")
    print(
        json.dumps(
            {"metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": scale}
        )
    )


if __name__ == "__main__":
    main(sys.argv[1:])

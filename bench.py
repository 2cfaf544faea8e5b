"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from meterlake.plans import all_queries

HEADLINE = [
    "dense_day_series", "rollup_hour", "metrics_summary", "hybrid_series", "primary_source", "cadence_gaps", "series_spearman",
    "lagged_best", "anomalies_mad", "session_list", "exercise_progression", "session_window_join", "batch_preaggregate", "keyset_page",
]


#: Not in the sum: the store that metrics_summary, hybrid_series and primary_source read, made anew each time.
BESIDE = ["stored_day_counts"]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in [*HEADLINE, *BESIDE]:
        query = all_queries()[name]
        best = float("inf")
        for _ in range(2):  # the first run compiles
            began = time.time()
            query(spark, folder).write.format("noop").mode("overwrite").save()
            best = min(best, time.time() - began)
        took[name] = round(best, 3)
    print(json.dumps({"metric": "headline queries, best of two", "value": round(sum(took[n] for n in HEADLINE), 3), "unit": "sec", "queries": took, "sf": folder.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()

"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_QUERIES (comma list, default the set below).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "track_speed", "head_direction", "isi_stats", "bursts", "asof_nearest", "occupancy_map", "rate_map_raw",
    "rate_map_smooth", "map_stats", "coherence", "border_score", "hd_vector", "speed_score", "grid_score",
    "place_fields", "null_pvalue", "temporal_emd", "sliced_w", "map_distance", "remapping_scores",
    "cluster_quality", "jsd_matrix", "mann_whitney_u", "weighted_ks",
]


def main() -> None:
    from pyspark.sql import SparkSession

    from spikegrid.plans.catalog import QUERIES
    from spikegrid.session import SQL_OPTIONS

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.ui.enabled", "false")
    builder = builder.config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g")
    for k, v in SQL_OPTIONS.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()   # start the executors before the clock
    times = {}
    for n in names:
        start = time.perf_counter()
        QUERIES[n](spark, sf).write.format("noop").mode("overwrite").save()
        times[n] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf.rstrip("/"))}))


if __name__ == "__main__":
    main()

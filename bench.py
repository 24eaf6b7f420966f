"""Time the headline queries: one JSON line. BENCH_SF_DIR and BENCH_CPUS choose tables and cores."""

import json
import os
import time

from pyspark.sql import SparkSession

from tidemark import plans

QUERIES = ["range_scan", "agg_sum", "agg_avg", "agg_min", "agg_max", "downsample_avg", "downsample_stddev", "downsample_lineitem", "scan_dedup_first", "limit_then_agg", "blob_live", "blob_prefix_scan", "interval_join", "mvcc_snapshot_read", "metric_flush", "morton_encode", "model_segments"]


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "4")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "4g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in QUERIES:
        runs = []
        for _ in range(3):  # the first compiles
            began = time.perf_counter()
            plans.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        took[name] = round(min(runs), 4)
    ratio = plans.QUERIES["segment_stats"](spark, folder).first()["average_compression_ratio"]
    print(json.dumps({"metric": "total of the fastest of three runs", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "compression_ratio": round(ratio, 2), "sf": folder.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()

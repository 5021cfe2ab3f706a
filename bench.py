"""Headline timings; prints one JSON line.

Every query runs whole into a ``noop`` sink: one warm-up, then the median of
three. The upsert is timed as the mean of ten micro-batches in arrival order.
"""

import json
import os
import statistics
import sys
import time

from pyspark.sql import functions as F

from watchlake.plans import catalog, sample
from watchlake.plans.incremental import EXACT, PARITY, refresh_table
from watchlake.session import build_session, new_work_folder

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
REPEATS = int(os.environ.get("BENCH_REPEATS", "3"))

HEADLINE = [
    "bronze_project",
    "silver_valid",
    "silver_invalid",
    "contract_violations",
    "dead_letter",
    "dedup_latest",
    "accumulate_state",
    "accumulate_skewed",
    "session_snapshot",
    "quality_counts",
    "ingest_lag",
]


def run_once(spark, name):
    start = time.perf_counter()
    catalog.QUERIES[name](spark, FOLDER).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def micro_batches(spark, mode, batches=10):
    """Mean seconds per micro-batch, the sample being fed in arrival order."""
    source = new_work_folder(spark, "bench-silver")
    rows = sample.watch_events(spark.read.parquet(f"{FOLDER}/events.parquet"))
    edges = rows.agg(F.min("ingest_ts").alias("low"), F.max("ingest_ts").alias("high")).first()
    step = (edges.high - edges.low) / batches
    place = F.floor(
        (F.unix_micros("ingest_ts") - F.unix_micros(F.lit(edges.low))) / F.lit(step.total_seconds() * 1e6)
    )
    slot = F.least(place, F.lit(batches - 1)).cast("int").alias("slot")
    rows.select("*", slot).write.partitionBy("slot").parquet(source)
    path = new_work_folder(spark, "bench-accumulated")
    start = time.perf_counter()
    for i in range(batches):
        refresh_table(spark.read.parquet(source).where(F.col("slot") == i).drop("slot"), path, mode)
    return (time.perf_counter() - start) / batches


def main():
    spark = build_session(
        "watchlake-bench",
        f"local[{CPUS}]",
        **{
            "spark.sql.shuffle.partitions": CPUS,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "8g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        run_once(spark, name)
        seconds[name] = round(statistics.median(run_once(spark, name) for _ in range(REPEATS)), 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    for label, mode in (("merge_batch_exact", EXACT), ("merge_batch_parity", PARITY)):
        seconds[label] = round(micro_batches(spark, mode), 3)
        print(label, seconds[label], file=sys.stderr, flush=True)
    events = spark.read.parquet(f"{FOLDER}/events.parquet").count()
    print(
        json.dumps(
            {
                "metric": "watch-event pipeline, total of headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(FOLDER.rstrip("/")).removeprefix("sf"),
                "events": events,
                "cpus": int(CPUS),
                "spark": spark.version,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()

"""Times the headline trace queries over $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from lanewise.plans.queries import queries

HEADLINE = [
    "flagship_error_to_purchase", "match_numeric", "match_meta_lines", "pair_next", "pair_skip2", "exclude_rows", "exclude_all", "top_elapsed", "hits_in_window", "rows_hide_flushed", "locate_rids",
    "search_text", "search_regex", "search_stage_text", "suggest_metadata", "overview", "operation_details", "metadata_text", "ingest_ops", "ingest_stages",
]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    config = {
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.ui.showConsoleProgress": "false",
        "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.coalescePartitions.enabled": "true",
    }
    spark = SparkSession.builder.master(f"local[{cpus}]").config(map=config).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    known, took = queries(), {}
    known["match_single"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # starts up the engine
    for name in HEADLINE:
        began = time.time()
        known[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "trace_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()

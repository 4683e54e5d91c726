"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

from quarry.plans import registry

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
NAMES = ["vector_topk", "two_lane_rrf", "retrieve_low", "retrieve_medium", "retrieve_high", "relevance_cut", "legacy_chunks", "trim_overlap", "neighbours", "adjacent_runs", "bm25", "snippet_containment", "rebuilt_files", "scored_questions", "latencies", "incremental_plan", "structured_chunks"]

spark = SparkSession.builder.master(f"local[{CPUS}]").config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
spark.sparkContext.setLogLevel("ERROR")
spark.read.parquet(f"{SF}/documents.parquet").count()
took = {}
for name in NAMES:
    began = time.time()
    registry.QUERIES[name](spark, SF).write.format("noop").mode("overwrite").save()
    took[name] = round(time.time() - began, 3)
print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": SF}))

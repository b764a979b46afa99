"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; one JSON line. Each query: median of three warm runs."""

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from quillspan.plans import catalogue

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "4")
HEADLINE = ["chunk_recursive", "chunk_chars", "vector_topk", "vector_topk_batch", "html_extract", "heading_enrich", "history_last3", "stage_metrics", "repetition_flag", "word_char_counts", "doc_listing", "full_prompt"]


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.files.maxPartitionBytes", "4m")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        runs = []
        for _ in range(4):
            began = time.perf_counter()
            catalogue.QUERIES[name](spark, SF).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        took[name] = round(statistics.median(runs[1:]), 3)
    print(json.dumps({"metric": "headline queries, sum of medians of 3 warm runs", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": SF.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()

"""Times the headline queries: one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

HEADLINE = ["lexical_topk", "rrf_fusion", "vector_topk", "html_to_text", "ngram_phrases", "shard_fanout", "manifest_delta", "obs_totals", "obs_groups", "usage_counters", "budget_alerts", "session_windows", "asof_rating", "retrieval_eval", "chunk_split"]


def main() -> None:
    from lodestone.plans import registry

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        began = time.time()
        registry.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf}))


if __name__ == "__main__":
    main()

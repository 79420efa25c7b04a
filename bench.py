"""Time the headline queries and print one line of JSON."""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

from pyspark.sql import SparkSession  # noqa: E402

from loreloom import registry  # noqa: E402

HEADLINE = ["bm25_topk", "bm25_df", "dense_topk", "hybrid_rrf", "sync_changes", "exact_dup_groups", "page_links", "page_clean_text", "benchmark_contained", "conversation_context", "nation_components", "events_tumbling"]


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    found, seconds = registry.queries(), {}
    # The first query of a session pays for what the engine loads and compiles; this one isn't timed.
    found["bm25_topk"](spark, folder).write.format("noop").mode("overwrite").save()
    for name in HEADLINE:
        began = time.time()
        found[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - began, 3)
    spark.stop()
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()

"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from brightwell import catalog

HEADLINE = ["dense_prefix_topk", "normalized_topk", "rrf_topk", "pair_fold", "conditional_fold", "seed_topk_vectors", "paired_delta", "need_bucket", "context_compact", "text_functions", "entity_overlap_edges", "fixed_hop2_topk", "links_top_l"]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    catalog.qid_set_diff(spark, sf).collect()
    took = {}
    for name in HEADLINE:
        began = time.time()
        catalog.Q[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline queries, wall clock", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf}))


if __name__ == "__main__":
    main()

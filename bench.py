"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs to completion through the ``noop`` sink (every row is
produced, nothing is collected to the driver).  Every query first runs once
on the sf0.001 tables (JIT warm-up of a fresh JVM, not counted), then once
timed at the target scale.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "top_tokens_per_class",
    "class_distribution",
    "token_length_histogram",
    "word_frequency",
    "rare_word_share",
    "lemmatize_nouns",
    "stratified_split",
    "build_vocab",
    "pad_truncate",
    "tfidf_vectors",
    "vectorize_heldout",
    "confusion_matrix",
    "run_summary",
    "epoch_weighted_means",
    "early_stop_epoch",
    "attn_pool_linear",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from tessera.plans.catalog import QUERIES
    from tessera.session import clear_scratch, get_spark

    spark = get_spark(cpus=cpus)
    spark.conf.set("tessera.scan.partitions", cpus)  # the test tables are files of one row group
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    warm_dir = os.environ.get("BENCH_WARMUP_DIR", "/root/testdata/sf0.001")
    if os.path.isdir(warm_dir):  # JIT warm-up on the smallest tables, not timed
        for name in names:
            QUERIES[name](spark, warm_dir).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in names:
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
        print(f"# {name}: {times[name]:.2f}s", file=sys.stderr, flush=True)
    clear_scratch(spark)
    sf = sf_dir.rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "total_query_time", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))


if __name__ == "__main__":
    main()

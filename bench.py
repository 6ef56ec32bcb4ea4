"""Time the headline jobs and print one JSON line.

Settings: BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8).
Every job runs to the end into a sink that discards its rows.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pulse.catalog import REGISTRY, Tables  # noqa: E402
from pulse.session import build_session  # noqa: E402

HEADLINE = (
    "top_groups", "top_groups_by_flag", "activity_by_grain", "activity_by_dow", "activity_vs_size",
    "controversial_groups", "ranked_panel", "missing_profile", "time_features", "clean_comments",
    "gap_filled_series", "daily_panel", "enriched_daily", "asof_join", "keyword_rates",
    "topic_share", "topic_hot_words", "price_percentiles", "quantile_report", "length_histogram",
    "top_words", "key_terms", "class_key_terms", "sentiment_summary", "sentiment_daily",
    "balanced_set", "deleted_set", "rule_report", "vectorised_terms", "lemmatised_text", "sentiment_by_table",
    "hashed_terms", "document_vectors", "clf_deleted",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("pulse-bench", f"local[{cpus}]", int(cpus), spark__ui__enabled="false")
    spark.sparkContext.setLogLevel("ERROR")
    tables = Tables(spark, folder)
    tables.orders.groupBy("o_orderstatus").count().collect()  # start the executor threads
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        REGISTRY[name].build(tables).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline_jobs_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()

"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every query runs once, and then, while time is left, once more for its figure; all of its result is computed
and dropped. Each timing goes to stderr at once. When $BENCH_SECONDS (1,500) are over, the line is printed
with what has been measured, and names the query that was running.
"""

from __future__ import annotations

import json
import os
import sys
import threading
import time

HEADLINE = (
    "txt_clean_clipping", "kw_weekly", "kw_link_tokens", "cls_multilabel", "cls_content_type", "cls_idea_scores", "agg_dups", "agg_layer_health",
    "state_incremental", "stream_daily_window", "agg_assets", "cls_card_fields", "span_points", "cls_skill_dims", "span_quotes", "cls_quality", "sim_topk",
)
FIRST_ONLY = 60.0  # seconds of a first run after which it is not repeated


def main() -> None:
    from pyspark.sql import SparkSession

    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    from quillspark.plans import registry

    cpus, folder, limit = os.environ.get("BENCH_CPUS", "8"), os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), float(os.environ.get("BENCH_SECONDS", "1500"))
    times: dict[str, float] = {}
    running = [""]
    once = threading.Lock()

    def report() -> None:
        if once.acquire(blocking=False):
            line = {"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(folder).removeprefix("sf")}
            print(json.dumps(line | ({"unfinished": running[0]} if running[0] else {})), flush=True)

    def stop() -> None:
        report()
        os._exit(0)

    watch = threading.Timer(limit, stop)
    watch.daemon = True
    watch.start()
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.driver.memory", "12g").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.sql.files.maxPartitionBytes", "2m").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    for name in HEADLINE:
        running[0] = name
        for _ in range(2):
            began = time.time()
            registry.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            times[name] = round(time.time() - began, 3)
            print(name, times[name], file=sys.stderr, flush=True)
            if times[name] > FIRST_ONLY:
                break
    running[0] = ""
    report()


if __name__ == "__main__":
    main()

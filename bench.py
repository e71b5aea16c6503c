"""Times the headline queries and prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 4).
"""

from __future__ import annotations

import json
import os
import time

from tidemark.plans import catalog
from tidemark.session import build_session
from tidemark.sources.stage import clear_stages

HEADLINE = [
    "flagship", "row_index", "row_index_long", "chunk_split", "normal_rows", "run_stride", "slide_windows",
    "mask_around_events", "tumble_windows_wide", "upsample_linear", "robust_fit", "scale_apply", "inject_gwn",
    "error_distribution", "roc_auc", "metrics_record", "global_error_timeline", "sweep", "running_best", "early_stop_epoch",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "4")
    spark = build_session("bench", f"local[{cpus}]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    catalog.QUERIES["scan_table"](spark, sf_dir).count()  # start the JVM and warm the file cache
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        clear_stages(spark)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()

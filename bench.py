"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from grainline.plans.queries import QUERIES
from grainline.session import build_session

HEADLINE = (
    "burst_groups", "burst_numbering", "hamming_pairs", "duplicate_clusters", "exact_duplicate_groups", "laplacian_blur", "library_report",
    "view_counts", "luma_histogram", "histogram_percentile", "edit_auto_contrast", "edit_pipeline", "nms", "export_plan", "unique_names_fold",
    "decision_toggle", "phash", "heal", "edit_color_full", "render_full", "edit_state", "nearest_neighbour",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(f"local[{cpus}]", "bench", **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g", "spark.driver.host": "127.0.0.1"})
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        runs = []
        for _ in range(2):  # the first compiles
            t = time.perf_counter()
            QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - t)
            spark.catalog.clearCache()
        print(name, runs, file=sys.stderr, flush=True)
        took[name] = round(min(runs), 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()

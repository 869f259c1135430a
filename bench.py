"""Times the headline queries: BENCH_SF_DIR and BENCH_CPUS in, one JSON line out."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path
from statistics import median

sys.path.insert(0, str(Path(__file__).resolve().parent))

from colsight.plans.catalog import QUERIES  # noqa: E402
from colsight.session import build_session  # noqa: E402

HEADLINES = (
    "profile_roles_lineitem", "detected_roles_lineitem", "hygiene_score_orders", "cat_stats_orders", "dedup_orders",
    "clean_orders", "clean_report", "hist30", "box_by_group", "topn_share", "trend_month", "bar_median",
    "corr_matrix", "nl_filter_multi", "ask_top", "ask_top_customers", "ask_stats", "ask_filter_stats",
    "pca_points", "kmeans_points", "kmeans_summary", "iforest_flags", "anomaly_summary", "tfidf_search",
    "tfidf_weights_capped", "knowledge_chunks_orders", "union_files", "running_num_stats", "running_top",
)


def run(spark, name: str, sf_dir: str) -> float:
    """Seconds to compute every row of a query; rows go nowhere."""
    started = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    shared = tempfile.TemporaryDirectory(prefix="bench-")
    spark = build_session(
        "bench", f"local[{cpus}]", **{
            "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g",
            "spark.ui.showConsoleProgress": "false", "spark.checkpoint.dir": shared.name,
        }
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in sys.argv[1:] or HEADLINES:
        run(spark, name, sf_dir)
        seconds[name] = round(median(run(spark, name, sf_dir) for _ in range(3)), 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": sf_dir.rsplit("sf", 1)[-1],
    }))
    spark.stop()


if __name__ == "__main__":
    main()

"""Times the headline queries and prints one JSON line.

``BENCH_SF_DIR`` (default sf0.1), ``BENCH_CPUS`` (default 8), ``BENCH_RUNS`` (default 3 timed runs
after one warm-up), ``BENCH_QUERIES`` (comma-separated names).  Every result is computed
in full and thrown away by the no-op sink.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from lamina.queries import QUERIES  # noqa: E402
from lamina.session import build_session  # noqa: E402

HEADLINE = [
    "null_token_normalise", "numeric_promotion", "expand_long", "depth_histogram", "expand_wide", "chain_prune",
    "preprocess_wide", "composition_formula", "group_mode_lines", "topk_other_parts", "corr_matrix",
    "regression_metrics", "impute_median", "scale_standard", "scale_robust", "encode_ordinal_parts",
    "split_train_test", "split_kfold", "split_stratified", "model_knn", "impute_knn", "cv_scores", "model_gbt",
    "shapley_sampled",
]
# Training queries are timed once; they dominate the run time.
ONCE = {"cv_scores", "model_gbt", "shapley_sampled"}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = build_session(
        "lamina-bench", cpus,
        **{
            "spark.sql.shuffle.partitions": cpus if cpus.isdigit() else "8",
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
            # one machine, so that a folder of its own is shared by all
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="lamina-bench-"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")

    def once(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    times, failed = {}, {}
    for name in names:
        try:
            if name not in ONCE:
                once(name)
            times[name] = round(statistics.median(once(name) for _ in range(1 if name in ONCE else runs)), 3)
        except Exception as error:
            failed[name] = str(error)[:200]
    found = re.search(r"sf([0-9.]+)", sf_dir)
    result = {
        "metric": "sum of median query times", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": float(found.group(1)) if found else None, "cpus": cpus,
    }
    if failed:
        result["failed"] = failed
    spark.stop()
    print(json.dumps(result))


if __name__ == "__main__":
    main()

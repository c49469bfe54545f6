"""Tables of tracked runs and metrics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def filter_runs(runs: DataFrame, columns: Sequence[str], contains: Mapping[str, str]) -> DataFrame:
    """Runs whose tag arrays contain the given tags, projected to the columns."""
    tests = [F.array_contains(F.col(c), tag) for c, tag in contains.items()]
    return runs.filter(reduce(lambda a, b: a & b, tests)).select(*columns)


def append_metrics(report: DataFrame, run_id: str, path: str) -> None:
    """``(run_id, split, metric, value)`` rows added to the metric table at ``path``."""
    report.select(F.lit(run_id).alias("run_id"), "split", "metric", "value").write.mode("append").parquet(path)


def append_summary(summary: DataFrame, run_id: str, path: str) -> None:
    """Fold means and deviations as metric rows ``mean_train``, ``std_test`` and so on."""
    long = summary.unpivot(["metric"], ["mean_train", "std_train", "mean_test", "std_test"], "split", "value")
    append_metrics(long, run_id, path)

"""Column profiles, counts, correlation and regression metrics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.plans.gram import pairwise_correlations
from lamina.plans.modes import group_modes


def _as_rows(one_row: DataFrame, columns: Sequence[str], value: str) -> DataFrame:
    return one_row.unpivot([], list(columns), "column_name", value)


def null_fraction(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column_name, sparsity)`` from one aggregate."""
    one = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns])
    return _as_rows(one, columns, "sparsity")


def null_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    one = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return _as_rows(one, columns, "nulls")


def dense_columns(df: DataFrame, columns: Sequence[str], percent: float) -> list[str]:
    """Columns with at least ``percent`` of the rows not null; 0 or less keeps all."""
    if percent <= 0.0 or not columns:
        return list(columns)
    row = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count(c).alias(c) for c in columns]).first()
    return [c for c in columns if row[c] >= row["_n"] * percent]


def density_filter(df: DataFrame, percent: float, keep: Sequence[str] = ()) -> DataFrame:
    kept = set(dense_columns(df, [c for c in df.columns if c not in keep], percent)) | set(keep)
    return df.select(*[c for c in df.columns if c in kept])


def group_mode(df: DataFrame, key: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Mode of the columns (all others by default) per key; rows without a key are left out."""
    columns = [c for c in df.columns if c != key] if columns is None else columns
    return group_modes(df.filter(F.col(key).isNotNull()), [key], columns)


def group_mean(df: DataFrame, key: str, column: str) -> DataFrame:
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.avg(column).alias(column))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """``(value, n)``, most frequent first, equal counts by value; nulls are not counted."""
    counted = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value"))
    return counted.agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value")


def topk_other(df: DataFrame, column: str, k: int = 20, other: str = "other") -> DataFrame:
    """The k most frequent values and one row with the rest; a bar chart's data.

    The top k is a bounded sort per task; the rest is all rows minus the top's, so no task
    ranks the whole list of values.
    """
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(
        F.count(F.lit(1)).alias("n")
    )
    top = counts.orderBy(F.desc("n"), "value").limit(k)
    sums = top.agg(F.lit(-1).alias("sign"), F.sum("n").alias("n")).unionByName(
        counts.agg(F.lit(1).alias("sign"), F.sum("n").alias("n"))
    )
    rest = sums.agg(
        F.lit(other).alias("value"), F.coalesce(F.sum(F.col("sign") * F.col("n")), F.lit(0)).cast("bigint").alias("n")
    )
    return top.unionByName(rest)


def count_exact(df: DataFrame, sums: Mapping[str, Column], exact: Mapping[str, float]) -> DataFrame:
    """``(site, valid, invalid)``: rows whose site sum equals its exact value, in one pass."""
    entries = F.array(
        *[F.struct(F.lit(s).alias("site"), (sums[s] == F.lit(exact[s])).alias("ok")) for s in sums]
    )
    return df.select(F.explode(entries).alias("e")).groupBy("e.site").agg(
        F.count_if(F.col("e.ok")).alias("valid"), F.count_if(~F.col("e.ok")).alias("invalid")
    )


def corr_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(x, y, r)`` for all ordered pairs: Pearson over the rows where both are present.

    NaN where a column is constant over those rows or fewer than two remain.  Products of value and
    presence matrices are summed by blocks of columns, so neither the plan nor what a task holds at
    a time grows with the square of the columns.
    """
    return pairwise_correlations(df, columns)


# -- regression metrics ----------------------------------------------------------


def metric_aggregates(label: str = "label", prediction: str = "prediction") -> dict[str, Column]:
    """Aggregates by metric name; new ones can be passed wherever a metric dict is taken.

    ``r2_pred_denominator`` divides by the variance of the predictions, which is what the
    train and validation report uses; ``r`` is NaN where r2 is negative.
    """
    y, p = F.col(label).cast("double"), F.col(prediction).cast("double")
    error = y - p

    def r2(of: Column) -> Column:
        return F.lit(1.0) - F.try_divide(F.sum(error * error), F.count(error) * F.var_pop(of))

    return {
        "r2": r2(y),
        "r": F.sqrt(r2(y)),
        "mae": F.avg(F.abs(error)),
        "mse": F.avg(error * error),
        "rmse": F.sqrt(F.avg(error * error)),
        "r2_pred_denominator": r2(p),
    }


def regression_metrics(
    scored: DataFrame, by: Sequence[str] = (), metrics: Sequence[str] | None = None,
    aggregates: Mapping[str, Column] | None = None,
) -> DataFrame:
    """``(by..., metric, value)`` from one aggregate."""
    known = dict(aggregates or metric_aggregates())
    names = list(metrics) if metrics is not None else list(known)
    unknown = [m for m in names if m not in known]
    if unknown:
        raise ValueError(f"unsupported metrics {unknown}; known: {sorted(known)}")
    wide = scored.groupBy(*by).agg(*[known[m].alias(m) for m in names])
    return wide.unpivot(list(by), names, "metric", "value")


def fold_summary(results: DataFrame) -> DataFrame:
    """``(metric, mean_train, std_train, mean_test, std_test)`` of ``(fold, metric, train, test)``."""
    return results.groupBy("metric").agg(
        F.avg("train").alias("mean_train"), F.stddev_pop("train").alias("std_train"),
        F.avg("test").alias("mean_test"), F.stddev_pop("test").alias("std_test"),
    )


def fold_table(scores: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """One row per fold with columns like ``Train R`` and ``Test RMSE`` from ``(fold, split, metric, value)``."""
    labels = [(s, m) for s in ("test", "train") for m in metrics]
    return scores.groupBy("fold").agg(
        *[
            F.max(F.when((F.col("split") == s) & (F.col("metric") == m), F.col("value"))).alias(
                f"{s.capitalize()} {m.upper()}"
            )
            for s, m in labels
        ]
    )


def best_per_group(df: DataFrame, group: str, order: Sequence[Column], columns: Sequence[str] | None = None) -> DataFrame:
    """First row of each group; the rank limit is applied before the shuffle."""
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    return ranked.filter(F.col("_rank") == 1).drop("_rank").select(*(columns or df.columns))


def ranked_table(df: DataFrame, order: Sequence[Column], limit: int | None = None) -> DataFrame:
    ordered = df.orderBy(*order)
    return ordered if limit is None else ordered.limit(limit)

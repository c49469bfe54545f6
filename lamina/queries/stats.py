"""Metrics, fold summaries and run ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from lamina.operators import stats
from lamina.operators.models import paired_scores
from lamina.operators.sweep import best_trial
from lamina.queries.fixtures import fixture, oracle
from lamina.queries.registry import query
from lamina.sources.runs import filter_runs

R2_SQL = "1.0e0 - sum((label - prediction) * (label - prediction)) / (count(*) * var_pop({of}))"
WIDE_METRICS_SQL = f"""
  {R2_SQL.format(of='label')} AS r2,
  CASE WHEN {R2_SQL.format(of='label')} < 0 THEN CAST('nan' AS DOUBLE) ELSE sqrt(greatest({R2_SQL.format(of='label')}, 0.0e0)) END AS r,
  avg(abs(label - prediction)) AS mae, avg((label - prediction) * (label - prediction)) AS mse,
  sqrt(avg((label - prediction) * (label - prediction))) AS rmse, {R2_SQL.format(of='prediction')} AS r2_pred_denominator"""
METRICS = ["r2", "r", "mae", "mse", "rmse", "r2_pred_denominator"]
# Metrics in the label's unit are rounded to its scale.
ROUND_SQL = "round(CASE WHEN metric = 'mse' THEN value / 1e6 WHEN metric IN ('mae', 'rmse') THEN value / 1e3 ELSE value END, 6)"


def _rounded(table):
    scaled = F.when(F.col("metric") == "mse", F.col("value") / 1e6).when(
        F.col("metric").isin("mae", "rmse"), F.col("value") / 1e3
    ).otherwise(F.col("value"))
    return table.withColumn("value", F.round(scaled, 6))


def long_metrics_sql(by: str, source: str = "src") -> str:
    return f"""
, w AS (SELECT {by}, {WIDE_METRICS_SQL} FROM {source} GROUP BY {by})
, l AS ({" UNION ALL ".join(f"SELECT {by}, '{m}' AS metric, {m} AS value FROM w" for m in METRICS)})"""


@query("regression_metrics", oracle("numeric", long_metrics_sql("cat") + f"""
SELECT cat, metric, {ROUND_SQL} AS value FROM l"""))
def regression_metrics(spark, sf_dir):
    df = fixture(spark, sf_dir, "numeric").select("cat", "label", "prediction")
    return _rounded(stats.regression_metrics(df, ["cat"]))


def _fold_scores(spark, sf_dir):
    df = fixture(spark, sf_dir, "numeric")
    # Two scored parts per fold: line numbers up to 5, and the rest.
    side = F.when(F.col("l_linenumber") <= 5, F.lit("train")).otherwise(F.lit("test"))
    return stats.regression_metrics(df.withColumn("split", side), ["fold", "split"], ["r2", "mae", "rmse"])


FOLD_SQL = """
, s AS (SELECT *, CASE WHEN l_linenumber <= 5 THEN 'train' ELSE 'test' END AS split FROM src)
""" + long_metrics_sql("fold, split", "s")


@query("cv_summary", oracle("numeric", FOLD_SQL + """
, p AS (SELECT fold, metric, max(value) FILTER (WHERE split = 'train') AS train, max(value) FILTER (WHERE split = 'test') AS test
  FROM l WHERE metric IN ('r2', 'mae', 'rmse') GROUP BY fold, metric)
SELECT metric, round(avg(train), 5) AS mean_train, round(stddev_pop(train), 5) AS std_train,
  round(avg(test), 5) AS mean_test, round(stddev_pop(test), 5) AS std_test FROM p GROUP BY metric"""))
def cv_summary(spark, sf_dir):
    table = stats.fold_summary(paired_scores(_fold_scores(spark, sf_dir)))
    return table.select("metric", *[F.round(c, 5).alias(c) for c in table.columns[1:]])


@query("cv_results_table", oracle("numeric", FOLD_SQL + "\nSELECT fold, " + ", ".join(
    f"round(max(value) FILTER (WHERE split = '{s}' AND metric = '{m}'), 5) AS \"{s.capitalize()} {m.upper()}\""
    for s in ("test", "train") for m in ("r2", "mae", "rmse")) + " FROM l GROUP BY fold"))
def cv_results_table(spark, sf_dir):
    table = stats.fold_table(_fold_scores(spark, sf_dir), ["r2", "mae", "rmse"])
    return table.select("fold", *[F.round(f"`{c}`", 5).alias(c) for c in table.columns[1:]])


def _runs(spark, sf_dir):
    status = F.col("status")
    return fixture(spark, sf_dir, "runs").withColumns(
        {
            "tags": F.when(status == "F", F.array(F.lit("sweep"), F.lit("cv"))).otherwise(F.array(F.lit("cv"))),
            "group_tags": F.when(F.col("test_r_mean") < 0.5, F.array(F.lit("bandgap"))).otherwise(F.array(F.lit("example"))),
        }
    )


@query("runs_filter", oracle("runs", "\nSELECT run_id, model_type, val_r, test_r_mean FROM src WHERE status = 'F' AND test_r_mean < 0.5e0"))
def runs_filter(spark, sf_dir):
    return filter_runs(
        _runs(spark, sf_dir), ["run_id", "model_type", "val_r", "test_r_mean"], {"group_tags": "bandgap", "tags": "sweep"}
    )


@query("best_run_per_model", oracle("runs", """
SELECT model_type, run_id, val_r, test_r_mean FROM src WHERE val_r IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY model_type ORDER BY val_r DESC, test_r_mean DESC, run_id) = 1"""))
def best_run_per_model(spark, sf_dir):
    df = fixture(spark, sf_dir, "runs").na.drop()
    order = [F.desc("val_r"), F.desc("test_r_mean"), F.asc("run_id")]
    return stats.best_per_group(df, "model_type", order, ["model_type", "run_id", "val_r", "test_r_mean"])


@query("runs_ranked", oracle("runs", """
SELECT run_id, model_type, val_r, test_r_mean FROM src WHERE val_r IS NOT NULL"""))
def runs_ranked(spark, sf_dir):
    df = fixture(spark, sf_dir, "runs").na.drop().select("run_id", "model_type", "val_r", "test_r_mean")
    return stats.ranked_table(df, [F.desc("val_r"), F.desc("test_r_mean")])


@query("sweep_best", oracle("runs", """
SELECT run_id, test_r_mean, val_r FROM src WHERE val_r IS NOT NULL ORDER BY val_r, run_id LIMIT 1"""))
def sweep_best(spark, sf_dir):
    df = fixture(spark, sf_dir, "runs").select("run_id", "test_r_mean", "val_r")
    return best_trial(df, "minimize", "val_r", "run_id")

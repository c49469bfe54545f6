"""Training, validation, neighbour regression and sweeps."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lamina.operators import experiment, models, split, sweep
from lamina.operators.layers import build_catalog
from lamina.queries.fixtures import LINE_KEYS, fixture, table
from lamina.queries.layers import REFERENCE
from lamina.queries.registry import query
from lamina.queries.splits import hash_sql
from lamina.session import materialise, scratch_path
from lamina.sources.model_store import load_model, save_model

FEATURES = ["x1", "x2", "x3", "quantity"]
FOREST = {"model_type": "random_forest", "n_estimators": 10, "max_depth": 5}
GRADIENT = {"model_type": "xgboost", "eta": 0.3, "max_depth": 4, "n_estimators": 8}
HISTOGRAM = {"model_type": "hist_gradient_boost", "max_iter": 8, "max_depth": 4}
ORDERED = {"model_type": "catboost", "iterations": 8, "depth": 4, "learning_rate": 0.3, "border_count": 64}


def model_table(spark, sf_dir):
    """Line items with a label the features explain in part."""
    df = fixture(spark, sf_dir, "numeric")
    label = F.col("prediction") + 0.1 * F.col("label") + 1e4 * F.col("x3")
    return df.select(*LINE_KEYS, "fold", "x1", "x2", "x3", (F.col("prediction") / 1.5e3 % 7).alias("quantity"), label.alias("label"))


def _split(spark, sf_dir):
    return materialise(split.train_test_split(model_table(spark, sf_dir), LINE_KEYS, 0.1, seed=42), "split")


def _report(spark, sf_dir, config):
    return models.train_report(_split(spark, sf_dir), FEATURES, "label", config)[1]


@query("model_random_forest")
def model_random_forest(spark, sf_dir):
    return _report(spark, sf_dir, FOREST)


@query("model_gbt")
def model_gbt(spark, sf_dir):
    parted = _split(spark, sf_dir)
    tables = [
        models.train_report(parted, FEATURES, "label", c)[1].withColumn("model_type", F.lit(c["model_type"]))
        for c in (GRADIENT, HISTOGRAM, ORDERED)
    ]
    return tables[0].unionByName(tables[1]).unionByName(tables[2])


@query("train_report")
def train_report(spark, sf_dir):
    config = {**FOREST, "n_estimators": 5}
    return models.train_report(_split(spark, sf_dir), FEATURES, "label", config, cv_fold="fold", cv_metrics=["r", "mae", "rmse"])[1]


@query("cv_scores")
def cv_scores(spark, sf_dir):
    folded = split.kfold(model_table(spark, sf_dir).drop("fold"), LINE_KEYS, 5)
    return models.cross_validate(folded, FEATURES, "label", {**FOREST, "n_estimators": 5}, ["r", "mae", "rmse"])


@query("actual_vs_predicted")
def actual_vs_predicted(spark, sf_dir):
    parted = _split(spark, sf_dir)
    fitted = models.fit(parted.filter("split = 'train'"), FEATURES, "label", FOREST)
    return models.actual_vs_predicted(fitted, parted, "label", keep=LINE_KEYS)


@query("boosting_curve")
def boosting_curve(spark, sf_dir):
    parted = _split(spark, sf_dir)
    train, val = parted.filter("split = 'train'"), parted.filter("split = 'test'")
    return models.boosting_curve(models.fit(train, FEATURES, "label", GRADIENT), {"train": train, "val": val}, "label")


@query("importance_topk")
def importance_topk(spark, sf_dir):
    fitted = models.fit(model_table(spark, sf_dir), FEATURES, "label", FOREST)
    return models.importance_topk(fitted, spark, 20)


@query("permutation_importance")
def permutation_importance(spark, sf_dir):
    df = model_table(spark, sf_dir)
    return models.permutation_importance(models.fit(df, FEATURES, "label", FOREST), df, "label", LINE_KEYS)


@query("model_store")
def model_store(spark, sf_dir):
    df = model_table(spark, sf_dir)
    path = scratch_path(spark, "model")
    save_model(models.fit(df, FEATURES, "label", {**FOREST, "n_estimators": 5}), FOREST, path, spark)
    fitted, _ = load_model(path, spark)
    return models.predict(fitted, df, LINE_KEYS)


# -- neighbours ------------------------------------------------------------------

N_COORDINATES = 64
COORDINATES = [f"f{i}" for i in range(N_COORDINATES)]
VECTORS_SQL = "SELECT vec_id, " + ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS f{i}" for i in range(N_COORDINATES)) + ", CAST(label AS DOUBLE) AS label FROM embeddings"
DISTANCE_SQL = " + ".join(f"(q.{c} - d.{c}) * (q.{c} - d.{c})" for c in COORDINATES)


def vectors(spark, sf_dir):
    cells = [F.get("embedding", F.lit(i)).cast("double").alias(f"f{i}") for i in range(N_COORDINATES)]
    return table(spark, sf_dir, "embeddings").select("vec_id", *cells, F.col("label").cast("double").alias("label"))


@query("model_knn", f"""
WITH v AS ({VECTORS_SQL})
, r AS (SELECT *, row_number() OVER (ORDER BY {hash_sql('42', 'cast(vec_id AS varchar)')}, cast(vec_id AS varchar)) AS place, count(*) OVER () AS n FROM v)
, p AS (SELECT q.vec_id, d.label, row_number() OVER (PARTITION BY q.vec_id ORDER BY {DISTANCE_SQL}, d.vec_id) AS rn
  FROM r q JOIN r d ON q.place <= ceil(q.n * 0.3e0) AND d.place > ceil(d.n * 0.3e0))
SELECT vec_id, round(avg(label), 6) AS prediction FROM p WHERE rn <= 5 GROUP BY vec_id""")
def model_knn(spark, sf_dir):
    parted = split.train_test_split(vectors(spark, sf_dir), ["vec_id"], 0.3, seed=42)
    train, test = parted.filter("split = 'train'"), parted.filter("split = 'test'")
    scored = models.knn_predict(train, test, COORDINATES, "label", "vec_id")
    return scored.select("vec_id", F.round("prediction", 6).alias("prediction"))


@query("loo_knn", f"""
WITH v AS ({VECTORS_SQL})
, p AS (SELECT q.vec_id, q.label, d.label AS near, row_number() OVER (PARTITION BY q.vec_id ORDER BY {DISTANCE_SQL}, d.vec_id) AS rn
  FROM v q JOIN v d ON q.vec_id <> d.vec_id)
SELECT vec_id, any_value(label) AS label, round(avg(near), 6) AS prediction FROM p WHERE rn <= 5 GROUP BY vec_id""")
def loo_knn(spark, sf_dir):
    scored = models.knn_leave_one_out(vectors(spark, sf_dir), COORDINATES, "label", "vec_id")
    return scored.withColumn("prediction", F.round("prediction", 6))


# -- search ----------------------------------------------------------------------

# The keys of SPACE and STUDY are those of the config format.
SPACE = {
    "model": {
        "model_type": "xgboost",
        "n_estimators": {"type": "int", "low": 5, "high": 100},
        "learning_rate": {"type": "float", "low": 1e-3, "high": 0.3, "log": True},
        "subsample": {"type": "float", "low": 0.5, "high": 1.0},
        "max_bin": {"type": "int", "low": 2, "high": 255, "log": True},
    },
    "pruning": {
        "method": "chain_pruner",
        "steps": [
            {"method": "breadth_pruner", "sparsity_threshold": {"type": "float", "low": 0, "high": 1}},
            {"method": "depth_pruner", "layer_coverage": {"type": "categorical", "choices": [0.5, 0.75, 0.95]}},
        ],
    },
}


def draw_sql(path: str) -> str:
    return f"({hash_sql('42|' + path, 'cast(o_orderkey AS varchar)')} / 4503599627370496e0)"


@query("sweep_trials", f"""
SELECT o_orderkey AS trial,
  CAST(floor({draw_sql('model.n_estimators')} * 96e0) + 5 AS INTEGER) AS "model.n_estimators",
  round(exp({draw_sql('model.learning_rate')} * (ln(0.3e0) - ln(1e-3)) + ln(1e-3)), 9) AS "model.learning_rate",
  round({draw_sql('model.subsample')} * 0.5e0 + 0.5e0, 9) AS "model.subsample",
  CAST(greatest(2, least(255, CAST(round(exp({draw_sql('model.max_bin')} * (ln(255.5e0) - ln(1.5e0)) + ln(1.5e0))) AS INTEGER))) AS INTEGER) AS "model.max_bin",
  round({draw_sql('pruning.steps.0.sparsity_threshold')} * 1e0, 9) AS "pruning.steps.0.sparsity_threshold",
  ([0.5e0, 0.75e0, 0.95e0])[CAST(floor({draw_sql('pruning.steps.1.layer_coverage')} * 3e0) AS INTEGER) + 1] AS "pruning.steps.1.layer_coverage"
FROM orders""")
def sweep_trials(spark, sf_dir):
    """One trial per order."""
    trials = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("trial"))
    drawn = sweep.sample_trials(trials, sweep.search_space(SPACE), seed=42)
    floats = ["model.learning_rate", "model.subsample", "pruning.steps.0.sparsity_threshold"]
    return drawn.withColumns({c: F.round(F.col(f"`{c}`"), 9) for c in floats})


STUDY = {
    "data": {"target_feature": "target"},
    "experiment": {"test_size": 0.1, "seed": 42},
    "pruning": {
        "method": "chain_pruner",
        "steps": [
            {"method": "breadth_pruner", "sparsity_threshold": {"type": "float", "low": 0.5, "high": 0.8}},
            {"method": "depth_pruner", "layer_coverage": {"type": "float", "low": 0.5, "high": 1.0}},
        ],
    },
    "process": {
        "numerical": [{"type": "other", "method": "passthrough"}],
        "categorical": [{"type": "encode", "method": "ordinal", "handle_unknown": "use_encoded_value", "unknown_value": -1}],
    },
    "model": {"model_type": "random_forest", "n_estimators": {"type": "int", "low": 3, "high": 6}, "max_depth": {"type": "int", "low": 2, "high": 5}},
    "validation": {"method": "kfold", "n_splits": 3, "metrics": ["r", "mae", "rmse"]},
}


def _study_input(spark, sf_dir):
    df = fixture(spark, sf_dir, "layered_small")
    return df, build_catalog(df.filter("target is not null"), REFERENCE)


@query("sweep_study")
def sweep_study(spark, sf_dir):
    df, catalog = _study_input(spark, sf_dir)
    study, _ = experiment.run_sweep(df, catalog, STUDY, ["row_id"], n_trials=3)
    return study


@query("experiment_report")
def experiment_report(spark, sf_dir):
    df, catalog = _study_input(spark, sf_dir)
    fixed = {p: {"float": 0.75, "int": 4}[leaf["type"]] for p, leaf in sweep.search_space(STUDY).items()}
    return experiment.run_experiment(df, catalog, sweep.filled_config(STUDY, fixed), ["row_id"])[2]


# -- facts about trained models ------------------------------------------------------


@query("model_store_facts", "SELECT count(*) AS n_rows, 0.0e0 AS largest_difference FROM lineitem")
def model_store_facts(spark, sf_dir):
    """A model read back predicts what the saved one does, over all rows."""
    df = split.number_rows(model_table(spark, sf_dir), LINE_KEYS)
    path = scratch_path(spark, "model")
    fitted = models.fit(df, FEATURES, "label", GRADIENT)
    save_model(fitted, GRADIENT, path, spark)
    again, _ = load_model(path, spark)
    # both predictions ride along with their row, which is never moved
    first = models.predict(fitted, df, ["row_id", *FEATURES])
    both = models.predict(again, first.withColumnRenamed("prediction", "first"), ["row_id", "first"]).withColumnsRenamed({"prediction": "again", "first": "prediction"})
    return both.agg(F.count("*").alias("n_rows"), F.max(F.abs(F.col("prediction") - F.col("again"))).alias("largest_difference"))


@query("boosting_curve_facts", """SELECT split, 8 AS rounds, CAST(0 AS BIGINT) AS rises, true AS ends_with_model
FROM (VALUES ('train')) AS parts(split)""")
def boosting_curve_facts(spark, sf_dir):
    """The training loss has a value a round, never rises, and ends with the model's own."""
    df = model_table(spark, sf_dir)
    fitted = models.fit(df, FEATURES, "label", GRADIENT)
    curve = models.boosting_curve(fitted, {"train": df}, "label")
    before = F.lag("loss").over(Window.partitionBy("split").orderBy("iter"))
    own = models.predict(fitted, df, ["label"]).agg(F.sqrt(F.avg((F.col("label") - F.col("prediction")) ** 2))).first()[0]
    steps = curve.withColumn("rise", F.col("loss") > before * (1 + 1e-9)).groupBy("split").agg(
        F.count("*").cast("int").alias("rounds"), F.count_if("rise").alias("rises"), F.max_by("loss", "iter").alias("last")
    )
    return steps.select("split", "rounds", "rises", (F.abs(F.col("last") / F.lit(own) - 1) < 1e-6).alias("ends_with_model"))


@query("early_stopping_facts", "SELECT true AS ends_at_lowest, true AS same_losses, true AS same_rounds")
def early_stopping_facts(spark, sf_dir):
    """A model cut at its best round on the test part has that many rounds and repeats their losses."""
    parted = _split(spark, sf_dir)
    train, held = parted.filter("split = 'train'"), parted.filter("split = 'test'")
    cut, rounds = models.fit_with_evaluation(train, held, FEATURES, "label", GRADIENT, patience=2)
    kept = rounds.where("kept").join(models.boosting_curve(cut, {"test": held}, "label").withColumnRenamed("loss", "again"), "iter", "full")
    lowest = rounds.agg(F.min("loss")).first()[0]
    return kept.agg(
        (F.min("loss") == F.lit(lowest)).alias("ends_at_lowest"), F.bool_and(F.abs(F.col("loss") / F.col("again") - 1) < 1e-9).alias("same_losses"),
        F.bool_and(F.col("again").isNotNull() & F.col("loss").isNotNull()).alias("same_rounds"),
    )


@query("halving_promotions", """
WITH s AS (SELECT o_custkey AS trial, CAST(extract(year FROM o_orderdate) AS INTEGER) AS rung, min(o_totalprice) AS score
  FROM orders GROUP BY 1, 2)
, p AS (SELECT trial, rung, score, row_number() OVER (PARTITION BY rung ORDER BY score, trial) AS place, count(*) OVER (PARTITION BY rung) AS n FROM s)
SELECT trial, rung, score, CAST(place AS INTEGER) AS place, place <= ceil(n * 0.25e0) AS promoted FROM p""")
def halving_promotions(spark, sf_dir):
    """Customers as trials, years as rungs, the cheapest order as score."""
    orders = table(spark, sf_dir, "orders")
    scores = orders.groupBy(F.col("o_custkey").alias("trial"), F.year("o_orderdate").alias("rung")).agg(F.min("o_totalprice").alias("score"))
    return sweep.promoted(scores, 0.25)


@query("model_knn_facts", "SELECT count(*) AS n_rows, 0.0e0 AS largest_difference FROM embeddings")
def model_knn_facts(spark, sf_dir):
    """With one neighbour, weighted by distance, a training row is predicted by rows equal to it."""
    df = vectors(spark, sf_dir)
    fitted = models.fit(df, COORDINATES, "label", {"model_type": "knn", "n_neighbors": 1, "weights": "distance"})
    same = df.groupBy(*COORDINATES).agg(F.min("label").alias("low"), F.max("label").alias("high"))
    found = models.predict(fitted, df, ["vec_id", *COORDINATES]).join(same, COORDINATES)
    outside = F.greatest(F.col("low") - F.col("prediction"), F.col("prediction") - F.col("high"), F.lit(0.0))
    return found.agg(F.count("*").alias("n_rows"), F.max(outside).alias("largest_difference"))

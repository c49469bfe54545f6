"""Regressors on Spark ML, the exact neighbour regressor, and their reports."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from typing import Any, NamedTuple

from pyspark import SparkContext
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.functions.hashing import key_hash
from lamina.operators.split import row_key
from lamina.operators.stats import metric_aggregates, regression_metrics
from lamina.plans.neighbours import mean_value, nearest, weighted_value
from lamina.plans.row_index import with_row_index
from lamina.session import materialise

FIT_THREADS = 4
# The deepest tree that can be trained; stands for no limit.
UNLIMITED_DEPTH = 30

# Option names of each model type and the Spark ML parameter they set.
_FOREST = {"n_estimators": "numTrees", "max_depth": "maxDepth", "min_samples_leaf": "minInstancesPerNode",
           "max_features": "featureSubsetStrategy", "random_state": "seed", "max_bins": "maxBins"}
_HISTOGRAM = {"max_iter": "maxIter", "learning_rate": "stepSize", "max_depth": "maxDepth", "max_bins": "maxBins",
              "min_samples_leaf": "minInstancesPerNode", "random_state": "seed"}
_GRADIENT = {"n_estimators": "maxIter", "eta": "stepSize", "learning_rate": "stepSize", "max_depth": "maxDepth",
             "subsample": "subsamplingRate", "colsample_bytree": "featureSubsetStrategy",
             "min_child_weight": "minInstancesPerNode", "gamma": "minInfoGain", "max_bin": "maxBins",
             "random_state": "seed"}
_ORDERED = {"iterations": "maxIter", "n_estimators": "maxIter", "depth": "maxDepth", "max_depth": "maxDepth",
            "learning_rate": "stepSize", "border_count": "maxBins", "subsample": "subsamplingRate",
            "rsm": "featureSubsetStrategy", "min_data_in_leaf": "minInstancesPerNode", "random_state": "seed"}
# Options that end boosting early.
STOPPING = ("early_stopping_rounds", "od_type", "od_wait")
# Options that only concern threads, printing or files.
_IGNORED = {"n_jobs", "verbose", "eval_metric", "allow_writing_files"}
MODELS = {
    "random_forest": (RandomForestRegressor, _FOREST, {"numTrees": 100, "maxDepth": 10, "featureSubsetStrategy": "all", "seed": 42}),
    "hist_gradient_boost": (GBTRegressor, _HISTOGRAM, {"maxIter": 100, "stepSize": 0.1, "maxDepth": 5, "maxBins": 255, "minInstancesPerNode": 20, "seed": 42}),
    "xgboost": (GBTRegressor, _GRADIENT, {"maxIter": 100, "stepSize": 0.3, "maxDepth": 6, "maxBins": 256, "seed": 42}),
    "catboost": (GBTRegressor, _ORDERED, {"maxIter": 1000, "stepSize": 0.03, "maxDepth": 6, "maxBins": 254, "seed": 42}),
}


def create_estimator(config: Mapping[str, Any], features: str = "features", label: str = "label"):
    """Estimator for a config with ``model_type`` and options.

    An option without a counterpart is an error, unless the config says ``unsupported = "record"``: then it is
    left out and ``dropped_options`` names it.  Two options only come close to their namesakes: ``gamma`` is a least gain of variance, and
    ``colsample_bytree`` and ``rsm`` draw features for each node rather than for each tree.
    """
    options = dict(config)
    unsupported = options.pop("unsupported", "error")
    if unsupported not in ("error", "record"):
        raise ValueError(f"unknown option unsupported={unsupported!r}")
    kind = options.pop("model_type", None)
    if kind not in MODELS:
        raise ValueError(f"unknown model type {kind!r}; known: {sorted(MODELS)} and knn")
    estimator, names, defaults = MODELS[kind]
    params = dict(defaults)
    for option, value in options.items():
        if option in _IGNORED:
            continue
        if option not in names:
            if unsupported == "record":
                continue
            raise ValueError(f"{kind} option {option!r} has no counterpart")
        param = names[option]
        if param == "featureSubsetStrategy":
            value = _feature_subset(kind, option, value)
        if param == "minInstancesPerNode":
            if isinstance(value, float) and 0 < value < 1:
                raise ValueError(f"{kind} option {option}={value} is a share of the rows; give a number of rows")
            value = max(1, int(value))
        if param == "maxDepth" and value is None:
            value = UNLIMITED_DEPTH
        if param == "maxBins":
            value = max(2, int(value))
        params[param] = value
    return estimator(featuresCol=features, labelCol=label, predictionCol="prediction", **params)


def dropped_options(config: Mapping[str, Any]) -> list[str]:
    """Options of a config that its model type has no counterpart for."""
    known = {"model_type", "unsupported", *_IGNORED, *MODELS.get(config.get("model_type"), (None, {}, None))[1]}
    return [] if config.get("model_type") == "knn" else sorted(set(config) - known)


def _feature_subset(kind: str, option: str, value) -> str:
    """Spark's name for a number of features: a whole number counts them, a fraction is a share, None is all."""
    if value is None or isinstance(value, float) and value == 1.0:
        return "all"
    if isinstance(value, int) and option != "max_features":
        # a share in these options, whatever its type
        return "all" if value == 1 else str(value)
    return str(value)


# -- feature vectors -------------------------------------------------------------


def fit_missing(df: DataFrame, features: Sequence[str]) -> dict[str, float]:
    """A value below the column's range that stands for a missing cell.

    Trees can then separate missing cells by one threshold.
    """
    row = df.agg(
        *[F.min(c).cast("double").alias(f"l{i}") for i, c in enumerate(features)],
        *[F.max(c).cast("double").alias(f"h{i}") for i, c in enumerate(features)],
    ).first()
    return {
        c: 0.0 if row[f"l{i}"] is None else row[f"l{i}"] - 1.0 - (row[f"h{i}"] - row[f"l{i}"])
        for i, c in enumerate(features)
    }


def filled(features: Sequence[str], missing: Mapping[str, float]) -> list[Column]:
    return [F.coalesce(F.col(c).cast("double"), F.lit(missing[c])).alias(c) for c in features]


def assemble(df: DataFrame, features: Sequence[str], missing: Mapping[str, float], keep: Sequence[str]) -> DataFrame:
    """``keep`` columns and the feature vector, nothing else."""
    vectors = VectorAssembler(inputCols=[f"_x{i}" for i in range(len(features))], outputCol="features")
    numbers = [c.alias(f"_x{i}") for i, c in enumerate(filled(features, missing))]
    narrow = df.select(*keep, *numbers)
    return vectors.transform(narrow).select(*keep, "features")


class Fitted(NamedTuple):
    """A trained model with what it takes to apply it to raw columns."""

    model: Any
    features: tuple[str, ...]
    missing: dict[str, float]

    def vectors(self, df: DataFrame, keep: Sequence[str]) -> DataFrame:
        return assemble(df, self.features, self.missing, keep)


def balanced(data: DataFrame) -> DataFrame:
    """``data`` persisted for repeated passes, dealt out evenly if it has fewer partitions than cores.

    A table with enough partitions is not shuffled.  A lost block is computed again.
    """
    data = data.persist()
    cores = data.sparkSession.sparkContext.defaultParallelism
    if data.rdd.getNumPartitions() >= cores:
        return data
    spread = data.repartition(cores).persist()
    spread.count()
    data.unpersist()
    return spread


class Neighbours(NamedTuple):
    """A neighbour regressor: its training rows ``(id, f0.., label)`` and options."""

    rows: DataFrame
    n_neighbors: int = 5
    weights: str = "uniform"


def _fit_knn(df: DataFrame, features: Sequence[str], label: str, missing: Mapping[str, float], config: Mapping[str, Any]) -> Neighbours:
    options = {k: v for k, v in config.items() if k not in _IGNORED and k != "model_type"}
    if options.pop("p", 2) != 2 or options.pop("metric", "minkowski") not in ("minkowski", "euclidean"):
        raise ValueError("knn uses the Euclidean distance")
    if set(options) - {"n_neighbors", "weights"} or options.get("weights", "uniform") not in ("uniform", "distance"):
        raise ValueError(f"knn options without a counterpart in {sorted(options)}")
    cells = [c.alias(f"f{i}") for i, c in enumerate(filled(features, missing))]
    narrow = df.select(*cells, F.col(label).cast("double").alias("label"))
    # Rows have no number here; equal distances are ordered by a hash of the row.
    return Neighbours(narrow.withColumn("id", F.xxhash64(*narrow.columns)), **options)


def _predict_knn(fitted: Fitted, df: DataFrame, keep: Sequence[str], cells: Column) -> DataFrame:
    model = fitted.model
    vec = F.array(*[F.col(f"f{i}") for i in range(len(fitted.features))])
    given = model.rows.select(F.lit("0").alias("space"), vec.alias("vec"), "id", F.col("label").alias("value"))
    asked = df.select(*keep, F.lit("0").alias("space"), cells.alias("vec"))
    near = nearest(asked, given, model.n_neighbors)
    value = mean_value(F.col("near")) if model.weights == "uniform" else weighted_value(F.col("near"))
    return near.select(*keep, value.alias("prediction"))


def fit(
    df: DataFrame, features: Sequence[str], label: str, config: Mapping[str, Any], is_balanced: bool = False
) -> Fitted:
    """Train on ``df``.  The learner keeps its own binned copy; ``is_balanced`` data are only read for it.

    ``min_samples_leaf`` may be a share of the rows, rounded up.
    """
    share = config.get("min_samples_leaf")
    if isinstance(share, float) and 0 < share < 1:
        config = {**config, "min_samples_leaf": max(1, math.ceil(share * df.count()))}
    missing = fit_missing(df, features)
    if config.get("model_type") == "knn":
        return Fitted(_fit_knn(df, features, label, missing, config), tuple(features), missing)
    data = assemble(df, features, missing, [label])
    if is_balanced:
        return Fitted(create_estimator(config, label=label).fit(data), tuple(features), missing)
    data = balanced(data)
    try:
        model = create_estimator(config, label=label).fit(data)
    finally:
        data.unpersist()
    return Fitted(model, tuple(features), missing)


def stopping_patience(config: Mapping[str, Any]) -> tuple[int | None, dict]:
    """Rounds without improvement after which boosting ends, if the config has an option for it, and the config without it."""
    rest = {k: v for k, v in config.items() if k not in STOPPING}
    if config.get("early_stopping_rounds") is not None:
        return int(config["early_stopping_rounds"]), rest
    if config.get("od_wait") is None and config.get("od_type") is None:
        return None, rest
    if config.get("od_type", "Iter") != "Iter":
        raise ValueError(f"od_type {config['od_type']!r} has no counterpart")
    return int(config.get("od_wait", 20)), rest


def fit_with_evaluation(
    train: DataFrame, evaluation: DataFrame, features: Sequence[str], label: str, config: Mapping[str, Any], patience: int,
) -> tuple[Fitted, DataFrame]:
    """A boosted model that ends with its best round on ``evaluation``, and ``(iter, loss, kept)``.

    Rounds stop counting when the evaluation RMSE has not fallen for ``patience`` rounds; the model keeps the rounds up to the
    lowest one before that, the first of equal ones.
    """
    fitted = fit(train, features, label, config)
    if not hasattr(fitted.model, "evaluateEachIteration"):
        raise ValueError(f"{config.get('model_type')} has no rounds to stop")
    curve = [r["loss"] for r in boosting_curve(fitted, {"evaluation": evaluation}, label).orderBy("iter").collect()]
    best, seen = 0, 0
    for seen, loss in enumerate(curve):
        if loss < curve[best]:
            best = seen
        if seen - best >= patience:
            break
    table = train.sparkSession.createDataFrame([(i, x, i <= best) for i, x in enumerate(curve[: seen + 1])], "iter int, loss double, kept boolean")
    return fitted._replace(model=first_rounds(fitted.model, best + 1)), table


def first_rounds(model: GBTRegressionModel, rounds: int) -> GBTRegressionModel:
    """The boosted model of the first rounds alone."""
    context = model._sc if hasattr(model, "_sc") else SparkContext._active_spark_context
    jvm, java = context._jvm, model._java_obj
    trees = context._gateway.new_array(jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, rounds)
    weights = context._gateway.new_array(jvm.double, rounds)
    for k in range(rounds):
        trees[k], weights[k] = java.trees()[k], java.treeWeights()[k]
    cut = GBTRegressionModel(jvm.org.apache.spark.ml.regression.GBTRegressionModel(java.uid(), trees, weights))
    model._copyValues(cut)
    return cut


def predict(fitted: Fitted, df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """``keep`` columns and ``prediction``."""
    if isinstance(fitted.model, Neighbours):
        return _predict_knn(fitted, df, keep, F.array(*filled(fitted.features, fitted.missing)))
    return fitted.model.transform(fitted.vectors(df, keep)).drop("features")


def predict_arrays(fitted: Fitted, df: DataFrame, keep: Sequence[str], cells: str) -> DataFrame:
    """``keep`` columns and ``prediction`` for rows whose complete feature values are in an array column."""
    if isinstance(fitted.model, Neighbours):
        return _predict_knn(fitted, df, keep, F.col(cells))
    return fitted.model.transform(df.select(*keep, array_to_vector(cells).alias("features"))).drop("features")


# -- nearest neighbours ----------------------------------------------------------


def knn_predict(
    train: DataFrame, test: DataFrame, features: Sequence[str], label: str, row_id: str,
    n_neighbors: int = 5, keep: Sequence[str] = (),
) -> DataFrame:
    """``(row_id, keep..., prediction)``: mean label of the nearest training rows, ties by row id."""
    vec = F.array(*[F.col(c).cast("double") for c in features])
    asked = test.select(row_id, *keep, F.lit("0").alias("space"), vec.alias("vec"))
    given = train.select(
        F.lit("0").alias("space"), vec.alias("vec"), F.col(row_id).cast("bigint").alias("id"),
        F.col(label).cast("double").alias("value"),
    )
    near = nearest(asked, given, n_neighbors)
    return near.select(row_id, *keep, mean_value(F.col("near")).alias("prediction"))


def knn_leave_one_out(
    df: DataFrame, features: Sequence[str], label: str, row_id: str, n_neighbors: int = 5, weights: str = "uniform"
) -> DataFrame:
    """``(row_id, label, prediction)``, each row predicted from all the others.

    One more neighbour than needed is found, then the row itself is taken out.
    """
    vec = F.array(*[F.col(c).cast("double") for c in features])
    asked = df.select(row_id, F.col(label).alias("label"), F.lit("0").alias("space"), vec.alias("vec"))
    given = df.select(
        F.lit("0").alias("space"), vec.alias("vec"), F.col(row_id).cast("bigint").alias("id"),
        F.col(label).cast("double").alias("value"),
    )
    near = nearest(asked, given, n_neighbors + 1)
    others = F.slice(F.filter("near", lambda n: n["id"] != F.col(row_id)), 1, n_neighbors)
    value = mean_value(F.col("_others")) if weights == "uniform" else weighted_value(F.col("_others"))
    return near.withColumn("_others", others).select(row_id, "label", value.alias("prediction"))


# -- cross-validation and reports ------------------------------------------------


def cross_validate(
    folded: DataFrame, features: Sequence[str], label: str, config: Mapping[str, Any],
    metrics: Sequence[str] = ("rmse",), fold: str = "fold", role: str | None = None, threads: int = FIT_THREADS,
) -> DataFrame:
    """``(fold, split, metric, value)``: fit without a fold's rows, score on them and on the rest.

    With ``role``, a row may occur in several folds and says there whether it is ``train`` or
    ``test``.  Folds are fitted from a few driver threads; each fit and each score is a Spark
    job over the same persisted columns.  Stand-ins for missing cells come from the training part.
    """
    unknown = [m for m in metrics if m not in metric_aggregates()]
    if unknown:
        raise ValueError(f"unsupported metrics {unknown}")
    side = [F.col(role).alias("_role")] if role else []
    columns = [fold, *side, F.col(label).alias("label"), *[F.col(c).cast("double") for c in features]]
    data = balanced(folded.select(*columns))
    numbers = [r[0] for r in data.select(fold).distinct().orderBy(fold).collect()]

    def scores(number) -> DataFrame:
        if role:
            part = data.filter(F.col(fold) == number).withColumnRenamed("_role", "split")
        else:
            test = F.col(fold) == number
            part = data.withColumn("split", F.when(test, F.lit("test")).otherwise(F.lit("train")))
        fitted = fit(part.filter(F.col("split") == "train"), features, "label", config, is_balanced=True)
        table = regression_metrics(predict(fitted, part, ["split", "label"]), ["split"], metrics)
        return table.select(F.lit(number).alias("fold"), "split", "metric", "value")

    try:
        with ThreadPoolExecutor(threads) as pool:
            # written, so that the result doesn't need the persisted rows any more
            return materialise(reduce(DataFrame.unionByName, pool.map(scores, numbers)), "scores")
    finally:
        data.unpersist()


def leave_one_out_scores(scored: DataFrame, row_id: str, metrics: Sequence[str]) -> DataFrame:
    """``(fold, split, metric, value)`` with one fold per row of ``(row_id, label, prediction)``."""
    error = F.abs(F.col("label") - F.col("prediction"))
    known = {"mae": error, "rmse": error, "mse": error * error, "r2": F.lit(float("nan")), "r": F.lit(float("nan"))}
    unknown = [m for m in metrics if m not in known]
    if unknown:
        raise ValueError(f"unsupported metrics {unknown}")
    entries = F.array(*[F.struct(F.lit(m).alias("metric"), known[m].alias("value")) for m in metrics])
    return scored.select(F.col(row_id).alias("fold"), F.explode(entries).alias("e")).select(
        "fold", F.lit("test").alias("split"), "e.metric", "e.value"
    )


def paired_scores(scores: DataFrame) -> DataFrame:
    """``(fold, metric, train, test)`` of ``(fold, split, metric, value)``."""
    return scores.groupBy("fold", "metric").agg(
        *[F.max(F.when(F.col("split") == s, F.col("value"))).alias(s) for s in ("train", "test")]
    )


def train_report(
    df: DataFrame, features: Sequence[str], label: str, config: Mapping[str, Any], split: str = "split",
    cv_fold: str | None = None, cv_metrics: Sequence[str] = ("rmse",),
) -> tuple[Fitted, DataFrame]:
    """Fit on the train part; ``(split, metric, value)`` on train and ``val``, then on the folds if any.

    The reported r2 has the variance of the predictions below it, and r is its root.  With ``early_stopping_rounds``, or
    ``od_wait``, a boosted model ends with its best round on the other rows; folds take all rounds.
    """
    train = df.filter(F.col(split) == "train")
    patience, config = stopping_patience(config)
    held = df.filter(F.col(split) != "train")
    if patience is None or held.isEmpty():
        fitted = fit(train, features, label, config)
    else:
        fitted, _ = fit_with_evaluation(train, held, features, label, config, patience)
    side = F.when(F.col(split) == "train", F.lit("train")).otherwise(F.lit("val"))
    scored = predict(fitted, df.select(side.alias("split"), F.col(label).alias("label"), *features), ["split", "label"])
    known = metric_aggregates()
    report = {m: known[m] for m in ("mae", "mse", "rmse")}
    report["r2"] = known["r2_pred_denominator"]
    report["r"] = F.sqrt(known["r2_pred_denominator"])
    table = regression_metrics(scored, ["split"], aggregates=report)
    if cv_fold:
        folds = cross_validate(train, features, label, config, cv_metrics, cv_fold)
        means = folds.groupBy("split", "metric").agg(F.avg("value").alias("value"))
        table = table.unionByName(means.select(F.concat(F.lit("cv_"), "split").alias("split"), "metric", "value"))
    return fitted, table


def actual_vs_predicted(fitted: Fitted, df: DataFrame, label: str, split: str = "split", keep: Sequence[str] = ()) -> DataFrame:
    named = df.select(*keep, F.col(split).alias("split"), F.col(label).alias("label"), *[c for c in fitted.features if c not in keep])
    return predict(fitted, named, [*keep, "split", "label"])


def boosting_curve(fitted: Fitted, parts: Mapping[str, DataFrame], label: str) -> DataFrame:
    """``(iter, split, loss)``: RMSE after every boosting round on each part."""
    rows = []
    for name, part in parts.items():
        data = balanced(fitted.vectors(part, [label]))
        for i, loss in enumerate(fitted.model.evaluateEachIteration(data, "squared")):
            rows.append((i, name, float(loss) ** 0.5))
        data.unpersist()
    spark = next(iter(parts.values())).sparkSession
    return spark.createDataFrame(rows, "iter int, split string, loss double")


def importance_topk(fitted: Fitted, spark, k: int = 20) -> DataFrame:
    """``(feature, feature_importance)`` by the model's own measure, the k largest."""
    values = fitted.model.featureImportances.toArray().tolist()
    table = spark.createDataFrame(list(zip(fitted.features, values)), "feature string, feature_importance double")
    return table.orderBy(F.desc("feature_importance"), "feature").limit(k)


def permutation_importance(
    fitted: Fitted, df: DataFrame, label: str, keys: Sequence[str], seed: int = 42
) -> DataFrame:
    """``(feature, feature_importance)``: rise of the MSE when one column's values are dealt out anew.

    Rows are numbered by one hash and the values by another; row i gets value i.  Both
    numberings are range shuffles, and every row of the table takes part.
    """
    features = list(fitted.features)
    frame, _ = with_row_index(
        df.select(F.col(label).alias("label"), F.array(*filled(features, fitted.missing)).alias("_x"), key_hash(seed, "a", row_key(*keys)).alias("_a"),
                  row_key(*keys).alias("_k")), ["_a", "_k"], "_i"
    )
    dealt, _ = with_row_index(
        df.select(F.array(*filled(features, fitted.missing)).alias("_d"), key_hash(seed, "b", row_key(*keys)).alias("_b"),
                  row_key(*keys).alias("_q")), ["_b", "_q"], "_i"
    )
    # one row per feature dealt out, -1 for none; the plan does not grow with the features
    rows = frame.join(dealt, "_i").select("label", "_x", "_d", F.explode(F.sequence(F.lit(-1), F.lit(len(features) - 1))).alias("_f"))
    mixed = F.transform("_x", lambda x, f: F.when(f == F.col("_f"), F.get("_d", f)).otherwise(x))
    scored = predict_arrays(fitted, rows.select("label", "_f", mixed.alias("_v")), ["_f", "label"], "_v")
    error = F.col("label") - F.col("prediction")
    mse = {r["_f"]: r["mse"] for r in scored.groupBy("_f").agg(F.avg(error * error).alias("mse")).collect()}
    rises = [(f, mse[k] - mse[-1]) for k, f in enumerate(features)]
    return df.sparkSession.createDataFrame(rises, "feature string, feature_importance double").orderBy(
        F.desc("feature_importance"), "feature"
    )

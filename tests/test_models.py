import pytest
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from lamina.operators import explain, models
from lamina.sources.model_store import load_model, save_model

FEATURES = ["a", "b", "c"]
FOREST = {"model_type": "random_forest", "n_estimators": 5, "max_depth": 4}


@pytest.fixture(scope="module")
def data(spark):
    df = spark.range(400).select(
        "id", (F.col("id") * 37 % 101 / 10.0).alias("a"), F.when(F.col("id") % 7 != 0, F.col("id") * 53 % 89 / 10.0).alias("b"),
        (F.col("id") * 11 % 13 / 1.0).alias("c"),
    )
    return df.withColumn("label", 3 * F.col("a") - 2 * F.coalesce("b", F.lit(20.0)) + F.col("a") * F.col("c") / 10).withColumn(
        "split", F.when(F.col("id") % 10 == 0, F.lit("test")).otherwise(F.lit("train"))
    ).persist()


@pytest.mark.parametrize(
    "config",
    [FOREST, {"model_type": "xgboost", "n_estimators": 5, "eta": 0.5, "subsample": 0.9, "gamma": 0.0, "min_child_weight": 1, "n_jobs": -1},
     {"model_type": "catboost", "iterations": 5, "depth": 4, "learning_rate": 0.5, "border_count": 64, "verbose": False},
     {"model_type": "hist_gradient_boost", "max_iter": 5, "learning_rate": 0.5, "min_samples_leaf": 2}],
)
def test_models_beat_the_mean(data, config):
    _, report = models.train_report(data, FEATURES, "label", config)
    got = {(r["split"], r["metric"]): r["value"] for r in report.collect()}
    spread = data.filter("split = 'test'").agg(F.stddev_pop("label")).first()[0]
    assert got["val", "rmse"] < spread and got["train", "rmse"] < spread
    assert {s for s, _ in got} == {"train", "val"} and {m for _, m in got} == {"r2", "r", "mae", "mse", "rmse"}


def test_unknown_options(spark):
    for bad in ({"model_type": "svm"}, {"model_type": "catboost", "l2_leaf_reg": 1.0}, {"model_type": "xgboost", "booster": "dart"}):
        with pytest.raises(ValueError):
            models.create_estimator(bad)


def test_cross_validation(data):
    folded = data.withColumn("fold", (F.col("id") % 3).cast("int"))
    scores = models.cross_validate(folded, FEATURES, "label", FOREST, ["rmse", "r"])
    assert {(r["fold"], r["split"], r["metric"]) for r in scores.collect()} == {(f, s, m) for f in range(3) for s in ("train", "test") for m in ("rmse", "r")}
    roles = data.select("*", F.explode(F.array(*map(F.lit, range(2)))).alias("fold")).withColumn("role", F.when(F.col("id") % 4 == F.col("fold"), F.lit("test")).otherwise(F.lit("train")))
    pairs = models.paired_scores(models.cross_validate(roles, FEATURES, "label", FOREST, ["rmse"], role="role")).collect()
    assert len(pairs) == 2 and all(p["train"] > 0 and p["test"] > 0 for p in pairs)
    with pytest.raises(ValueError):
        models.cross_validate(folded, FEATURES, "label", FOREST, ["mape"])


def test_save_and_load(spark, data, tmp_path):
    for config in (FOREST, {"model_type": "xgboost", "n_estimators": 3}):
        fitted = models.fit(data, FEATURES, "label", config)
        path = str(tmp_path / config["model_type"])
        save_model(fitted, config, path, spark)
        again, stored = load_model(path, spark)
        assert stored == config
        assert sorted(models.predict(fitted, data, ["id"]).collect()) == sorted(models.predict(again, data, ["id"]).collect())


def test_curve_falls_and_importance(spark, data):
    fitted = models.fit(data, FEATURES, "label", {"model_type": "xgboost", "n_estimators": 6, "eta": 0.3})
    curve = models.boosting_curve(fitted, {"train": data, "val": data.filter("split = 'test'")}, "label").collect()
    train = [r["loss"] for r in sorted(curve) if r["split"] == "train"]
    assert len(train) == 6 and train == sorted(train, reverse=True)
    top = models.importance_topk(fitted, spark, 2).collect()
    assert len(top) == 2 and top[0]["feature_importance"] >= top[1]["feature_importance"]
    rises = {r["feature"]: r["feature_importance"] for r in models.permutation_importance(fitted, data, "label", ["id"]).collect()}
    assert set(rises) == set(FEATURES) and rises["b"] > 0


def linear(data, spark):
    """An additive model with the same interface as the trees."""
    missing = models.fit_missing(data, FEATURES)
    vectors = models.assemble(data, FEATURES, missing, ["label"])
    return models.Fitted(LinearRegression(featuresCol="features", labelCol="label").fit(vectors), tuple(FEATURES), missing)


def test_shapley_adds_up(spark, data):
    for fitted in (models.fit(data, FEATURES, "label", FOREST), linear(data, spark), models.fit(data, FEATURES, "label", {"model_type": "knn"})):
        values, ends = explain.sampled_shapley(fitted, data, "id", n_samples=6)
        sums = {r["id"]: r["s"] for r in values.groupBy("id").agg(F.sum("value").alias("s")).collect()}
        direct = {r["id"]: r["prediction"] for r in models.predict(fitted, data, ["id"]).collect()}
        rows = ends.collect()
        assert len(rows) == 400
        for r in rows:
            assert r["prediction"] == pytest.approx(direct[r["id"]])
            assert sums[r["id"]] == pytest.approx(r["prediction"] - r["base"], abs=1e-9)


def test_shapley_of_a_linear_model_is_exact(spark, data):
    fitted = linear(data, spark)
    lines = explain._prepared(data, fitted, "id", 2, 42).select("id", "_x", "_z").collect()
    values, _ = explain.sampled_shapley(fitted, data, "id", n_samples=2)
    expected = {}
    for r in lines:
        for i, (x, z) in enumerate(zip(r["_x"], r["_z"])):
            expected[r["id"], FEATURES[i]] = expected.get((r["id"], FEATURES[i]), 0.0) + fitted.model.coefficients[i] * (x - z) / 2
    # backgrounds come from the whole table, not from a few rows
    assert len({tuple(r["_z"]) for r in lines}) > 150
    for r in values.collect():
        assert r["value"] == pytest.approx(expected[r["id"], r["feature"]], abs=1e-9)


def test_interactions(spark, data):
    additive = explain.sampled_interactions(linear(data, spark), data, "id", 2)
    assert additive.agg(F.max(F.abs("value"))).first()[0] < 1e-9
    pairs = explain.sampled_interactions(models.fit(data, FEATURES, "label", FOREST), data, "id", 2)
    got = {(r["id"], r["feature_i"], r["feature_j"]): r["value"] for r in pairs.collect()}
    assert len(got) == 400 * 6 and all(v == got[i, b, a] for (i, a, b), v in got.items())
    matrix = explain.interaction_matrix(pairs)
    assert matrix.count() == 6 and explain.interaction_pairs(matrix, 1e9).count() == 0


def test_leave_one_out_with_copies(spark):
    # more copies of one point than neighbours: the row itself may not be among the nearest
    rows = [(i, 0.0, float(i)) for i in range(12)] + [(12, 5.0, 100.0)]
    df = spark.createDataFrame(rows, "id bigint, x double, y double")
    got = {r["id"]: r["prediction"] for r in models.knn_leave_one_out(df, ["x"], "y", "id", 3).collect()}
    assert got[0] == 2.0 and got[1] == pytest.approx(5 / 3) and got[11] == 1.0 and got[12] == 1.0


def test_knn_as_a_model(spark, data, tmp_path):
    config = {"model_type": "knn", "n_neighbors": 2, "weights": "distance", "n_jobs": -1}
    train = spark.createDataFrame([(0.0, 1.0), (1.0, 2.0), (4.0, 9.0)], "x double, y double")
    fitted = models.fit(train, ["x"], "y", config)
    asked = spark.createDataFrame([(1, 0.0), (2, 0.25)], "id int, x double")
    got = {r["id"]: r["prediction"] for r in models.predict(fitted, asked, ["id"]).collect()}
    # at 0.25: weights 4 and 4/3
    assert got == {1: 1.0, 2: pytest.approx((1 * 4 + 2 * 4 / 3) / (4 + 4 / 3))}
    save_model(fitted, config, str(tmp_path / "knn"), spark)
    again, _ = load_model(str(tmp_path / "knn"), spark)
    assert {r["id"]: r["prediction"] for r in models.predict(again, asked, ["id"]).collect()} == got
    _, report = models.train_report(data, FEATURES, "label", {"model_type": "knn"})
    assert {r["split"] for r in report.collect()} == {"train", "val"}
    for bad in ({"p": 1}, {"weights": "cubic"}, {"leaf_size": 3}):
        with pytest.raises(ValueError):
            models.fit(train, ["x"], "y", {"model_type": "knn", **bad})


def test_leave_one_out_of_an_experiment(spark, data):
    from lamina.operators import experiment

    part = data.filter("id < 60").select("id", "split", "label", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in FEATURES])
    prepared = experiment.Prepared(part, tuple(FEATURES))
    config = {"model": {"model_type": "knn", "n_neighbors": 3}, "validation": {"method": "leave_one_out", "metrics": ["mae", "mse"]}}
    scores = experiment.validate(prepared, config, ["id"]).collect()
    rows = {r["id"]: r for r in part.filter("split = 'train'").collect()}
    assert len(scores) == 2 * len(rows)
    total = 0.0
    for i, r in rows.items():
        others = sorted((sum((r[f] - o[f]) ** 2 for f in FEATURES), j, o["label"]) for j, o in rows.items() if j != i)
        total += abs(r["label"] - sum(label for _, _, label in others[:3]) / 3)
    assert sum(s["value"] for s in scores if s["metric"] == "mae") == pytest.approx(total)


def test_options_by_value_type():
    def setting(kind, name, **options):
        return models.create_estimator({"model_type": kind, **options}).getOrDefault(name)

    table = [
        ("random_forest", "featureSubsetStrategy", {"max_features": 1}, "1"), ("random_forest", "featureSubsetStrategy", {"max_features": 1.0}, "all"),
        ("random_forest", "featureSubsetStrategy", {"max_features": 0.5}, "0.5"), ("random_forest", "featureSubsetStrategy", {"max_features": None}, "all"),
        ("random_forest", "maxDepth", {"max_depth": None}, 30), ("random_forest", "minInstancesPerNode", {"min_samples_leaf": 3}, 3),
        ("xgboost", "featureSubsetStrategy", {"colsample_bytree": 1}, "all"),
    ]
    for kind, name, options, expected in table:
        assert setting(kind, name, **options) == expected
    with pytest.raises(ValueError):
        models.create_estimator({"model_type": "random_forest", "min_samples_leaf": 0.1})
    sweep_options = {"model_type": "catboost", "l2_leaf_reg": 3, "od_type": "Iter", "depth": 4}
    with pytest.raises(ValueError):
        models.create_estimator(sweep_options)
    assert models.create_estimator({**sweep_options, "unsupported": "record"}).getMaxDepth() == 4
    assert models.dropped_options(sweep_options) == ["l2_leaf_reg", "od_type"]


def test_leave_one_out_weights_matter(spark):
    rows = [(i, float(i), float(i * i)) for i in range(12)]
    df = spark.createDataFrame(rows, "id long, x double, y double")
    plain, near = (
        [r["prediction"] for r in models.knn_leave_one_out(df, ["x"], "y", "id", 3, w).orderBy("id").collect()] for w in ("uniform", "distance")
    )
    assert plain != near

import os
import random

import pytest
from pyspark.sql import functions as F

from lamina.operators import experiment, models, sweep

CONFIG = {
    "data": {"target_feature": "y"},
    "experiment": {"test_size": 0.25, "seed": 3},
    "process": {
        "numerical": [{"type": "impute", "method": "simple", "strategy": {"type": "categorical", "choices": ["mean", "median"]}}],
        "categorical": [{"type": "encode", "method": "ordinal", "handle_unknown": "use_encoded_value"}],
    },
    "model": {"model_type": "xgboost", "n_estimators": 3, "max_depth": {"type": "int", "low": 1, "high": 3}},
}


@pytest.fixture(scope="module")
def plain(spark):
    """A table without a field catalog: text, numbers with gaps, a date."""
    rng = random.Random(1)
    rows = [(i, None if i % 7 == 0 else rng.random(), rng.choice("abc"), rng.random() + (i % 2)) for i in range(200)]
    return spark.createDataFrame(rows, "id long, x double, kind string, y double").withColumn("day", F.current_date()).persist()


def test_a_plain_table_needs_no_catalog(spark, plain):
    config = {**CONFIG, "process": {**CONFIG["process"], "numerical": [{"type": "impute", "method": "simple"}]}, "model": {"model_type": "xgboost", "n_estimators": 2}}
    fitted, prepared, report = experiment.run_experiment(plain, None, config, ["id"])
    assert prepared.features == ("x", "kind") == fitted.features
    assert prepared.frame.count() == 200 and {r["split"] for r in report.collect()} == {"train", "val"}
    chosen = experiment.prepare(plain, None, {**config, "data": {"target_feature": "y", "features": ["x"]}}, ["id"])
    assert chosen.features == ("x",)
    with pytest.raises(ValueError, match="catalog"):
        experiment.prepare(plain, None, {**config, "pruning": {"method": "breadth_pruner"}}, ["id"])


def test_trials_share_what_they_prepare_alike(spark, plain, monkeypatch):
    written = []
    path_of = experiment.scratch_path
    monkeypatch.setattr(experiment, "scratch_path", lambda s, name: written.append((name, path_of(s, name))) or written[-1][1])
    study, best = experiment.run_sweep(plain, None, CONFIG, ["id"], n_trials=8, seed=5)
    rows = study.collect()
    strategies = {r["process.numerical.0.strategy"] for r in rows}
    assert len(rows) == 8 and len(strategies) == 2
    assert sorted(name for name, _ in written) == ["prepared", "prepared", "wide"]
    # deleted with their last trial
    assert not any(os.path.exists(path) for _, path in written)
    lowest = min(rows, key=lambda r: (r["score"], r["trial"]))
    assert best["model"]["max_depth"] == lowest["model.max_depth"]
    alone = {**CONFIG, "model": {**CONFIG["model"], "max_depth": lowest["model.max_depth"]}}
    alone["process"] = {**CONFIG["process"], "numerical": [{**CONFIG["process"]["numerical"][0], "strategy": lowest["process.numerical.0.strategy"]}]}
    assert experiment.objective(plain, None, alone, ["id"]) == pytest.approx(lowest["score"])


def test_a_failing_preparation_fails_every_trial_that_needs_it(spark, plain):
    shared = experiment.Preparations(plain, None, ["id"])
    bad = {**CONFIG, "process": {"numerical": [{"type": "impute", "method": "other"}]}}
    shared.expect([bad, bad])
    for _ in range(2):
        with pytest.raises(ValueError):
            shared.get(bad)
        shared.release(bad)


SPACE = {"model": {"depth": {"type": "int", "low": 1, "high": 1000}}}


def test_halving_keeps_the_best_of_each_rung(spark):
    calls, ended = [], []

    def objective(config, budget):
        calls.append((config["model"]["depth"], budget))
        return config["model"]["depth"] + 1.0 / budget

    study = sweep.successive_halving(spark, SPACE, objective, 18, [1, 3, 9], 1 / 3, seed=2, ended=lambda c: ended.append(c["model"]["depth"]))
    rows = study.collect()
    assert [sum(r["rung"] == k for r in rows) for k in range(3)] == [18, 6, 2]
    # the best of the exhaustive search is the best of the last rung
    full = sweep.run_study(spark, SPACE, lambda c: c["model"]["depth"] + 1 / 9, 18, seed=2)
    best = sweep.best_trial(study.where("rung = 2")).first()
    assert (best["trial"], best["score"]) == (sweep.best_trial(full).first()["trial"], sweep.best_trial(full).first()["score"])
    for rung in range(2):
        on = {r["trial"] for r in rows if r["rung"] == rung and r["promoted"]}
        assert on == {r["trial"] for r in rows if r["rung"] == rung + 1}
        worst = max(r["score"] for r in rows if r["rung"] == rung and r["promoted"])
        assert all(r["score"] >= worst for r in rows if r["rung"] == rung and not r["promoted"])
    assert len(calls) == 26 and len(ended) == 18


def test_halving_without_scores(spark):
    table = spark.createDataFrame([(t, 0, s) for t, s in enumerate([3.0, float("nan"), None, 1.0, 1.0])], "trial long, rung int, score double")
    low = {r["trial"]: (r["place"], r["promoted"]) for r in sweep.promoted(table, 0.4).collect()}
    assert low[3] == (1, True) and low[4] == (2, True) and low[0] == (3, False)
    high = {r["trial"]: r["promoted"] for r in sweep.promoted(table, 0.9, "maximize").collect()}
    assert high == {0: True, 1: False, 2: False, 3: True, 4: True}
    study = sweep.successive_halving(spark, SPACE, lambda c, b: float("nan"), 4, [1, 2])
    assert study.count() == 4 and study.where("promoted").isEmpty()


def test_a_sweep_by_halving(spark, plain):
    study, best = experiment.run_sweep(plain, None, CONFIG, ["id"], n_trials=4, seed=5, budgets=[1, 3], keep=0.5)
    assert study.where("rung = 0").count() == 4 and study.where("rung = 1").count() == 2
    assert best["model"]["n_estimators"] == 3


def test_early_stopping_keeps_the_rounds_up_to_the_best(spark, plain):
    table = plain.select("x", F.when(F.col("kind") == "a", 1.0).otherwise(0.0).alias("a"), F.col("y").alias("label"), "id")
    train, held = table.where("id < 120"), table.where("id >= 120")
    config = {"model_type": "xgboost", "n_estimators": 12, "max_depth": 4, "eta": 0.5}
    whole = models.fit(train, ["x", "a"], "label", config)
    curve = [r["loss"] for r in models.boosting_curve(whole, {"e": held}, "label").orderBy("iter").collect()]
    cut, rounds = models.fit_with_evaluation(train, held, ["x", "a"], "label", config, patience=2)
    best = cut.model.getNumTrees
    seen = rounds.orderBy("iter").collect()
    assert [r["loss"] for r in seen] == pytest.approx(curve[: len(seen)])
    assert min(range(len(seen)), key=lambda i: seen[i]["loss"]) == best - 1 and (len(seen) == 12 or len(seen) - best == 2)
    assert [r["kept"] for r in seen] == [i < best for i in range(len(seen))]
    assert cut.model.treeWeights == whole.model.treeWeights[:best]
    again = [r["loss"] for r in models.boosting_curve(cut, {"e": held}, "label").orderBy("iter").collect()]
    assert again == pytest.approx(curve[:best])
    assert models.predict(cut, held, ["id"]).count() == 80
    with pytest.raises(ValueError, match="no rounds"):
        models.fit_with_evaluation(train, held, ["x"], "label", {"model_type": "random_forest", "n_estimators": 2}, 2)


def test_options_for_stopping_and_shares_of_rows(spark, plain):
    table = plain.select(F.coalesce("x", F.lit(0.0)).alias("x"), F.col("y").alias("label"), F.when(F.col("id") < 120, "train").otherwise("test").alias("split"), "id")
    config = {"model_type": "catboost", "iterations": 10, "depth": 4, "learning_rate": 0.6, "od_type": "Iter", "od_wait": 1}
    fitted, report = models.train_report(table, ["x"], "label", config)
    plain_config = {k: v for k, v in config.items() if not k.startswith("od_")}
    cut, _ = models.fit_with_evaluation(table.where("split = 'train'"), table.where("split = 'test'"), ["x"], "label", plain_config, 1)
    assert fitted.model.getNumTrees == cut.model.getNumTrees and report.count() == 10
    assert models.stopping_patience({"od_type": "Iter"}) == (20, {})
    assert models.stopping_patience({"early_stopping_rounds": 3, "eta": 1}) == (3, {"eta": 1})
    with pytest.raises(ValueError):
        models.stopping_patience({"od_type": "IncToDec"})
    forest = models.fit(table, ["x"], "label", {"model_type": "random_forest", "n_estimators": 1, "min_samples_leaf": 0.101})
    assert forest.model.getMinInstancesPerNode() == 21

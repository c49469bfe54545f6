import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lamina.functions.composition import SITE_SUMS, formula_map, ion_pairs
from lamina.operators import composition, explain, rows, stats, sweep
from lamina.plans import gram


def test_correlation(spark):
    df = spark.createDataFrame(
        [(1.0, 2.0, 5.0, None), (2.0, 4.0, 5.0, 1.0), (3.0, None, 5.0, 4.0), (4.0, 7.0, 5.0, 2.0)], "a double, b double, c double, d double"
    )
    got = {(r["x"], r["y"]): r["r"] for r in stats.corr_matrix(df, ["a", "b", "c", "d"]).collect()}
    pandas = df.toPandas().corr()
    assert len(got) == 16
    for (x, y), r in got.items():
        expected = pandas.loc[x, y]
        assert (math.isnan(r) and math.isnan(expected)) or r == pytest.approx(expected)


def test_correlation_of_many_columns(spark, monkeypatch):
    monkeypatch.setattr(gram, "BLOCK_COLUMNS", 7)
    rng = np.random.default_rng(2)
    base = rng.normal(size=(120, 5)) @ rng.normal(size=(5, 40)) * 10.0 ** rng.integers(-1, 7, 40) + 1e3
    base[:, 3] = 4.5
    table = np.where(rng.random(base.shape) < 0.3, np.nan, base)
    table[:, 8] = np.nan
    table[:118, 9] = np.nan
    names = [f"c{k}" for k in range(40)]
    rows = [tuple(None if math.isnan(v) else float(v) for v in r) for r in table]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in names)).repartition(5)
    got = stats.corr_matrix(df, names)
    found = {(r["x"], r["y"]): r["r"] for r in got.collect()}
    assert len(found) == 1600
    expected = pd.DataFrame(table, columns=names).corr(min_periods=2)
    for (x, y), r in found.items():
        e = expected.loc[x, y]
        assert math.isnan(r) == math.isnan(e) and (math.isnan(r) or abs(r - e) < 1e-9), (x, y, r, e)
    empty = stats.corr_matrix(df.limit(0), names[:2]).collect()
    assert len(empty) == 4 and all(math.isnan(r["r"]) for r in empty)
    assert stats.corr_matrix(df, []).collect() == []


def test_correlation_plan_does_not_grow_with_pairs(spark):
    def size(n):
        df = spark.range(10).select(*[(F.col("id") * k).alias(f"c{k}") for k in range(n)])
        return len(stats.corr_matrix(df, df.columns)._jdf.queryExecution().optimizedPlan().toString())

    assert size(80) < 3 * size(40)


def test_metrics(spark):
    df = spark.createDataFrame([(1.0, 3.0), (2.0, 1.0), (3.0, 8.0)], "label double, prediction double")
    got = {r["metric"]: r["value"] for r in stats.regression_metrics(df).collect()}
    assert got["mse"] == pytest.approx(10.0) and got["mae"] == pytest.approx(8 / 3)
    assert got["r2"] == pytest.approx(1 - 30 / 2) and math.isnan(got["r"])
    assert got["r2_pred_denominator"] == pytest.approx(1 - 30 / 26)
    with pytest.raises(ValueError):
        stats.regression_metrics(df, metrics=["mape"])
    median = {"median_error": F.median(F.abs(F.col("label") - F.col("prediction")))}
    assert stats.regression_metrics(df, aggregates=median).collect() == [("median_error", 2.0)]


def test_topk(spark):
    df = spark.createDataFrame([(v,) for v in "aaabbcdd"] + [(None,)], "v string")
    assert sorted(stats.topk_other(df, "v", 2).collect()) == [("a", 3), ("b", 2), ("other", 3)]
    assert sorted(stats.topk_other(df, "v", 9).collect())[-1] == ("other", 0)
    assert stats.value_counts(df, "v").collect() == [("a", 3), ("b", 2), ("d", 2), ("c", 1)]


def test_density_boundary(spark):
    df = spark.createDataFrame([(1, None), (None, None)], "a int, b int")
    assert stats.density_filter(df, 0.5).columns == ["a"]
    assert stats.density_filter(df, 0.0).columns == ["a", "b"]


def test_formula_parsing(spark):
    cases = {
        "Cs0.05FA0.79MA0.16PbI2.5Br0.5": {"Cs": 0.05, "FA": 0.79, "MA": 0.16, "Pb": 1.0, "I": 2.5, "Br": 0.5},
        "MAPbI3": {"MA": 1.0, "Pb": 1.0, "I": 3.0}, "IBr2I": {"I": 1.0, "Br": 2.0}, "I.5Zr2": {"I": 0.5}, "": {},
    }
    df = spark.createDataFrame([(c,) for c in cases], "f string")
    assert {r["f"]: r["m"] for r in df.select("f", formula_map(F.col("f")).alias("m")).collect()} == cases


def test_ion_lists(spark):
    df = spark.createDataFrame([("Cs; FA; Cs", "0.1; x; 0.3; 9"), ("MA", "")], "i string, c string")
    got = [[tuple(p) for p in r["p"]] for r in df.select(ion_pairs(F.col("i"), F.col("c")).alias("p")).collect()]
    assert got == [[("Cs", 0.1), ("FA", 0.0), ("Cs", 0.3)], [("MA", 0.0)]]


def test_ion_table_with_found_vocabulary(spark):
    df = spark.createDataFrame(
        [("x", 1.5, "Cs; PEA", "0.1; 0.9", "Pb", "1", "I", "3"), ("y", None, "MA", "1", "Sn", "1", "Br; I", "1; 2")],
        "compound string, E_g double, a_ions string, a_coeff string, b_ions string, b_coeff string, c_ions string, c_coeff string",
    )
    wide = composition.ion_composition(df)
    repeated = df.limit(1).withColumns({"a_ions": F.lit("Cs; FA; Cs"), "a_coeff": F.lit("1; 2; 3")})
    assert sorted(r[1:] for r in composition.ion_long(repeated).filter("site = 'a'").collect()) == [("a", "Cs", 3.0), ("a", "FA", 2.0)]
    assert wide.columns == ["compound", "E_g", "a_Cs", "a_MA", "a_PEA", "b_Pb", "b_Sn", "c_Br", "c_I"]
    assert sorted(wide.collect())[0][2:] == (0.1, 0.0, 0.9, 1.0, 0.0, 0.0, 3.0)


def test_site_checks(spark):
    columns = "Cs double, FA double, MA double, Pb double, Sn double, I double, Br double"
    df = spark.createDataFrame([(1.0, 0.0, 0.0, 1.0, 0.0, 3.0, 0.0), (0.9, 0.0, 0.0, 0.5, 0.5, 2.9, 0.0), (0.5, 0.0, 0.0, 1.0, 0.0, 3.0, 0.0)], columns)
    sums = composition.site_sums()
    assert composition.valid_compositions(df).count() == 2
    assert rows.off_stoichiometry(df, sums).count() == 2
    got = {r["site"]: (r["valid"], r["invalid"]) for r in stats.count_exact(df, sums, SITE_SUMS).collect()}
    assert got == {"a": (1, 2), "b": (3, 0), "c": (2, 1)}
    assert composition.normalise_group(df, ["I", "Br"]).select("I").distinct().collect() == [(1.0,)]


# -- search ----------------------------------------------------------------------

CONFIG = {
    "model": {"model_type": "xgboost", "eta": {"type": "float", "low": 1e-4, "high": 0.1, "log": True}, "max_depth": {"type": "int", "low": 3, "high": 5}},
    "pruning": [{"method": "breadth_pruner", "sparsity_threshold": {"type": "float", "low": 0, "high": 1}}, {"kind": {"type": "categorical", "choices": ["a", "b"]}}],
    "experiment": {"seed": 42, "tags": ["x"]},
}


def test_search_space():
    space = sweep.search_space(CONFIG)
    assert list(space) == ["model.eta", "model.max_depth", "pruning.0.sparsity_threshold", "pruning.1.kind"]
    filled = sweep.filled_config(CONFIG, dict(zip(space, (0.01, 4, 0.5, "b"))))
    assert filled["model"] == {"model_type": "xgboost", "eta": 0.01, "max_depth": 4}
    assert filled["pruning"] == [{"method": "breadth_pruner", "sparsity_threshold": 0.5}, {"kind": "b"}]
    assert filled["experiment"] == CONFIG["experiment"]


def test_sampling(spark):
    trials = spark.range(2000).withColumnRenamed("id", "trial")
    space = sweep.search_space(CONFIG)
    one = sweep.sample_trials(trials, space, 1).orderBy("trial").collect()
    assert one == sweep.sample_trials(trials.repartition(5), space, 1).orderBy("trial").collect()
    assert one != sweep.sample_trials(trials, space, 2).orderBy("trial").collect()
    eta = [r["model.eta"] for r in one]
    assert 1e-4 <= min(eta) and max(eta) <= 0.1 and 0.3 < sum(e < 10 ** -2.5 for e in eta) / 2000 < 0.7
    assert {r["model.max_depth"] for r in one} == {3, 4, 5} and {r["pruning.1.kind"] for r in one} == {"a", "b"}


def test_study(spark):
    study = sweep.run_study(spark, CONFIG, lambda c: c["model"]["max_depth"] + c["model"]["eta"], 12, seed=3)
    best = sweep.best_trial(study).first()
    scores = [r["score"] for r in study.collect()]
    assert len(scores) == 12 and best["score"] == min(scores)
    assert sweep.best_trial(study, "maximize").first()["score"] == max(scores)
    with pytest.raises(ValueError):
        sweep.best_trial(study, "sideways")


def test_best_trial_skips_missing(spark):
    study = spark.createDataFrame([(1, None), (2, float("nan")), (3, 2.0), (4, 2.0)], "trial int, score double")
    assert sweep.best_trial(study, "maximize").collect() == [(3, 2.0)]


def test_dependence_plan(spark):
    pairs = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "a")], "feature_i string, feature_j string")
    plan = {tuple(r) for r in explain.dependence_plan(pairs).collect()}
    assert plan == {("a", "a", None), ("a", "b", "b"), ("a", "c", "c"), ("b", "b", None), ("b", "a", "a")}


def test_ion_coefficients(spark):
    from lamina.functions.composition import coefficient

    texts = ["1d", "1.5f", "0.5", "x", "", "nan", "inf", "-Infinity", "1e2"]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(coefficient(F.col("t"))).collect()]
    assert got[:5] == [None, None, 0.5, None, None] and got[5] != got[5] and got[6:] == [float("inf"), float("-inf"), 100.0]

"""Tree models as tables, and rows that draw rows of a numbered table by blocks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamina.operators import explain, models
from lamina.operators.attributions import node_table
from lamina.operators.grids import model_grids
from lamina.plans import dealt

FEATURES = ["a", "b", "c"]
BOOSTED = {"model_type": "xgboost", "n_estimators": 4, "max_depth": 3}
FOREST = {"model_type": "random_forest", "n_estimators": 3, "max_depth": 6}


@pytest.fixture(scope="module")
def data(spark):
    df = spark.range(600).select(
        "id", *[(F.pmod(F.xxhash64(F.lit(c), "id"), F.lit(1000)) / 10).alias(c) for c in FEATURES]
    ).withColumn("a", F.when(F.col("id") % 9 != 0, F.col("a")))
    return df.withColumn("label", F.coalesce("a", F.lit(-5.0)) * F.col("b") + F.col("c")).cache()


@pytest.mark.parametrize("grid_cells", [1 << 16, 300, 1])
@pytest.mark.parametrize("config", [BOOSTED, FOREST])
def test_grids_predict_as_the_model(spark, data, config, grid_cells):
    fitted = models.fit(data, FEATURES, "label", config)
    grids = model_grids([r.asDict() for r in node_table(fitted.model, spark).collect()], 3, grid_cells)
    assert (not grids.walks if grid_cells > 300 else grids.walks or grid_cells > 1)
    rows = np.array([r for r in data.select(*models.filled(FEATURES, fitted.missing)).collect()])
    direct = [r["prediction"] for r in models.predict(fitted, data, ["id"]).collect()]
    codes = grids.codes(rows)
    assert grids.predictions(codes) == pytest.approx(direct)
    # one feature after the other, and pairs, against predictions of the mixed rows
    own, other = codes, codes[::-1].copy()
    order = np.tile([2, 0, 1], (len(own), 1))
    mixed, steps = other.copy(), grids.along(own, other, order)
    for s, f in enumerate([None, 2, 0, 1]):
        if f is not None:
            mixed[:, f] = own[:, f]
        assert steps[:, s] == pytest.approx(grids.predictions(mixed))
    take = np.random.default_rng(1).random(own.shape) < 0.5
    for (i, j), change in zip([(0, 1), (1, 2)], grids.second_differences(own, other, [(0, 1), (1, 2)], lambda i, j: take)):
        expected = 0.0
        for a, b, sign in ((True, True, 1), (True, False, -1), (False, True, -1), (False, False, 1)):
            mask = take.copy()
            mask[:, i], mask[:, j] = a, b
            expected = expected + sign * grids.predictions(np.where(mask, own, other))
        assert change == pytest.approx(expected, abs=1e-9)


def test_hash_goes_on_as_in_spark(spark):
    df = spark.range(50).select(F.xxhash64(F.lit(7), "id").alias("h"), F.xxhash64(F.lit(7), "id", F.lit(3), F.lit(-2)).alias("wanted"))
    rows = df.collect()
    h = np.array([r["h"] for r in rows])
    assert dealt.hash_int(-2, dealt.hash_int(3, h)).tolist() == [r["wanted"] for r in rows]


@pytest.mark.parametrize("row_id, small", [("id", False), ("text", True), ("twice", True)])
def test_blocks_agree_with_single_rows(spark, data, row_id, small, monkeypatch):
    """The same draws as by a join of single rows, with any ids; no row is made for each sample and step."""
    keyed = data.select(
        *FEATURES, "label", "id", F.concat(F.lit("k"), "id").alias("text"), F.when(F.col("id") % 5 != 0, F.floor(F.col("id") / 2)).alias("twice")
    )
    fitted = models.fit(keyed, FEATURES, "label", BOOSTED)
    if small:
        monkeypatch.setattr(dealt, "sizes", lambda total, draws, width, kind: dealt.Sizes(total, draws, width, kind, 64, 37))

    def tables():
        values, ends = explain.sampled_shapley(fitted, keyed, row_id, n_samples=3)
        return values, ends, explain.sampled_interactions(fitted, keyed, row_id, n_samples=3)

    def rows(df):
        keys = [c for c in df.columns if not c.endswith(("value", "base", "prediction"))]
        numbers = [c for c in df.columns if c not in keys]
        return {tuple(map(str, (r[c] for c in keys))): [r[c] for c in numbers] for r in df.collect()}

    plan = tables()[0]._jdf.queryExecution().executedPlan().toString()
    assert "sequence" not in plan.lower() and "array_position" not in plan
    got = [rows(df) for df in tables()]
    monkeypatch.setattr(explain, "TREES", ())
    for mine, wanted in zip(got, [rows(df) for df in tables()]):
        assert mine.keys() == wanted.keys()
        for key, numbers in wanted.items():
            assert mine[key] == pytest.approx(numbers, abs=1e-6)

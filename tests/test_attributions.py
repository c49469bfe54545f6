from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamina.operators import attributions, models

NODES = "tree int, node int, feature int, threshold double, left int, right int, value double, cover double, weight double"


def random_tree(rng, tree, features, depth, rows):
    """A node table grown by random splits over the rows, and covers counted from them."""
    nodes = []

    def grow(inside, level):
        number = len(nodes)
        row = {"tree": tree, "node": number, "feature": None, "threshold": None, "left": -1, "right": -1,
               "value": float(rng.normal()), "cover": float(len(inside)), "weight": 0.5}
        nodes.append(row)
        feature = int(rng.integers(features))
        values = np.unique(rows[inside, feature])
        if level < depth and len(values) > 1:
            cut = float(rng.choice(values[:-1]))
            left = rows[inside, feature] <= cut
            row |= {"feature": feature, "threshold": cut, "left": grow(inside[left], level + 1), "right": grow(inside[~left], level + 1)}
        return number

    grow(np.arange(len(rows)), 0)
    return nodes


def value_of(nodes, row, known):
    """Mean over the leaves when only ``known`` features follow the row."""
    by = {(n["tree"], n["node"]): n for n in nodes}

    def walk(n):
        if n["feature"] is None:
            return n["value"]
        left, right = by[n["tree"], n["left"]], by[n["tree"], n["right"]]
        if n["feature"] in known:
            return walk(left if row[n["feature"]] <= n["threshold"] else right)
        return (walk(left) * left["cover"] + walk(right) * right["cover"]) / n["cover"]

    return sum(n["weight"] * walk(n) for n in nodes if n["node"] == 0)


def brute(nodes, row, p):
    subsets = [frozenset(s) for k in range(p + 1) for s in combinations(range(p), k)]
    f = {s: value_of(nodes, row, s) for s in subsets}
    phi, pairs = np.zeros(p), np.zeros((p, p))
    for i in range(p):
        for s in subsets:
            if i not in s:
                phi[i] += factorial(len(s)) * factorial(p - len(s) - 1) / factorial(p) * (f[s | {i}] - f[s])
            for j in range(p):
                if i != j and i not in s and j not in s:
                    w = factorial(len(s)) * factorial(p - len(s) - 2) / (2 * factorial(p - 1))
                    pairs[i, j] += w * (f[s | {i, j}] - f[s | {i}] - f[s | {j}] + f[s])
    return phi, pairs, f[frozenset()]


@pytest.mark.parametrize("seed,p,depth", [(0, 1, 1), (1, 3, 4), (2, 5, 5), (3, 5, 7), (4, 4, 0)])
def test_against_all_subsets(seed, p, depth, monkeypatch):
    monkeypatch.setattr(attributions, "BLOCK_NUMBERS", 200)
    rng = np.random.default_rng(seed)
    rows = np.round(rng.normal(size=(60, p)), 1)
    nodes = [n for t in range(3) for n in random_tree(rng, t, p, depth, rows)]
    trees = attributions.flatten(nodes)
    found = attributions.shapley_values(trees, rows[:12])
    pairs = attributions.feature_pairs(trees)
    crossed = attributions.interaction_values(trees, rows[:12], pairs)
    for k in range(12):
        phi, matrix, base = brute(nodes, rows[k], p)
        assert np.allclose(found[k], phi, atol=1e-12) and abs(trees.base - base) < 1e-12
        mine = np.zeros((p, p))
        mine[pairs[:, 0], pairs[:, 1]] = mine[pairs[:, 1], pairs[:, 0]] = crossed[k]
        assert np.allclose(mine, matrix, atol=1e-12)


def test_children_without_rows_and_values_that_are_no_numbers():
    nodes = [
        {"tree": 0, "node": 0, "feature": 0, "threshold": 1.0, "left": 1, "right": 2, "value": 0.0, "cover": 4.0, "weight": 1.0},
        {"tree": 0, "node": 1, "feature": None, "threshold": None, "left": -1, "right": -1, "value": 3.0, "cover": 4.0, "weight": 1.0},
        {"tree": 0, "node": 2, "feature": 1, "threshold": 0.0, "left": 3, "right": 4, "value": 0.0, "cover": 0.0, "weight": 1.0},
        {"tree": 0, "node": 3, "feature": None, "threshold": None, "left": -1, "right": -1, "value": 5.0, "cover": 0.0, "weight": 1.0},
        {"tree": 0, "node": 4, "feature": None, "threshold": None, "left": -1, "right": -1, "value": 7.0, "cover": 0.0, "weight": 1.0},
    ]
    trees = attributions.flatten(nodes)
    rows = np.array([[0.0, 0.0], [np.nan, 1.0], [2.0, np.nan]])
    found = attributions.shapley_values(trees, rows)
    assert trees.base == 3.0 and np.allclose(trees.base + found.sum(axis=1), [3.0, 7.0, 7.0])


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 5)).round(2)
    y = 3 * x[:, 0] + x[:, 1] * x[:, 2] + (x[:, 3] > 0.3)
    rows = [(i, *(None if i % 9 == 0 and k == 3 else float(v) for k, v in enumerate(r)), float(t)) for i, (r, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "row_id long, a double, b double, c double, d double, e double, label double").repartition(4)


@pytest.mark.parametrize("config", [
    {"model_type": "random_forest", "n_estimators": 5, "max_depth": 6},
    {"model_type": "xgboost", "n_estimators": 6, "max_depth": 4},
])
def test_models_of_spark(spark, table, config):
    features = ["a", "b", "c", "d", "e"]
    fitted = models.fit(table, features, "label", config)
    values, ends = attributions.tree_shapley(fitted, table, "row_id")
    rows = {r["row_id"]: r for r in ends.collect()}
    sums = {r["row_id"]: r["v"] for r in values.groupBy("row_id").agg(F.sum("value").alias("v")).collect()}
    for r in models.predict(fitted, table, ["row_id"]).collect():
        assert abs(rows[r["row_id"]]["prediction"] - r["prediction"]) < 1e-9
        assert abs(sums[r["row_id"]] + rows[r["row_id"]]["base"] - r["prediction"]) < 1e-9
    crossed = attributions.tree_interactions(fitted, table, "row_id")
    pairs = {(r["row_id"], r["feature_i"], r["feature_j"]): r["value"] for r in crossed.collect()}
    assert all(abs(v - pairs[k[0], k[2], k[1]]) < 1e-15 for k, v in pairs.items())
    nodes = attributions.node_table(fitted.model, spark).collect()
    first = table.where("row_id = 1").select(*models.filled(features, fitted.missing)).first()
    phi, matrix, _ = brute([n.asDict() for n in nodes if n["tree"] >= 0], [first[c] for c in features], 5)
    own = {r["feature"]: r["value"] for r in values.where("row_id = 1").collect()}
    assert np.allclose([own[c] for c in features], phi, atol=1e-9)
    assert all(abs(pairs.get((1, features[i], features[j]), 0.0) - matrix[i, j]) < 1e-9 for i in range(5) for j in range(5) if i != j)


def test_plan_does_not_grow_with_features(spark):
    wide = 200
    rows = [{"tree": 0, "node": 0, "feature": 150, "threshold": 0.5, "left": 1, "right": 2, "value": 0.0, "cover": 2.0, "weight": 1.0}]
    rows += [{"tree": 0, "node": k, "feature": None, "threshold": None, "left": -1, "right": -1, "value": float(k), "cover": 1.0, "weight": 1.0} for k in (1, 2)]
    df = spark.range(20).select(F.col("id").alias("row_id"), *[(F.col("id") % 2).cast("double").alias(f"f{k}") for k in range(wide)])
    names = [f"f{k}" for k in range(wide)]
    values, _ = attributions.shapley_from(attributions.flatten(rows), names, df, "row_id", [F.col(c) for c in names])
    assert values.count() == 20 * wide
    found = {r["row_id"]: r["value"] for r in values.where("feature = 'f150'").collect()}
    assert found == {i: 0.5 if i % 2 else -0.5 for i in range(20)}


def test_models_without_trees(spark, table):
    fitted = models.fit(table, ["a", "b"], "label", {"model_type": "knn"})
    with pytest.raises(TypeError):
        attributions.tree_shapley(fitted, table, "row_id")


@pytest.mark.parametrize("numbers", [1 << 18, 1])
def test_attributions_by_cell_are_those_by_row(spark, numbers, monkeypatch):
    """The same values from tables and from paths, and no path is followed for a row of a model with tables."""
    df = spark.range(500).select("id", *[(F.pmod(F.xxhash64(F.lit(c), "id"), F.lit(100)) / 7).alias(c) for c in "abc"])
    df = df.withColumn("label", F.col("a") * F.col("b") + F.col("c")).cache()
    fitted = models.fit(df, list("abc"), "label", {"model_type": "xgboost", "n_estimators": 3, "max_depth": 3})
    nodes = [r.asDict() for r in attributions.node_table(fitted.model, spark).collect()]
    rows = np.array([list(r) for r in df.select("a", "b", "c").collect()])
    wanted = attributions.shapley_values(attributions.flatten(nodes), rows)
    found = attributions.cell_shapley(attributions.model_grids(nodes, 3, numbers, numbers), nodes)
    if numbers > 1:
        plain = attributions.shapley_values
        monkeypatch.setattr(attributions, "shapley_values", lambda trees, rows: plain(trees, rows) if not trees.groups else 1 / 0)
    assert found(rows) == pytest.approx(wanted, abs=1e-9)
    assert found(rows[:0]).shape == (0, 3)

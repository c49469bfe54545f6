"""Sampled Shapley attributions and the tables derived from attributions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.ml.regression import DecisionTreeRegressionModel, GBTRegressionModel, RandomForestRegressionModel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.functions.hashing import key_hash
from lamina.operators.attributions import node_table
from lamina.operators.grids import Grids, model_grids
from lamina.operators.models import Fitted, filled, predict_arrays
from lamina.plans.dealt import hash_int, with_drawn
from lamina.plans.row_index import Indexed, with_row_index
from lamina.session import materialise

TREES = (DecisionTreeRegressionModel, GBTRegressionModel, RandomForestRegressionModel)


def _score(fitted: Fitted, rows: DataFrame, keep: Sequence[str]) -> DataFrame:
    """``keep`` and the prediction for the coordinates in ``_v``, whatever the model's type."""
    return predict_arrays(fitted, rows, keep, "_v")


def _background(df: DataFrame, fitted: Fitted, row_id: str, seed: int) -> tuple[DataFrame, Indexed]:
    """Own values ``_x`` of each row, and the rows in the order of a hash with their number."""
    own = df.select(F.col(row_id), F.array(*filled(fitted.features, fitted.missing)).alias("_x"))
    key = key_hash(seed, F.col(row_id).cast("string"))
    return own, with_row_index(own.select(key.alias("_h"), F.col(row_id).cast("string").alias("_k"), "_x"), ["_h", "_k"], "_i")


def _prepared(df: DataFrame, fitted: Fitted, row_id: str, n_samples: int, seed: int) -> DataFrame:
    """One line per row and sample: own values x, background values z, one random number per feature.

    The background row is drawn from the whole table, by its row number.
    """
    own, table = _background(df, fitted, row_id, seed)
    pick = F.pmod(F.xxhash64(F.lit(seed), row_id, "_m"), F.lit(max(1, table.total)))
    drawn = own.withColumn("_m", F.explode(F.sequence(F.lit(0), F.lit(n_samples - 1)))).withColumn("_i", pick)
    background = table.frame.select("_i", F.col("_x").alias("_z"))
    numbers = F.transform(F.sequence(F.lit(0), F.lit(len(fitted.features) - 1)), lambda f: F.xxhash64(F.lit(seed + 1), row_id, "_m", f))
    return drawn.join(background, "_i").drop("_i").withColumn("_r", numbers)


def _by_blocks(fitted: Fitted, df: DataFrame, row_id: str, n_samples: int, seed: int, compute: Callable, columns: str, *seeds: int) -> tuple[DataFrame, int] | None:
    """What ``compute`` makes of the codes of each row and of its background rows, for a model of trees; None without rows."""
    p = len(fitted.features)
    grids = model_grids((r.asDict() for r in node_table(fitted.model, df.sparkSession).collect()), p)
    own, table = _background(df, fitted, row_id, seed)
    if not table.total:
        return None
    return with_drawn(
        own, row_id, table.frame, table.total, n_samples, p, seed, grids.codes, grids.kind, lambda x, z, h: compute(grids, x, z, h), columns, seeds
    )


def _numbers(m: int, p: int, h: np.ndarray) -> np.ndarray:
    """A random number per row, sample and feature."""
    return hash_int(np.arange(p), hash_int(np.arange(m), h[:, None])[:, :, None]).reshape(-1, p)


def _attributed(grids: Grids, x: np.ndarray, z: np.ndarray, h: list[np.ndarray]) -> list[np.ndarray]:
    """Attributions, and base and prediction, of some rows."""
    n, m, p = z.shape
    order = _numbers(m, p, h[0]).argsort(axis=1, kind="stable")
    predictions = grids.along(np.repeat(x, m, axis=0), z.reshape(n * m, p), order)
    change = np.empty((n * m, p))
    np.put_along_axis(change, order, np.diff(predictions, axis=1), axis=1)
    return [change.reshape(n, m, p).sum(axis=1) / m, predictions.reshape(n, m, p + 1)[:, :, [0, p]].sum(axis=1) / m]


def _interacting(grids: Grids, x: np.ndarray, z: np.ndarray, h: list[np.ndarray]) -> list[np.ndarray]:
    """Half the mean second difference of every pair of features of some rows."""
    n, m, p = z.shape
    pairs = [(i, j) for i in range(p - 1) for j in range(i + 1, p)]
    numbers, marks = _numbers(m, p, h[0]), hash_int(np.arange(m), h[1][:, None]).ravel()

    def takes(i: int, j: int) -> np.ndarray:
        return numbers < hash_int(j, hash_int(i, marks))[:, None]

    found = np.empty((n, len(pairs)))
    for k, change in enumerate(grids.second_differences(np.repeat(x, m, axis=0), z.reshape(n * m, p), pairs, takes)):
        found[:, k] = change.reshape(n, m).sum(axis=1) / (2.0 * m)
    return [found]


def _summed(found: DataFrame, repeated: int, row_id: str, column: str, place: str) -> DataFrame:
    """``(row_id, place, value)`` of an array column; rows of one id are added up."""
    exploded = found.select(row_id, "_same", F.posexplode(column).alias(place, "value"))
    single = exploded.select(row_id, place, "value")
    if not repeated:
        return single
    several = exploded.where("_same > 1").groupBy(row_id, place).agg(F.sum("value").alias("value"))
    return exploded.where("_same = 1").select(row_id, place, "value").unionByName(several)


def _from_blocks(found: DataFrame, repeated: int, fitted: Fitted, row_id: str, written: bool) -> tuple[DataFrame, DataFrame]:
    if written or repeated:
        found = materialise(found, "shapley_rows")
    names = F.array(*map(F.lit, fitted.features))
    values = _summed(found, repeated, row_id, "_values", "_f").select(row_id, F.get(names, F.col("_f")).alias("feature"), "value")
    first, last = (F.get("_ends", F.lit(k)) for k in (0, 1))
    if not repeated:
        return values, found.select(row_id, first.alias("base"), last.alias("prediction"))
    several = found.where("_same > 1").groupBy(row_id).agg(F.sum(first).alias("base"), F.sum(last).alias("prediction"))
    return values, found.where("_same = 1").select(row_id, first.alias("base"), last.alias("prediction")).unionByName(several)


def sampled_shapley(
    fitted: Fitted, df: DataFrame, row_id: str, n_samples: int = 8, seed: int = 42, written: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Attributions ``(row_id, feature, value)`` and ``(row_id, base, prediction)``.

    For every row and sample a random order of the features and a background row of the whole table are drawn
    (Strumbelj and Kononenko, 2014).  Replacing the background values by the row's own in that
    order, each step's change of the prediction belongs to the feature that changed; the
    changes are averaged.  They add up to the prediction minus the mean background prediction.
    The plan does not grow with the number of features.

    A model of trees is applied to blocks of rows where their background rows arrive; both tables come from one pass over
    the blocks, made once if they are ``written``.
    """
    p = len(fitted.features)
    if isinstance(fitted.model, TREES):
        blocks = _by_blocks(fitted, df, row_id, n_samples, seed, _attributed, "_values,_ends", seed + 1)
        if blocks is not None:
            return _from_blocks(*blocks, fitted, row_id, written)
    lines = _prepared(df, fitted, row_id, n_samples, seed)
    # features in the random order, equal numbers by position; then each one's place in it
    ordered = F.transform(
        F.array_sort(F.transform("_r", lambda r, f: F.struct(r.alias("r"), f.alias("f")))), lambda e: e["f"]
    )
    placed = lines.withColumn("_o", ordered).withColumn(
        "_p", F.transform("_o", lambda _, f: F.array_position("_o", f).cast("int") - 1)
    )
    steps = placed.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(p))))
    mixed = F.transform("_x", lambda x, f: F.when(F.get("_p", f) < F.col("_s"), x).otherwise(F.get("_z", f)))
    scored = _score(fitted, steps.withColumn("_v", mixed), [row_id, "_s", "_p"])
    # Prediction s closes the step of the feature at place s - 1 and opens that of the one at s.
    def feature_at(s: Column) -> Column:
        return F.array_position("_p", s).cast("int") - 1

    prediction = F.col("prediction")
    closed = F.struct(F.when(F.col("_s") > 0, feature_at(F.col("_s") - 1)).otherwise(F.lit(-1)).alias("f"), prediction.alias("v"))
    opened = F.struct(
        F.when(F.col("_s") < p, feature_at(F.col("_s"))).otherwise(F.lit(-2)).alias("f"),
        F.when(F.col("_s") < p, -prediction).otherwise(prediction).alias("v"),
    )
    terms = F.array(closed, opened)
    sums = (
        scored.select(row_id, F.explode(terms).alias("t"))
        .groupBy(row_id, F.col("t.f").alias("f"))
        .agg((F.sum("t.v") / F.lit(float(n_samples))).alias("value"))
    )
    names = F.array(*map(F.lit, fitted.features))
    values = sums.filter("f >= 0").select(row_id, F.get(names, F.col("f")).alias("feature"), "value")
    ends = sums.filter("f < 0").groupBy(row_id).agg(
        F.max(F.when(F.col("f") == -1, F.col("value"))).alias("base"),
        F.max(F.when(F.col("f") == -2, F.col("value"))).alias("prediction"),
    )
    return values, ends


def sampled_interactions(
    fitted: Fitted, df: DataFrame, row_id: str, n_samples: int = 8, seed: int = 42
) -> DataFrame:
    """``(row_id, feature_i, feature_j, value)`` for i <> j, symmetric.

    Half the mean second difference f(S+ij) - f(S+i) - f(S+j) + f(S), S being the features
    before the pair in a random order; it is zero for an additive model.
    """
    p = len(fitted.features)
    if isinstance(fitted.model, TREES) and p > 1:
        blocks = _by_blocks(fitted, df, row_id, n_samples, seed, _interacting, "_values", seed + 1, seed + 2)
        if blocks is not None:
            found, repeated = blocks
            pairs = [(i, j) for i in range(p - 1) for j in range(i + 1, p)]
            first, second = (F.array(*[F.lit(pair[k]) for pair in pairs]) for k in (0, 1))
            halves = _summed(materialise(found, "shapley_rows") if repeated else found, repeated, row_id, "_values", "_f")
            return _both_ways(halves.select(row_id, F.get(first, F.col("_f")).alias("i"), F.get(second, F.col("_f")).alias("j"), "value"), fitted, row_id)
    lines = _prepared(df, fitted, row_id, n_samples, seed)
    corners = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (False, True) for b in (False, True)])
    firsts = lines.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(p - 2)))) if p > 1 else lines.limit(0).withColumn("i", F.lit(0))
    pairs = firsts.withColumn("j", F.explode(F.sequence(F.col("i") + 1, F.lit(p - 1))))
    steps = pairs.withColumn("_mark", F.xxhash64(F.lit(seed + 2), row_id, "_m", "i", "j")).withColumn("_c", F.explode(corners)).select(
        row_id, "_m", "_x", "_z", "_r", "_mark", "i", "j", "_c.a", "_c.b"
    )

    def own(f: Column) -> Column:
        return F.when(f == F.col("i"), F.col("a")).when(f == F.col("j"), F.col("b")).otherwise(F.get("_r", f) < F.col("_mark"))

    mixed = F.transform("_x", lambda x, f: F.when(own(f), x).otherwise(F.get("_z", f)))
    scored = _score(fitted, steps.withColumn("_v", mixed), [row_id, "i", "j", "a", "b"])
    signed = F.when(F.col("a") == F.col("b"), F.col("prediction")).otherwise(-F.col("prediction"))
    halves = scored.groupBy(row_id, "i", "j").agg((F.sum(signed) / F.lit(2.0 * n_samples)).alias("value"))
    return _both_ways(halves, fitted, row_id)


def _both_ways(halves: DataFrame, fitted: Fitted, row_id: str) -> DataFrame:
    """Both orders of each pair, by the features' names."""
    both = F.array(F.struct(F.col("i"), F.col("j")), F.struct(F.col("j").alias("i"), F.col("i").alias("j")))
    names = F.array(*map(F.lit, fitted.features))
    return halves.select(row_id, F.explode(both).alias("e"), "value").select(
        row_id, F.get(names, F.col("e.i")).alias("feature_i"), F.get(names, F.col("e.j")).alias("feature_j"), "value"
    )


# -- tables from attributions ----------------------------------------------------


def attribution_rank(attributions: DataFrame) -> DataFrame:
    """``(feature, importance)``: mean absolute attribution, largest first."""
    return attributions.groupBy("feature").agg(F.avg(F.abs("value")).alias("importance")).orderBy(
        F.desc("importance"), "feature"
    )


def interaction_matrix(pairs: DataFrame) -> DataFrame:
    """``(feature_i, feature_j, total, place_i, place_j)``.

    ``total`` is the sum of absolute values over all rows, 0 on the diagonal; features are
    placed by their row total, largest first.
    """
    sums = pairs.groupBy("feature_i", "feature_j").agg(F.sum(F.abs("value")).alias("total"))
    own = F.col("feature_i") == F.col("feature_j")
    cells = sums.withColumn("total", F.when(own, F.lit(0.0)).otherwise(F.col("total")))
    # One row per feature from here on.
    weight = cells.groupBy(F.col("feature_i").alias("feature")).agg(F.sum("total").alias("weight"))
    placed = weight.select(
        "feature", (F.row_number().over(Window.orderBy(F.desc("weight"), "feature")) - 1).cast("int").alias("place")
    )
    first = placed.select(F.col("feature").alias("feature_i"), F.col("place").alias("place_i"))
    second = placed.select(F.col("feature").alias("feature_j"), F.col("place").alias("place_j"))
    return cells.join(first, "feature_i").join(second, "feature_j").select(
        "feature_i", "feature_j", "total", "place_i", "place_j"
    )


def interaction_pairs(matrix: DataFrame, threshold: float = 1.0) -> DataFrame:
    """Ordered pairs whose total exceeds the threshold, largest first."""
    return matrix.filter(F.col("total") > F.lit(float(threshold))).select("feature_i", "feature_j", "total").orderBy(
        F.desc("total"), "feature_i", "feature_j"
    )


def dependence_plan(pairs: DataFrame) -> DataFrame:
    """``(feature_i, feature_j, colour)`` of the extracts for ``(feature_i, feature_j)`` pairs: each distinct
    first feature against itself without a colour, united with the pairs coloured by their second feature."""
    alone = pairs.select("feature_i").distinct().select(
        "feature_i", F.col("feature_i").alias("feature_j"), F.lit(None).cast("string").alias("colour")
    )
    return alone.unionByName(pairs.distinct().select("feature_i", "feature_j", F.col("feature_j").alias("colour")))


def dependence_points(values: DataFrame, pairs: DataFrame, row_id: str, plan: DataFrame) -> DataFrame:
    """``(row_id, feature_i, feature_j, x, attribution, colour)`` for every extract of the plan.

    ``values`` is the wide feature table, ``pairs`` the long ``(row_id, feature_i, feature_j, value)``.
    """
    features = [c for c in values.columns if c != row_id]
    cells = F.map_from_arrays(F.array(*map(F.lit, features)), F.array(*[F.col(c).cast("double") for c in features]))
    wanted = pairs.join(plan.withColumnRenamed("colour", "_by"), ["feature_i", "feature_j"])
    joined = wanted.join(values.select(row_id, cells.alias("_cells")), row_id)
    by = F.when(F.col("_by").isNotNull(), F.try_element_at("_cells", F.col("_by")))
    return joined.select(
        row_id, "feature_i", "feature_j", F.try_element_at("_cells", F.col("feature_i")).alias("x"),
        F.col("value").alias("attribution"), by.alias("colour"),
    )

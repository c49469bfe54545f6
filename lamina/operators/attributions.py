"""Exact Shapley attributions and interactions of tree models.

The value of a set S of features in a tree is the mean over its leaves when features in S follow the row
and all others the shares of training rows at each split.  A tree is flattened to one path a
leaf: for every feature on it the interval that leads there and the share z of rows that the splits
on it let through.  With o = 1 where the row lies in the interval, 0 elsewhere, a leaf of value v gives
feature i the Shapley value

    v (o_i - z_i) * integral over t in (0, 1) of the product over j <> i of z_j (1 - t) + o_j t

for the weights of set sizes are Beta integrals.  The integrand is a polynomial in t, so Gauss-Legendre
nodes give it exactly; for a pair the product leaves out both, with half of (o_i - z_i)(o_j - z_j).  The cost
is rows x path entries x half a path's length; no set is enumerated and no plan grows with the features.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.util import MLWritable
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.operators.grids import Grids, cell_rows, model_grids
from lamina.operators.models import Fitted, filled
from lamina.session import scratch_path

# Numbers that one block of rows, leaves and path entries may hold at a time.
BLOCK_NUMBERS = 1 << 20
# Numbers of one table of attributions by cell, and of all tables of a model.
TABLE_NUMBERS = 1 << 18
MODEL_NUMBERS = 1 << 20


class Paths(NamedTuple):
    """Leaves with equally many distinct features on their path: a row each, an entry a feature."""

    feature: np.ndarray
    low: np.ndarray
    high: np.ndarray
    share: np.ndarray
    value: np.ndarray


class Trees(NamedTuple):
    """All leaves of a model by the length of their path, and its value without any feature known."""

    groups: tuple[Paths, ...]
    base: float


def node_table(model: Any, spark: SparkSession) -> DataFrame:
    """``(tree, node, feature, threshold, left, right, value, cover, weight)`` of a Spark ML tree model.

    ``cover`` is the training weight that reached the node; leaves have no feature.  A row of a split goes left
    if its value is at most the threshold.
    """
    if not isinstance(model, MLWritable):
        raise TypeError(f"{type(model).__name__} has no tree table")
    path = scratch_path(spark, "trees")
    model.write().save(path)
    data = spark.read.parquet(f"{path}/data")
    tree, node = ("treeID", F.col("nodeData")) if "treeID" in data.columns else (None, F.struct("*"))
    split = node["split"]
    inner = split["featureIndex"] >= 0
    weights = F.array(*[F.lit(float(w)) for w in _weights(model)])
    number = F.col(tree) if tree else F.lit(0)
    return data.select(
        number.alias("tree"), node["id"].alias("node"), F.when(inner, split["featureIndex"]).alias("feature"),
        F.when(inner, F.get(split["leftCategoriesOrThreshold"], F.lit(0))).alias("threshold"),
        F.when(inner & (split["numCategories"] >= 0), True).otherwise(False).alias("categorical"),
        node["leftChild"].alias("left"), node["rightChild"].alias("right"), node["prediction"].alias("value"),
        F.get(node["impurityStats"], F.lit(0)).alias("cover"), F.get(weights, number).alias("weight"),
    )


def _weights(model: Any) -> list[float]:
    """What each tree's value counts in the prediction."""
    if not hasattr(model, "treeWeights"):
        return [1.0]
    weights = list(model.treeWeights)
    # a forest averages, boosting adds up
    return [w / sum(weights) for w in weights] if "Forest" in type(model).__name__ else weights


def flatten(nodes: Iterable[Mapping[str, Any]]) -> Trees:
    """The leaves' paths of a node table; as large as the model, whatever the data."""
    known = {(r["tree"], r["node"]): r for r in nodes}
    found: dict[int, list[tuple]] = {}
    base = 0.0
    children = {(r["tree"], r[side]) for r in known.values() if r["feature"] is not None for side in ("left", "right")}
    stack = [(key, {}) for key in known if key not in children]
    while stack:
        (tree, number), path = stack.pop()
        row = known[tree, number]
        if row["feature"] is None:
            value = row["weight"] * row["value"]
            base += value * float(np.prod([share for _, _, share in path.values()]))
            if path:
                found.setdefault(len(path), []).append((value, sorted(path.items())))
            continue
        if dict(row.asDict() if hasattr(row, "asDict") else row).get("categorical"):
            raise ValueError("splits on categories have no interval")
        low, high, share = path.get(row["feature"], (-np.inf, np.inf, 1.0))
        for side, bounds in (("left", (low, min(high, row["threshold"]))), ("right", (max(low, row["threshold"]), high))):
            child = known[tree, row[side]]
            part = child["cover"] / row["cover"] if row["cover"] else 0.0
            stack.append(((tree, row[side]), {**path, row["feature"]: (*bounds, share * part)}))
    groups = []
    for _, leaves in sorted(found.items()):
        entries = [[(f, *bounds) for f, bounds in path] for _, path in leaves]
        feature, low, high, share = (np.array([[e[k] for e in path] for path in entries]) for k in range(4))
        groups.append(Paths(feature.astype(np.int64), low, high, share, np.array([v for v, _ in leaves])))
    return Trees(tuple(groups), base)


def _nodes(degree: int) -> list[tuple[float, float]]:
    """Points and weights on (0, 1) that integrate polynomials of a degree exactly."""
    points, weights = np.polynomial.legendre.leggauss(degree // 2 + 1)
    return list(zip(((points + 1) / 2).tolist(), (weights / 2).tolist()))


def _inside(paths: Paths, rows: np.ndarray) -> np.ndarray:
    """Whether each row lies in each interval; a value that is no number goes right, as in the model."""
    cells = rows[:, paths.feature]
    return ~(cells <= paths.low) & ((cells <= paths.high) | np.isinf(paths.high))


def _summed(terms: np.ndarray, slots: np.ndarray, out: np.ndarray) -> None:
    """Add the columns of ``terms`` to the slots of ``out`` they belong to."""
    order = np.argsort(slots, kind="stable")
    ordered = slots[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    out[:, ordered[first]] += np.add.reduceat(terms[:, order], first, axis=1)


def _blocks(paths: Paths, n: int) -> Iterator[tuple[slice, Paths]]:
    leaves = max(1, BLOCK_NUMBERS // paths.feature.shape[1] // 64)
    for begin in range(0, len(paths.value), leaves):
        part = Paths(*(a[begin:begin + leaves] for a in paths))
        rows = max(1, BLOCK_NUMBERS // part.feature.size)
        for at in range(0, n, rows):
            yield slice(at, at + rows), part


def shapley_values(trees: Trees, rows: np.ndarray) -> np.ndarray:
    """Attribution of every feature in every row."""
    out = np.zeros(rows.shape)
    for group in trees.groups:
        for block, paths in _blocks(group, len(rows)):
            own = _inside(paths, rows[block]).astype(float)
            total = np.zeros(own.shape)
            for t, weight in _nodes(own.shape[2] - 1):
                factors = paths.share * (1 - t) + own * t
                # a factor is 0 only where o = z = 0, which gives nothing anyway
                with np.errstate(divide="ignore", invalid="ignore"):
                    rest = np.prod(factors, axis=2)[:, :, None] / factors
                total += weight * np.where(factors > 0, rest, 0.0)
            total *= (own - paths.share) * paths.value[:, None]
            _summed(total.reshape(len(own), -1), paths.feature.ravel(), out[block])
    return out


def feature_pairs(trees: Trees) -> np.ndarray:
    """The pairs of features that meet on some path, smaller first; all others don't interact."""
    found = [np.zeros((0, 2), np.int64)]
    for group in trees.groups:
        i, j = np.triu_indices(group.feature.shape[1], 1)
        found.append(np.unique(np.stack([group.feature[:, i].ravel(), group.feature[:, j].ravel()], axis=1), axis=0))
    return np.unique(np.concatenate(found), axis=0)


def interaction_values(trees: Trees, rows: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Interaction of every pair in every row; both orders have this value each."""
    out = np.zeros((len(rows), len(pairs)))
    width = rows.shape[1]
    codes = pairs[:, 0] * width + pairs[:, 1]
    for group in trees.groups:
        i, j = np.triu_indices(group.feature.shape[1], 1)
        if not len(i):
            continue
        for block, paths in _blocks(Paths(*group), len(rows)):
            own = _inside(paths, rows[block]).astype(float)
            total = np.zeros((len(own), len(paths.value), len(i)))
            for t, weight in _nodes(max(own.shape[2] - 2, 0)):
                factors = paths.share * (1 - t) + own * t
                two = factors[:, :, i] * factors[:, :, j]
                with np.errstate(divide="ignore", invalid="ignore"):
                    rest = np.prod(factors, axis=2)[:, :, None] / two
                total += weight * np.where(two > 0, rest, 0.0)
            gain = own - paths.share
            total *= gain[:, :, i] * gain[:, :, j] * (paths.value / 2)[:, None]
            slots = np.searchsorted(codes, (paths.feature[:, i] * width + paths.feature[:, j]).ravel())
            _summed(total.reshape(len(own), -1), slots, out[block])
    return out


def _per_row(df: DataFrame, row_id: str, cells, compute, names: str) -> DataFrame:
    """``row_id`` and the arrays that ``compute`` returns for a block of rows."""
    kind = df.schema[row_id].dataType.simpleString()
    columns = names.split(",")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            width = len(batch.column(1)[0])
            flat = batch.column(1).flatten()
            rows = np.asarray(flat, dtype=float).reshape(batch.num_rows, width)
            arrays = [
                pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1, dtype=np.int32) * a.shape[1]), pa.array(a.ravel())) for a in compute(rows)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["_id", *columns])

    schema = f"_id {kind}, " + ", ".join(f"{c} array<double>" for c in columns)
    found = df.select(F.col(row_id).alias("_id"), F.array(*cells).alias("_x")).mapInArrow(run, schema)
    return found.withColumnRenamed("_id", row_id)


def _trees(fitted: Fitted, spark: SparkSession) -> Trees:
    return flatten(node_table(fitted.model, spark).collect())


def tree_shapley(fitted: Fitted, df: DataFrame, row_id: str) -> tuple[DataFrame, DataFrame]:
    """Exact attributions ``(row_id, feature, value)`` and ``(row_id, base, prediction)``.

    They add up to the prediction minus ``base``, the model's value with no feature known.  A
    missing cell is the value that stood for it in training.  Every row comes back, whatever its id.
    """
    nodes = [r.asDict() for r in node_table(fitted.model, df.sparkSession).collect()]
    p = len(fitted.features)
    grids = model_grids(nodes, p, TABLE_NUMBERS // p, MODEL_NUMBERS // p)
    return _shapley(flatten(nodes).base, cell_shapley(grids, nodes), fitted.features, df, row_id, filled(fitted.features, fitted.missing))


def cell_shapley(grids: Grids, nodes: Sequence[Mapping[str, Any]]) -> Callable[[np.ndarray], np.ndarray]:
    """``shapley_values`` of a model, looked up where its trees have tables: attributions too only depend on a row's cell."""
    known = [shapley_values(flatten(r for r in nodes if r["tree"] in table.numbers), cell_rows(grids, table)) for table in grids.tables]
    rest = flatten(r for r in nodes if r["tree"] in grids.walked)

    def values(rows: np.ndarray) -> np.ndarray:
        codes, out = grids.codes(rows), shapley_values(rest, rows)
        for table, attributed in zip(grids.tables, known):
            out += attributed[table.places(codes)]
        return out

    return values


def shapley_from(trees: Trees, features: Sequence[str], df: DataFrame, row_id: str, cells) -> tuple[DataFrame, DataFrame]:
    """``tree_shapley`` for flattened trees of any origin; ``cells`` are the features' columns without nulls."""
    return _shapley(trees.base, lambda rows: shapley_values(trees, rows), features, df, row_id, cells)


def _shapley(base: float, attribute: Callable[[np.ndarray], np.ndarray], features: Sequence[str], df: DataFrame, row_id: str, cells) -> tuple[DataFrame, DataFrame]:
    def compute(rows):
        values = attribute(rows)
        return values, np.stack([np.full(len(rows), base), base + values.sum(axis=1)], axis=1)

    found = _per_row(df, row_id, cells, compute, "_values,_ends")
    names = F.array(*map(F.lit, features))
    values = found.select(row_id, F.posexplode("_values").alias("_f", "value")).select(row_id, F.get(names, F.col("_f")).alias("feature"), "value")
    return values, found.select(row_id, F.get("_ends", F.lit(0)).alias("base"), F.get("_ends", F.lit(1)).alias("prediction"))


def tree_interactions(fitted: Fitted, df: DataFrame, row_id: str) -> DataFrame:
    """``(row_id, feature_i, feature_j, value)`` for i <> j, symmetric.

    A feature's attribution is the sum of its interactions and of a main effect of its own.  Pairs that
    share no path don't interact and are left out.
    """
    return interactions_from(_trees(fitted, df.sparkSession), fitted.features, df, row_id, filled(fitted.features, fitted.missing))


def interactions_from(trees: Trees, features: Sequence[str], df: DataFrame, row_id: str, cells) -> DataFrame:
    """``tree_interactions`` for flattened trees of any origin."""
    pairs = feature_pairs(trees)
    found = _per_row(df, row_id, cells, lambda rows: [interaction_values(trees, rows, pairs)], "_values")
    names = F.array(*map(F.lit, features))
    first, second = (F.array(*[F.lit(int(f)) for f in pairs[:, k]]).cast("array<int>") for k in (0, 1))
    long = found.select(row_id, F.posexplode("_values").alias("_p", "value")).select(
        row_id, F.get(names, F.get(first, F.col("_p"))).alias("i"), F.get(names, F.get(second, F.col("_p"))).alias("j"), "value"
    )
    both = F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j")))
    return long.select(row_id, F.explode(both).alias("e"), "value").select(
        row_id, F.col("e.i").alias("feature_i"), F.col("e.j").alias("feature_j"), "value"
    )

"""Column transforms.  ``fit_*`` runs aggregates and returns plain parameters; ``apply_*`` is a projection."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any, NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.operators.rows import categorical_columns, numeric_columns
from lamina.plans.dictionary import apply_codes, fit_categories, fit_codes
from lamina.plans.lookup import BROADCAST_BYTES, lookup_join
from lamina.plans.modes import column_modes
from lamina.plans.neighbours import mean_value, nearest, weighted_value
from lamina.plans.order_stats import exact_percentiles
from lamina.plans.row_index import with_row_index
from lamina.session import BROADCAST_ROWS, materialise


def _replace(df: DataFrame, new: Mapping[str, Column]) -> DataFrame:
    return df.select(*[new[c].alias(c) if c in new else F.col(c) for c in df.columns])


# -- imputation ------------------------------------------------------------------


def fit_impute(df: DataFrame, columns: Sequence[str], strategy: str = "mean", fill_value: Any = None) -> dict[str, Any]:
    """Fill value per column; None when the column has no value at all."""
    if strategy == "mean":
        return df.agg(*[F.avg(c).alias(c) for c in columns]).first().asDict()
    if strategy == "median":
        return {c: v[0] for c, v in exact_percentiles(df, columns, [0.5]).items()}
    if strategy == "most_frequent":
        return column_modes(df, columns)
    if strategy == "constant":
        return {c: fill_value for c in columns}
    raise ValueError(f"unknown strategy {strategy!r}")


def apply_impute(df: DataFrame, fills: Mapping[str, Any]) -> DataFrame:
    return _replace(df, {c: F.coalesce(F.col(c), F.lit(v)) for c, v in fills.items() if v is not None})


class KnnImputer(NamedTuple):
    """Fitted state: the donor rows ``(_id, columns...)`` and the means that stand in without a donor."""

    donors: DataFrame
    columns: tuple[str, ...]
    means: dict[str, Any]
    n_neighbors: int = 5
    weights: str = "uniform"


def fit_impute_knn(
    df: DataFrame, columns: Sequence[str], n_neighbors: int = 5, weights: str = "uniform", row_id: str | None = None
) -> KnnImputer:
    """Keep the rows of ``df`` as donors.  Equal distances go by ``row_id``, or by a hash of the row."""
    if weights not in ("uniform", "distance"):
        raise ValueError(f"unknown weights {weights!r}")
    cells = [F.col(c).cast("double").alias(c) for c in columns]
    order = F.xxhash64(*[F.col(c).cast("double") for c in columns]) if row_id is None else F.col(row_id).cast("bigint")
    donors = materialise(df.select(order.alias("_id"), *cells, _pattern(columns).alias("_mask")), "donors")
    return KnnImputer(donors, tuple(columns), fit_impute(donors, columns, "mean"), n_neighbors, weights)


def _pattern(columns: Sequence[str]) -> Column:
    """Which columns a row has, one letter each: any number of columns fits."""
    return F.concat(F.lit(""), *[F.when(F.col(c).isNotNull(), "1").otherwise("0") for c in columns])


def _pattern_slots(rows: DataFrame, name: str, letter: str) -> DataFrame:
    """``(name, slot)``: the distinct patterns and the columns for which they have the letter."""
    masks = rows.select(F.col("_mask").alias(name)).distinct()
    places = F.transform(F.split(name, ""), lambda c, i: F.when(c == letter, i))
    return masks.select(name, F.explode(F.filter(places, lambda i: i.isNotNull())).alias("slot"))


def apply_impute_knn(df: DataFrame, fitted: KnnImputer, row_id: str | None = None) -> DataFrame:
    """Mean of the nearest donors' values, by distance over the coordinates both rows have.

    The squared distance is scaled by all / shared coordinates.  Rows fall into patterns of
    missing columns; for a receiver pattern and a donor pattern the shared coordinates are
    fixed, so each pair of patterns is an ordinary exact neighbour search, and the k best
    over all donor patterns follow.  Without any usable donor the column mean is used.

    Donors are the rows that were fitted, never those of ``df``.  Without a ``row_id`` the rows are written once with a number.
    """
    columns, k, p = fitted.columns, fitted.n_neighbors, len(fitted.columns)
    if row_id is None:
        df = materialise(df.withColumn("_row", F.monotonically_increasing_id()), "receivers")
    key = row_id or "_row"
    cells = [F.col(c).cast("double").alias(c) for c in columns]
    # written, as a condition on an expression over all columns keeps the optimiser busy at every later step
    asked_rows = materialise(df.select(F.col(key).alias("_id"), *cells, _pattern(columns).alias("_mask")), "asked")
    asked_rows, given_rows = asked_rows.filter(F.col("_mask").contains("0")), fitted.donors
    # one row per pattern of missing columns on either side; they meet in the columns one lacks and the other has
    receivers = _pattern_slots(asked_rows, "receiver", "0")
    givers = _pattern_slots(given_rows, "donor", "1")
    letters = F.zip_with(F.split("receiver", ""), F.split("donor", ""), lambda x, y: F.when((x == "1") & (y == "1"), "1").otherwise("0"))
    met = receivers.join(givers, "slot").withColumn("shared", F.array_join(F.slice(letters, 1, p), ""))
    common = F.octet_length("shared") - F.octet_length(F.replace("shared", F.lit("1"), F.lit("")))
    plan = materialise(met.where(common > 0).withColumn("scale", F.lit(float(p)) / common), "patterns")
    pairs = plan.count()
    if not pairs:
        return apply_impute(df, fitted.means).drop("_row") if row_id is None else apply_impute(df, fitted.means)
    # one row per column, receiver pattern and donor pattern
    plan = F.broadcast(plan) if pairs <= BROADCAST_ROWS and pairs * 3 * p <= BROADCAST_BYTES else plan
    space = F.concat_ws(":", "slot", "receiver", "donor").alias("space")
    cells = F.array(*columns)
    vec = F.transform(cells, lambda c, i: F.when(F.substring("shared", i + 1, F.lit(1)) == "1", c).otherwise(F.lit(0.0))).alias("vec")
    asked = asked_rows.join(plan, F.col("_mask") == F.col("receiver")).select("_id", "slot", "scale", space, vec)
    given = given_rows.join(plan, F.col("_mask") == F.col("donor")).select(
        F.col("_id").alias("id"), space, vec, F.get(cells, F.col("slot")).alias("value")
    )
    answers = nearest(asked, given, k)

    def scaled(n: Column) -> Column:
        return F.struct((n["d2"] * F.col("scale")).alias("d2"), n["id"].alias("id"), n["value"].alias("value"))

    donors = answers.select("_id", "slot", F.transform("near", scaled).alias("near"))
    # Per receiver and column: k donors from each donor pattern.
    merged = donors.groupBy("_id", "slot").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k).alias("near"))
    value = mean_value(F.col("near")) if fitted.weights == "uniform" else weighted_value(F.col("near"))
    fills = merged.filter(F.size("near") > 0).select("_id", "slot", value.alias("fill"))
    by_slot = fills.groupBy("_id").agg(F.map_from_entries(F.collect_list(F.struct("slot", "fill"))).alias("_fill"))
    joined = df.join(by_slot, df[key] == by_slot["_id"], "left")
    new = {c: F.coalesce(F.col(c), F.try_element_at("_fill", F.lit(i)), F.lit(fitted.means[c])) for i, c in enumerate(columns)}
    return joined.select(*[new[c].alias(c) if c in new else F.col(c) for c in df.columns if row_id or c != "_row"])


def impute_knn(df: DataFrame, columns: Sequence[str], row_id: str | None = None, n_neighbors: int = 5, weights: str = "uniform") -> DataFrame:
    """Fit on ``df`` and apply to it; see :func:`apply_impute_knn`."""
    return apply_impute_knn(df, fit_impute_knn(df, columns, n_neighbors, weights, row_id), row_id)


# -- scaling ---------------------------------------------------------------------


def fit_scale(df: DataFrame, columns: Sequence[str], method: str = "standard") -> dict[str, tuple[float, float]]:
    """``(shift, divisor)`` per column; a zero divisor becomes 1."""
    if method == "standard":
        aggregates = [(F.avg(c), F.stddev_pop(c)) for c in columns]
    elif method == "minmax":
        aggregates = [(F.min(c).cast("double"), (F.max(c) - F.min(c)).cast("double")) for c in columns]
    elif method == "robust":
        quartiles = exact_percentiles(df, columns, [0.25, 0.5, 0.75])
        return {c: (q[1], (q[2] - q[0]) or 1.0) for c, q in quartiles.items() if q[1] is not None}
    else:
        raise ValueError(f"unknown scaler {method!r}")
    flat = [a.alias(f"{'sd'[j]}{i}") for i, pair in enumerate(aggregates) for j, a in enumerate(pair)]
    row = df.agg(*flat).first()
    return {c: (row[f"s{i}"], row[f"d{i}"] or 1.0) for i, c in enumerate(columns) if row[f"s{i}"] is not None}


def apply_scale(df: DataFrame, scales: Mapping[str, tuple[float, float]]) -> DataFrame:
    return _replace(df, {c: (F.col(c) - F.lit(s)) / F.lit(d) for c, (s, d) in scales.items()})


def normalise_rows(df: DataFrame, columns: Sequence[str], norm: str = "l2") -> DataFrame:
    """Each row divided by its norm over the columns; a zero row stays."""
    cells = [F.col(c).cast("double") for c in columns]
    if norm == "l2":
        size = F.sqrt(sum((c * c for c in cells[1:]), cells[0] * cells[0]))
    elif norm == "l1":
        size = sum((F.abs(c) for c in cells[1:]), F.abs(cells[0]))
    elif norm == "max":
        size = F.greatest(*[F.abs(c) for c in cells]) if len(cells) > 1 else F.abs(cells[0])
    else:
        raise ValueError(f"unknown norm {norm!r}")
    divisor = F.when(size == 0.0, F.lit(1.0)).otherwise(size)
    return _replace(df, {c: F.col(c).cast("double") / divisor for c in columns})


# -- encoding --------------------------------------------------------------------


def fit_ordinal(df: DataFrame, column: str) -> DataFrame:
    """``(category, code, n)``: sorted distinct values numbered from 0."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("category")).agg(
        F.count(F.lit(1)).alias("n")
    )
    counts = materialise(counts, "categories")
    if counts.count() <= BROADCAST_ROWS:
        return counts.withColumn("code", (F.row_number().over(Window.orderBy("category")) - 1).cast("double"))
    indexed = with_row_index(counts, ["category"], "code").frame
    return indexed.withColumn("code", F.col("code").cast("double"))


def apply_ordinal(
    df: DataFrame, column: str, codes: DataFrame, handle_unknown: str = "error", unknown_value: float = -1.0
) -> DataFrame:
    """Code of each value; null stays null.  An unseen value is an error or ``unknown_value``."""
    if handle_unknown not in ("error", "use_encoded_value"):
        raise ValueError(f"unknown option handle_unknown={handle_unknown!r}")
    missing = (
        F.lit(float(unknown_value))
        if handle_unknown == "use_encoded_value"
        else F.raise_error(F.concat(F.lit(f"unknown category in {column}: "), F.col(column).cast("string"))).cast("double")
    )
    joined = lookup_join(df, codes.withColumnRenamed("category", column).withColumnRenamed("code", "_code"), column, "n")
    code = F.when(F.col(column).isNull(), F.lit(None).cast("double")).otherwise(F.coalesce(F.col("_code"), missing))
    return joined.select(*[code.alias(c) if c == column else F.col(c) for c in df.columns])


def fit_onehot(df: DataFrame, column: str, max_columns: int | None = None) -> list:
    """Sorted distinct values, null last if it occurs; they become column names.

    More than ``max_columns``, if given, are an error.
    """
    found = df.select(column).distinct()
    rows = (found if max_columns is None else found.limit(max_columns + 1)).collect()
    if max_columns is not None and len(rows) > max_columns:
        raise ValueError(f"{column} has more than {max_columns} categories; use onehot_vector")
    values = [r[0] for r in rows]
    return sorted(v for v in values if v is not None) + ([None] if None in values else [])


def _name_of(value) -> str:
    return "null" if value is None else str(value)


def apply_onehot(df: DataFrame, column: str, categories: Sequence) -> DataFrame:
    """The column replaced by one 0/1 column per category, named ``column_category``."""
    flags = [F.col(column).eqNullSafe(F.lit(v)).cast("double").alias(f"{column}_{_name_of(v)}") for v in categories]
    return df.select(*[c for c in df.columns if c != column], *flags)


def onehot_vector(df: DataFrame, column: str, codes: DataFrame) -> DataFrame:
    """The column replaced by a sparse 0/1 vector, for any number of categories."""
    from pyspark.ml.feature import OneHotEncoder

    size = codes.count()
    coded = apply_ordinal(df, column, codes, "use_encoded_value", size).fillna({column: float(size)})
    encoder = OneHotEncoder(inputCol=column, outputCol="_vector", dropLast=True)
    # The last index stands for unknown and null; dropping it leaves an all-zero vector.
    attributes = {"ml_attr": {"type": "nominal", "num_vals": size + 1}}
    coded = coded.withMetadata(column, attributes)
    return encoder.fit(coded).transform(coded).drop(column).withColumnRenamed("_vector", column)


# -- per-dtype pipelines ---------------------------------------------------------


def fit_pipeline(df: DataFrame, numerical: Sequence[Mapping] = (), categorical: Sequence[Mapping] = (),
                 exclude: Sequence[str] = ()) -> tuple[DataFrame, list]:
    """Fit and apply the steps of both groups; returns the transformed frame and the fitted steps.

    A step is a mapping with ``type``, ``method`` and options.  The result has the excluded
    columns, then the numeric ones, then the categorical ones; other dtypes are dropped.
    """
    groups = {"numerical": [c for c in numeric_columns(df) if c not in exclude],
              "categorical": [c for c in categorical_columns(df) if c not in exclude]}
    frame = df.select(*exclude, *groups["numerical"], *groups["categorical"])
    fitted = []
    for group, steps in (("numerical", numerical), ("categorical", categorical)):
        for step in steps:
            columns = groups[group]
            if not columns:
                continue
            applied = _fit_step(frame, columns, dict(step))
            frame, groups[group] = apply_step(frame, columns, applied)
            fitted.append((group, applied))
    return frame.select(*exclude, *groups["numerical"], *groups["categorical"]), fitted


def apply_pipeline(df: DataFrame, fitted: Sequence, exclude: Sequence[str] = ()) -> DataFrame:
    """Apply steps fitted on another frame."""
    groups = {"numerical": [c for c in numeric_columns(df) if c not in exclude],
              "categorical": [c for c in categorical_columns(df) if c not in exclude]}
    frame = df.select(*exclude, *groups["numerical"], *groups["categorical"])
    for group, applied in fitted:
        frame, groups[group] = apply_step(frame, groups[group], applied)
    return frame.select(*exclude, *groups["numerical"], *groups["categorical"])


# The names of step types and methods here and in ``apply_step`` are those of the config format.
def _fit_step(df: DataFrame, columns: Sequence[str], step: dict) -> tuple[str, str, Any]:
    kind, method = step.pop("type", "other"), step.pop("method", "passthrough")
    if (kind, method) == ("impute", "simple"):
        return kind, method, fit_impute(df, columns, **step)
    if (kind, method) == ("impute", "knn"):
        return kind, method, (fit_impute_knn(df, columns, **step), step.get("row_id"))
    if (kind, method) == ("scale", "normalize"):
        return kind, method, step.get("norm", "l2")
    if kind == "scale" and method in ("standard", "minmax", "robust"):
        return kind, method, fit_scale(df, columns, method)
    if (kind, method) == ("encode", "ordinal"):
        return kind, method, (fit_codes(df, columns), step)
    if (kind, method) == ("encode", "onehot"):
        return kind, method, fit_categories(df, columns)
    if kind == "other" and method in ("passthrough", "drop"):
        return kind, method, None
    raise ValueError(f"unknown step {kind}/{method}")


def apply_step(df: DataFrame, columns: Sequence[str], step: tuple[str, str, Any]) -> tuple[DataFrame, list[str]]:
    kind, method, params = step
    columns = list(columns)
    if (kind, method) == ("impute", "simple"):
        return apply_impute(df, params), columns
    if (kind, method) == ("impute", "knn"):
        return apply_impute_knn(df, *params), columns
    if (kind, method) == ("scale", "normalize"):
        return normalise_rows(df, columns, params), columns
    if kind == "scale":
        return apply_scale(df, params), columns
    if (kind, method) == ("encode", "ordinal"):
        return apply_codes(df, params[0], **params[1]), columns
    if (kind, method) == ("encode", "onehot"):
        flags = [
            F.col(c).eqNullSafe(F.lit(v)).cast("double").alias(f"{c}_{_name_of(v)}") for c, categories in params.items() for v in categories
        ]
        return df.select(*[c for c in df.columns if c not in params], *flags), [f"{c}_{_name_of(v)}" for c, categories in params.items() for v in categories]
    if method == "drop":
        return df.drop(*columns), []
    return df, columns

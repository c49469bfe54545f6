"""Projections, row filters and type conversion."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamina.functions.composition import ALLOWED_FORMULA, SITE_RANGES, SITE_SUMS
from lamina.functions.text import NULL_TOKENS, is_integer, is_number_or_empty, null_token, number

LAYER_MARK = "|"


def project(df: DataFrame, columns: Sequence[str], rename: Mapping[str, str] | None = None) -> DataFrame:
    """Columns in the given order, optionally renamed."""
    rename = rename or {}
    return df.select(*[F.col(c).alias(rename.get(c, c)) for c in columns])


def drop_columns(df: DataFrame, columns: Sequence[str], ignore_missing: bool = True) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing and not ignore_missing:
        raise KeyError(f"no such columns: {missing}")
    return df.drop(*columns)


def drop_null_rows(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Rows without a null in ``subset`` (all columns by default)."""
    return df.na.drop("any", subset=list(subset) if subset else None)


def keep_true(df: DataFrame, *flags: str) -> DataFrame:
    return df.filter(reduce(lambda a, b: a & b, [F.col(f) for f in flags]))


def is_multi_layer(column: str) -> Column:
    return F.coalesce(F.col(column).contains(LAYER_MARK), F.lit(False))


def single_layer(df: DataFrame, column: str) -> DataFrame:
    """Rows whose cell describes one layer; a null cell stays, as text it has no mark."""
    return df.filter(~is_multi_layer(column))


def exclude_containing(df: DataFrame, column: str, text: str) -> DataFrame:
    return df.filter(~F.col(column).contains(text))


def allowed_formulas(df: DataFrame, column: str, grammar: str = ALLOWED_FORMULA) -> DataFrame:
    return df.filter(F.col(column).rlike(grammar))


def within_tolerance(
    df: DataFrame, sums: Mapping[str, Column], ranges: Mapping[str, tuple[float, float]] = SITE_RANGES
) -> DataFrame:
    """Rows whose site sums all lie in their closed range."""
    return df.filter(reduce(lambda a, b: a & b, [sums[s].between(*ranges[s]) for s in sums]))


def off_stoichiometry(
    df: DataFrame, sums: Mapping[str, Column], exact: Mapping[str, float] = SITE_SUMS
) -> DataFrame:
    """Rows where at least one site sum differs from its exact value."""
    return df.filter(reduce(lambda a, b: a | b, [sums[s] != F.lit(exact[s]) for s in sums]))


def normalise_nulls(df: DataFrame, tokens: Sequence[str] = NULL_TOKENS) -> DataFrame:
    """Null tokens to null in every string column, in one projection."""
    return df.select(
        *[null_token(F.col(f.name), tokens).alias(f.name) if _is_string(f) else F.col(f.name) for f in df.schema]
    )


def _is_string(field: T.StructField) -> bool:
    return isinstance(field.dataType, T.StringType)


def split_target(df: DataFrame, target: str, drop_target: bool = True, label: str = "label") -> DataFrame:
    """Rows with a target; its value goes to ``label`` and the column itself is dropped or kept."""
    if not isinstance(target, str):
        raise TypeError("one target column is expected")
    kept = [c for c in df.columns if c != target or not drop_target]
    return df.filter(F.col(target).isNotNull()).select(*kept, F.col(target).alias(label))


# -- type conversion -------------------------------------------------------------


def promote_numeric(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """String columns whose every value is a number become numeric; the others stay.

    BIGINT when all values are integers and none is missing, otherwise DOUBLE.  One
    aggregate over all columns decides, a projection casts.
    """
    names = [f.name for f in df.schema if _is_string(f) and (columns is None or f.name in columns)]
    if not names:
        return df
    tests = []
    for i, c in enumerate(names):
        tests.append(F.coalesce(F.every(is_number_or_empty(F.col(c))), F.lit(True)).alias(f"n{i}"))
        tests.append(F.coalesce(F.every(is_integer(F.col(c))), F.lit(False)).alias(f"i{i}"))
    verdict = df.agg(*tests).first()
    casts = {}
    for i, c in enumerate(names):
        if verdict[f"i{i}"]:
            casts[c] = F.col(c).try_cast("bigint").alias(c)
        elif verdict[f"n{i}"]:
            casts[c] = number(F.col(c)).alias(c)
    return df.select(*[casts.get(c, F.col(c)) for c in df.columns])


def coerce_numeric(df: DataFrame, *columns: str) -> DataFrame:
    """Numeric value of each text, null where it is none."""
    return df.select(*[number(F.col(c)).alias(c) if c in columns else F.col(c) for c in df.columns])


def text_or_nan(column: str) -> Column:
    """Cell as text, a missing one as ``nan``."""
    return F.coalesce(F.col(column).cast("string"), F.lit("nan"))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def categorical_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, (T.StringType, T.BooleanType))]

"""Most frequent value per group, counted before it is compared."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def group_modes(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Mode of each column per key tuple; smallest value on ties, null when there is none.

    Values are counted per ``(key, column, value)`` first, so a key that owns a third of the
    rows arrives at its task as at most one row per distinct value and earlier task.  All
    columns share one scan; values travel in one slot per data type.
    """
    keys = list(keys)
    types = list(dict.fromkeys(df.schema[c].dataType for c in columns))
    typed = {c: f"v{types.index(df.schema[c].dataType)}" for c in columns}

    def entry(i: int, c: str):
        values = [
            (F.col(c) if typed[c] == f"v{t}" else F.lit(None)).cast(kind).alias(f"v{t}") for t, kind in enumerate(types)
        ]
        return F.struct(F.lit(i).alias("slot"), F.col(c).isNotNull().alias("known"), *values)

    fields = ["slot", "known", *[f"v{t}" for t in range(len(types))]]
    counts = (
        df.select(*keys, F.explode(F.array(*[entry(i, c) for i, c in enumerate(columns)])).alias("e"))
        .select(*keys, *[F.col(f"e.{f}").alias(f"_{f}") for f in fields])
        .groupBy(*keys, *[f"_{f}" for f in fields])
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    # A missing value ranks behind every real one, whatever its count.
    rank = F.when(F.col("_known"), -F.col("_n")).otherwise(F.lit(0)).alias("rank")
    best = [
        F.min(F.when(F.col("_slot") == i, F.struct(rank, F.col(f"_{typed[c]}").alias("value"))))["value"].alias(c)
        for i, c in enumerate(columns)
    ]
    return counts.groupBy(*keys).agg(*best)


def column_modes(df: DataFrame, columns: Sequence[str]) -> dict[str, object]:
    """Mode of each column over the whole frame, as a one-row result."""
    row = group_modes(df.select(F.lit(0).alias("_all"), *columns), ["_all"], columns).first()
    return {c: row[c] if row else None for c in columns}

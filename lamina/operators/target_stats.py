"""Target statistics of text columns in the order of a random permutation, for boosting on categories."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.functions.hashing import HASH_BITS, key_hash
from lamina.operators.split import row_key
from lamina.plans.lookup import lookup_join
from lamina.session import materialise

# Rows of the permutation that are ordered together, about.
CHUNK_ROWS = 100_000


class TargetStatistics(NamedTuple):
    """Fitted state: ``(slot, category, total, n)``, the label's mean and its weight."""

    table: DataFrame
    columns: tuple[str, ...]
    prior: float
    weight: float


def ordered_target_statistics(
    df: DataFrame, columns: Sequence[str], label: str, keys: Sequence[str], weight: float = 1.0, seed: int = 42, chunk_rows: int = CHUNK_ROWS,
) -> tuple[DataFrame, TargetStatistics]:
    """``df`` with each column's cells replaced by a statistic that has not seen the row's own label, and what to apply to other rows.

    Rows are put in the order of a hash of their keys, rows of equal keys by rising label; every row is one of its own.  A cell becomes
    ``(sum + weight * prior) / (n + weight)`` over the labels of the rows before it that have its category; ``prior`` is
    the mean label.  A null is a category of its own; rows without a label are an error.

    The permutation is cut into chunks by the leading bits of the hash.  Sums per (column, category, chunk) are made
    first, and what earlier chunks hold follows from them; only rows of one category in one chunk are ordered in a task.
    """
    if df.where(F.col(label).isNull()).limit(1).count():
        raise ValueError(f"rows without {label}")
    size = df.agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(label).cast("double")).alias("mean")).first()
    prior = 0.0 if size["mean"] is None else size["mean"]
    bits = max(0, (size["n"] // chunk_rows).bit_length())
    key = row_key(*keys)
    order = key_hash(seed, key)
    # written with a number, which then stays a row's own
    df = materialise(df.withColumn("_row", F.monotonically_increasing_id()), "rows")
    chunk = F.shiftright(order, HASH_BITS - bits) if bits else F.lit(0).cast("bigint")
    cells = F.array(*[F.struct(F.lit(k).alias("slot"), F.col(c).cast("string").alias("category")) for k, c in enumerate(columns)])
    rows = materialise(df.select(
        "_row", key.alias("_k"), order.alias("_h"), chunk.alias("_chunk"), F.col(label).cast("double").alias("_y"), F.explode(cells).alias("e")
    ).select("_row", "_k", "_h", "_chunk", "_y", "e.slot", F.coalesce(F.concat(F.lit("="), "e.category"), F.lit("")).alias("category")), "cells")
    sums = materialise(rows.groupBy("slot", "category", "_chunk").agg(F.sum("_y").alias("total"), F.count(F.lit(1)).alias("n")), "sums")
    earlier = Window.partitionBy("slot", "category").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(
        "slot", "category", "_chunk", F.coalesce(F.sum("total").over(earlier), F.lit(0.0)).alias("_total"),
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_n"),
    )
    inside = Window.partitionBy("slot", "category", "_chunk").orderBy("_h", "_k", "_y", "_row").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("_own", F.coalesce(F.sum("_y").over(inside), F.lit(0.0))).withColumn("_count", F.count(F.lit(1)).over(inside))
    value = (F.col("_total") + F.col("_own") + F.lit(weight * prior)) / (F.col("_n") + F.col("_count") + F.lit(float(weight)))
    valued = placed.join(before, ["slot", "category", "_chunk"]).groupBy("_row").agg(
        F.map_from_entries(F.collect_list(F.struct("slot", value.alias("value")))).alias("_values")
    )
    joined = df.join(valued, "_row")
    slots = {c: k for k, c in enumerate(columns)}
    encoded = joined.select(*[F.element_at("_values", F.lit(slots[c])).alias(c) if c in slots else F.col(c) for c in df.columns if c != "_row"])
    totals = materialise(sums.groupBy("slot", "category").agg(F.sum("total").alias("total"), F.sum("n").alias("n")), "totals")
    return encoded, TargetStatistics(totals, tuple(columns), prior, float(weight))


def apply_target_statistics(df: DataFrame, fitted: TargetStatistics) -> DataFrame:
    """Rows that were not fitted: the statistic over all fitted rows; an unseen category has the prior."""
    def value(total: Column, n: Column) -> Column:
        return (F.coalesce(total, F.lit(0.0)) + F.lit(fitted.weight * fitted.prior)) / (F.coalesce(n, F.lit(0)) + F.lit(fitted.weight))

    for slot, name in enumerate(fitted.columns):
        own = fitted.table.where(F.col("slot") == slot).select(F.col("category").alias("_c"), F.struct("total", "n").alias("_s"), F.col("n").alias("_n"))
        named = df.withColumn("_c", F.coalesce(F.concat(F.lit("="), F.col(name).cast("string")), F.lit("")))
        joined = lookup_join(named, own, "_c", "_n")
        df = joined.select(*[value(F.col("_s.total"), F.col("_s.n")).alias(c) if c == name else F.col(c) for c in df.columns])
    return df

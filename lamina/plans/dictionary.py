"""One dictionary for the categories of many columns: fitted in one count, looked up in one pass."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamina.plans.lookup import BROADCAST_BYTES, lookup_join
from lamina.plans.row_index import with_row_index
from lamina.session import BROADCAST_ROWS, materialise


class Codes(NamedTuple):
    """Codes of several columns: ``(slot, category, code, n)``, ``slot`` being the column's place."""

    table: DataFrame
    columns: tuple[str, ...]


def _text(df: DataFrame, name: str) -> Column:
    """A category as text; the same for equal values."""
    kind = df.schema[name].dataType
    return ((F.col(name) + F.lit(0.0)) if isinstance(kind, T.FractionalType) and not isinstance(kind, T.DecimalType) else F.col(name)).cast("string")


def fit_codes(df: DataFrame, columns: Sequence[str], broadcast_rows: int = BROADCAST_ROWS) -> Codes:
    """Sorted distinct values of each column numbered from 0; nulls have no code.

    One count of (column, value) pairs, combined before its shuffle, serves all columns.  A large
    dictionary is numbered by a range shuffle on (column, value), less what comes before the column.
    """
    entries = []
    for slot, name in enumerate(columns):
        numeric = isinstance(df.schema[name].dataType, T.NumericType)
        order = F.col(name).cast("double") if numeric else F.lit(None).cast("double")
        entries.append(F.struct(F.lit(slot).alias("slot"), order.alias("order"), _text(df, name).alias("category")))
    spark = df.sparkSession
    if not entries:
        return Codes(spark.createDataFrame([], "slot int, category string, code double, n bigint"), ())
    pairs = df.select(F.explode(F.array(*entries)).alias("e")).select("e.*").where("category is not null")
    counts = materialise(pairs.groupBy("slot", "order", "category").agg(F.count(F.lit(1)).alias("n")), "categories")
    if counts.count() <= broadcast_rows:
        code = F.row_number().over(Window.partitionBy("slot").orderBy("order", "category")) - 1
        numbered = counts.withColumn("code", code)
    else:
        indexed = with_row_index(counts, ["slot", "order", "category"], "_at").frame
        # one row per column
        starts = indexed.groupBy("slot").agg(F.min("_at").alias("_start"))
        numbered = indexed.join(F.broadcast(starts), "slot").withColumn("code", F.col("_at") - F.col("_start"))
    return Codes(numbered.select("slot", "category", F.col("code").cast("double").alias("code"), "n"), tuple(columns))


def apply_codes(
    df: DataFrame, codes: Codes, handle_unknown: str = "error", unknown_value: float = -1.0,
    broadcast_rows: int = BROADCAST_ROWS, broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """The columns replaced by their codes; null stays null, an unseen value is an error or ``unknown_value``.

    The dictionaries that together stay within the bounds are sent to all workers and looked up in one Arrow pass over
    the rows; the smallest come first.  Each larger one is a join that splits its hot keys.
    """
    if handle_unknown not in ("error", "use_encoded_value"):
        raise ValueError(f"unknown option handle_unknown={handle_unknown!r}")
    if not codes.columns:
        return df
    weight = F.sum(F.octet_length("category") + 24).alias("bytes")
    sizes = {r["slot"]: r for r in codes.table.groupBy("slot").agg(F.count(F.lit(1)).alias("rows"), weight).collect()}
    small, rows, total = [], 0, 0
    for slot in sorted(range(len(codes.columns)), key=lambda s: sizes[s]["bytes"] if s in sizes else 0):
        rows, total = rows + (sizes[slot]["rows"] if slot in sizes else 0), total + (sizes[slot]["bytes"] if slot in sizes else 0)
        if rows > broadcast_rows or total > broadcast_bytes:
            break
        small.append(slot)
    found = {}
    if small:
        df = df.withColumn("_codes", _looked_up(df, codes, small))
        found = {slot: F.get("_codes", F.lit(k)) for k, slot in enumerate(small)}
    for slot, name in enumerate(codes.columns):
        if slot not in found:
            key = f"_category{slot}"
            own = codes.table.where(F.col("slot") == slot).select(F.col("category").alias(key), F.col("code").alias(f"_code{slot}"), "n")
            df = lookup_join(df.withColumn(key, _text(df, name)), own, key, "n", broadcast_rows, broadcast_bytes)
            found[slot] = F.col(f"_code{slot}")

    def coded(slot: int, name: str) -> Column:
        if handle_unknown == "error":
            missing = F.raise_error(F.concat(F.lit(f"unknown category in {name}: "), F.col(name).cast("string"))).cast("double")
        else:
            missing = F.lit(float(unknown_value))
        return F.when(F.col(name).isNull(), F.lit(None).cast("double")).otherwise(F.coalesce(found[slot], missing)).alias(name)

    slots = {name: slot for slot, name in enumerate(codes.columns)}
    kept = [c for c in df.columns if c != "_codes" and not c.startswith(("_category", "_code"))]
    return df.select(*[coded(slots[c], c) if c in slots else F.col(c) for c in kept])


def _looked_up(df: DataFrame, codes: Codes, slots: Sequence[int]) -> Column:
    """The codes of the columns in an array, null where there is none."""
    wanted = codes.table.where(F.col("slot").isin(list(slots))).select("slot", "category", "code")
    table = wanted.toArrow()
    place = np.asarray(table.column("slot"))
    keys = [table.filter(pa.array(place == s)) for s in slots]
    shared = df.sparkSession.sparkContext.broadcast([(k.column("category").combine_chunks(), k.column("code").combine_chunks()) for k in keys])

    @F.arrow_udf("array<double>")
    def look(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            columns = [
                code.take(pc.index_in(batch.field(k).cast(pa.string()), value_set=category.cast(pa.string())))
                for k, (category, code) in enumerate(shared.value)
            ]
            n, width = len(batch), len(columns)
            # row by row from the columns
            flat = pa.concat_arrays(columns).take(pa.array((np.arange(n)[:, None] + np.arange(width)[None, :] * n).ravel()))
            yield pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), flat)

    return look(F.struct(*[_text(df, codes.columns[s]).alias(f"c{s}") for s in slots]))


def fit_categories(df: DataFrame, columns: Sequence[str]) -> dict[str, list]:
    """Sorted distinct values of text and boolean columns, null last where it occurs, from one count."""
    entries = [F.struct(F.lit(slot).alias("slot"), F.col(c).cast("string").alias("category")) for slot, c in enumerate(columns)]
    found: dict[str, list] = {c: [] for c in columns}
    if not entries:
        return found
    rows = df.select(F.explode(F.array(*entries)).alias("e")).select("e.*").distinct().collect()
    for row in rows:
        name = columns[row["slot"]]
        is_flag = isinstance(df.schema[name].dataType, T.BooleanType)
        found[name].append(row["category"] == "true" if is_flag and row["category"] is not None else row["category"])
    return {c: sorted(v for v in values if v is not None) + ([None] if None in values else []) for c, values in found.items()}

"""Exact percentiles of many columns at once, by radix selection."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Bits of the key that one scan looks at, and the values left in all brackets from which on one scan takes the rest.
DIGIT_BITS = 16
FEW_VALUES = 200_000
# Distinct entries a worker holds before it hands them on.
HELD_ENTRIES = 1 << 20


def sort_keys(values: np.ndarray) -> np.ndarray:
    """64-bit numbers in the order of the values; both zeros are one, NaN is above all others."""
    bits = np.where(np.isnan(values), np.nan, values + 0.0).view(np.uint64)
    return bits ^ np.where(bits >> np.uint64(63), ~np.uint64(0), np.uint64(1 << 63))


def key_value(key: int) -> float:
    """The value of a key."""
    bits = key ^ (1 << 63) if key >> 63 else key ^ (1 << 64) - 1
    return float(np.array([bits], np.uint64).view(float)[0])


def exact_percentiles(
    df: DataFrame, columns: Sequence[str], shares: Sequence[float], few_values: int = FEW_VALUES, digit_bits: int = DIGIT_BITS,
) -> dict[str, list[float | None]]:
    """Linearly interpolated percentiles of each column, nulls ignored; a column without values has none.

    Values become 64-bit keys of the same order.  A scan counts the next digit of the keys that lie in an
    open bracket, for all columns and ranks at once, and says in which digit each rank lies; so four scans find
    any number of ranks in any number of columns.  When few values are left in the brackets, the next scan takes
    all other digits.  Counts are combined in the worker; a task never sees more than a
    column's histogram.
    """
    if not columns:
        return {}
    cells = df.select(F.array(*[F.col(c).cast("double") for c in columns]).alias("v"))
    # bracket: column and leading digits -> rows below it and inside it, all of the column at first
    brackets: dict[tuple[int, int], tuple[int, int]] = {(k, 0): (0, 0) for k in range(len(columns))}
    totals: dict[int, int] = {}
    depth = 0
    while depth < 64 and brackets:
        bits = 64 - depth if depth and sum(n for _, n in brackets.values()) <= few_values else min(digit_bits, 64 - depth)
        order = sorted(brackets)
        wanted = {} if not totals else {
            slot: sorted({r - brackets[c, p][0] for r in _ranks(totals[c], shares) if 0 <= r - brackets[c, p][0] < brackets[c, p][1]})
            for slot, (c, p) in enumerate(order)
        }
        found = _hits(_histogram(cells, order, depth, bits), shares, wanted)
        fresh: dict[tuple[int, int], tuple[int, int]] = {}
        for row in found:
            column, prefix = order[row["slot"]]
            totals.setdefault(column, row["total"])
            fresh[column, prefix << bits | row["digit"]] = (brackets[column, prefix][0] + row["below"], row["n"])
        brackets, depth = fresh, depth + bits
    result: dict[str, list[float | None]] = {}
    for k, name in enumerate(columns):
        if k not in totals:
            result[name] = [None] * len(shares)
            continue
        own = [(below, n, key_value(key)) for (c, key), (below, n) in brackets.items() if c == k]
        result[name] = []
        for share in shares:
            position = (totals[k] - 1) * share
            low, high = (next(v for below, n, v in own if below <= r < below + n) for r in (math.floor(position), math.ceil(position)))
            result[name].append(low if low == high else low + (high - low) * (position - math.floor(position)))
    return result


def _ranks(total: int, shares: Sequence[float]) -> set[int]:
    return {r for s in shares for r in (math.floor((total - 1) * s), math.ceil((total - 1) * s))}


def _histogram(cells: DataFrame, brackets: Sequence[tuple[int, int]], depth: int, bits: int) -> DataFrame:
    """``(slot, digit, n)``: how often each next digit occurs in each bracket."""
    shift = np.uint64(64 - depth - bits)
    mask = np.uint64((1 << bits) - 1)
    above = np.uint64(64 - depth) if depth else None
    slots: dict[int, list[tuple[int, int]]] = {}
    for slot, (column, prefix) in enumerate(brackets):
        slots.setdefault(column, []).append((slot, prefix))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        size = 0

        def handed():
            for slot, (digits, n) in held.items():
                named = [pa.array(np.full(len(n), slot, np.int32)), pa.array(digits.astype(np.int64)), pa.array(n)]
                yield pa.RecordBatch.from_arrays(named, ["slot", "digit", "n"])

        for batch in batches:
            if not batch.num_rows:
                continue
            flat = batch.column(0).flatten()
            there = np.asarray(flat.is_valid()).reshape(batch.num_rows, -1)
            values = np.asarray(flat.fill_null(0.0)).reshape(batch.num_rows, -1)
            for column, own in slots.items():
                keys = sort_keys(values[there[:, column], column])
                for slot, prefix in own:
                    inside = keys if above is None else keys[keys >> above == np.uint64(prefix)]
                    digits, n = np.unique(inside >> shift & mask, return_counts=True)
                    if slot in held:
                        before = held[slot]
                        merged, place = np.unique(np.concatenate([before[0], digits]), return_inverse=True)
                        size -= len(before[0])
                        digits, n = merged, np.bincount(place, np.concatenate([before[1], n])).astype(np.int64)
                    held[slot] = digits, n
                    size += len(digits)
            if size > HELD_ENTRIES:
                yield from handed()
                held, size = {}, 0
        yield from handed()

    return cells.mapInArrow(count, "slot int, digit bigint, n bigint").groupBy("slot", "digit").agg(F.sum("n").alias("n"))


def _hits(counts: DataFrame, shares: Sequence[float], wanted: dict[int, list[int]]) -> list:
    """The digits in which the wanted ranks of each slot lie; without ``wanted`` those of the shares of its rows."""
    by_slot = Window.partitionBy("slot")
    placed = counts.withColumn("below", F.sum("n").over(by_slot.orderBy("digit")) - F.col("n")).withColumn("total", F.sum("n").over(by_slot))
    if wanted:
        flat = [(slot, r) for slot, ranks in wanted.items() for r in ranks]
        asked = counts.sparkSession.createDataFrame(flat, "slot int, r bigint").groupBy("slot").agg(F.collect_list("r").alias("ranks"))
        placed = placed.join(F.broadcast(asked), "slot")
    else:
        positions = [(F.col("total") - 1) * F.lit(float(s)) for s in shares]
        placed = placed.withColumn("ranks", F.array(*[f(p).cast("bigint") for p in positions for f in (F.floor, F.ceil)]))
    inside = F.exists("ranks", lambda r: (r >= F.col("below")) & (r < F.col("below") + F.col("n")))
    return placed.where(inside).select("slot", "digit", "n", "below", "total").collect()

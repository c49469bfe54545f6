"""Keys at given ranks of a total order, found without sorting or moving the table."""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Callable, Mapping, Sequence
from functools import cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The sample grows with the square root of the rows between these bounds.
SAMPLE_ROWS = (10_000, 100_000)
BRACKET_ROWS = 50_000


def order_key(df: DataFrame, order: Sequence[str]) -> Column:
    """One comparable struct of the order columns, nulls first.

    Timestamps become numbers or text of the same order, so that a collected key can be
    written back as a literal in any time zone.
    """
    parts = []
    for name in order:
        kind = df.schema[name].dataType
        if isinstance(kind, T.TimestampType):
            parts.append(F.unix_micros(name).alias(name))
        elif isinstance(kind, T.TimestampNTZType):
            parts.append(F.col(name).cast("string").alias(name))
        else:
            parts.append(F.col(name))
    return F.struct(*parts)


def key_literals(df: DataFrame, key: Column) -> Callable[[Sequence], Column]:
    """A function from key values to struct literals comparable with ``key``, each built once."""
    fields = [(f.name, f.dataType.simpleString()) for f in df.select(key.alias("k")).schema["k"].dataType.fields]

    @cache
    def literal(value: tuple) -> Column:
        return F.struct(*[F.lit(v).cast(kind).alias(name) for (name, kind), v in zip(fields, value)])

    return lambda value: literal(tuple(value))


def keys_at_ranks(
    df: DataFrame, key: Column, ranks: Sequence[int], total: int,
    sample_rows: int | None = None, bracket_rows: int = BRACKET_ROWS,
) -> dict[int, tuple]:
    """The key at each 0-based rank; keys are expected to be unique.

    A bounded sample brackets every rank, one counting scan gives the exact rank of the
    brackets' ends, and the brackets shrink until few enough rows are left to sort.  Only
    the key columns are read and nothing is shuffled but those last rows.
    """
    keys = df.select(key.alias("k"))
    if sample_rows is None:
        sample_rows = min(max(math.isqrt(total), SAMPLE_ROWS[0]), SAMPLE_ROWS[1])
    literal = key_literals(df, key)
    # open brackets: rank -> (low, high, rows below low, rows inside)
    state: dict[int, tuple] = {r: (None, None, 0, total) for r in ranks if 0 <= r < total}
    found: dict[int, tuple] = {}
    spread = 4.0
    while state:
        small = {r: b for r, b in state.items() if b[3] <= bracket_rows}
        if small:
            found.update(_sorted_lookup(keys, literal, small))
            state = {r: b for r, b in state.items() if r not in small}
            continue
        rows = max(b[3] for b in state.values())
        drawn = keys.filter(_in_any(literal, state)).sample(min(1.0, sample_rows / rows), seed=len(found) + 1)
        columns = drawn.limit(8 * sample_rows).select("k.*").toArrow().columns
        sample = sorted(zip(*[c.to_pylist() for c in columns]), key=nulls_first)
        places = [nulls_first(s) for s in sample]
        guesses = {r: _bracket(sample, places, b, r, spread) for r, b in state.items()}
        aggregates = []
        for i, (lo, hi) in enumerate(guesses.values()):
            aggregates.append((F.count_if(F.col("k") < literal(lo)) if lo is not None else F.lit(0)).alias(f"a{i}"))
            aggregates.append((F.count_if(F.col("k") <= literal(hi)) if hi is not None else F.lit(total)).alias(f"b{i}"))
        seen = keys.agg(F.count(F.lit(1)).alias("n"), *aggregates).first()
        smaller = False
        for i, (r, (lo, hi)) in enumerate(guesses.items()):
            below, upto = seen[f"a{i}"], seen[f"b{i}"]
            if below <= r < upto and upto - below < state[r][3]:
                smaller = True
                state[r] = (lo, hi, below, upto - below)
                if lo is not None and lo == hi:
                    found[r] = lo
        state = {r: b for r, b in state.items() if r not in found}
        spread = 4.0 if smaller else spread * 2
        if spread > 4096:
            raise ValueError("the order does not identify rows: one key value fills the bracket")
    return found


def nulls_first(key: Sequence) -> tuple:
    return tuple((v is not None, v) if v is not None else (False,) for v in key)


def _inside(literal: Callable, bracket: tuple) -> Column:
    lo, hi = bracket[0], bracket[1]
    above = F.lit(True) if lo is None else F.col("k") >= literal(lo)
    return above if hi is None else above & (F.col("k") <= literal(hi))


def _in_any(literal: Callable, state: Mapping[int, tuple]) -> Column:
    test = F.lit(False)
    for bracket in state.values():
        test = test | _inside(literal, bracket)
    return test


def _bracket(sample: list, places: list, bracket: tuple, rank: int, spread: float) -> tuple:
    """Sample values a few standard deviations around the rank's place, inside the old bracket."""
    lo, hi, below, rows = bracket
    first = 0 if lo is None else bisect_left(places, nulls_first(lo))
    last = len(sample) if hi is None else bisect_left(places, nulls_first(hi))
    size = max(1, last - first)
    place = first + (rank - below) / rows * size
    margin = spread * math.sqrt(size) / 2 + 1
    at_lo, at_hi = math.floor(place - margin), math.ceil(place + margin)
    new_lo = sample[at_lo] if first <= at_lo < last else lo
    new_hi = sample[at_hi] if first <= at_hi < last else hi
    return new_lo, new_hi


def _sorted_lookup(keys: DataFrame, literal: Callable, brackets: Mapping[int, tuple]) -> dict[int, tuple]:
    """Ranks inside brackets of at most BRACKET_ROWS rows each."""
    order = list(brackets)
    slots = F.filter(
        F.array(*[F.when(_inside(literal, brackets[r]), F.lit(i)) for i, r in enumerate(order)]), lambda s: s.isNotNull()
    )
    rows = keys.filter(_in_any(literal, brackets)).select("k", F.explode(slots).alias("slot"))
    ranked = rows.withColumn("at", F.row_number().over(Window.partitionBy("slot").orderBy("k")) - 1)
    wanted = F.lit(False)
    for i, r in enumerate(order):
        wanted = wanted | ((F.col("slot") == i) & (F.col("at") == r - brackets[r][2]))
    return {order[row["slot"]]: tuple(row["k"]) for row in ranked.filter(wanted).collect()}

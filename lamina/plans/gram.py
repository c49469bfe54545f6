"""Correlations of many columns with gaps, from sums of products of column blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Columns of a block; what two blocks have in common is four squares of that many columns.
BLOCK_COLUMNS = 64
# A worker hands on its sums when they take about this many bytes; so many of them meet in the first round.
HELD_BYTES = 64 << 20
SALTS = 32
# A variance below this share of the mean square is rounding.
CONSTANT = 1e-13

SCHEMA = "i int, j int, sums binary"


def _cells(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Values, zero where missing, and presence."""
    flat = batch.column(0).flatten()
    there = np.asarray(flat.is_valid()).reshape(batch.num_rows, -1)
    return np.asarray(flat.fill_null(0.0), dtype=float).reshape(batch.num_rows, -1), there


def _added(frame: DataFrame, parts: Callable[[pa.RecordBatch], Iterator[tuple[int, int, np.ndarray]]]) -> DataFrame:
    """Sums of the arrays that ``parts`` gives by ``(i, j)``: in the worker, then by salted key, then by key."""

    def add(given):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[tuple[int, int], np.ndarray] = {}
            size = 0

            def handed():
                for (i, j), sums in held.items():
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([i], pa.int32()), pa.array([j], pa.int32()), pa.array([sums.tobytes()], pa.binary())], ["i", "j", "sums"]
                    )

            for batch in batches:
                if not batch.num_rows:
                    continue
                for i, j, sums in given(batch):
                    if (i, j) in held:
                        held[i, j] += sums
                    else:
                        held[i, j] = sums.copy()
                        size += sums.nbytes
                if size > HELD_BYTES:
                    yield from handed()
                    held, size = {}, 0
            yield from handed()

        return run

    def unpacked(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray]]:
        for i, j, sums in zip(*(c.to_pylist() for c in batch.columns)):
            yield i, j, np.frombuffer(sums)

    first = frame.mapInArrow(add(parts), SCHEMA)
    salted = first.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    second = salted.repartition("i", "j", "_salt").drop("_salt").mapInArrow(add(unpacked), SCHEMA)
    return second.repartition("i", "j").mapInArrow(add(unpacked), SCHEMA)


def _means(cells: DataFrame, n: int) -> np.ndarray:
    """Mean of each column, 0 of one without values."""
    def parts(batch):
        values, there = _cells(batch)
        yield 0, 0, np.concatenate([values.sum(axis=0), there.sum(axis=0)]).astype(float)

    total = np.zeros(2 * n)
    for row in _added(cells, parts).collect():
        total += np.frombuffer(row["sums"])
    return total[:n] / np.maximum(total[n:], 1)


def pairwise_correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(x, y, r)`` of all ordered pairs of columns, each over the rows that have both values.

    Values are taken from the columns' means, so that sums of squares keep their digits.  For blocks I and J
    of columns a worker adds up X'X, X'M, M'X, (X^2)'M, M'(X^2) and M'M of its Arrow batches, X being
    values and M presence; the sums are added in two rounds.
    """
    n = len(columns)
    spark = df.sparkSession
    if not n:
        return spark.createDataFrame([], "x string, y string, r double")
    cells = df.select(F.array(*[F.col(c).cast("double") for c in columns]).alias("v"))
    means = _means(cells, n)
    blocks = [slice(b, min(b + BLOCK_COLUMNS, n)) for b in range(0, n, BLOCK_COLUMNS)]

    def parts(batch):
        values, there = _cells(batch)
        present = there.astype(float)
        values = (values - means) * present
        squares = values * values
        for i, a in enumerate(blocks):
            for j, b in enumerate(blocks[i:], i):
                yield i, j, np.concatenate([
                    (left.T @ right).ravel() for left, right in (
                        (values[:, a], values[:, b]), (values[:, a], present[:, b]), (present[:, a], values[:, b]),
                        (squares[:, a], present[:, b]), (present[:, a], squares[:, b]), (present[:, a], present[:, b]),
                    )
                ])

    names = list(columns)

    def correlations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, sums in zip(*(c.to_pylist() for c in batch.columns)):
                x, y = names[blocks[i]], names[blocks[j]]
                xy, sx, sy, qx, qy, count = np.frombuffer(sums).reshape(6, len(x), len(y))
                with np.errstate(divide="ignore", invalid="ignore"):
                    spreads = [np.where(q / count - (s / count) ** 2 > CONSTANT * q / count, q / count - (s / count) ** 2, 0.0) for q, s in ((qx, sx), (qy, sy))]
                    r = (xy / count - sx / count * sy / count) / np.sqrt(spreads[0] * spreads[1])
                r = np.where((spreads[0] > 0) & (spreads[1] > 0), r, np.nan)
                if i == j:
                    own = np.diag_indices(len(x))
                    r[own] = np.where(np.isnan(r[own]), np.nan, 1.0)
                first, second, flat = np.repeat(x, len(y)).tolist(), np.tile(y, len(x)).tolist(), r.ravel()
                if i != j:
                    first, second, flat = first + second, second + first, np.concatenate([flat, flat])
                yield pa.RecordBatch.from_arrays([pa.array(first, pa.string()), pa.array(second, pa.string()), pa.array(flat)], ["x", "y", "r"])

    found = _added(cells, parts).mapInArrow(correlations, "x string, y string, r double")
    # a table without rows has no block
    if len(means) and df.isEmpty():
        return spark.createDataFrame([(x, y, float("nan")) for x in names for y in names], "x string, y string, r double")
    return found

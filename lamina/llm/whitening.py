"""Whitened principal components of vectors: blockwise QR, Householder bidiagonal form, dqds, twisted factorisations.

No covariance matrix is formed: the triangle R of the centred rows has their singular values, found
from its bidiagonal form by the shifted quotient-difference algorithm to high relative accuracy; a
twisted factorisation at each value gives the direction.  Spark reduces the rows to R in a
tree; what reaches the driver is R, a square of the vector length, however many rows there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.text import col
from lamina.session import materialise

# How an entry becomes a whole number.
SCALE, SHIFT = 1024, 100_000
# Whole numbers beyond this are taken as this, so that sums of a batch fit a long.
LARGEST = 2.0**48
COMPONENTS = 8
FAN_IN = 32
# Values closer than this share of themselves are one cluster, whose directions are made orthogonal.
NEAR = 1e-3
EPS = np.finfo(float).eps


def bidiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, superdiagonal and right factor ``V`` of a square matrix ``U B V'`` by Householder reflections."""
    work = matrix.astype(float).copy()
    d = len(work)
    right = np.eye(d)

    def reflector(x):
        """Unit ``v`` such that ``x - 2 v v'x`` has only a first entry; None if that is so already."""
        v = x.copy()
        size = np.linalg.norm(v)
        if not np.any(v[1:]):
            return None
        v[0] += np.copysign(size, v[0])
        return v / np.linalg.norm(v)

    for k in range(d):
        v = reflector(work[k:, k])
        if v is not None:
            work[k:, k:] -= 2 * np.outer(v, v @ work[k:, k:])
        if k + 2 < d:
            v = reflector(work[k, k + 1:])
            if v is not None:
                work[k:, k + 1:] -= 2 * np.outer(work[k:, k + 1:] @ v, v)
                right[:, k + 1:] -= 2 * np.outer(right[:, k + 1:] @ v, v)
    return np.diag(work).copy(), np.diag(work, 1).copy(), right


def _transform(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], list[float]] | None:
    """One dqds step: the new ``q`` and ``e`` and the values ``d`` on the way; None if the shift was too large."""
    d, new_q, new_e, seen = q[0] - shift, [], [], []
    for k in range(len(e)):
        if d < 0:
            return None
        seen.append(d)
        total = d + e[k]
        ratio = q[k + 1] / total if total else 0.0
        new_q.append(total)
        new_e.append(e[k] * ratio)
        d = d * ratio - shift
    if d < 0:
        return None
    return new_q + [d], new_e, seen + [d]


def singular_squares(diagonal: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Squares of the singular values of an upper bidiagonal matrix, falling.

    Shifts are Newton's lower bound, the inverse of the sum of the inverse ``d`` of a step without shift; so a
    step with it never makes a value negative but by rounding, and is then repeated without shift.
    """
    top = max([0.0, *np.abs(diagonal), *np.abs(above)])
    if not top:
        return np.zeros(len(diagonal))
    found = []
    blocks = [([float(x) ** 2 for x in diagonal / top], [float(x) ** 2 for x in above / top], 0.0)]
    tiny = EPS * EPS
    while blocks:
        q, e, base = blocks.pop()
        while q:
            split = next((k for k in range(len(e) - 1, -1, -1) if e[k] <= tiny * max(base + q[k], base + q[k + 1]) or e[k] < 1e-290), None)
            if len(q) == 1 or split == len(q) - 2:
                found.append(q.pop() + base)
                e = e[:-1]
                continue
            if split is not None:
                blocks.append((q[:split + 1], e[:split], base))
                q, e = q[split + 1:], e[split + 1:]
                continue
            plain = _transform(q, e, 0.0)
            low = min(plain[2])
            bound = 1 / sum(1 / d for d in plain[2]) if low > 1e-290 else 0.0
            shifted = _transform(q, e, bound) if bound > EPS * base else None
            if shifted is None:
                q, e = plain[0], plain[1]
            else:
                q, e, base = shifted[0], shifted[1], base + bound
            # the smallest values come to the end; a block that is graded the other way is turned round
            if q[-1] > 1.5 * q[0]:
                q, e = _turned(q, e)
    return np.sort(np.maximum(found, 0.0))[::-1] * top * top


def _turned(q: list[float], e: list[float]) -> tuple[list[float], list[float]]:
    """The same matrix with rows and columns in the opposite order, in qd form again."""
    q, e = q[::-1], e[::-1]
    # B B' of the flipped matrix is B'B of the first: one step without shift restores the form
    d, new_q, new_e = q[0], [], []
    for k in range(len(e)):
        total = d + e[k]
        ratio = q[k + 1] / total if total else 0.0
        new_q.append(total)
        new_e.append(e[k] * ratio)
        d *= ratio
    return new_q + [d], new_e


def twisted(diagonal: np.ndarray, above: np.ndarray, value: float, against: list[np.ndarray]) -> np.ndarray:
    """Unit eigenvector of ``B'B`` at an eigenvalue, orthogonal to those ``against`` it.

    The stationary and the progressive factorisation of ``B'B - value`` are joined where their twist
    has the least pivot; in a cluster the next one is taken until the direction is new.
    """
    n = len(diagonal)
    small = EPS * EPS * max(1e-290, float(np.max(diagonal**2, initial=0)), value)
    squares = np.where(diagonal == 0, np.sqrt(small), diagonal) ** 2
    lower = above / np.where(diagonal == 0, np.sqrt(small), diagonal)[:-1]

    def safe(x):
        return x if abs(x) > small else small

    down, up, s, p = np.zeros(n - 1), np.zeros(n - 1), np.zeros(n), np.zeros(n)
    s[0] = -value
    for k in range(n - 1):
        pivot = safe(s[k] + squares[k])
        down[k] = squares[k] * lower[k] / pivot
        s[k + 1] = down[k] * lower[k] * s[k] - value
    p[n - 1] = squares[n - 1] - value
    for k in range(n - 2, -1, -1):
        pivot = safe(squares[k] * lower[k] ** 2 + p[k + 1])
        ratio = squares[k] / pivot
        up[k] = lower[k] * ratio
        p[k] = p[k + 1] * ratio - value
    gamma = np.abs(s + p + value)
    best, length = None, 0.0
    for twist in np.argsort(gamma, kind="stable"):
        z = np.zeros(n)
        z[twist] = 1.0
        for k in range(twist - 1, -1, -1):
            z[k] = -down[k] * z[k + 1]
        for k in range(twist, n - 1):
            z[k + 1] = -up[k] * z[k]
        z /= np.linalg.norm(z)
        for _ in range(2):
            for other in against:
                z -= (z @ other) * other
        if np.linalg.norm(z) > length:
            best, length = z, np.linalg.norm(z)
        if length > 0.5 or not against:
            break
    return best / length


def principal(triangle: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Falling squares of all singular values, and the right directions of the first ``most``, as columns."""
    diagonal, above, right = bidiagonal(triangle)
    values = singular_squares(diagonal, above)
    vectors: list[np.ndarray] = []
    for k in range(min(most, len(values))):
        cluster = k
        while cluster and values[cluster - 1] - values[cluster] <= NEAR * values[cluster - 1]:
            cluster -= 1
        vectors.append(twisted(diagonal, above, float(values[k]), vectors[cluster:k]))
    return values, right @ np.array(vectors).T if vectors else np.zeros((len(values), 0))


def _matrix(column: pa.Array, dimension: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.int64).reshape(-1, dimension)


def _whole(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``(id, x)``: usable vectors as whole numbers."""
    entry = F.transform(col(vector_col), lambda c: c.cast("double"))
    finite = F.forall("v", lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False)))
    kept = vectors.select(col(id_col).alias("id"), entry.alias("v")).where(F.col("v").isNotNull() & finite)
    # guarded, as the filter may be evaluated later
    whole = F.transform("v", lambda c: F.floor(F.least(F.greatest(c * SCALE, F.lit(-LARGEST)), F.lit(LARGEST))) + SHIFT)
    return kept.select("id", F.when(finite, whole).alias("x"))


def _block_qr(rows: DataFrame, dimension: int, n: int, sums: np.ndarray) -> np.ndarray:
    """The triangle of the centred rows, from triangles of blocks combined in a tree."""

    def packed(triangle: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        if triangle is not None:
            yield pa.RecordBatch.from_arrays([pa.array([triangle.tobytes()], pa.binary())], ["r"])

    def joined(triangle: np.ndarray | None, block: np.ndarray) -> np.ndarray:
        return np.linalg.qr(block if triangle is None else np.concatenate([triangle, block]), mode="r")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        triangle = None
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("x"), dimension)
                triangle = joined(triangle, x - sums // n - (sums % n) / n)
        yield from packed(triangle)

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        triangle = None
        for batch in batches:
            for r in batch.column("r").to_pylist():
                triangle = joined(triangle, np.frombuffer(r).reshape(-1, dimension))
        yield from packed(triangle)

    triangles = materialise(rows.mapInArrow(blocks, "r binary"), "triangles")
    parts = triangles.count()
    while parts > 1:
        parts = -(-parts // FAN_IN)
        triangles = triangles.repartition(parts).mapInArrow(combine, "r binary")
    found = [np.frombuffer(r["r"]).reshape(-1, dimension) for r in triangles.collect()]
    triangle = np.zeros((dimension, dimension))
    if found:
        triangle[:len(found[0])] = found[0]
    return triangle


def whiten(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS,
) -> DataFrame:
    """``(id, component, n, deviation, whitened, explained, identity_error)`` per usable row and component.

    Rows go whose vector is null, empty or holds null or non-finite entries, and those whose length isn't the
    commonest one (of equally common ones the largest).  An entry ``c`` becomes ``floor(1024 c) + 100000``,
    at most 2^48 of it above or below.  ``n`` rows are left, with exact sums S; ``deviation`` is the exact sum of
    ``(n x - S)^2``, and an error where no long holds it.  ``whitened`` is the centred row along a component
    over the root of its eigenvalue (divisor n), ``explained`` the eigenvalue's share of the trace.  Components are numbered
    from 1 by falling eigenvalue; those of no variance to working precision are left out, so
    vectors that are all alike give no rows, and neither does an empty table.  Repeated rows and ids and rows without an id count and come back
    like others.  ``identity_error`` is the largest absolute entry of the covariance of all whitened rows less the identity.
    """
    rows = _whole(vectors, id_col, vector_col).where(F.size("x") > 0)
    lengths = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    schema = f"id {vectors.schema[id_col].dataType.simpleString()}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    if not lengths:
        return vectors.sparkSession.createDataFrame([], schema)
    dimension, n = lengths[0]
    rows = rows.where(F.size("x") == dimension)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = _matrix(batch.column("x"), dimension).sum(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(range(dimension), pa.int32()), pa.array(sums)], ["k", "s"])

    totals = rows.select("x").mapInArrow(add, "k int, s bigint").groupBy("k").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    sums = np.zeros(dimension, np.int64)
    for r in totals.collect():
        sums[r["k"]] = int(r["s"])
    values, directions = principal(_block_qr(rows.select("x"), dimension, n, sums), components)
    # a value below rounding has no direction to scale
    count = int((values[:components] > values[0] * EPS * dimension).sum()) if values[0] > 0 else 0
    if not count:
        return vectors.sparkSession.createDataFrame([], schema)
    scale = directions[:, :count] / np.sqrt(values[:count] / n)
    explained = values[:count] / values.sum()

    def projected(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        x = _matrix(batch.column("x"), dimension)
        return x, (x - sums // n - (sums % n) / n) @ scale

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, w = projected(batch)
            entries = np.concatenate([(w.T @ w).ravel(), w.sum(axis=0)])
            yield pa.RecordBatch.from_arrays([pa.array(range(len(entries)), pa.int32()), pa.array(entries)], ["k", "s"])

    gram = np.zeros(count * count + count)
    for r in rows.select("x").mapInArrow(products, "k int, s double").groupBy("k").agg(F.sum("s").alias("s")).collect():
        gram[r["k"]] = r["s"]
    mean = gram[count * count:] / n
    covariance = gram[:count * count].reshape(count, count) / n - np.outer(mean, mean)
    error = float(np.abs(covariance - np.eye(count)).max())

    def deviations(x: np.ndarray) -> np.ndarray:
        # in plain integers where a long might not hold a step
        bound = max(float(np.abs(x).max()) * n, float(np.abs(sums).max())) * 2
        if bound < 2.0**62 and (reach := float(np.abs(centred := x * n - sums).max())) * reach * dimension < 2.0**62:
            return (centred * centred).sum(axis=1)
        whole = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums)) for row in x]
        return np.array(whole, dtype=np.int64)

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, w = projected(batch)
            repeat = np.repeat(np.arange(len(x)), count)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id").take(pa.array(repeat)),
                    pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(len(repeat), n, np.int64)),
                    pa.array(deviations(x)[repeat]),
                    pa.array(w.ravel()),
                    pa.array(np.tile(explained, len(x))),
                    pa.array(np.full(len(repeat), error)),
                ],
                ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(report, schema)

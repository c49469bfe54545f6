"""Exact k-nearest-neighbour join by pivot cells.

Donors are assigned to the nearest of a few pivots.  For a query, the donors of its own cell or
the triangle inequality give a radius that surely holds k donors, and only other cells that reach
into that radius are visited (Lu et al., "Efficient processing of k nearest neighbor joins
using MapReduce", 2012).  No pair is ever emitted: cells that lie together make a part, a query comes once to each
part that it visits, with a bit for each cell, and gets the k best donors of the part.  Donors of a part are held as one
matrix of bounded size, queries stream past it.  Equal vectors are collapsed beforehand and large cells are cut
into several parts, as queries of a part are, so no task depends on how the data are spread.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.plans.lookup import lookup_join
from lamina.session import materialise

# Expected pivots over all spaces; they and the cell sizes are what the driver and the tasks hold in memory.
TOTAL_PIVOTS = 50_000
BLOCK_ROWS = 8192
# Donors of a part, the bytes of their vectors, and rows of queries that one task takes to a part.
PART_ROWS = 1 << 16
PART_BYTES = 32 << 20
QUERY_ROWS = 1 << 16
_CELLS_IN_MEMORY = 1_000_000
# A tile of donors; where queries visit more than this share of a part's cells, all pairs are compared.
_TILE_ROWS = 4096
_DENSE = 0.25
# Up to so many dimensions distances are summed for all pairs at once.
PLAIN_DIMENSIONS = 4
# So many spaces are named in a filter; with more all queries are routed again.
LISTED_SPACES = 1000


def nearest(
    queries: DataFrame, donors: DataFrame, k: int,
    max_pivots: int | None = None, block_rows: int = BLOCK_ROWS, visited: list | None = None,
) -> DataFrame:
    """Add ``near``: the k nearest donors as ``array<struct<d2, id, value>>``, nearest first.

    ``queries`` has ``space string, vec array<double>`` and any other columns; ``donors`` has
    ``space, vec, id bigint, value double``.  Only donors of the same space are seen; a query whose space has none
    has a null ``near``.  ``d2`` is the squared Euclidean distance and equal distances are ordered by ``id``.

    Two passes: the nearest donors of a query's own cell say how far the others can be, then
    the other cells that reach so close are visited.  A list given as ``visited`` gets the number of
    donors that lay in the cells visited, a number per pass.
    """
    keyed = queries.withColumn("_key", _vector_key())
    asked = materialise(keyed.groupBy("_key", "space", "vec").agg(F.count(F.lit(1)).alias("_n")), "asked")
    # Equal vectors can never contribute more than the k smallest ids.
    same = Window.partitionBy("_key", "space", "vec").orderBy("id")
    named = donors.withColumn("_key", _vector_key())
    given = (
        named.withColumn("_rank", F.row_number().over(same))
        .filter(F.col("_rank") <= k)
        .groupBy("_key", "space", "vec")
        .agg(F.min("id").alias("first_id"), F.collect_list(F.struct("id", "value")).alias("holders"))
    )
    pivots = _choose_pivots(named, max_pivots, block_rows)
    placed = materialise(_placed(given, pivots), "placed")
    cells = {
        (r["space"], r["cell"]): (r["n"], r["reach"])
        for r in placed.groupBy("space", "cell").agg(F.count(F.lit(1)).alias("n"), F.max("reach").alias("reach")).collect()
    }
    parts = _parts(pivots, cells)
    sample = asked.select("_key", "space", "vec", F.lit(None).cast("double").alias("bound"))
    best = _visit(_routed(sample, pivots, cells, parts, k, True), placed, parts, k, block_rows, visited)
    # spaces of one cell are done
    several = [space for space, where in pivots.items() if sum((space, c) in cells for c in range(len(where))) > 1]
    if several:
        best = materialise(_top(best, k), "first")
        bounds = best.groupBy("_key").agg(F.when(F.count(F.lit(1)) >= k, F.max("d2")).alias("bound"))
        wanted = asked.where(F.col("space").isin(several)) if len(several) <= LISTED_SPACES else asked
        again = wanted.select("_key", "space", "vec").join(bounds, "_key", "left")
        best = best.unionByName(_visit(_routed(again, pivots, cells, parts, k, False), placed, parts, k, block_rows, visited))
    answers = (
        _top(best, k)
        .groupBy("_key")
        .agg(F.array_sort(F.collect_list(F.struct("d2", "id", "value"))).alias("near"))
        .join(asked.select("_key", "_n"), "_key")
    )
    return lookup_join(keyed, materialise(answers, "answers"), "_key", "_n").drop("_key")


def _top(best: DataFrame, k: int) -> DataFrame:
    """The k nearest of every query."""
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("_key").orderBy("d2", "id")))
    return ranked.filter(F.col("rank") <= k).drop("rank")


def _together(points: np.ndarray) -> list[int]:
    """The points in an order that keeps near ones together: halves along the widest dimension, and so on."""
    order, stack = [], [np.arange(len(points))]
    while stack:
        some = stack.pop()
        if len(some) < 3:
            order.extend(some.tolist())
            continue
        widest = np.ptp(points[some], axis=0).argmax()
        some = some[points[some, widest].argsort(kind="stable")]
        stack += [some[len(some) // 2:], some[:len(some) // 2]]
    return order


def _parts(pivots: dict[str, np.ndarray], cells: dict) -> dict[str, list[tuple[list[int], int]]]:
    """The parts of each space: their cells, and how many parts share these, which is more than one for a large cell."""
    found: dict[str, list[tuple[list[int], int]]] = {}
    for space, where in pivots.items():
        most = max(1, min(PART_ROWS, PART_BYTES // 8 // max(1, where.shape[1])))
        parts, now, rows = [], [], 0
        for cell in _together(where):
            n = cells.get((space, cell), (0, 0.0))[0]
            if n == 0:
                continue
            if now and rows + n > most:
                parts.append((now, 1))
                now, rows = [], 0
            if n > most:
                parts.append(([cell], math.ceil(n / most)))
            else:
                now, rows = [*now, cell], rows + n
        if now:
            parts.append((now, 1))
        found[space] = parts
    return found


def _visit(routes: DataFrame, placed: DataFrame, parts: dict, k: int, block_rows: int, visited: list | None) -> DataFrame:
    """``(_key, d2, id, value)``: the k nearest donors of each query in every part it visits."""
    routed = materialise(routes, "routed")
    spark = routed.sparkSession
    visits = {(r["space"], r["part"]): (r["n"], r["donors"]) for r in routed.groupBy("space", "part").agg(
        F.count(F.lit(1)).alias("n"), F.sum("donors").alias("donors")
    ).collect()}
    if visited is not None:
        visited.append(sum(donors for _, donors in visits.values()))
    share = math.ceil(sum(n for n, _ in visits.values()) / (3 * spark.sparkContext.defaultParallelism))
    rows = max(block_rows, min(QUERY_ROWS, share))
    # One row per part, and per cell: bounded by TOTAL_PIVOTS.
    splits = spark.createDataFrame(
        [(space, part, math.ceil(n / rows), parts[space][part][1]) for (space, part), (n, _) in visits.items()],
        "space string, part int, query_parts int, donor_parts int",
    )
    where = spark.createDataFrame(
        [(space, cell, part, bit) for space, listed in parts.items() for part, (own, _) in enumerate(listed) if (space, part) in visits
         for bit, cell in enumerate(own)],
        "space string, cell int, part int, bit int",
    )
    block = ["space", "part", "query_part", "donor_part"]
    nothing = F.lit(None)
    asked = (
        routed.join(F.broadcast(splits), ["space", "part"])
        .withColumn("query_part", F.pmod(F.xxhash64("_key"), F.col("query_parts")).cast("int"))
        .withColumn("donor_part", F.explode(F.sequence(F.lit(0), F.col("donor_parts") - 1)))
        .select(*block, F.lit(1).alias("side"), "_key", "vec", "bound", "cells", F.lit(0).alias("bit"), nothing.cast("bigint").alias("first_id"),
                nothing.cast("array<struct<id:bigint,value:double>>").alias("holders"))
    )
    given = (
        placed.join(F.broadcast(where), ["space", "cell"])
        .join(F.broadcast(splits), ["space", "part"])
        .withColumn("donor_part", F.pmod(F.xxhash64("_key"), F.col("donor_parts")).cast("int"))
        .withColumn("query_part", F.explode(F.sequence(F.lit(0), F.col("query_parts") - 1)))
        .select(*block, F.lit(0).alias("side"), nothing.cast("string").alias("_key"), "vec", nothing.cast("double").alias("bound"),
                nothing.cast("binary").alias("cells"), "bit", "first_id", "holders")
    )
    return (
        given.unionByName(asked)
        .repartition(*block)
        .sortWithinPartitions(*block, "side")
        .mapInArrow(_part_best(k), "_key string, d2 double, holders array<struct<id:bigint,value:double>>")
        .select("_key", "d2", F.explode("holders").alias("holder"))
        .select("_key", "d2", "holder.id", "holder.value")
    )


def mean_value(near: Column) -> Column:
    return F.aggregate(near, F.lit(0.0), lambda acc, n: acc + n["value"], lambda acc: acc / F.size(near))


def weighted_value(near: Column) -> Column:
    """Mean weighted by inverse distance; donors at distance 0 count alone."""
    exact = F.filter(near, lambda n: n["d2"] == 0.0)
    zero = F.struct(F.lit(0.0).alias("value"), F.lit(0.0).alias("weight"))

    def add(acc: Column, n: Column) -> Column:
        weight = F.lit(1.0) / F.sqrt(n["d2"])
        return F.struct((acc["value"] + n["value"] * weight).alias("value"), (acc["weight"] + weight).alias("weight"))

    inverse = F.aggregate(near, zero, add, lambda acc: acc["value"] / acc["weight"])
    return F.when(F.size(exact) > 0, mean_value(exact)).otherwise(inverse)


def _vector_key():
    # The text of a double identifies it; its 128-bit hash names the vector, which stays beside it in every group.
    return F.md5(F.concat_ws("|", F.col("space"), F.concat_ws(",", F.col("vec").cast("array<string>"))))


def _choose_pivots(donors: DataFrame, max_pivots: int | None, block_rows: int) -> dict[str, np.ndarray]:
    """About the square root of the donors per space, drawn by a hash of the row; equal vectors count once.

    Every row decides for itself, by the size of its space.  A space whose donors fit one block has the origin alone, and
    so has one whose draw is empty, as any point will do.
    """
    sizes = donors.groupBy("space").agg(F.count(F.lit(1)).alias("n"), F.first(F.size("vec")).alias("dims")).collect()
    most = max(1, min(max_pivots or TOTAL_PIVOTS, TOTAL_PIVOTS // max(1, len(sizes))))
    shares = [(r["space"], min(1.0, min(most, math.ceil(math.sqrt(r["n"]))) / r["n"])) for r in sizes]
    if all(r["n"] <= block_rows and max_pivots is None for r in sizes):
        return {r["space"]: np.zeros((1, r["dims"])) for r in sizes}
    shares = [(space, 0.0 if n <= block_rows and max_pivots is None else rate) for (space, rate), n in zip(shares, (r["n"] for r in sizes))]
    rates = F.broadcast(donors.sparkSession.createDataFrame(shares, "space string, rate double"))
    place = F.pmod(F.xxhash64("_key", "id"), F.lit(1 << 30)) / float(1 << 30)
    rows = donors.join(rates, "space").filter(place < F.col("rate")).select("space", "vec").collect()
    grouped: dict[str, set] = {r["space"]: set() for r in sizes}
    for r in rows:
        grouped[r["space"]].add(tuple(r["vec"]))
    origin = {r["space"]: (0.0,) * r["dims"] for r in sizes}
    return {space: np.array(sorted(vecs) or [origin[space]], dtype=float) for space, vecs in grouped.items()}


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances, summed dimension by dimension in order."""
    total, diff = np.zeros((len(a), len(b))), np.empty((len(a), len(b)))
    for d in range(a.shape[1]):
        np.subtract(a[:, d, None], b[None, :, d], out=diff)
        np.multiply(diff, diff, out=diff)
        total += diff
    return total


def _placed(given: DataFrame, pivots: dict[str, np.ndarray]) -> DataFrame:
    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for space, every in batch.groupby("space", sort=False):
                step = max(1, _CELLS_IN_MEMORY // len(pivots[space]))
                for begin in range(0, len(every), step):
                    rows = every.iloc[begin:begin + step]
                    distance = np.sqrt(_squared(np.vstack(rows["vec"].to_numpy()), pivots[space]))
                    cell = distance.argmin(axis=1)
                    yield rows.assign(cell=cell.astype("int32"), reach=distance[np.arange(len(cell)), cell])

    schema = "_key string, space string, vec array<double>, first_id bigint, " \
        "holders array<struct<id:bigint,value:double>>, cell int, reach double"
    return given.select("_key", "space", "vec", "first_id", "holders").mapInPandas(place, schema)


def _routed(asked: DataFrame, pivots: dict[str, np.ndarray], cells: dict, parts: dict, k: int, own: bool) -> DataFrame:
    """Each query in the part of its own cell, the one with the nearest pivot; or in the parts of other cells that may hold one of its k nearest donors.

    ``bound`` is the squared distance within which k donors were seen.  No donor of a cell is nearer than the pivot less
    the cell's reach, nor than the plane between the cell's pivot and the query's nearest one.  ``cells`` has a bit for each
    cell of the part, ``donors`` is the number of donors in those visited.
    """
    counts = {s: np.array([cells.get((s, c), (0, 0.0))[0] for c in range(len(p))]) for s, p in pivots.items()}
    reaches = {s: np.array([cells.get((s, c), (0, 0.0))[1] for c in range(len(p))]) for s, p in pivots.items()}

    def visits(space: str, vectors: np.ndarray, bound: np.ndarray) -> np.ndarray:
        count, reach = counts[space], reaches[space]
        squares = _squared(vectors, pivots[space])
        distance = np.sqrt(squares)
        home = np.where(count > 0, distance, np.inf).argmin(axis=1)
        rows = np.arange(len(home))
        if own:
            visit = np.zeros(distance.shape, bool)
            visit[rows, home] = True
            return visit & (count > 0)
        # without k donors seen: walk the farthest possible donors of cells until k are sure
        farthest = np.where(count > 0, distance + reach, np.inf)
        order = farthest.argsort(axis=1)
        sure = np.cumsum(count[order], axis=1) >= k
        walked = np.take_along_axis(farthest, order, axis=1)
        radius = np.where(sure.any(axis=1), walked[rows, sure.argmax(axis=1)], np.inf)
        radius = np.fmin(radius, np.sqrt(bound))
        # A little slack for rounding only adds cells.
        radius = radius + 1e-9 * (1.0 + np.where(np.isinf(radius), 0.0, radius))
        nearest_pivot = distance.argmin(axis=1)
        which, place = np.unique(nearest_pivot, return_inverse=True)
        apart = np.sqrt(_squared(pivots[space][which], pivots[space]))[place]
        gap = squares - squares[rows, nearest_pivot][:, None]
        with np.errstate(divide="ignore", invalid="ignore"):
            plane = np.where(apart > 0, gap / (2 * apart), 0.0)
        # what is no number rules nothing out
        visit = (count > 0) & ~(distance - reach > radius[:, None]) & ~(plane > radius[:, None])
        visit[rows, home] = False
        return visit

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            spaces = batch.column(1).dictionary_encode()
            for at, space in enumerate(spaces.dictionary.to_pylist()):
                if space not in pivots:
                    continue
                mine = np.flatnonzero(np.asarray(spaces.indices.fill_null(-1)) == at)
                step = max(1, _CELLS_IN_MEMORY // len(pivots[space]))
                for begin in range(0, len(mine), step):
                    rows = batch.take(pa.array(mine[begin:begin + step]))
                    visit = visits(space, _matrix(rows.column(2)), _numbers(rows.column(3)))
                    for part, (members, _) in enumerate(parts[space]):
                        inside = visit[:, members]
                        row = np.flatnonzero(inside.any(axis=1))
                        if not len(row):
                            continue
                        inside, hit = inside[row], rows.take(pa.array(row))
                        bits = np.packbits(inside, axis=1)
                        ends = np.arange(len(row) + 1, dtype=np.int32) * bits.shape[1]
                        yield pa.RecordBatch.from_arrays(
                            [*hit.columns, pa.array(np.full(len(row), part, np.int32)),
                             pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(bits))]),
                             pa.array(inside.astype(np.int64) @ counts[space][members].astype(np.int64))],
                            ["_key", "space", "vec", "bound", "part", "cells", "donors"],
                        )

    return asked.select("_key", "space", "vec", "bound").mapInArrow(
        route, "_key string, space string, vec array<double>, bound double, part int, cells binary, donors bigint"
    )


def _numbers(cells: pa.Array) -> np.ndarray:
    """A column of numbers, NaN for null."""
    return np.asarray(cells.cast(pa.float64()).fill_null(float("nan")))


def _matrix(vectors: pa.Array) -> np.ndarray:
    """The vectors of a batch, all of one length; NaN for null."""
    return _numbers(vectors.flatten()).reshape(len(vectors), -1)


def _all_pairs(asked: np.ndarray, given: np.ndarray) -> Callable[[slice, slice, np.ndarray, int], tuple[np.ndarray, np.ndarray]]:
    """A function that gives the pairs of some rows and columns among which are all within a row's squared ``limit``, or the ``keep`` nearest.

    Products give distances up to rounding; they are single numbers where these can hold the vectors, with as much slack.
    """
    finite = given[np.isfinite(given).all(axis=1)]
    centre = finite.mean(axis=0) if len(finite) else np.zeros(given.shape[1])
    a, b = asked - centre, given - centre
    aa, bb = np.einsum("ij,ij->i", a, a), np.einsum("ij,ij->i", b, b)
    top = max(np.nanmax(aa, initial=0.0), np.nanmax(bb, initial=0.0))
    kind = np.float32 if top < 1e30 else np.float64
    # of the products, and of the difference to the centre
    error = 4 * np.finfo(kind).eps * (asked.shape[1] + 16)
    lost = 64 * np.finfo(float).eps * asked.shape[1] * (aa + np.nanmax(bb, initial=0.0) + np.square(centre).sum())
    left = np.hstack([-2 * a, np.ones((len(a), 1))]).astype(kind)
    right = np.hstack([b, bb[:, None]]).astype(kind)

    def pairs(rows: slice, columns: slice, limit: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
        rough = left[rows] @ right[columns].T
        slack = error * (aa[rows] + np.nanmax(bb[columns], initial=0.0)) + lost[rows] + 1e-30
        worst = limit - aa[rows] + slack
        free = np.flatnonzero(~(limit < np.inf))
        if len(free):
            at = min(keep, rough.shape[1]) - 1
            worst[free] = np.partition(rough[free], at, axis=1)[:, at] + 2 * slack[free]
        if kind is np.float32:
            worst = np.nextafter(worst.astype(kind), np.float32(np.inf))
        row, col = np.nonzero(~(rough > worst[:, None].astype(kind)))
        return row + rows.start, col + columns.start

    return pairs


def _exact(asked: np.ndarray, given: np.ndarray, row: np.ndarray, col: np.ndarray) -> np.ndarray:
    """Squared distances of pairs, summed dimension by dimension in order."""
    total = np.zeros(len(row))
    for d in range(asked.shape[1]):
        total += np.square(asked[row, d] - given[col, d])
    return total


def _near_in_part(
    asked: np.ndarray, limit: np.ndarray, visit: np.ndarray, given: np.ndarray, cell: np.ndarray, first_id: np.ndarray, k: int,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, donor and squared distance of the k nearest donors of each query in the cells it visits, or of those within its limit.

    Donors are in the order of their cells, ``cell`` has where each begins, and the end.
    """
    limit = limit.copy()
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]

    def taken(row: np.ndarray, col: np.ndarray, d2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        within = ~(d2 > limit[row]) & (np.isfinite(d2) | ~(limit[row] < np.inf))
        row, col, d2 = row[within], col[within], d2[within]
        order = np.lexsort((first_id[col], d2, row))
        row, col, d2 = row[order], col[order], d2[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        near = place < k
        # with k donors none beyond the last of them counts any more
        full = place == k - 1
        limit[row[full]] = np.fmin(limit[row[full]], d2[full])
        return row[near], col[near], d2[near]

    if asked.shape[1] > PLAIN_DIMENSIONS and visit.mean() > _DENSE and (limit < np.inf).all():
        of = np.repeat(np.arange(len(cell) - 1), np.diff(cell))
        pairs = _all_pairs(asked, given)
        step = max(1, _CELLS_IN_MEMORY // min(_TILE_ROWS, len(given)))
        for low in range(0, len(asked), step):
            rows, seen = slice(low, min(len(asked), low + step)), found[0]
            for begin in range(0, len(given), _TILE_ROWS):
                row, col = pairs(rows, slice(begin, min(len(given), begin + _TILE_ROWS)), limit[rows], k)
                there = visit[row, of[col]]
                row, col = row[there], col[there]
                fresh = (row, col, _exact(asked, given, row, col))
                seen = taken(*(np.concatenate(both) for both in zip(seen, fresh)))
            found.append(seen)
    else:
        for c in np.flatnonzero(visit.any(axis=0)):
            some, begin, end = np.flatnonzero(visit[:, c]), cell[c], cell[c + 1]
            # tiles, so that a large cell is no large matrix
            for start in range(begin, end, _TILE_ROWS * 4):
                tile = given[start:min(end, start + _TILE_ROWS * 4)]
                keep, step = min(k, len(tile)), max(1, _CELLS_IN_MEMORY // len(tile))
                pairs = _all_pairs(asked[some], tile) if asked.shape[1] > PLAIN_DIMENSIONS else None
                for low in range(0, len(some), step):
                    rows = slice(low, min(len(some), low + step))
                    if pairs:
                        row, col = pairs(rows, slice(0, len(tile)), limit[some[rows]], keep)
                        d2 = _exact(asked, tile, some[row], col)
                    else:
                        all_d2 = _squared(asked[some[rows]], tile)
                        worst = np.partition(all_d2, keep - 1, axis=1)[:, keep - 1]
                        row, col = np.nonzero(~(all_d2 > worst[:, None]))
                        d2, row = all_d2[row, col], row + low
                    found.append(taken(some[row], col + start, d2))
    return taken(*(np.concatenate(part) for part in zip(*found)))


def _part_best(k: int):
    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, donors = None, [], None
        for batch in batches:
            at = 0
            # runs of one block and side
            marks = np.stack([np.asarray(batch.column(c)) for c in range(1, 5)], axis=1)
            spaces = batch.column(0).to_pylist()
            change = np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1) | np.array([x != y for x, y in zip(spaces[1:], spaces[:-1])], bool)) + 1
            for end in [*change.tolist(), batch.num_rows]:
                run, name = batch.slice(at, end - at), (spaces[at], *marks[at, :3]) if end > at else None
                side, at = marks[at, 3] if end > at else 0, end
                if not run.num_rows:
                    continue
                if name != block:
                    block, held, donors = name, [], None
                if side == 0:
                    held.append((_matrix(run.column(6)), np.asarray(run.column(9)), np.asarray(run.column(10)), run.column(11)))
                    continue
                if donors is None and held:
                    bits, first_id = (np.concatenate([h[c] for h in held]) for c in (1, 2))
                    order = np.lexsort((first_id, bits))
                    holders = pa.chunked_array([h[3] for h in held]).combine_chunks().take(pa.array(order))
                    given = np.concatenate([h[0] for h in held])[order]
                    donors, held = (given, bits[order], first_id[order], holders), []
                if donors is None:
                    continue
                given, bits, first_id, holders = donors
                packed = run.column(8)
                width = len(packed[0].as_py())
                visit = np.unpackbits(np.frombuffer(b"".join(packed.to_pylist()), np.uint8).reshape(-1, width), axis=1).astype(bool)
                bound = _numbers(run.column(7))
                row, col, d2 = _near_in_part(
                    _matrix(run.column(6)), np.where(np.isnan(bound), np.inf, bound), visit, given,
                    np.searchsorted(bits, np.arange(width * 8 + 1)), first_id, k,
                )
                for begin in range(0, len(row), 1 << 14):
                    some = slice(begin, begin + (1 << 14))
                    yield pa.RecordBatch.from_arrays(
                        [run.column(5).take(pa.array(row[some])), pa.array(d2[some]), holders.take(pa.array(col[some]))], ["_key", "d2", "holders"]
                    )

    return best

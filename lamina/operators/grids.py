"""Tree models as tables over the cells that their thresholds cut the features into.

A tree sees of a value only on which side of each threshold it lies, so a row is a code per feature: the number of
thresholds below its value.  Trees whose thresholds cut few cells share one table with the sum of their predictions,
and a prediction is one look-up; trees with more cells are walked node by node.  Both are exact for any row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from typing import Any, NamedTuple

import numpy as np

# Cells of one table, and of all tables of a model.
GRID_CELLS = 1 << 16
MODEL_CELLS = 1 << 20


class Walk(NamedTuple):
    """One tree by node: a row goes left if its code is at most ``place``; a leaf leads to itself."""

    feature: np.ndarray
    place: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    root: int

    def __call__(self, codes: np.ndarray) -> np.ndarray:
        at, rows = np.full(len(codes), self.root), np.arange(len(codes))
        while True:
            below = np.where(codes[rows, self.feature[at]] <= self.place[at], self.left[at], self.right[at])
            if np.array_equal(below, at):
                return self.value[at]
            at = below


class Table(NamedTuple):
    """Trees with few cells: what a code of each of their features adds to a cell's number, and the cells' values."""

    numbers: tuple[int, ...]
    features: tuple[int, ...]
    steps: tuple[np.ndarray, ...]
    cells: np.ndarray
    values: np.ndarray

    def places(self, codes: np.ndarray) -> np.ndarray:
        """The number of each row's cell."""
        place = np.zeros(len(codes), np.int32)
        for f, step in zip(self.features, self.steps):
            place += step[codes[:, f]]
        return place


class Grids(NamedTuple):
    """A model: the thresholds of each feature, the tables, and the trees that are walked."""

    thresholds: tuple[np.ndarray, ...]
    tables: tuple[Table, ...]
    walks: tuple[Walk, ...]
    walked: tuple[int, ...]

    @property
    def kind(self) -> np.dtype:
        return np.min_scalar_type(max((len(t) for t in self.thresholds), default=0))

    def codes(self, rows: np.ndarray) -> np.ndarray:
        """The code of each cell of ``rows``; a value that is no number is above all thresholds, as in the model."""
        out = np.empty(rows.shape, self.kind)
        for f, thresholds in enumerate(self.thresholds):
            out[:, f] = np.searchsorted(thresholds, rows[:, f], "left")
        return out

    def predictions(self, codes: np.ndarray) -> np.ndarray:
        total = np.zeros(len(codes))
        for table in self.tables:
            total += table.values[table.places(codes)]
        for walk in self.walks:
            total += walk(codes)
        return total

    def along(self, own: np.ndarray, other: np.ndarray, order: np.ndarray) -> np.ndarray:
        """Predictions of ``other`` with ever more features taken from ``own``, in the order given; one more than features."""
        n, p = other.shape
        total = np.zeros((n, p + 1))
        for table in self.tables:
            change = np.zeros((n, p), np.int32)
            start = np.zeros(n, np.int32)
            for f, step in zip(table.features, table.steps):
                low = step[other[:, f]]
                start += low
                np.subtract(step[own[:, f]], low, out=change[:, f])
            place = np.empty((n, p + 1), np.int32)
            place[:, 0] = start
            place[:, 1:] = np.take_along_axis(change, order, axis=1)
            total += table.values[np.cumsum(place, axis=1, out=place)]
        if self.walks:
            mixed, rows = other.copy(), np.arange(n)
            for s in range(p + 1):
                if s:
                    mixed[rows, order[:, s - 1]] = own[rows, order[:, s - 1]]
                for walk in self.walks:
                    total[:, s] += walk(mixed)
        return total

    def second_differences(
        self, own: np.ndarray, other: np.ndarray, pairs: Sequence[tuple[int, int]], takes: Callable[[int, int], np.ndarray]
    ) -> Iterator[np.ndarray]:
        """For each pair of features the prediction with both from ``own``, less those with one, plus that with none.

        All other features are from ``own`` where ``takes(i, j)``, a mask of rows and features, says so.
        """
        places = []
        for table in self.tables:
            steps = dict(zip(table.features, table.steps))
            places.append((table, {f: (step[own[:, f]], step[other[:, f]]) for f, step in steps.items()}))
        for i, j in pairs:
            take, total = takes(i, j), np.zeros(len(own))
            for table, numbers in places:
                # without both features all four predictions of these trees are in pairs
                if i not in numbers or j not in numbers:
                    continue
                rest = np.zeros(len(own), np.int32)
                for f, (mine, theirs) in numbers.items():
                    if f not in (i, j):
                        rest += np.where(take[:, f], mine, theirs)
                (a, c), (b, d) = numbers[i], numbers[j]
                total += table.values[rest + a + b] - table.values[rest + a + d] - table.values[rest + c + b] + table.values[rest + c + d]
            if self.walks:
                mixed = np.where(take, own, other)
                for of_i, of_j, sign in ((own, own, 1.0), (own, other, -1.0), (other, own, -1.0), (other, other, 1.0)):
                    mixed[:, i], mixed[:, j] = of_i[:, i], of_j[:, j]
                    total += sign * sum(walk(mixed) for walk in self.walks)
            yield total


def cell_rows(grids: Grids, table: Table) -> np.ndarray:
    """A row in each cell of a table."""
    rows = np.zeros(table.cells.shape)
    for f in table.features:
        thresholds = grids.thresholds[f]
        rows[:, f] = np.concatenate([thresholds[:1], np.nextafter(thresholds, np.inf)])[table.cells[:, f]]
    return rows


def _walk(rows: Sequence[Mapping[str, Any]], thresholds: Sequence[np.ndarray]) -> Walk:
    """A tree of node rows; leaf values count with the tree's weight."""
    at = {r["node"]: i for i, r in enumerate(rows)}
    feature, place, left, right = (np.zeros(len(rows), np.int64) for _ in range(4))
    value, inner = np.zeros(len(rows)), set()
    for i, r in enumerate(rows):
        if r["feature"] is None:
            left[i] = right[i] = i
            value[i] = r["weight"] * r["value"]
            continue
        feature[i], left[i], right[i] = r["feature"], at[r["left"]], at[r["right"]]
        place[i] = np.searchsorted(thresholds[r["feature"]], r["threshold"])
        inner |= {at[r["left"]], at[r["right"]]}
    return Walk(feature, place, left, right, value, next(i for i in range(len(rows)) if i not in inner))


def _cuts(walk: Walk) -> dict[int, set[int]]:
    """The thresholds that a tree compares with, by feature."""
    found: dict[int, set[int]] = {}
    for i in np.flatnonzero(walk.left != np.arange(len(walk.left))):
        found.setdefault(int(walk.feature[i]), set()).add(int(walk.place[i]))
    return found


def _size(cuts: Mapping[int, set[int]]) -> int:
    size = 1
    for places in cuts.values():
        size *= len(places) + 1
    return size


def _table(numbers: Sequence[int], walks: Sequence[Walk], cuts: Mapping[int, set[int]], thresholds: Sequence[np.ndarray], dtype: np.dtype) -> Table:
    features = sorted(cuts)
    cells = np.zeros((_size(cuts), len(thresholds)), dtype)
    stride, steps = 1, []
    for f in features:
        own = np.array(sorted(cuts[f]))
        local = np.searchsorted(own, np.arange(len(thresholds[f]) + 1), "left")
        steps.append((local * stride).astype(np.int32))
        # one code for each side of the own thresholds
        codes = np.concatenate([[0], own + 1])
        cells[:, f] = codes[np.arange(len(cells)) // stride % len(codes)]
        stride *= len(codes)
    return Table(tuple(numbers), tuple(features), tuple(steps), cells, sum(walk(cells) for walk in walks))


def model_grids(nodes: Iterable[Mapping[str, Any]], n_features: int, grid_cells: int = GRID_CELLS, model_cells: int = MODEL_CELLS) -> Grids:
    """A model from its node table; as large as the model, or ``model_cells``, whatever the data."""
    trees: dict[int, list] = {}
    found: list[set[float]] = [set() for _ in range(n_features)]
    for r in nodes:
        trees.setdefault(r["tree"], []).append(r)
        if r["feature"] is not None:
            if r["categorical"]:
                raise ValueError("splits on categories have no thresholds")
            found[r["feature"]].add(r["threshold"])
    thresholds = tuple(np.array(sorted(f)) for f in found)
    dtype = Grids(thresholds, (), (), ()).kind
    tables, walks, walked, left = [], [], [], model_cells
    group: tuple[list, list, dict] = ([], [], {})

    def close() -> None:
        nonlocal left
        numbers, members, cuts = group
        if not members:
            return
        if _size(cuts) > min(grid_cells, left):
            walks.extend(members)
            walked.extend(numbers)
            return
        left -= _size(cuts)
        tables.append(_table(numbers, members, cuts, thresholds, dtype))

    for number, rows in sorted(trees.items()):
        walk = _walk(rows, thresholds)
        cuts = _cuts(walk)
        both = {f: group[2].get(f, set()) | cuts.get(f, set()) for f in {*group[2], *cuts}}
        if group[1] and _size(both) > min(grid_cells, left):
            close()
            group, both = ([], [], {}), cuts
        group = ([*group[0], number], [*group[1], walk], both)
    close()
    return Grids(thresholds, tuple(tables), tuple(walks), tuple(walked))

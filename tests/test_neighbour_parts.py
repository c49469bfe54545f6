"""Parts of cells in the neighbour join: a query is sent once to each part, whatever the cells it visits there."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamina.plans import neighbours


def frames(spark, points, spaces=1):
    rows = [(str(i % spaces), p.tolist(), i, float(i)) for i, p in enumerate(points)]
    return spark.createDataFrame(rows, "space string, vec array<double>, id bigint, value double").repartition(3)


@pytest.mark.parametrize("dims, part_rows", [(3, 50), (12, 90), (12, 100_000)])
def test_parts_are_exact_and_queries_come_once(spark, dims, part_rows, monkeypatch):
    # without clusters nearly all cells are visited; a third of the points lies close to one, so that a cell is large
    rng = np.random.default_rng(dims)
    points = rng.random((900, dims))
    points[::3] = points[0] + rng.random((300, dims)) * 1e-3
    monkeypatch.setattr(neighbours, "PART_ROWS", part_rows)
    monkeypatch.setattr(neighbours, "_TILE_ROWS", 64)
    sent = []
    visit = neighbours._visit

    def counted(routes, placed, parts, *args):
        row = routes.groupBy("space").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("_key").alias("keys")).collect()
        sent.extend((r["n"], r["keys"] * len(parts[r["space"]])) for r in row)
        return visit(routes, placed, parts, *args)

    monkeypatch.setattr(neighbours, "_visit", counted)
    d = frames(spark, points, 2)
    got = neighbours.nearest(d.select("id", "space", "vec"), d, 5, max_pivots=30, block_rows=100).collect()
    assert len(got) == 900 and all(n <= most for n, most in sent)
    for r in got:
        mine = np.arange(r["id"] % 2, 900, 2)
        d2 = np.zeros(len(mine))
        for k in range(dims):
            d2 += (points[mine, k] - points[r["id"], k]) ** 2
        assert [n["id"] for n in r["near"]] == mine[np.lexsort((mine, d2))[:5]].tolist()


def test_dense_and_sparse_ways_agree():
    """Limits, cells ruled out, ties and vectors without numbers, against all pairs."""
    rng = np.random.default_rng(5)
    given = rng.integers(0, 3, (500, 6)).astype(float)
    given[7, 2] = np.nan
    asked = given[::9].copy()
    cell, first_id = np.array([0, 120, 300, 500]), np.arange(500)
    for bounded in (False, True):
        every = np.zeros((len(asked), 500))
        for k in range(6):
            every += (asked[:, k, None] - given[None, :, k]) ** 2
        limit = np.sort(every, axis=1)[:, 40] if bounded else np.full(len(asked), np.inf)
        for share in (1.0, 0.5, 0.1):
            visit = np.zeros((len(asked), 8), bool)
            visit[:, :3] = rng.random((len(asked), 3)) < share
            row, col, d2 = neighbours._near_in_part(asked, limit, visit, given, np.concatenate([cell, np.full(5, 500)]), first_id, 4)
            for q in range(len(asked)):
                near = [d for d in np.lexsort((first_id, every[q])) if visit[q, np.searchsorted(cell, d, "right") - 1]]
                near = [d for d in near if not bounded or every[q, d] <= limit[q]][:4]
                assert col[row == q].tolist() == near
                assert d2[row == q].tolist() == pytest.approx(every[q, near].tolist(), nan_ok=True)

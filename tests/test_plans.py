"""Building blocks against brute force, also beyond the sizes where they change their way."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamina.functions.hashing import key_hash
from lamina.plans import neighbours
from lamina.plans.cuts import hash_cuts
from lamina.plans.lookup import lookup_join
from lamina.plans.modes import column_modes, group_modes
from lamina.plans.order_stats import exact_percentiles
from lamina.plans.ranks import keys_at_ranks, order_key
from lamina.plans.row_index import with_row_index


def test_row_index_with_hot_leading_key(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50).alias("a"), (F.col("id") * 7919 % 5000).alias("b"))
    indexed, total = with_row_index(df, ["a", "b"])
    rows = sorted(tuple(r) for r in indexed.select("row_index", "a", "b").collect())
    assert total == 5000 and [r[0] for r in rows] == list(range(5000))
    assert [r[1:] for r in rows] == sorted(r[1:] for r in rows)


@pytest.mark.parametrize("bucket_rows", [50_000, 20, 1])
def test_hash_cut_is_exact(spark, bucket_rows):
    df = spark.range(3000)
    key = F.col("id").cast("string")
    hashes = {s: key_hash(s, key) for s in range(2)}
    cuts, total = hash_cuts(df, hashes, key, lambda n: 901, bucket_rows)
    assert total == 3000
    for s, cut in cuts.items():
        chosen = {r["id"] for r in df.filter(cut).collect()}
        ranked = sorted((r["h"], str(r["id"]), r["id"]) for r in df.select("id", hashes[s].alias("h")).collect())
        assert chosen == {r[2] for r in ranked[:901]}


def test_hash_cut_ends(spark):
    df = spark.range(10)
    key = F.col("id").cast("string")
    for size, expected in ((0, 0), (10, 10), (1, 1)):
        cut = hash_cuts(df, {0: key_hash(1, key)}, key, lambda n: size)[0][0]
        assert df.filter(cut).count() == expected


@pytest.mark.parametrize("buffer", [10**6, 40])
def test_percentiles(spark, buffer):
    rng = random.Random(5)
    a = [rng.gauss(0, 100) for _ in range(2000)]
    b = [3.0 if i % 3 == 0 else float(rng.randint(0, 5)) for i in range(2000)]
    df = spark.createDataFrame([(x, y, None) for x, y in zip(a, b)], "a double, b double, c double")
    shares = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = exact_percentiles(df, ["a", "b", "c"], shares, buffer)
    for name, values in (("a", a), ("b", b)):
        assert np.allclose(got[name], np.percentile(values, [s * 100 for s in shares]), rtol=1e-12)
    assert got["c"] == [None] * 5


@pytest.mark.parametrize("few,bits", [(10**6, 16), (0, 16), (0, 5), (3, 11)])
def test_percentiles_of_odd_values(spark, few, bits):
    odd = [0.0, -0.0, 5e-324, -5e-324, 1e308, -1e308, float("inf"), float("-inf"), 1.0, 1.0, math.nextafter(1.0, 2), -1.0, 7.25]
    df = spark.createDataFrame([(v, None if v > 0 else v) for v in odd], "a double, b double").repartition(3)
    ranks = sorted(odd)
    got = exact_percentiles(df, ["a", "b"], [k / 12 for k in range(13)], few, bits)
    for k, value in enumerate(got["a"]):
        position = 12 * (k / 12)
        low, high = ranks[math.floor(position)], ranks[math.ceil(position)]
        assert value == (low if low == high else low + (high - low) * (position - math.floor(position)))
    assert got["b"][0] == float("-inf") and got["b"][-1] == 0.0
    nan = spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "a double")
    assert exact_percentiles(nan, ["a"], [0.0], few, bits) == {"a": [1.0]}
    assert math.isnan(exact_percentiles(nan, ["a"], [1.0], few, bits)["a"][0])
    assert exact_percentiles(nan.limit(0), ["a"], [0.5, 1.0], few, bits) == {"a": [None, None]}


def test_percentiles_of_many_columns_take_few_jobs(spark):
    rng = np.random.default_rng(6)
    values = rng.normal(size=(300, 400)) * 10.0 ** rng.integers(-5, 6, 400)
    names = [f"c{k}" for k in range(400)]
    df = spark.createDataFrame([r.tolist() for r in values], ", ".join(f"{n} double" for n in names)).persist()
    df.count()
    tracker = spark.sparkContext.statusTracker()
    counts = []
    for width in (4, 400):
        group = f"percentiles{width}"
        spark.sparkContext.setJobGroup(group, group)
        got = exact_percentiles(df, names[:width], [0.25, 0.5, 0.75], few_values=0)
        counts.append(len(tracker.getJobIdsForGroup(group)))
        assert all(np.allclose(got[n], np.percentile(values[:, k], [25, 50, 75]), rtol=1e-12) for k, n in enumerate(names[:width]))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    df.unpersist()
    # a scan with a window over its counts is a handful of stages, each a job under adaptive execution
    assert counts[1] == counts[0] <= 20


@pytest.mark.parametrize("sample,bracket", [(10**5, 10**5), (200, 50)])
def test_keys_at_ranks(spark, sample, bracket):
    rows = [(i % 5 if i % 3 else None, f"k{i:05d}") for i in range(4000)]
    df = spark.createDataFrame(rows, "a int, b string").repartition(8)
    expected = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    ranks = [0, 1, 1333, 2000, 3999]
    got = keys_at_ranks(df, order_key(df, ["a", "b"]), ranks, 4000, sample, bracket)
    assert got == {r: expected[r] for r in ranks}


def test_modes(spark):
    rows = [("h", None if i % 4 else 5.0, i % 2) for i in range(300)] + [("e", None, 3), ("t", 2.0, 9), ("t", 1.0, 8)]
    df = spark.createDataFrame(rows, "k string, v double, w int")
    got = {r["k"]: (r["v"], r["w"]) for r in group_modes(df, ["k"], ["v", "w"]).collect()}
    assert got == {"h": (5.0, 0), "e": (None, 3), "t": (1.0, 8)}
    assert column_modes(df, ["v", "w"]) == {"v": 5.0, "w": 0}


@pytest.mark.parametrize("limit", [100_000, 10])
def test_lookup_with_hot_and_null_keys(spark, limit):
    df = spark.range(3000).select("id", F.when(F.col("id") % 11 == 0, None).when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 700)).alias("key"))
    counts = df.filter("key is not null").groupBy("key").count().filter("key <> 'k1'")
    table = counts.select("key", F.concat(F.lit("v"), "key").alias("value"), F.col("count").alias("n"))
    got = {r["id"]: (r["key"], r["value"]) for r in lookup_join(df, table, "key", "n", broadcast_rows=limit).collect()}
    assert len(got) == 3000
    for key, value in got.values():
        assert value == (None if key in (None, "k1") else "v" + key)


@pytest.mark.parametrize("seed,block,pivots", [(0, 8192, 1024), (1, 16, 1024), (2, 5, 3)])
def test_nearest_with_duplicates_and_ties(spark, seed, block, pivots):
    rng = random.Random(seed)
    # a lattice with a third of the donors on one point: many equal distances
    points = [(0.0, 0.0) if rng.random() < 0.33 else (float(rng.randint(-3, 3)), float(rng.randint(-3, 3))) for _ in range(300)]
    donors = [(str(i % 2), list(p), i, float(i)) for i, p in enumerate(points)]
    asked = [(str(i % 3), list(p), i) for i, p in enumerate(points[:150])]
    q = spark.createDataFrame(asked, "space string, vec array<double>, qid int")
    d = spark.createDataFrame(donors, "space string, vec array<double>, id bigint, value double")
    got = neighbours.nearest(q, d, 6, max_pivots=pivots, block_rows=block).collect()
    assert len(got) == 150
    for r in got:
        mine = [(sum((a - b) ** 2 for a, b in zip(r["vec"], v)), i) for s, v, i, _ in donors if s == r["space"]]
        near = r["near"] or []
        assert [(n["d2"], n["id"]) for n in near] == sorted(mine)[:6]


def test_nearest_with_few_donors(spark):
    q = spark.createDataFrame([("0", [1.0], 1)], "space string, vec array<double>, qid int")
    d = spark.createDataFrame([("0", [2.0], 5, 1.0), ("0", [4.0], 6, 2.0)], "space string, vec array<double>, id bigint, value double")
    near = neighbours.nearest(q, d, 5).first()["near"]
    assert [(n["id"], math.sqrt(n["d2"])) for n in near] == [(5, 1.0), (6, 3.0)]


@pytest.mark.parametrize("dims", [2, 16])
def test_neighbours_of_clustered_points_visit_few_donors(spark, dims):
    rng = np.random.default_rng(dims)
    centres = rng.normal(size=(60, dims)) * 100
    points = centres[rng.integers(60, size=3000)] + rng.normal(size=(3000, dims))
    asked = centres[rng.integers(60, size=150)] + rng.normal(size=(150, dims))
    d = spark.createDataFrame([("s", v.tolist(), i, float(i)) for i, v in enumerate(points)], "space string, vec array<double>, id bigint, value double")
    q = spark.createDataFrame([(i, "s", v.tolist()) for i, v in enumerate(asked)], "row int, space string, vec array<double>")
    visited = []
    got = neighbours.nearest(q, d, 4, block_rows=500, visited=visited).collect()
    assert len(visited) == 2 and sum(visited) < 0.05 * len(points) * len(asked)
    for r in got:
        d2 = ((points - asked[r["row"]]) ** 2).sum(axis=1)
        order = np.lexsort((np.arange(len(d2)), d2))[:4]
        assert [n["id"] for n in r["near"]] == order.tolist()


def test_neighbours_far_from_the_origin_are_exact(spark):
    rng = np.random.default_rng(3)
    points = np.round(rng.normal(size=(400, 12)), 1) + 1e7
    rows = [("s", v.tolist(), i, 0.0) for i, v in enumerate(points)]
    d = spark.createDataFrame(rows, "space string, vec array<double>, id bigint, value double")
    for r in neighbours.nearest(d.select("id", "space", "vec"), d, 6).collect():
        d2 = np.zeros(400)
        for k in range(12):
            d2 += (points[:, k] - points[r["id"], k]) ** 2
        assert [n["id"] for n in r["near"]] == np.lexsort((np.arange(400), d2))[:6].tolist()

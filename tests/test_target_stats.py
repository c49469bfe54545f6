import random

import pytest
from pyspark.sql import functions as F

from lamina.functions.hashing import key_hash
from lamina.operators.split import row_key
from lamina.operators.target_stats import apply_target_statistics, ordered_target_statistics


@pytest.mark.parametrize("chunk", [10**6, 50, 3])
def test_like_a_walk_through_the_permutation(spark, chunk):
    rng = random.Random(4)
    rows = [(i, None if i % 11 == 0 else rng.choice(["a", "a", "a", "b", "", "é"]), rng.choice("xy"), float(rng.randint(0, 9))) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, c string, d string, y double").repartition(5)
    encoded, fitted = ordered_target_statistics(df, ["c", "d"], "y", ["id"], weight=2.0, chunk_rows=chunk)
    got = {r["id"]: (r["c"], r["d"], r["y"]) for r in encoded.collect()}
    order = [r["id"] for r in df.withColumn("k", row_key("id")).orderBy(key_hash(42, F.col("k")), "k").collect()]
    by_id = {r[0]: r for r in rows}
    prior = sum(r[3] for r in rows) / len(rows)
    for place in (1, 2):
        sums = {}
        for i in order:
            total, n = sums.get(by_id[i][place], (0.0, 0))
            assert got[i][place - 1] == pytest.approx((total + 2 * prior) / (n + 2))
            sums[by_id[i][place]] = (total + by_id[i][3], n + 1)
        other = spark.createDataFrame([(1, "a", "x"), (2, None, "z"), (3, "new", "y")], "id long, c string, d string")
        for r in apply_target_statistics(other, fitted).collect():
            value = [None, {1: "a", 2: None, 3: "new"}, {1: "x", 2: "z", 3: "y"}][place][r["id"]]
            total, n = sums.get(value, (0.0, 0))
            assert r["cd"[place - 1]] == pytest.approx((total + 2 * prior) / (n + 2))
    assert len(got) == 300 and all(got[i][2] == by_id[i][3] for i in got)


def test_rows_without_a_label(spark):
    df = spark.createDataFrame([(1, "a", None)], "id long, c string, y double")
    with pytest.raises(ValueError):
        ordered_target_statistics(df, ["c"], "y", ["id"])
    encoded, fitted = ordered_target_statistics(df.limit(0), ["c"], "y", ["id"])
    assert encoded.collect() == []
    assert apply_target_statistics(df.drop("y"), fitted).first()["c"] == 0.0


def test_rows_of_equal_keys_are_rows_of_their_own(spark):
    df = spark.createDataFrame([(1, "a", 2.0), (1, "a", 1.0), (1, "a", 1.0), (1, "b", 5.0)], "id long, c string, y double").repartition(3)
    encoded, _ = ordered_target_statistics(df, ["c"], "y", ["id"])
    prior = 9.0 / 4
    expected = [(1.0, prior), (1.0, (1 + prior) / 2), (2.0, (2 + prior) / 3), (5.0, prior)]
    got = sorted((r["y"], r["c"]) for r in encoded.collect())
    assert all(a[0] == b[0] and a[1] == pytest.approx(b[1]) for a, b in zip(got, sorted(expected)))

import random

import pytest
from pyspark.sql import functions as F

from lamina.operators import transform
from lamina.plans import dictionary


def brute_knn(rows, k):
    p = len(rows[0]) - 1
    out = []
    for r in rows:
        filled = list(r)
        for c in range(1, p + 1):
            if r[c] is not None:
                continue
            found = []
            for d in rows:
                shared = [j for j in range(1, p + 1) if r[j] is not None and d[j] is not None]
                if d[c] is not None and shared:
                    found.append((sum((r[j] - d[j]) ** 2 for j in shared) * (p / len(shared)), d[0], d[c]))
            near = sorted(found)[:k]
            present = [d[c] for d in rows if d[c] is not None]
            filled[c] = sum(v for _, _, v in near) / len(near) if near else sum(present) / len(present)
        out.append(tuple(filled))
    return out


def test_impute_knn(spark):
    rng = random.Random(3)
    rows = [(i, *[None if rng.random() < 0.25 else round(rng.gauss(0, 1), 3) for _ in range(3)]) for i in range(80)]
    rows += [(80, None, None, None)]
    df = spark.createDataFrame(rows, "id int, a double, b double, c double")
    got = sorted(tuple(r) for r in transform.impute_knn(df, ["a", "b", "c"], "id").collect())
    for mine, theirs in zip(got, brute_knn(rows, 5)):
        assert mine == pytest.approx(theirs, abs=1e-9)


def test_ordinal(spark, monkeypatch):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("c",), ("b",)], "k string")
    codes = transform.fit_ordinal(df, "k")
    assert [r["k"] for r in transform.apply_ordinal(df, "k", codes).collect()].count(1.0) == 2
    unseen = spark.createDataFrame([("z",), (None,), ("a",)], "k string")
    got = transform.apply_ordinal(unseen, "k", codes, "use_encoded_value", -1).collect()
    assert sorted((r["k"] is None, r["k"]) for r in got if r["k"] is not None) == [(False, -1.0), (False, 0.0)]
    with pytest.raises(Exception, match="unknown category"):
        transform.apply_ordinal(unseen, "k", codes).collect()
    monkeypatch.setattr(transform, "BROADCAST_ROWS", 1)
    by_index = {r["category"]: r["code"] for r in transform.fit_ordinal(df, "k").collect()}
    assert by_index == {"a": 0.0, "b": 1.0, "c": 2.0}


@pytest.mark.parametrize("rows,size", [(10**5, 10**7), (3, 10**7), (0, 0), (10**5, 200)])
def test_one_dictionary_for_all_columns(spark, rows, size):
    values = [("b", 3, True, 1.5), ("a", 20, False, -0.0), (None, None, None, None), ("c", 3, True, 0.0), ("b", 100, None, 20.0), ("", 3, False, 3.0)]
    df = spark.createDataFrame([(i, *v) for i, v in enumerate(values)], "id int, s string, n int, f boolean, x double").repartition(3)
    codes = dictionary.fit_codes(df, ["s", "n", "f", "x"], broadcast_rows=rows)
    got = {r["id"]: tuple(r)[1:] for r in dictionary.apply_codes(df, codes, broadcast_rows=rows, broadcast_bytes=size).collect()}
    for k in range(4):
        order = {v: float(i) for i, v in enumerate(sorted({v[k] for v in values if v[k] is not None}))}
        assert [got[i][k] for i in range(6)] == [None if v[k] is None else order[v[k]] for v in values]
    other = spark.createDataFrame([(1, "z", 3, None, 9.0), (2, None, 4, True, 1.5)], "id int, s string, n int, f boolean, x double")
    known = dictionary.apply_codes(other, codes, "use_encoded_value", -7, rows, size).orderBy("id").collect()
    assert [tuple(r) for r in known] == [(1, -7.0, 0.0, None, -7.0), (2, None, -7.0, 1.0, 1.0)]
    with pytest.raises(Exception, match="unknown category"):
        dictionary.apply_codes(other, codes, broadcast_rows=rows, broadcast_bytes=size).collect()


def test_encoding_takes_as_many_jobs_for_many_columns(spark):
    tracker = spark.sparkContext.statusTracker()
    counts = []
    for width in (2, 200):
        df = spark.range(50).select("id", *[F.concat(F.lit("v"), F.col("id") % (k % 7 + 1)).alias(f"c{k}") for k in range(width)])
        group = f"encode{width}"
        spark.sparkContext.setJobGroup(group, group)
        coded, _ = transform.fit_pipeline(df, categorical=[{"type": "encode", "method": "ordinal"}], exclude=["id"])
        rows = coded.collect()
        wide, _ = transform.fit_pipeline(df, categorical=[{"type": "encode", "method": "onehot"}], exclude=["id"])
        assert len(wide.columns) == 1 + sum(k % 7 + 1 for k in range(width))
        counts.append(len(tracker.getJobIdsForGroup(group)))
        assert all(r[f"c{k}"] == r["id"] % (k % 7 + 1) for r in rows for k in range(width))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert counts[0] == counts[1] <= 20


def test_onehot(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, None)], "id int, k string")
    wide = transform.apply_onehot(df, "k", transform.fit_onehot(df, "k"))
    assert wide.columns == ["id", "k_a", "k_b", "k_null"]
    assert sorted(wide.collect()) == [(1, 0.0, 1.0, 0.0), (2, 1.0, 0.0, 0.0), (3, 0.0, 0.0, 1.0)]
    with pytest.raises(ValueError):
        transform.fit_onehot(df, "k", max_columns=1)
    vectors = transform.onehot_vector(df, "k", transform.fit_ordinal(df, "k")).orderBy("id").collect()
    assert [list(r["k"].toArray()) for r in vectors] == [[0.0, 1.0], [1.0, 0.0], [0.0, 0.0]]


def test_scalers(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (6.0, None)], "a double, b double")
    assert transform.fit_scale(df, ["a", "b"], "minmax") == {"a": (1.0, 5.0), "b": (5.0, 1.0)}
    mean, deviation = transform.fit_scale(df, ["a"])["a"]
    assert (mean, round(deviation, 6)) == (3.0, 2.160247)
    assert transform.fit_scale(df, ["a"], "robust") == {"a": (2.0, 2.5)}
    zero = spark.createDataFrame([(0.0, 0.0), (3.0, 4.0)], "a double, b double")
    assert sorted(transform.normalise_rows(zero, ["a", "b"]).collect()) == [(0.0, 0.0), (0.6, 0.8)]
    assert transform.normalise_rows(zero, ["a", "b"], "max").collect()[1] == (0.75, 1.0)


def test_pipeline(spark):
    df = spark.createDataFrame([("x", 1, 1.0, True), ("y", 2, None, False)], "s string, id int, n double, f boolean").withColumn("t", F.current_timestamp())
    out, fitted = transform.fit_pipeline(
        df, [{"type": "impute", "method": "simple", "strategy": "constant", "fill_value": 0.5}], [{"type": "encode", "method": "onehot"}], exclude=["id"]
    )
    assert out.columns == ["id", "n", "s_x", "s_y", "f_False", "f_True"]
    other = spark.createDataFrame([("q", 3, None, True)], "s string, id int, n double, f boolean")
    assert transform.apply_pipeline(other, fitted, exclude=["id"]).collect() == [(3, 0.5, 0.0, 0.0, 0.0, 1.0)]
    dropped, _ = transform.fit_pipeline(df, (), [{"type": "other", "method": "drop"}], exclude=["id"])
    assert dropped.columns == ["id", "n"]
    same, _ = transform.fit_pipeline(df, exclude=["id"])
    assert same.columns == ["id", "n", "s", "f"]
    with pytest.raises(ValueError):
        transform.fit_pipeline(df, [{"type": "scale", "method": "none"}])


def test_impute_knn_takes_donors_from_the_fitted_rows(spark):
    train = spark.createDataFrame([(i, float(i), float(i)) for i in range(10)], "id int, a double, b double")
    test = spark.createDataFrame([(100, None, 5.0), (101, 1000.0, 5.0)], "id int, a double, b double")
    steps = [{"type": "impute", "method": "knn", "n_neighbors": 1}]
    _, fitted = transform.fit_pipeline(train, steps, exclude=["id"])
    got = {r["id"]: r["a"] for r in transform.apply_pipeline(test, fitted, exclude=["id"]).collect()}
    assert got == {100: 5.0, 101: 1000.0}


def test_impute_knn_over_many_columns(spark):
    names = [f"c{i}" for i in range(70)]
    rows = [(i, *[None if j == i % 3 else float(i) for j in range(70)]) for i in range(12)]
    df = spark.createDataFrame(rows, "id int, " + ", ".join(f"{n} double" for n in names))
    filled = transform.impute_knn(df, names, "id", n_neighbors=2)
    assert filled.filter(" or ".join(f"{n} is null" for n in names)).count() == 0


def test_percentiles_of_decimals(spark):
    df = spark.range(100).selectExpr("cast(id as decimal(10, 2)) as x")
    from lamina.plans.order_stats import exact_percentiles

    assert exact_percentiles(df, ["x"], [0.5]) == exact_percentiles(df, ["x"], [0.5], few_values=5) == {"x": [49.5]}

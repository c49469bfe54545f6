import pytest
from pyspark.sql import functions as F

from lamina.operators import experiment, split


def test_train_test_sizes_and_repeatability(spark):
    df = spark.range(1003).withColumnRenamed("id", "k")
    one = {r["k"] for r in split.train_test_split(df, ["k"], 0.3, 1).filter("split = 'test'").collect()}
    two = {r["k"] for r in split.train_test_split(df.repartition(13), ["k"], 0.3, 1).filter("split = 'test'").collect()}
    other = {r["k"] for r in split.train_test_split(df, ["k"], 0.3, 2).filter("split = 'test'").collect()}
    assert len(one) == 301 and one == two and one != other


def test_shuffle_split(spark):
    out = split.shuffle_split(spark.range(100), ["id"], 4, 7, seed=1).groupBy("split_no", "role").count().collect()
    assert {(r["split_no"], r["role"], r["count"]) for r in out} == {(s, *x) for s in range(4) for x in (("test", 7), ("train", 93))}


@pytest.mark.parametrize("n,k", [(10, 3), (10, 10), (2, 2), (11, 4)])
def test_kfold_blocks(spark, n, k):
    got = [r["fold"] for r in split.kfold(spark.range(n), ["id"], k).orderBy("id").collect()]
    sizes = [n // k + (1 if f < n % k else 0) for f in range(k)]
    assert got == [f for f, s in enumerate(sizes) for _ in range(s)]
    shuffled = [r["fold"] for r in split.kfold(spark.range(n), ["id"], k, shuffle=True, seed=3).collect()]
    assert sorted(shuffled) == got


@pytest.mark.parametrize("edges", [200, 0])
def test_stratified(spark, edges):
    labels = list("bbabcaabbbcabbaab")
    df = spark.createDataFrame(list(enumerate(labels)), "i int, y string")
    got = {r["i"]: r["fold"] for r in split.stratified_kfold(df, "y", ["i"], 3, max_edges=edges).collect()}
    # classes in order of first appearance, positions dealt to folds by turns
    order = sorted(labels, key=["b", "a", "c"].index)
    for c in "abc":
        quota = [sum(1 for p, x in enumerate(order) if x == c and p % 3 == f) for f in range(3)]
        members = [i for i, x in enumerate(labels) if x == c]
        assert [got[i] for i in members] == [f for f in range(3) for _ in range(quota[f])]


def test_time_series(spark):
    rows = split.time_series_split(spark.range(11), ["id"], 3).collect()
    for s in range(3):
        part = {role: sorted(r["id"] for r in rows if r["split_no"] == s and r["role"] == role) for role in ("train", "test")}
        start = 5 + 2 * s
        assert part == {"train": list(range(start)), "test": [start, start + 1]}
    with pytest.raises(ValueError):
        split.time_series_split(spark.range(3), ["id"], 3)


def test_time_order_by_timestamp(spark):
    df = spark.range(40).select("id", (F.lit("2024-03-31 01:30:00").cast("timestamp") + F.make_dt_interval(mins=F.col("id").cast("int") * 7)).alias("ts"))
    for kind in ("timestamp", "timestamp_ntz"):
        typed = df.withColumn("ts", F.col("ts").cast(kind))
        folds = [r["fold"] for r in split.kfold(typed, ["ts", "id"], 4).orderBy("id").collect()]
        assert folds == [i // 10 for i in range(40)]


def test_validation_methods(spark):
    df = spark.range(30).withColumn("label", F.col("id") % 2)
    for method in set(experiment.VALIDATORS) - {"leave_one_out"}:
        folded, role = experiment.assign_folds(df, ["id"], {"method": method, "n_splits": 3, "metrics": ["rmse"]})
        assert {r["fold"] for r in folded.collect()} == {0, 1, 2}
        assert (role == "role") == (method in ("shuffle_split", "time_series_split"))
    alone = experiment.assign_folds(df, ["id"], {"method": "leave_one_out"})[0].groupBy("fold").count().collect()
    assert [r["count"] for r in alone] == [1] * 30
    many = experiment.assign_folds(spark.range(500), ["id"], {"method": "leave_one_out"})[0]
    assert many.select("fold").distinct().count() == 500
    with pytest.raises(ValueError):
        experiment.assign_folds(df, ["id"], {"method": "other"})


def test_head_and_numbers(spark):
    df = spark.range(50).repartition(7)
    assert [r["id"] for r in split.head_rows(df, ["id"], 3).collect()] == [0, 1, 2]
    numbered = split.number_rows(df.filter("id > 9"), ["id"])
    assert all(r["row_id"] == r["id"] - 10 for r in numbered.collect())


def test_keys_do_not_run_into_each_other(spark):
    rows = [("a|b", "c"), ("a", "b|c"), ("a", None), (None, "a"), ("a\\", "|b"), ("a\\|", "b")]
    df = spark.createDataFrame(rows, "x string, y string")
    assert df.select(split.row_key("x", "y")).distinct().count() == len(rows)
    for size in (1, 3):
        assert split.train_test_split(df, ["x", "y"], size).filter("split = 'test'").count() == size


def test_shuffled_folds_by_counted_hashes(spark, monkeypatch):
    """Buckets of hashes, too large buckets, equal keys and nulls give the folds of a plain sort; keys of whole numbers are not searched for marks."""
    df = spark.range(3000).select((F.col("id") % 1500).alias("a"), F.when(F.col("id") % 7 != 0, (F.col("id") % 1500 * 3).cast("int")).alias("b"))
    plain = split.keys_at_ranks
    for rows, general in ((50, False), (1, True)):
        used = []
        monkeypatch.setattr(split, "keys_at_ranks", lambda *a, **k: used.append(a) or plain(*a, **k))
        monkeypatch.setattr(split._hashed_keys, "__defaults__", (rows,))
        got = split.kfold(df, ["a", "b"], 7, shuffle=True, seed=3)
        assert "replace" not in got._jdf.queryExecution().optimizedPlan().toString()
        hashed = df.select("a", "b", split.key_hash(3, split.row_key("a", "b")).alias("h")).collect()
        order = sorted(range(3000), key=lambda i: (hashed[i]["h"], hashed[i]["a"], (hashed[i]["b"] is not None, hashed[i]["b"] or 0)))
        places = {}
        for place, i in enumerate(order):
            places.setdefault((hashed[i]["a"], hashed[i]["b"]), []).append(place)
        base, longer = divmod(3000, 7)
        starts = [f * base + min(f, longer) for f in range(1, 7)]
        for r in got.collect():
            # equal keys lie in one fold, that of the first fold edge at or before the first of them, or beyond it
            assert r["fold"] == sum(places[r["a"], r["b"]][-1] >= s for s in starts)
        assert bool(used) == general

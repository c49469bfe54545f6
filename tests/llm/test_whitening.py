import numpy as np
import pytest

from lamina.llm.queries import QUERIES
from lamina.llm.whitening import principal, whiten

SCHEMA = "vec_id long, embedding array<float>, label int, id string, x int, n string, component string"


def frame(spark, vectors, ids=None):
    ids = range(len(vectors)) if ids is None else ids
    rows = [(i, None if v is None else [None if e is None else float(e) for e in v], 1, "a", 2, "b", "c") for i, v in zip(ids, vectors)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def triangle(matrix):
    d = matrix.shape[1]
    r = np.linalg.qr(matrix, mode="r")
    return np.concatenate([r, np.zeros((d - len(r), d))])


def matrices():
    rng = np.random.default_rng(3)
    base = rng.normal(size=(300, 40))
    turn, left = np.linalg.qr(rng.normal(size=(40, 40)))[0], np.linalg.qr(base)[0]
    return {
        "one": rng.normal(size=(9, 1)), "two": rng.normal(size=(9, 2)), "plain": base,
        "graded": base * np.logspace(0, -7, 40), "graded up": base * np.logspace(-7, 0, 40),
        "alike": np.tile(np.eye(12), (3, 1)), "blocks": np.tile(np.kron(np.eye(6), np.ones((2, 2))), (2, 1)),
        "few rows": rng.normal(size=(5, 20)), "low rank": rng.normal(size=(50, 4)) @ rng.normal(size=(4, 30)),
        "cluster": left @ np.diag(np.r_[5 + 1e-10 * np.arange(10), np.ones(30)]) @ turn, "zero": np.zeros((4, 6)),
    }


@pytest.mark.parametrize("name", matrices())
def test_values_and_directions(name):
    matrix = matrices()[name]
    values, vectors = principal(triangle(matrix), 8)
    d = matrix.shape[1]
    expected = np.zeros(d)
    singular = np.linalg.svd(matrix, compute_uv=False)
    expected[:len(singular)] = singular**2
    top = max(expected[0], 1e-300)
    assert np.abs(values - expected).max() <= 1e-13 * top
    good = values[:vectors.shape[1]] > 1e-13 * top
    vectors, values = vectors[:, good], values[:vectors.shape[1]][good]
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max(initial=0) < 1e-11
    assert np.abs(matrix.T @ (matrix @ vectors) - vectors * values).max(initial=0) < 1e-12 * top


def brute(vectors, most=8):
    x = np.floor(np.array(vectors, dtype=np.float32).astype(float) * 1024).astype(np.int64) + 100_000
    n, sums = len(x), x.sum(axis=0)
    centred = x - sums / n
    values, directions = np.linalg.eigh(centred.T @ centred / n)
    values, directions = values[::-1], directions[:, ::-1]
    count = int((values[:most] > values[0] * 1e-12).sum())
    return ((n * x - sums) ** 2).sum(axis=1), centred @ directions[:, :count] / np.sqrt(values[:count]), values[:count] / values.sum()


def same(found, ids, vectors, most=8):
    deviation, whitened, explained = brute(vectors, most)
    table = found.toPandas().sort_values(["id", "component"])
    got = table.whitened.to_numpy().reshape(len(ids), -1)
    assert got.shape == whitened.shape
    sign = np.sign((got * whitened).sum(axis=0))
    assert np.abs(got * sign - whitened).max() < 1e-8
    assert table.component.tolist() == list(range(1, whitened.shape[1] + 1)) * len(ids)
    assert table.deviation.tolist() == np.repeat(deviation, whitened.shape[1]).tolist()
    assert np.allclose(table.explained.to_numpy().reshape(len(ids), -1), explained, rtol=1e-9)
    assert set(table.n) == {len(ids)} and table.identity_error.nunique() == 1 and table.identity_error.max() < 1e-9


def test_unusable_and_repeated_rows(spark):
    rng = np.random.default_rng(1)
    good = rng.normal(size=(60, 12)).tolist()
    good += good[:3]
    bad = [None, [], [None] * 12, [1.0] * 11 + [float("nan")], [float("inf")] + [0.0] * 11, [-float("inf")] * 12, [1.0, 2.0], [0.0] * 11 + [None]]
    docs = frame(spark, good + bad)
    same(whiten(docs), list(range(63)), good)
    same(whiten(docs, components=3), list(range(63)), good, 3)
    nameless = whiten(frame(spark, good, [None, None, *range(61)]))
    assert nameless.where("id is null").count() == 16


def test_fewer_components_than_asked_for(spark):
    rng = np.random.default_rng(2)
    flat = np.round(rng.normal(size=(20, 2)) * 8) @ np.array([[1, 2, 0, 1], [0, 1, 1, 3]])
    assert whiten(frame(spark, flat.tolist())).select("component").distinct().count() == 2
    assert {r["component"] for r in whiten(frame(spark, rng.normal(size=(30, 3)).tolist())).collect()} == {1, 2, 3}
    assert whiten(frame(spark, [[1.0, 2.0]] * 5)).collect() == []
    assert whiten(frame(spark, [[1.0, 2.0]])).collect() == []


def test_no_rows(spark):
    for empty in (frame(spark, []), frame(spark, [None, [None]])):
        found = whiten(empty)
        assert found.collect() == [] and found.columns[0] == "id"


def test_exact_deviations_of_large_entries(spark):
    found = whiten(frame(spark, [[4e6, 0.0], [0.0, 1.0], [1.0, 3.0]]))
    x = [[4_096_100_000, 100_000], [100_000, 101_024], [101_024, 103_072]]
    sums = [sum(c) for c in zip(*x)]
    exact = [sum((3 * a - s) ** 2 for a, s in zip(row, sums)) for row in x]
    with pytest.raises(Exception):
        found.collect()
    assert max(exact) > 2**63
    fits = whiten(frame(spark, [[4e5, 0.0], [0.0, 1.0], [1.0, 3.0]]))
    x = [[409_700_000, 100_000], *x[1:]]
    sums = [sum(c) for c in zip(*x)]
    exact = [sum((3 * a - s) ** 2 for a, s in zip(row, sums)) for row in x]
    assert {r["id"]: r["deviation"] for r in fits.where("component = 1").collect()} == dict(enumerate(exact))


def test_query(spark):
    directory = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{directory}/embeddings.parquet").orderBy("vec_id").collect()
    same(QUERIES["op12_whitening"](spark, directory).withColumnRenamed("vec_id", "id"), [r["vec_id"] for r in rows], [r["embedding"] for r in rows])

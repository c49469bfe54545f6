"""A small awkward table: nulls, empty and long texts, ties, repeated rows, clashing column names."""

import random

import pytest

LETTERS = "abcdefghij"


def words(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(LETTERS) for _ in range(rng.randint(2, 7))) for _ in range(n))


LONG = words(1, 30_000)
BASE = words(2, 400)
AWKWARD = [
    (1, "", "a"), (2, None, "a"), (3, "   \n\t ", None), (4, "one", "b"), (5, "One TWO", "b"),
    (6, BASE, "a"), (7, BASE, "a"), (8, BASE + " tail", "b"), (9, BASE.upper(), None), (None, BASE, "c"),
    (10, LONG, "c"), (11, "été ñandú Ünder straße 你好 world", "c"), (11, "été ñandú Ünder straße 你好 world", "c"),
    (None, None, None), (12, "x\u0085y z\x1cq", "a"), (13, "a\x00b  c", "a"),
    *[(100 + i, words(50 + i, 20 + i), "abcd"[i % 4]) for i in range(40)],
]
SCHEMA = "doc_id long, text string, source string, id string, fingerprint string, size int, key int, `n.x` string"


@pytest.fixture(scope="session")
def awkward(spark):
    rows = [(i, t, s, "id", "print", 7, 8, "dotted") for i, t, s in AWKWARD]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def rows():
    return AWKWARD

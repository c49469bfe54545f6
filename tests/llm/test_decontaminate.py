import random

from brute import contamination
from hypothesis import given, settings
from hypothesis import strategies as st

from lamina.llm import decontaminate

SCHEMA = "item_id long, text string, id string, hit int"


def items(rows):
    whole = rows[5][1].split()
    return [
        (1, " ".join(whole[10:40])), (2, "one two"), (3, None), (4, "!!"), (5, " ".join(whole[10:40]) + "."), (None, "world"),
        (2, " ".join(rows[10][1].split()[29_000:29_020])), (6, "été NÉ"),
    ]


def test_matches_brute_force(spark, awkward, rows, nothing):
    bench = items(rows)
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in bench], SCHEMA)
    expected = sorted(((i, *contamination(t, bench)) for i, t, _ in rows), key=repr)
    for size in (10, 1 << 22):
        got = decontaminate.contamination(awkward, frame, pass_bytes=size).collect()
        assert sorted(((r["id"], r["n_words"], r["n_hit"], list(r["items"])) for r in got), key=repr) == expected
        assert all(r["contaminated"] == (r["n_hit"] > 0 and 20 * r["n_hit"] >= r["n_words"]) for r in got)
    left = decontaminate.drop_contaminated(awkward, frame)
    assert left.columns == awkward.columns
    ids = {r["doc_id"] for r in left.collect()}
    assert 6 not in ids and 10 in ids and None in ids


def test_empty_tables(spark, awkward, nothing):
    empty = spark.createDataFrame([], SCHEMA)
    assert decontaminate.contamination(nothing, empty).count() == 0
    assert decontaminate.contamination(awkward, empty).where("n_hit > 0").count() == 0


@settings(max_examples=50, deadline=None)
@given(st.integers(0, 10**6))
def test_search_of_random_texts(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["a", "b", "ab", "é", "A1", "zz"])
    text = lambda n: rng.choice([" ", ", ", "\n"]).join(word() for _ in range(n))
    bench = [(str(i), text(rng.choice([0, 1, 2, 13, 15]))) for i in range(5)]
    docs = [text(rng.randint(0, 60)) for _ in range(8)]
    got = list(decontaminate.Search(bench, 4).scan([d.encode() for d in docs]))
    for d, (n, hit, found) in zip(docs, got):
        assert (n, len(hit), sorted(found)) == contamination(d, bench, 4)


def test_benchmark_slices_are_fetched_one_ahead(spark, monkeypatch):
    fetched, made, slices, init = [], [], decontaminate._slices, decontaminate.Search.__init__
    monkeypatch.setattr(decontaminate, "_slices", lambda *a: (fetched.append(part) or part for part in slices(*a)))
    monkeypatch.setattr(decontaminate.Search, "__init__", lambda *a: made.append(len(fetched)) or init(*a))
    bench = spark.createDataFrame([(str(i), f"word{i}") for i in range(4)], "item_id string, text string").coalesce(1)
    docs = spark.createDataFrame([(1, "word0 word3"), (2, "none")], "doc_id long, text string").coalesce(1)
    found = {r["id"]: list(r["items"]) for r in decontaminate.contamination(docs, bench, pass_bytes=1).collect()}
    assert found == {1: ["0", "3"], 2: []} and made == [2, 3, 4, 4]

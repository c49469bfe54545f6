import random
from collections import defaultdict

import pytest
from brute import WORD

from lamina.llm.mix_sources import Flight, mix, source_targets, take_mix


def targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    total, stopped = sum(sizes.values()), set()
    while True:
        rest = total - sum(most * sizes[s] for s in stopped)
        free = sum(weight[s] for s in names if s not in stopped)
        share = {s: most * sizes[s] if s in stopped else rest * weight[s] / free for s in names}
        more = {s for s in names if s not in stopped and share[s] > most * sizes[s]}
        if not more:
            return share
        stopped |= more


def test_targets(spark):
    rng = random.Random(2)
    for trial in range(4):
        sizes = {f"s{i:02d}": rng.choice([0, 5, 100, 10_000]) for i in range(9)} | {None: 50}
        rows = [(s, n) for s, n in sizes.items()]
        got = {r["source"]: r["target"] for r in source_targets(spark.createDataFrame(rows, "source string, size long")).collect()}
        expected = targets(sizes)
        assert all(got[s] == pytest.approx(expected[s], abs=1e-6) for s in sizes), trial


def test_draw_is_near_the_targets_and_repeats(spark):
    rng = random.Random(3)
    docs = [(i, "w " * rng.choice([0, 3, 50, 60, 900]), rng.choice("aaaaab") if i % 7 else None) for i in range(3000)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string")
    first = {r["id"]: r for r in mix(frame, flight_rows=64).collect()}
    again = {r["id"]: r for r in mix(frame.repartition(5), flight_rows=64).collect()}
    assert len(first) == 3000 and all(first[i]["taken"] == again[i]["taken"] for i in first)
    assert all(r["taken"] <= 3 * r["size"] for r in first.values())
    taken, target = defaultdict(int), {}
    for r in first.values():
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert r["times"] in (int(r["target"] / r["source_size"]), int(r["target"] / r["source_size"]) + 1)
    assert all(abs(taken[s] - target[s]) <= 0.01 * target[s] for s in target)
    # documents are balanced like words
    own = [r for r in first.values() if r["source"] == "a"]
    assert abs(sum(r["times"] for r in own) / len(own) - own[0]["target"] / own[0]["source_size"]) < 0.01


def test_flight_keeps_totals():
    rng = random.Random(5)
    sizes = sorted((rng.randint(1, 500) for _ in range(500)), reverse=True)
    flight, done = Flight(1, ("x", 0), reserve=12), []
    for s in sizes:
        done += flight.add(0.3, s, s)
        assert len(flight.units) <= 2 and len(flight.kept) <= 12
    done += flight.land()
    assert len(done) == 500 and {u[0] for u in done} <= {0.0, 1.0}
    assert abs(sum(u[0] * u[1] for u in done) - 0.3 * sum(sizes)) < 5
    assert abs(sum(u[0] for u in done) - 150) <= 1.5


def test_awkward_rows(awkward, nothing, rows):
    got = mix(awkward).collect()
    assert sorted((r["id"], r["size"]) for r in got if r["id"] is not None) == sorted(
        (i, len(WORD.findall(t or ""))) for i, t, _ in rows if i is not None
    )
    assert mix(nothing).count() == 0 and take_mix(nothing).count() == 0
    taken = take_mix(awkward)
    assert taken.columns == awkward.columns
    assert sum(r["doc_id"] is None for r in taken.collect()) in (1, 2)


def test_rows_of_one_id_and_of_none_stay(spark):
    rows = [(1, "a b"), (1, "c d"), (1, "a b"), (2, "e"), (None, "f"), (None, "g"), (None, "f")]
    taken = take_mix(spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, source string")).collect()
    assert sorted(r["text"] for r in taken) == ["a b", "c d", "e", "f", "f", "g"]

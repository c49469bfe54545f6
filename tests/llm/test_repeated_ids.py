"""Rows that share an id and differ in their texts are judged each by its own text."""

import random

import pytest

from lamina.llm.decontaminate import drop_contaminated
from lamina.llm.fuzzy_lines import drop_fuzzy_lines
from lamina.llm.mix_sources import take_mix
from lamina.llm.simhash import drop_near_duplicates
from lamina.llm.toxicity import drop_toxic


def words(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8))) for _ in range(n))


W, V, U = words(1, 60), words(2, 60), words(3, 60)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "s", 1) for r in rows], "doc_id long, text string, source string, id int").repartition(3)


def left(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=repr)


def test_near_duplicates(spark):
    assert left(drop_near_duplicates(frame(spark, [(1, W), (2, W), (2, V)]))) == sorted([(1, W), (2, V)])
    assert left(drop_near_duplicates(frame(spark, [(1, W), (1, V)]))) == sorted([(1, W), (1, V)])
    assert left(drop_near_duplicates(frame(spark, [(1, W), (1, W), (3, U)]))) == sorted([(1, W), (3, U)])
    assert left(drop_near_duplicates(frame(spark, [(None, W), (None, W), (1, W)]))) == sorted([(None, W), (None, W), (1, W)], key=repr)
    assert len(left(drop_near_duplicates(frame(spark, [(4, W), (4, W + " tail")])))) in (1, 2)


def test_contaminated(spark):
    benchmark = spark.createDataFrame([("b", W)], "item_id string, text string")
    rows = [(1, W), (1, V), (2, U), (None, W)]
    assert left(drop_contaminated(frame(spark, rows), benchmark)) == sorted([(1, V), (2, U), (None, W)], key=repr)


def test_lines(spark):
    rows = [(1, f"{W}\nown line of the first {V}"), (2, W), (2, U), (None, W)]
    got = left(drop_fuzzy_lines(frame(spark, rows)))
    assert got == sorted([(1, rows[0][1]), (2, ""), (2, U), (None, W)], key=repr)


@pytest.mark.parametrize("known", [True, False])
def test_toxic(spark, known):
    bad = "you rotten zorkface get lost zorkface"
    rows = [(i, f"{bad} {words(100 + i, 8)}" if i % 2 else words(100 + i, 12)) for i in range(80)]
    rows += [(500, f"{bad} again"), (500, V)]
    labels = spark.createDataFrame([(i, int(i % 2)) for i in range(80)] if known else [], "doc_id long, toxic int")
    got = left(drop_toxic(frame(spark, rows), labels))
    assert (500, V) in got and ((500, f"{bad} again") in got) == (not known)


def test_mix_draws_alike_whether_an_id_repeats(spark):
    rows = [(i, words(i, 20 + i % 9)) for i in range(60)]
    plain = left(take_mix(frame(spark, rows)))
    again = left(take_mix(frame(spark, rows + [(7, rows[7][1])])))
    assert plain == again

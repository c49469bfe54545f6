import random

import pyarrow as pa
import pytest
from brute import distance
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lamina.llm.toxicity import Automaton, Lexicon, drop_toxic, fit, quoted, remainder, score

LABELS = "doc_id long, toxic int, quality int, text string, score double"


@settings(max_examples=80, deadline=None)
@given(
    st.lists(st.text(alphabet="abc", min_size=3, max_size=6), min_size=1, max_size=6, unique=True),
    st.lists(st.text(alphabet="abcd", max_size=8), min_size=1, max_size=20),
)
def test_automaton_finds_one_edit(terms, words):
    automaton = Automaton({t: 1.0 for t in terms}, {}, set(terms))
    for word, state in zip(words, automaton.walk(words).tolist()):
        exact, near = automaton.result(state)
        assert (exact > 0) == (word in terms)
        assert (near is not None) == any(distance(word, t) == 1 or word == t and any(distance(word, u) <= 1 for u in terms) and near for t in terms)


def test_stems_and_whole_words():
    automaton = Automaton({"idiot": 3.0}, {"worth": 2.0}, {"idiot"})
    found = [automaton.result(s) for s in automaton.walk(["worthy", "worthless", "wort", "idiot", "idiots", "x" * 40, ""]).tolist()]
    assert [f[0] for f in found] == [2.0, 2.0, 0.0, 3.0, 0.0, 0.0, 0.0]
    assert found[4][1] == "idiot" and found[5][1] is None


def test_quotation():
    assert quoted([b"she", b"said", b"idiot"], 2)
    assert quoted([b'"you', b"idiot", b'now."'], 1)
    assert not quoted([b"you", b"idiot", b"now"], 1)


def scores(lexicon, texts):
    return lexicon.score(pa.array(texts)).tolist()


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(6)
    plain = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    bad = ["grumbler", "scoundrel", "blockhead"]
    rows, marks = [], []
    for i in range(1500):
        words = rng.choices(plain, k=60)
        if i % 6 == 0:
            for _ in range(3):
                words[rng.randrange(60)] = rng.choice(bad)
        rows.append((i, " ".join(words), "x"))
        marks.append((i, int(i % 6 == 0), None, "clash", 0.5))
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    return docs, spark.createDataFrame([*marks, (3, None, 1, "", 0.0), (None, 1, 1, "", 0.0), (99_999, 1, 1, "", 0.0)], LABELS)


def test_learns_terms_and_holds_out(labelled, spark):
    docs, labels = labelled
    lexicon = fit(docs, labels, train=lambda i: remainder(i, 4) != 2)
    assert {"grumbler", "scoundrel", "blockhead"} <= set(lexicon.whole)
    got = {r["id"]: r for r in score(docs, lexicon).withColumn("held", remainder("id", 4) == 2).collect()}
    held = [r for r in got.values() if r["held"]]
    assert len(held) > 200 and all(r["predicted"] == (r["id"] % 6 == 0) == (r["score"] >= 0.3) for r in held)
    plain, quote, spelled, clean = scores(lexicon, [
        "a scoundrel and blockhead here", 'they "scoundrel" and "blockhead" wrote', "a scoundrell and bl0ckhead here", "nothing bad at all here",
    ])
    assert plain > 0.5 > 0.3 > quote and spelled > 0.3 > clean
    # held-out labels don't matter
    turned = labels.withColumn("toxic", F.when(remainder("doc_id", 4) == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = fit(docs, turned, train=lambda i: remainder(i, 4) != 2)
    assert again.whole == lexicon.whole and again.weights == lexicon.weights


def test_copies_are_no_evidence(spark):
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(4000)]
    one = " ".join(words[:50])
    rows = [(i, one if i < 60 else " ".join(rng.choices(words[50:], k=50))) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 60)) for i in range(600)], "doc_id long, toxic int")
    assert not fit(docs, labels).whole


def test_awkward_rows(spark, awkward, rows, nothing, labelled):
    _, labels = labelled
    lexicon = fit(awkward, labels)
    got = score(awkward, lexicon).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    none = labels.limit(0)
    assert score(awkward, fit(awkward, none)).where("predicted = 1").count() == 0
    assert fit(nothing, labels).whole == {} and score(nothing, lexicon).count() == 0
    left = drop_toxic(awkward, none)
    assert left.columns == awkward.columns and left.count() == len(rows)


def test_predicted_documents_go(labelled):
    docs, labels = labelled
    left = {r["doc_id"] for r in drop_toxic(docs, labels).collect()}
    assert left == {i for i in range(1500) if i % 6}
    assert docs.columns == ["doc_id", "text", "score"]


def test_lexicon_travels(spark):
    import pickle

    lexicon = Lexicon({"idiot": 4.0}, {}, {"idiot"}, weights=[-4, 1, 0, 0, 0])
    before = scores(lexicon, ["an idiot", None, ""])
    assert scores(pickle.loads(pickle.dumps(lexicon)), ["an idiot", None, ""]) == before


def test_every_term_is_kept(spark):
    rng = random.Random(8)
    plain = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(300)]
    bad = ["".join(rng.choice("klmnopqrst") for _ in range(14)) for _ in range(400)]
    rows, marks = [], []
    for i in range(2000):
        words = rng.choices(plain, k=20)
        if i % 2:
            words[::4] = [bad[(i // 2 * 5 + k) * 7 % 400] for k in range(5)]
            words += [w for pair in ((bad[(i * 11 + k) % 400], rng.choice(plain)) for k in range(8)) for w in pair]
        rows.append((i, " ".join(words)))
        marks.append((i, i % 2))
    lexicon = fit(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int"))
    assert set(lexicon.whole) >= set(bad) and lexicon.fuzzy >= set(bad)
    assert lexicon.near([w[0] + "z" + w[2:] for w in bad]) == bad


def test_stems_that_add_nothing_go():
    from lamina.llm.toxicity import telling_stems

    assert telling_stems({"grumb": 2.0, "grumbl": 2.0, "grumble": 3.0, "grumbler": 2.5, "scoun": 1.0}) == {"grumb": 2.0, "grumble": 3.0, "scoun": 1.0}


def test_fresh_starts_change_nothing(monkeypatch):
    from lamina.llm import toxicity

    rng = random.Random(2)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(3, 9))) for _ in range(600)]
    terms = dict.fromkeys(words[:60], 1.0)
    whole = Lexicon(terms, {"abcab": 0.5}, set(terms))._results(words)
    monkeypatch.setattr(toxicity, "MAX_PLACES", 50)
    monkeypatch.setattr(toxicity, "WALK_WORDS", 7)
    assert Lexicon(terms, {"abcab": 0.5}, set(terms))._results(words) == whole

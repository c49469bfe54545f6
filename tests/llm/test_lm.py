import math
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import xxhash
from brute import WORD, lower, word_counts
from pyspark.sql import functions as F

from lamina.llm import mixing_lm
from lamina.llm.mixing_lm import paths, score_texts
from lamina.llm.text import blank_separated


def held_out(i):
    return i % 5 == 0


def check_base(got, rows):
    train = [t for i, t, _ in rows if i is None or i % 5]
    counts = word_counts(train)
    n, v = sum(counts.values()), len(counts)
    expected = []
    for i, t, _ in rows:
        tokens = [*WORD.findall(lower(t)), None]
        base = sum(math.log10((counts.get(w, 0) + 0.1) / (n + 0.1 * (v + 1))) for w in tokens)
        expected.append((repr(i), i is not None and i % 5 == 0, len(tokens), sum(counts.get(w, 0) > 0 for w in tokens), n, round(base, 4)))
    found = [(repr(r["id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in got]
    assert sorted(found) == sorted(expected)


def test_base_score(awkward, rows):
    check_base(score_texts(awkward, held_out).collect(), rows)
    # most words outside the model: they meet their counts in the join
    check_base(score_texts(awkward, held_out, max_words=40).collect(), rows)


def test_no_text(nothing, spark, awkward):
    assert score_texts(nothing, held_out).count() == 0
    alone = score_texts(awkward, lambda i: F.lit(True)).collect()
    assert all(r["train_tokens"] == 0 and r["n_known"] == 0 and r["score"] < 0 for r in alone)


def test_learns_what_it_is_given(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scored = score_texts(docs, lambda i: F.crc32(i.cast("string")) % 10 == 0).collect()
    trained = [r for r in scored if not r["held_out"]]
    assert sum(r["score"] for r in trained) > sum(r["base_score"] for r in trained)
    assert all(r["score"] < 0 and 0 < r["bits_per_byte"] < 16 for r in scored)


def test_paths_are_prefix_codes():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 50, 300):
        start, length, nodes, bits = paths(rng.integers(1, 10_000, n))
        codes = {tuple(zip(nodes[a:a + k].tolist(), bits[a:a + k].tolist())) for a, k in zip(start, length)}
        assert len(codes) == n
        assert n == 1 or abs(sum(2.0 ** -k for k in length.tolist()) - 1) < 1e-9


def test_class_probabilities_sum_to_one():
    """Over all next tokens, class path times share is a distribution."""
    words = [b"aa", b"bb", b"cc", b"dd"]
    import xxhash

    hashes = np.array([xxhash.xxh64_intdigest(w, 42) for w in words], np.uint64).view(np.int64)
    coder = mixing_lm.Coder(hashes, np.array([9, 5, 4, 2]), 3, 2, np.ones(256, np.int64))
    coder.classify(np.ones((6, mixing_lm.TOPIC_WORDS + 1), np.int64))
    bits = {"word": 14, "spell": 14}
    tables = {k: [np.zeros((mixing_lm._table_size(coder, k, i, bits), 2), np.uint16) for i in range(4)] for k in mixing_lm.PREDICTORS}
    model = mixing_lm.Model(coder, bits, tables, {k: mixing_lm.Mixer.fresh() for k in mixing_lm.PREDICTORS})
    total = 0.0
    for text in ["aa", "bb", "cc", "dd"]:
        events, static = coder.events(*blank_separated(pa.array([text])))
        total += 10 ** model.score(events, static)[0]
    assert 0 < total < 1


def test_counts_beyond_16_bits_keep_their_ratio():
    table = np.zeros((5, 2), np.int64)
    table[3] = 300_000, 100_000
    parts = pd.concat([b.to_pandas() for _ in range(3) for b in mixing_lm._slices("word", 1, 0, table)])
    summed = SimpleNamespace(toLocalIterator=lambda: mixing_lm._summed(parts).to_dict("records"))
    counts = mixing_lm._tables(summed, None, {"word": 14, "spell": 14})[0]["word"][1]
    assert counts[3].tolist() == [900_000, 300_000]
    assert (mixing_lm.pack(counts[3:4])[0] >> 2) * float(mixing_lm.ODDS_STEP) == pytest.approx(math.log(1 / 3), abs=0.01)


def test_next_tokens_sum_to_one():
    """Whatever the counts say, all words, the end and an escape after one context are a distribution."""
    rng = np.random.default_rng(2)
    coder = mixing_lm.Coder(np.arange(200), np.sort(rng.integers(1, 50, 200))[::-1], 30, 20, np.ones(256, np.int64))
    coder.classify(rng.integers(0, 5, (202, mixing_lm.TOPIC_WORDS + 1)))
    assert coder.nodes >= 201 and len(np.unique(coder.classes)) > 10
    bits = {"word": 14, "spell": 14}
    tables = {
        k: [rng.integers(0, 60, (mixing_lm._table_size(coder, k, i, bits), 2)) for i in range(4)] for k in mixing_lm.PREDICTORS
    }
    mixer = mixing_lm.Mixer(rng.random((mixing_lm.GATES, 4)), *np.zeros((2, mixing_lm.GATES * mixing_lm.REFINE_STEPS)))
    model = mixing_lm.Model(coder, bits, tables, {"word": mixer})
    _, depth, nodes, taken = mixing_lm.climb(coder.parent, coder.side, np.arange(202), 202)
    contexts = [np.full(len(nodes), k, np.uint32) for k in (11, 12, 13)]
    scores = model.score({"word": mixing_lm.Events(nodes, taken, np.repeat(np.arange(202), depth), contexts)}, depth)
    assert (10 ** scores).sum() == pytest.approx(1, abs=1e-4)


def test_a_word_of_a_class_is_told_by_the_word_before(spark):
    # no x or y follows a topic word, so all of them are in one class
    topics = " ".join(f"t{k}" for k in range(mixing_lm.TOPIC_WORDS))
    rows = [(1000 + i, topics + " " + topics) for i in range(100)]
    rows += [(i, f"x{i % 25} y{i % 25} x{i % 25} y{i % 25}") for i in range(500)]
    rows += [(-1, "x1 y1"), (-2, "x1 y2"), (-3, "x3 y3"), (-4, "x3 y4")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    score = {r["id"]: r["score"] for r in score_texts(docs, lambda i: i < 0).collect()}
    assert score[-1] > score[-2] + 0.7 and score[-3] > score[-4] + 0.7


def test_words_are_looked_up_once_and_decisions_made_in_parts(monkeypatch):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(300)]
    texts = pa.array([" ".join(rng.choice(words, rng.integers(0, 60))) for _ in range(80)])
    import xxhash

    hashes = np.array([xxhash.xxh64_intdigest(w, 42) for w in words[:200]], np.uint64).view(np.int64)
    coder = mixing_lm.Coder(hashes, np.arange(220, 20, -1), 80, 900, np.ones(256, np.int64))
    coder.classify(rng.integers(0, 5, (202, mixing_lm.TOPIC_WORDS + 1)))
    bits = {"word": 14, "spell": 14}
    tables = {k: [rng.integers(0, 60, (mixing_lm._table_size(coder, k, i, bits), 2)) for i in range(4)] for k in mixing_lm.PREDICTORS}
    model = mixing_lm.Model(coder, bits, tables, {k: mixing_lm.Mixer.fresh() for k in mixing_lm.PREDICTORS})
    whole, sizes = coder.events(*blank_separated(texts))
    wanted = model.score(whole, sizes)
    which, distinct, sizes = blank_separated(texts)
    parts = list(coder.parts(which, distinct, coder.symbols(distinct), sizes, 37))
    assert len(parts) > 20
    for kind, events in whole.items():
        for name in ("node", "bit", "text"):
            assert (np.concatenate([getattr(p[kind], name) for p in parts]) == getattr(events, name)).all()
    assert sum(model.score(p, sizes) for p in parts) == pytest.approx(wanted)

    asked, symbols = [], mixing_lm.Coder.symbols
    monkeypatch.setattr(mixing_lm.Coder, "symbols", lambda self, *a: asked.append(1) or symbols(self, *a))
    batch = pa.RecordBatch.from_arrays([pa.array(range(80)), pa.array([False] * 80), texts], ["id", "held_out", "text"])
    found = list(mixing_lm._scorer(SimpleNamespace(value=model), SimpleNamespace(value=np.zeros(202)), 0.1, 1.0, 0.0, True)([batch]))
    assert len(asked) == 1 and found[0].column(6).to_pylist() == pytest.approx(wanted.tolist())


def test_scores_in_parts_share_the_mixers_shifts(monkeypatch):
    rng = np.random.default_rng(4)
    names = sorted({b"w%d" % i for i in range(60)})
    hashes = np.array([xxhash.xxh64_intdigest(w, mixing_lm.HASH_SEED) for w in names], np.uint64).view(np.int64)
    coder = mixing_lm.Coder(hashes, np.arange(60, 0, -1) + 5, 20, 5, np.ones(256, np.int64))
    coder.classify(rng.integers(0, 50, (62, mixing_lm.TOPIC_WORDS + 1)))
    bits = {"word": 14, "spell": 14}
    packed = {k: [rng.integers(-8000, 8000, mixing_lm._table_size(coder, k, i, bits)).astype(np.int16) for i in range(4)] for k in bits}
    model = mixing_lm.Model(coder, bits, {}, {k: mixing_lm.Mixer.fresh() for k in bits}, packed)
    for mixer in model.mixers.values():
        mixer.hits += rng.integers(0, 9, len(mixer.hits))
        mixer.seen += mixer.hits + rng.integers(0, 9, len(mixer.hits))
    made = []
    shifts = mixing_lm.Mixer.shifts
    monkeypatch.setattr(mixing_lm.Mixer, "shifts", lambda self: made.append(self) or shifts(self))
    texts = [" ".join(f"{rng.choice(['w', 'x'])}{i}" for i in rng.integers(0, 70, n)) for n in (30, 0, 1, 50)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(4)), pa.array([True] * 4), pa.array(texts)], ["id", "held_out", "text"])

    class Sent:
        def __init__(self, value):
            self.value = value

    logs = np.full(62, -2.0)
    logs[[mixing_lm.ESCAPE, 5, 9]] = np.nan
    found = pa.Table.from_batches(mixing_lm._scorer(Sent(model), Sent(logs), 0.0, 1.0, -1.0, True)([batch, batch]))
    assert len(made) == 2
    spelled = {w.decode(): logs[s] for w, s in zip(names, coder.symbols(names).tolist())}
    for text, words, times in zip(texts * 2, found["words"].to_pylist(), found["times"].to_pylist()):
        wanted = Counter(w for w in text.split() if np.isnan(spelled.get(w, np.nan)))
        assert {w.decode(): n for w, n in zip(words, times)} == wanted


def _some_coder(rng, words):
    hashes = np.array([xxhash.xxh64_intdigest(w, mixing_lm.HASH_SEED) for w in words], np.uint64).view(np.int64)
    coder = mixing_lm.Coder(hashes, np.arange(len(words), 0, -1), 30, 20, np.ones(256, np.int64))
    coder.classify(rng.integers(0, 9, (len(words) + 2, mixing_lm.TOPIC_WORDS + 1)))
    return coder


def test_equal_decisions_are_counted_at_once(monkeypatch):
    rng = np.random.default_rng(6)
    words = [f"w{i}" for i in range(200)]
    coder, bits = _some_coder(rng, words), {"word": 14, "spell": 14}
    texts = [" ".join(rng.choice([*words, "new", "newer"], n)) for n in (0, 1, 40, 70)]
    made, slots = [], mixing_lm.slots
    monkeypatch.setattr(mixing_lm, "slots", lambda context, *a: made.append(len(context)) or slots(context, *a))

    def counted(times):
        made.clear()
        both = pa.array(texts * times), pa.array([i % 3 == 0 for i in range(4)] * times)
        found = list(mixing_lm._counter(SimpleNamespace(value=coder), bits)([pa.RecordBatch.from_arrays(list(both), ["text", "tuning"])]))
        return mixing_lm._tables(SimpleNamespace(toLocalIterator=lambda: pa.Table.from_batches(found).to_pylist()), coder, bits), sum(made)

    tables, once = counted(1)
    more, often = counted(30)
    assert often == once
    wanted = mixing_lm._tables(SimpleNamespace(toLocalIterator=lambda: []), coder, bits)
    for text, fold in zip(texts, (1, 0, 0, 1)):
        for kind, events in coder.events(*blank_separated(pa.array([text])), True)[0].items():
            for table, slot in zip(wanted[fold][kind], mixing_lm.addresses(events, bits[kind])):
                np.add.at(table, (slot, events.bit), 1)
    for fold in (0, 1):
        for kind in mixing_lm.PREDICTORS:
            for a, b, c in zip(tables[fold][kind], more[fold][kind], wanted[fold][kind]):
                assert (a == c).all() and (b == 30 * c).all()


def test_words_are_hashed_like_spark_does(spark):
    rng = np.random.default_rng(7)
    words = sorted({bytes(rng.integers(97, 123, n).astype(np.uint8)) for n in [*range(45), *rng.integers(1, 12, 200)]}) + ["żółw".encode()]
    text = pa.array([b" \t".join(words[:100]), b"", b"\n".join(words[100:]).upper()])
    which, distinct, sizes = mixing_lm._split(text)
    assert distinct.words(which) == [w for t in text.to_pylist() for w in lower(t.decode()).encode().split()] and len(which) == sizes.sum()
    found = dict(spark.createDataFrame([(w,) for w in words], "w binary").select("w", F.xxhash64("w")).collect())
    assert mixing_lm.Pieces.of(words).hashes().tolist() == [found[w] for w in words]

import random

import numpy as np
from brute import classes, simhash
from hypothesis import given, settings
from hypothesis import strategies as st

from lamina.llm.components import components
from lamina.llm.simhash import drop_near_duplicates, forest, links, near_duplicates
from lamina.llm.text import Words


def test_fingerprints_and_components(spark, awkward, rows):
    got = sorted(map(tuple, near_duplicates(awkward).collect()), key=repr)
    prints = [simhash(t) for _, t, _ in rows]
    pairs = [(a, b) for a in range(len(rows)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 2]
    group = classes(len(rows), pairs)
    smallest = {}
    for (i, _, _), g in zip(rows, group):
        if i is not None:
            smallest[g] = min(smallest.get(g, i), i)
    expected = [(i, p - (1 << 64) if p >> 63 else p, smallest.get(g)) for (i, _, _), p, g in zip(rows, prints, group)]
    assert got == sorted(expected, key=repr)


def test_links_keep_all_components(spark):
    rng = random.Random(4)
    prints = set()
    for _ in range(60):
        value = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 30])):
            prints.add(value)
            value ^= 1 << rng.randrange(64)
            if rng.random() < 0.5:
                value ^= 1 << rng.randrange(64)
    prints = sorted(p - (1 << 63) for p in prints)
    frame = spark.createDataFrame([(p,) for p in prints], "fingerprint long")
    close = [(a, b) for a in range(len(prints)) for b in range(a) if ((prints[a] ^ prints[b]) & (2**64 - 1)).bit_count() <= 2]
    expected = classes(len(prints), close)
    for block_rows in (2, 8192):
        index = {p: i for i, p in enumerate(prints)}
        edges = [(index[r["a"]], index[r["b"]]) for r in links(frame, 2, block_rows).collect()]
        assert set(map(tuple, map(sorted, edges))) <= set(map(tuple, map(sorted, close))) or classes(len(prints), edges) == expected
        assert classes(len(prints), edges) == expected


def test_forest_connects_the_same(spark):
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 50, 400).astype(np.uint64), rng.integers(0, 50, 400).astype(np.uint64)
    x, y = forest(a, b)
    assert len(x) < 50
    assert classes(50, zip(a.tolist(), b.tolist())) == classes(50, zip(x.tolist(), y.tolist()))


def test_components_of_chain_star_and_none(spark):
    chain = [(i, i + 1) for i in range(200)]
    star = [(1000, 1000 + i) for i in range(1, 300)]
    frame = spark.createDataFrame([*chain, *star, (5, 5), (7, 6), (None, 3)], "a long, b long")
    found = {r["node"]: r["root"] for r in components(frame).collect()}
    assert len(found) == 201 + 300
    assert len({found[i] for i in range(201)}) == 1
    assert len({found[1000 + i] for i in range(300)}) == 1
    assert found[0] != found[1000]
    assert components(frame.limit(0)).count() == 0


def test_one_of_each_group_stays(spark, awkward, nothing):
    kept = drop_near_duplicates(awkward)
    assert kept.columns == awkward.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(6) == 1 and 7 not in ids and 9 not in ids and ids.count(11) == 1 and ids.count(None) == 2
    assert 1 in ids and 3 not in ids
    assert near_duplicates(nothing).count() == 0 and drop_near_duplicates(nothing).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aB \n\té\x00"), max_size=6))
def test_words_of_any_text(texts):
    words = Words([t.encode() for t in texts])
    found = [words.data[a:b] for a, b in zip(words.starts.tolist(), words.ends.tolist())]
    assert found == [w for t in texts for w in t.encode().lower().split()]
    assert words.counts.tolist() == [len(t.encode().split()) for t in texts]

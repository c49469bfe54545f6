import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from lamina.llm import suffix_dedup
from lamina.llm.queries import QUERIES
from lamina.llm.suffix_sort import room, suffix_array

SMOKE = "/root/testdata/sf0.001"


def words(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


def plain_suffixes(text, limit):
    order = sorted(range(len(text)), key=lambda i: text[i:])
    shared = [0]
    for a, b in zip(order, order[1:]):
        k = 0
        while k < limit and text[a + k] == text[b + k]:
            k += 1
        shared.append(k)
    return order, shared


@pytest.mark.parametrize("memory", [1 << 20, 0])
def test_suffixes_and_common_prefixes(memory):
    rng = random.Random(5)
    for trial in range(150 if memory else 25):
        text = [rng.randint(1, rng.choice([1, 2, 3, 300])) for _ in range(rng.randint(1, 60))]
        if trial % 3 == 0:
            text = text[:7] * 9
        text, limit = text + [0], rng.randint(1, 40)
        places, shared = suffix_array(np.array(text), limit, memory)
        assert (places.tolist(), shared.tolist()) == plain_suffixes(text, limit)


def test_a_substring_that_ends_where_a_step_of_names_ends():
    # seven symbols of nine bits are named at once; the first of these substrings ends there, the others go on
    text = [300, 9, 2, 3, 3, 3, 3, 3, 2, 4, 9, 2, 3, 3, 3, 3, 3, 2, 1, 9, 2, 3, 3, 3, 3, 3, 2, 2, 1, 9, 0]
    places, shared = suffix_array(np.array(text), 20)
    assert (places.tolist(), shared.tolist()) == plain_suffixes(text, 20)


@pytest.mark.parametrize("seed", [6, 18, 24, 44, 70, 106])
def test_repeats_of_texts_of_few_letters(seed):
    rng = random.Random(seed)
    pool = ["".join(rng.choice("abc") * rng.randint(1, 6) for _ in range(rng.randint(6, 60))) for _ in range(3)]
    cuts = [[(p, rng.randint(0, len(p))) for p in rng.choices(pool, k=4)] for _ in range(5)]
    bodies = sorted({"".join(p[at:at + 150] * rng.choice([1, 1, 2, 5]) for p, at in c).encode() for c in cuts})
    bodies = [b for b in bodies if len(b) >= 20]
    starts = Counter(b[p:p + 20] for b in bodies for p in range(len(b) - 19))
    for body, places in zip(bodies, suffix_dedup.repeated_strings(bodies, [1] * len(bodies), 20)):
        assert places.tolist() == [p for p in range(len(body) - 19) if starts[body[p:p + 20]] > 1]


def test_large_arrays_are_files():
    array = room(1000, np.int64, 100)
    assert isinstance(array, np.memmap) and not array.any()
    assert not isinstance(room(10, np.int64, 100), np.memmap)


def brute(texts, length):
    texts = [(t or "").encode() for t in texts]
    starts = Counter(t[p:p + length] for t in texts for p in range(len(t) - length + 1))
    rows = []
    for t in texts:
        gone = np.zeros(len(t) + 2, bool)
        for p in range(len(t) - length + 1):
            if starts[t[p:p + length]] > 1:
                gone[p + 1:p + 1 + length] = True
        kept = bytes(b for b, g in zip(t, gone[1:]) if not g)
        runs = int((gone[1:] & ~gone[:-1]).sum())
        rows.append((len(t), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return rows


def told(frame):
    return sorted(tuple(r) for r in frame.select("n_bytes", "n_removed", "n_spans", "kept_sha256").collect())


@pytest.mark.parametrize("length,anchor,shard", [(8, 3, 1), (30, 30, 1 << 20), (60, 20, 4000)])
def test_awkward_rows(spark, awkward, rows, length, anchor, shard):
    found = suffix_dedup.repeated_text(awkward, length=length, anchor=anchor, shard_bytes=shard, memory=1 << 16)
    assert told(found) == sorted(brute([t for _, t, _ in rows], length))
    assert sorted(str(r["id"]) for r in found.collect()) == sorted(str(i) for i, _, _ in rows)


def test_no_rows(nothing):
    assert suffix_dedup.repeated_text(nothing).collect() == []


def planted(seed):
    rng = random.Random(seed)
    passage, other = words(seed, 90), words(seed + 1, 400)
    texts = ["x" * 1500, "ab" * 700 + "c", "ab" * 300, passage, passage + " "]
    for k in range(30):
        own = words(1000 + k, rng.randint(1, 120))
        at = rng.randint(0, len(passage) // 3)
        texts.append(own + passage[at:] + own[::-1] if k % 2 else own + other[at * 3:at * 3 + rng.randint(395, 405)])
    near = other.split()
    for k in range(40):
        near[rng.randrange(len(near))] = f"w{k}"
        texts.append(" ".join(near))
    return texts


def test_planted_passages(spark):
    texts = planted(3)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    found = {r["id"]: r for r in suffix_dedup.repeated_text(docs, shard_bytes=20_000, with_text=True).collect()}
    expected = brute(texts, 400)
    for k, text in enumerate(texts):
        r = found[k]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == expected[k]
        assert hashlib.sha256(bytes(r["kept"])).hexdigest() == r["kept_sha256"]


def test_blocks_of_a_long_text(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK", 1000)
    rng = random.Random(8)
    part = words(9, 300)
    text = "".join(words(20 + k, 50) + part[k * 40:k * 40 + rng.randint(380, 700)] for k in range(12))
    keys = suffix_dedup.Keys(400, 100)
    text_of, _, first, last, _ = keys.runs([b"short", text.encode(), b"", text.encode()[5:]])
    for k in (1, 3):
        own = sorted(zip(first[text_of == k].tolist(), last[text_of == k].tolist()))
        covered = [p for a, b in own for p in range(a, b + 1)]
        assert covered == list(range(len(text.encode()) - 399 - (5 if k == 3 else 0)))
    assert set(text_of.tolist()) == {1, 3}


def test_query_against_brute_force(spark):
    texts = [r["text"] for r in spark.read.parquet(f"{SMOKE}/documents.parquet").collect()]
    assert told(QUERIES["op11_suffix_dedup"](spark, SMOKE)) == sorted(brute(texts, 400))

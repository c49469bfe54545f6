import random
import tracemalloc
import zlib

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lamina.llm.queries import tokenizer_file
from lamina.llm.token_count import Counter, token_counts
from lamina.llm.token_store import Coder, Encoder, Known, _tokeniser, read_digests, read_tokens, scaled, write_tokens

tokenizers = pytest.importorskip("tokenizers")
ODD = ["a<|endoftext|>b <|startoftext|><|endoftext|>", "<|endoftext|", "aaaaaaaaaaaaaaaa ssssss", "ΑΣ ΑΣ. ΣΣΣ", "it's IT'S we'll'll 12345 ...!!!", "İx ẞ", "é ́", ""]


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(tokenizer_file())


@pytest.fixture(scope="module")
def tools():
    return Counter(tokenizer_file()), Encoder(tokenizer_file())


def texts(seed, n):
    rng = random.Random(seed)
    pool = [chr(x) for x in [*range(32, 127)] * 2 + [*range(0xA0, 0x250)] + [*range(0x370, 0x400)] + [
        0x130, 0x2028, 0x85, 0x1C, 0x3000, 0x301, 0x308, 0x4E2D, 0x1F600, 0xB2, 0x2160, 0x660, 0xFB01, 0xAC00, 0x1100, 0x1161, 0x200B, 0]]
    return ["".join(rng.choice(pool) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_like_the_library(library, tools):
    counter, encoder = tools
    sample = texts(1, 1500) + ODD
    wanted = [library.encode(t, add_special_tokens=False).ids for t in sample]
    assert counter.count(pa.array(sample)).tolist() == [len(w) for w in wanted]
    ids, counts = encoder.encode(pa.array(sample), 2)
    ends = np.cumsum(counts)
    assert [ids[e - c:e].tolist() for e, c in zip(ends, counts)] == [w + [2] for w in wanted]


@settings(max_examples=100, deadline=None)
@given(t=st.text(max_size=30))
def test_any_text_like_the_library(library, tools, t):
    assert tools[0].count(pa.array([t])).tolist() == [len(library.encode(t, add_special_tokens=False).ids)]


def test_token_counts(awkward, rows, library, nothing):
    got = {(r["id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts(awkward, tokenizer_file()).collect()}
    counts = [(i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t, _ in rows]
    assert got == {(i, b, n, n > 2048) for i, b, n in counts}
    assert token_counts(nothing, tokenizer_file()).count() == 0


def test_pipeline_encodes_in_little_memory(spark, sf_dir, monkeypatch):
    asked = {}
    monkeypatch.setattr(corpus_pipeline.token_store, "write_tokens", lambda *_, **options: asked.update(options))
    monkeypatch.setattr(corpus_pipeline.token_store, "read_digests", lambda *_: spark.range(1))
    corpus_pipeline.tokens(spark, spark.range(1), sf_dir)
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(3000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(400)), pa.array([" ".join(rng.choices(words, k=2000)) for _ in range(400)])], ["id", "text"])
    small, whole = _tokeniser(tokenizer_file(), 2, **asked), _tokeniser(tokenizer_file(), 2)
    wanted = pa.Table.from_batches(whole([batch]))
    tracemalloc.start()
    found = pa.Table.from_batches(small([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found.equals(wanted)
    assert peak < 30 << 20


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 5000), st.integers(1, 300), st.integers(0, 10**6))
def test_coder_round_trip(n, kinds, seed):
    rng = np.random.default_rng(seed)
    ids = rng.choice(rng.integers(0, 49_000, kinds), n)
    tokens, counts = np.unique(ids, return_counts=True)
    coder = Coder(tokens, scaled(counts))
    assert (coder.decode(coder.encode(ids)) == ids).all()


def test_long_blocks_and_damage():
    ids = np.random.default_rng(0).zipf(1.3, 600_000) % 1000
    tokens, counts = np.unique(ids, return_counts=True)
    coder = Coder(tokens, scaled(counts))
    block = coder.encode(ids)
    assert len(block["places"]) == 3 and (coder.decode(block) == ids).all()
    p = counts / counts.sum()
    assert len(block["words"]) * 8 < len(ids) * (-(p * np.log2(p)).sum() + 0.1) + 70_000
    with pytest.raises(ValueError):
        coder.decode({**block, "words": block["words"][:-1] + b"\x01\x02"})


def test_store_round_trip(spark, awkward, rows, library, tmp_path):
    for number, block_tokens in enumerate((500, 1 << 20)):
        path = str(tmp_path / f"store{number}")
        write_tokens(awkward, path, tokenizer_file(), block_tokens=block_tokens)
        got = sorted((r["start"], r["n_tokens"], r["id"], list(r["ids"])) for r in read_tokens(spark, path).collect())
        order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
        assert [g[2] for g in got] == [i for i, _, _ in order]
        start = 0
        for g in got:
            assert g[0] == start and g[1] == len(g[3])
            start += g[1]
        wanted = sorted((repr(i), library.encode(t or "", add_special_tokens=False).ids + [2]) for i, t, _ in rows)
        assert sorted((repr(g[2]), g[3]) for g in got) == wanted
        sums = {(r["start"], r["ids_crc32"]) for r in read_digests(spark, path).collect()}
        assert sums == {(g[0], zlib.crc32(np.array(g[3], "<u4").tobytes())) for g in got}


def test_empty_store(spark, nothing, tmp_path):
    write_tokens(nothing, str(tmp_path / "none"), tokenizer_file())
    assert read_tokens(spark, str(tmp_path / "none")).count() == 0


def test_frequent_strings_stay_known():
    known = Known(8)
    known.add([b"often", b"also"], np.array([7, 8, 9], np.uint32), np.array([1, 2]))
    for _ in range(5):
        known.of(np.array([0, 1, 1, 1, 0, 1]))
        known.age()
    # pieces that are met once each don't drive out what is met often, even where they are the latest
    for number in range(40):
        known.add([b"%d" % number], np.array([number], np.uint32), np.array([1]))
        assert known.of(np.array([known.numbers[b"%d" % number], 0, -1]), 99)[0].tolist() == [number, 7, 99]
        known.age()
        assert b"also" in known.numbers or number > 8
        assert len(known.sizes) == len(known.numbers) == len(known.starts) <= 8


def test_small_caches_change_no_id():
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgÀé'") for _ in range(rng.randint(1, 5))) for _ in range(400)]
    small, whole = Encoder(tokenizer_file(), 16), Encoder(tokenizer_file())
    for _ in range(6):
        texts = pa.array([" ".join(rng.choices(words, k=40)) + rng.choice(["", " <|endoftext|>x"]) for _ in range(5)])
        for a, b in zip(small.encode(texts, 2), whole.encode(texts, 2)):
            assert a.tolist() == b.tolist()

"""Token counts by merging all pre-tokens of a batch at once, in the order of the merge ranks."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from lamina.llm.text import CHUNK_BYTES, blank_separated, column_chunks, id_text, id_type

LIMIT_TOKENS = 2048
# Pieces whose counts a worker remembers; it starts afresh beyond them, which changes time only.
CACHE_PIECES = 1 << 19
NO_RANK = np.int64(1) << 40


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in plain}
    for number, byte in enumerate(b for b in range(256) if b not in letters):
        letters[byte] = chr(256 + number)
    return [letters[b] for b in range(256)]


class Merges:
    """Vocabulary and merges of a tokenizer file as arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, vocab = spec["model"], spec["model"]["vocab"]
        normal, splits = spec["normalizer"], spec["pre_tokenizer"]["pretokenizers"]
        kinds = [n["type"] for n in normal["normalizers"]], [p["type"] for p in splits]
        if kinds != (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]) or not splits[0]["invert"]:
            raise ValueError("only the normal form, split and byte-level steps of word-end BPE files are known here")
        ending = model["end_of_word_suffix"]
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int64)
        self.final = np.array([vocab[c + ending] for c in letters], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left, right = (np.array([vocab[p[side]] for p in pairs], np.int64) for side in (0, 1))
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.known = len(vocab)
        born = np.full(max(vocab.values()) + 1, -1)
        born[made] = np.arange(len(made))
        # A merge of two symbols that are made earlier can only come later: equal pairs can then merge together.
        if len(set(made.tolist())) != len(made) or not (np.maximum(born[left], born[right]) < np.arange(len(made))).all():
            raise ValueError("merges must make each symbol once and before it is used")
        order = np.argsort(left << 32 | right)
        self.keys, self.ranks, self.made = (left << 32 | right)[order], order, made[order]
        self.words = regex.compile(splits[0]["pattern"]["Regex"] + r"|\n")
        special = [regex.escape(t["content"]) for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(special)) if special else None

    def pre_tokens(self, pieces: list[bytes]) -> list[str]:
        """Pre-tokens of pieces without blanks, a line feed after those of each piece."""
        text = b"\n".join(pieces).decode("utf-8", "replace") + "\n"
        # letter by letter, so that a final sigma is lowered like any other
        return self.words.findall(unicodedata.normalize("NFC", text).replace("\u03a3", "\u03c3").lower())

    def split_special(self, piece: bytes) -> tuple[list[bytes], int]:
        """What is left around the special tokens of a piece, and how many there are."""
        parts = self.special.split(piece.decode("utf-8", "replace")) if self.special else [piece.decode("utf-8", "replace")]
        return [p.encode() for p in parts if p], len(parts) - 1

    def count(self, tokens: list[bytes]) -> np.ndarray:
        """Symbols that are left of each pre-token when no pair can merge."""
        if not tokens:
            return np.zeros(0, np.int64)
        sizes = np.array([len(t) for t in tokens], np.int64)
        data = np.frombuffer(b"".join(tokens), np.uint8)
        symbols = self.inner[data]
        ends = np.cumsum(sizes)
        symbols[ends - 1] = self.final[data[ends - 1]]
        result = np.zeros(len(tokens), np.int64)
        owner = np.repeat(np.arange(len(tokens)), sizes)
        while len(symbols):
            rank, made = self._ranks(symbols, owner)
            firsts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            lowest = np.minimum.reduceat(rank, firsts)
            lengths = np.diff(np.r_[firsts, len(symbols)])
            done = lowest == NO_RANK
            result[owner[firsts[done]]] = lengths[done]
            merge = (rank == np.repeat(lowest, lengths)) & (rank < NO_RANK)
            # in a run of equal symbols every other pair merges, from the left
            run = merge & np.r_[False, merge[:-1]]
            if run.any():
                start = np.maximum.accumulate(np.where(run, 0, np.arange(len(run))))
                merge &= (np.arange(len(run)) - start) % 2 == 0
            at = np.flatnonzero(merge)
            symbols[at] = made[at]
            keep = np.repeat(~done, lengths)
            keep[at + 1] = False
            symbols, owner = symbols[keep], owner[keep]
        return result

    def _ranks(self, symbols: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        pair = np.zeros(len(symbols), np.int64)
        pair[:-1] = symbols[:-1] << 32 | symbols[1:]
        place = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
        known = self.keys[place] == pair
        known[:-1] &= owner[:-1] == owner[1:]
        known[-1] = False
        return np.where(known, self.ranks[place], NO_RANK), self.made[place]


@lru_cache(maxsize=2)
def merges(path: str) -> Merges:
    return Merges(path)


class Counter:
    """Token counts of blank-separated pieces, remembered between batches."""

    def __init__(self, path: str):
        self.merges, self.cache = merges(path), {b"": 0}

    def learn(self, pieces: list[bytes]) -> None:
        if len(self.cache) > CACHE_PIECES:
            self.cache = {b"": 0}
        fresh = [p for p in pieces if p not in self.cache]
        marked = [p for p in fresh if b"<|" in p]
        plain = [p for p in fresh if b"<|" not in p] if marked else fresh
        self.cache.update(zip(plain, self._totals(plain).tolist()))
        for piece in marked:
            parts, specials = self.merges.split_special(piece)
            self.cache[piece] = specials + int(self._totals(parts).sum())

    def _totals(self, pieces: list[bytes]) -> np.ndarray:
        if not pieces:
            return np.zeros(0, np.int64)
        found = self.merges.pre_tokens(pieces)
        distinct = dict.fromkeys(found)
        distinct.pop("\n")
        counts = self.merges.count([t.encode() for t in distinct])
        known = dict(zip(distinct, counts.tolist()))
        known["\n"] = 0
        totals = np.cumsum(np.fromiter(map(known.__getitem__, found), np.int64, len(found)))
        ends = totals[[i for i, t in enumerate(found) if t == "\n"]]
        return np.diff(np.r_[0, ends])

    def count(self, texts: pa.Array) -> np.ndarray:
        which, distinct, sizes = blank_separated(texts)
        self.learn(distinct)
        counts = np.fromiter(map(self.cache.__getitem__, distinct), np.int64, len(distinct))
        totals = np.r_[0, np.cumsum(counts[which])]
        ends = np.cumsum(sizes)
        return totals[ends] - totals[ends - sizes]


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    """One counter for all tasks of a worker process."""
    return Counter(path)


def _counter(path: str):
    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in column_chunks(batches, 2 * CHUNK_BYTES):
            texts = batch.column(1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pc.binary_length(texts).cast(pa.int64()), pa.array(counter(path).count(texts))],
                ["id", "n_bytes", "n_tokens"],
            )

    return count


def token_counts(
    docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT_TOKENS
) -> DataFrame:
    """``(id, n_bytes, n_tokens, over_limit)`` for every row of ``docs``: tokens as the tokenizer file gives them.

    White space never is part of a token, so a text is counted by its blank-separated pieces, each distinct
    one once in a batch.  Their pre-tokens lie one after the other in an array of symbols; in
    every step all of them merge their lowest-ranked pair, until no pair is left.

    The file must be where ``tokenizer_path`` says on every node.  A null text is empty and has no
    tokens; strings of special tokens inside texts count as one.  Repeated rows get equal results.
    Other columns are not read.
    """
    counted = id_text(docs, id_col, text_col).mapInArrow(
        _counter(tokenizer_path), f"id {id_type(docs, id_col)}, n_bytes bigint, n_tokens bigint"
    )
    return counted.withColumn("over_limit", counted["n_tokens"] > limit)

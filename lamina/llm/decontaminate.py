"""Benchmark decontamination: Wu-Manber search for word windows, many positions of a text at a time."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.text import LOWER, ROW, col, id_type, text_chunks, with_row, without_rows
from lamina.session import materialise

WINDOW_WORDS = 13
# Share of hit words from which a document counts as contaminated: 1 in 20.
HIT_SHARE = 20
# Bytes that belong to words, lower case; everything else is a blank.
WORD_BYTES = bytes(LOWER[b] if 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80 else 32 for b in range(256))
# Benchmark text whose windows are searched in one pass; more text means more passes.
PASS_BYTES = 4 << 20
# Positions that move over a chunk together.
LANES = 1 << 14
SHIFT_BITS = 20


def blank_words(texts: list[bytes]) -> tuple[bytes, np.ndarray]:
    """Every text as `` word word ``, zero bytes between texts; where each text begins, and the end."""
    parts = [b" " + b" ".join(t.translate(WORD_BYTES).split()) + b" " for t in texts]
    begins = np.cumsum([0] + [len(p) + 1 for p in parts])
    return b"\0".join(parts) + b"\0", begins


class Patterns:
    """Shift tables and suffix buckets for patterns of at least ``shortest`` bytes."""

    def __init__(self, patterns: list[bytes], block: int):
        self.patterns, self.block = patterns, block
        self.length = min(map(len, patterns))
        self.suffix = min(self.length, 24)
        self.shift = np.full(1 << SHIFT_BITS, self.length - block + 1, np.int32)
        heads = np.frombuffer(b"".join(p[: self.length] for p in patterns), np.uint8).reshape(-1, self.length)
        for end in range(block, self.length + 1):
            np.minimum.at(self.shift, self.hash(heads, np.arange(len(heads)) * self.length + end), self.length - end)
        self.buckets = defaultdict(list)
        keys = self.key(heads.ravel(), np.arange(1, len(heads) + 1) * self.length)
        for pattern, key in enumerate(keys.tolist()):
            self.buckets[key].append(pattern)
        self.keys = np.array(sorted(self.buckets), np.uint64)

    def hash(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of the block before each end."""
        data, value = data.ravel(), np.zeros(len(ends), np.uint32)
        for back in range(self.block, 0, -1):
            value = value * np.uint32(256) + data[ends - back]
        return value * np.uint32(2654435761) >> np.uint32(32 - SHIFT_BITS)

    def key(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of the longer suffix that selects a bucket."""
        value = np.zeros(len(ends), np.uint64)
        for back in range(self.suffix, 0, -1):
            value = value * np.uint64(1099511628211) + data[ends - back]
        return value

    def find(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(start, pattern) of every occurrence in ``text``."""
        data = np.frombuffer(text, np.uint8)
        lanes = max(1, min(LANES, len(text) // 64))
        cuts = np.linspace(self.length, len(text) + 1, lanes + 1).astype(np.int64)
        at, stop = cuts[:-1], cuts[1:]
        candidates = []
        while len(at):
            alive = at < stop
            if not alive.all():
                at, stop = at[alive], stop[alive]
                if not len(at):
                    break
            shift = self.shift[self.hash(data, at)]
            here = at[shift == 0]
            if len(here):
                candidates.append(here)
            at = at + np.maximum(shift, 1)
        if not candidates:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        ends = np.concatenate(candidates)
        keys = self.key(data, ends)
        place = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        sure = self.keys[place] == keys
        starts, found = [], []
        for start, key in zip((ends[sure] - self.length).tolist(), keys[sure].tolist()):
            for pattern in self.buckets[key]:
                if text.startswith(self.patterns[pattern], start):
                    starts.append(start)
                    found.append(pattern)
        return np.array(starts, np.int64), np.array(found, np.int64)


class Search:
    """The windows of some benchmark items; short items, which are one window, are searched apart."""

    def __init__(self, items: list[tuple[str | None, str | None]], width: int = WINDOW_WORDS):
        self.width = width
        owners = defaultdict(set)
        for item, text in items:
            words = (text or "").encode().translate(WORD_BYTES).split()
            for first in range(max(len(words) - width + 1, 1) if words else 0):
                owners[b" " + b" ".join(words[first:first + width]) + b" "].add(item)
        groups = defaultdict(list)
        for pattern in sorted(owners):
            groups[0 if len(pattern) < 8 else 1 if pattern.count(b" ") <= width else 2].append(pattern)
        self.owners = [[sorted(i for i in owners[p] if i is not None) for p in groups[g]] for g in sorted(groups)]
        self.searchers = [Patterns(groups[g], 4 if g else 3) for g in sorted(groups)]

    def scan(self, texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, set]]:
        """For each text: how many words it has, which are hit, and the items found."""
        joined, begins = blank_words(texts)
        data = np.frombuffer(joined, np.uint8)
        firsts = np.flatnonzero((data[:-1] == 32) & (data[1:] > 32))
        bounds = np.searchsorted(firsts, begins)
        cover = np.zeros(len(firsts) + 1, np.int64)
        items: dict[int, set] = defaultdict(set)
        for searcher, owners in zip(self.searchers, self.owners):
            starts, patterns = searcher.find(joined)
            if len(starts):
                lengths = np.array([p.count(b" ") - 1 for p in searcher.patterns])
                word = np.searchsorted(firsts, starts)
                np.add.at(cover, word, 1)
                np.add.at(cover, word + lengths[patterns], -1)
                docs = np.searchsorted(begins, starts, side="right") - 1
                for doc, pattern in set(zip(docs.tolist(), patterns.tolist())):
                    items[doc].update(owners[pattern])
        hit = np.cumsum(cover[:-1]) > 0
        for doc in range(len(texts)):
            a, b = bounds[doc], bounds[doc + 1]
            yield int(b - a), np.flatnonzero(hit[a:b]), items.get(doc, set())


def _searcher(search):
    """Add one pass's hits to those of earlier passes; the last two columns are hit words and items."""

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = search.value
        for batch, texts in text_chunks(batches):
            words, hits, items = [], [], []
            earlier = zip(batch.column("hit").to_pylist(), batch.column("items").to_pylist())
            for (n, hit, seen), (old_hit, old_items) in zip(found.scan(texts), earlier):
                words.append(n)
                hits.append(np.union1d(hit, old_hit).astype(np.int32) if old_hit else hit.astype(np.int32))
                items.append(sorted(seen.union(old_items)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("text"), pa.array(words, pa.int64()),
                 pa.array(hits, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))],
                ["id", "text", "n_words", "hit", "items"],
            )

    return scan


def _finished(search):
    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _searcher(search)(batches):
            hits = [len(h) for h in batch.column("hit").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("n_words"), pa.array(hits, pa.int64()), batch.column("items")],
                ["id", "n_words", "n_hit", "items"],
            )

    return scan


def contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", width: int = WINDOW_WORDS, pass_bytes: int = PASS_BYTES,
) -> DataFrame:
    """``(id, n_words, n_hit, items, contaminated)`` for every row of ``docs``.

    Words are runs of letters, digits and non-ASCII characters, lower-cased (A-Z).  Every ``width``
    consecutive words of a benchmark item are a window; an item of fewer words is one window.  A document
    word inside any occurrence of a window is hit; ``items`` names the items with occurring windows,
    sorted as text.  A document is contaminated when it has a hit and at least one word in 20 is hit.

    The search is Wu-Manber: the hash of the bytes before a position gives how far it may
    jump; where it gives zero, a hash of the longer suffix selects the windows to compare.
    The benchmark is broadcast in slices of ``pass_bytes`` text, each a pass over
    the documents that adds to the hits of those before; more than one slice is written in between.

    A null or empty text has no words, neither in a document nor in an item.  A null item id hits words but
    is not named.  Repeated rows get equal results, repeated items count once.  Other columns are not read.
    """
    spark = docs.sparkSession
    kind = id_type(docs, id_col)
    found = docs.select(
        col(id_col).alias("id"), col(text_col).alias("text"),
        F.expr("CAST(array() AS array<int>)").alias("hit"), F.expr("CAST(array() AS array<string>)").alias("items"),
    )
    # two slices at most are in the driver: whether one is the last shows in the next
    slices = _slices(benchmark.select(col(item_col).cast("string"), col(item_text_col)), pass_bytes)
    items, following = next(slices), next(slices, None)
    while following is not None:
        search = spark.sparkContext.broadcast(Search(items, width))
        found = materialise(found.select("id", "text", "hit", "items").mapInArrow(
            _searcher(search), f"id {kind}, text string, n_words bigint, hit array<int>, items array<string>"
        ), "search")
        search.unpersist()
        items, following = following, next(slices, None)
    search = spark.sparkContext.broadcast(Search(items, width))
    found = found.select("id", "text", "hit", "items").mapInArrow(
        _finished(search), f"id {kind}, n_words bigint, n_hit bigint, items array<string>"
    )
    return found.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * HIT_SHARE >= F.col("n_words")))


def _slices(items: DataFrame, pass_bytes: int) -> Iterator[list[tuple]]:
    """The items in lists of about ``pass_bytes`` text, fetched a partition at a time; one empty list if there are none."""
    part, size, sent = [], 0, False
    for item, text in items.toLocalIterator():
        length = len(text or "") + 1
        if part and size + length > pass_bytes:
            yield part
            part, size, sent = [], 0, True
        part.append((item, text))
        size += length
    if part or not sent:
        yield part


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the contaminated ones, judged each by its own text; a row without an id, which can't be named, stays."""
    found = contamination(with_row(docs, id_col, text_col), benchmark, ROW, text_col, **options)
    return without_rows(docs, found.where("contaminated"), id_col, text_col)

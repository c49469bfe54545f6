"""Removal of byte strings that occur more than once, by suffix arrays of what may repeat.

A string of ``length`` bytes is dealt to the least hash of the shorter strings inside it (its key),
which depends on its bytes alone; so equal strings meet in one shard whatever documents they are
in.  Consecutive strings of one key are one record: the bytes they cover.  Keys that occur at
one place only can't hold a repeat and go no further.  The distinct records of the other keys
are joined by separators, and their suffixes sorted by ``suffix_sort``: a string repeats if
its suffix has ``length`` bytes in common with a neighbour, or its record stands at several places.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.suffix_sort import MEMORY, suffix_array
from lamina.llm.text import id_text
from lamina.session import materialise

LENGTH = 400
# Bytes whose hash is a candidate for the key of the strings around them.
ANCHOR = 100
# Records of about this many bytes are sorted at once; a key with more of them is a shard of its own.
SHARD_BYTES = 4 << 20
# Texts are cut into blocks of this many bytes; places in two of them fit the low bits of a number.
BLOCK = 1 << 20
PLACE_BITS = np.uint64(22)
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


class Keys:
    """Runs of equal keys in texts, a block at a time."""

    def __init__(self, length: int, anchor: int):
        self.length, self.anchor = length, min(anchor, length)
        self.powers = self.inverses = np.ones(1, np.uint64)

    def _grow(self, size: int) -> None:
        if len(self.powers) < size:
            self.powers, self.inverses = (
                np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(size - 1, b, np.uint64)])) for b in (BASE, INVERSE)
            )

    def _keys(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The key of the string at each place, and where it first is; void for strings that run on into the next text."""
        self._grow(len(data))
        total = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.powers[:len(data)])])
        hashes = (total[self.anchor:] - total[:-self.anchor]) * self.inverses[:len(data) - self.anchor + 1]
        hashes ^= hashes >> np.uint64(32)
        hashes *= np.uint64(0xFF51AFD7ED558CCD)
        hashes ^= hashes >> np.uint64(29)
        # least of ``width`` hashes and its first place: the end of one stretch and the beginning of the next
        width, found = self.length - self.anchor + 1, len(data) - self.length + 1
        rows = np.full(-(-len(hashes) // width) * width, ~np.uint64(0))
        rows[:len(hashes)] = hashes >> PLACE_BITS << PLACE_BITS | np.arange(len(hashes), dtype=np.uint64)
        rows = rows.reshape(-1, width)
        ahead = np.minimum.accumulate(rows, axis=1).ravel()
        back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(back[:found], ahead[width - 1:width - 1 + found])
        place = (least & ((np.uint64(1) << PLACE_BITS) - np.uint64(1))).view(np.int64)
        return hashes[place].view(np.int64), place

    def runs(self, texts: list[bytes]) -> tuple[np.ndarray, ...]:
        """Text number, key, first and last string of every run, and whether its key stands at two places in it.

        Without that the strings of one run all differ.  A text is cut at blocks.
        """
        empty = [np.zeros(0, np.int64)] * 5
        parts, pieces, held = [tuple(empty)], [], 0
        for number, text in enumerate(texts):
            for begin in range(0, len(text) - self.length + 1, BLOCK):
                piece = text[begin:begin + BLOCK + self.length - 1]
                pieces.append((number, begin, piece))
                held += len(piece)
                if held > BLOCK:
                    parts.append(self._of(pieces))
                    pieces, held = [], 0
        if pieces:
            parts.append(self._of(pieces))
        return tuple(np.concatenate(column) for column in zip(*parts))

    def _of(self, pieces: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, ...]:
        keys, place = self._keys(np.frombuffer(b"".join(p[2] for p in pieces), np.uint8))
        sizes = np.array([len(p[2]) for p in pieces])
        ends = np.cumsum(sizes)
        begins = ends - sizes
        change = np.zeros(len(keys) + 1, bool)
        change[1:-1] = keys[1:] != keys[:-1]
        change[begins] = True
        # strings that run into the next piece are no run
        stops = ends - self.length + 1
        change[stops] = True
        first = np.flatnonzero(change[:-1])
        last = np.append(first[1:], len(keys)) - 1
        piece = np.searchsorted(begins, first, "right") - 1
        good = first < stops[piece]
        first, last, piece = first[good], last[good], piece[good]
        shift = np.array([p[1] for p in pieces])[piece] - begins[piece]
        return np.array([p[0] for p in pieces])[piece], keys[first], first + shift, last + shift, place[first] != place[last]


def _binary(column: pa.Array) -> list[bytes]:
    return column.cast(pa.large_binary()).to_pylist()


def _anchors(docs: DataFrame, length: int, anchor: int) -> DataFrame:
    """``(digest, key, first, last, inner)`` of every run of every text."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = Keys(length, anchor)
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                text, key, first, last, inner = keys.runs(_binary(part.column("text")))
                yield pa.RecordBatch.from_arrays(
                    [part.column("digest").take(pa.array(text)), pa.array(key), pa.array(first), pa.array(last), pa.array(inner.astype(bool))],
                    ["digest", "key", "first", "last", "inner"],
                )

    long = docs.where(F.octet_length("text") >= length)
    return long.mapInArrow(cut, "digest binary, key bigint, first bigint, last bigint, inner boolean")


def _records(texts: DataFrame, length: int) -> DataFrame:
    """The bytes of every run, with a digest of their own."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for digest, text, runs in zip(
                batch.column("digest").to_pylist(), _binary(batch.column("text")), batch.column("runs").to_pylist()
            ):
                for begin in range(0, len(runs), 4096):
                    part = runs[begin:begin + 4096]
                    bodies = [text[r["first"]:r["last"] + length] for r in part]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([digest] * len(part), pa.binary()),
                            pa.array([r["first"] for r in part], pa.int64()),
                            pa.array([r["key"] for r in part], pa.int64()),
                            pa.array([hashlib.blake2b(b, digest_size=16).digest() for b in bodies], pa.binary()),
                            pa.array(bodies, pa.binary()),
                        ],
                        ["digest", "first", "key", "record", "body"],
                    )

    return texts.mapInArrow(cut, "digest binary, first bigint, key bigint, record binary, body binary")


def repeated_strings(bodies: list[bytes], copies: list[int], length: int, memory: int = MEMORY) -> list[np.ndarray]:
    """For each record the places whose string occurs again, in it or in another, or in a copy of it.

    The records are distinct; of each there are ``copies``.
    """
    symbols = np.empty(sum(map(len, bodies)) + len(bodies) + 1, np.int16)
    at, begins = 0, []
    for body in bodies:
        begins.append(at)
        symbols[at:at + len(body)] = np.frombuffer(body, np.uint8)
        symbols[at:at + len(body)] += 2
        symbols[at + len(body)] = 1
        at += len(body) + 1
    symbols[at] = 0
    places, shared = suffix_array(symbols, length, memory)
    same = shared >= length
    same[:-1] |= same[1:]
    # only strings without a separator have anything in common with a place that counts
    found = np.sort(places[same])
    begins = np.array(begins)
    cuts = np.searchsorted(found, np.append(begins, at))
    result = []
    for k, body in enumerate(bodies):
        inside = len(body) - length + 1
        own = found[cuts[k]:cuts[k + 1]] - begins[k]
        result.append(np.arange(inside) if copies[k] > 1 else own[own < inside])
    return result


def spans_of(places: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the stretches covered by strings at sorted ``places``."""
    if not len(places):
        return places, places
    cut = np.flatnonzero(np.diff(places) > length) + 1
    return places[np.concatenate([[0], cut])], places[np.append(cut - 1, len(places) - 1)] + length


def _repeats(records: DataFrame, length: int, shard_bytes: int, memory: int) -> DataFrame:
    """``(record, begins, ends)``: stretches of repeated strings in each distinct record that has any."""
    distinct = records.groupBy("key", "record", "body").agg(F.count(F.lit(1)).alias("copies"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, key = [], 0, None

        def flush():
            out = []
            for row, places in zip(held, repeated_strings([r[1] for r in held], [r[2] for r in held], length, memory)):
                if len(places):
                    begins, ends = spans_of(places, length)
                    out.append((row[0], begins.tolist(), ends.tolist()))
            for begin in range(0, len(out), 4096):
                columns = list(zip(*out[begin:begin + 4096]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[0], pa.binary())] + [pa.array(c, pa.list_(pa.int64())) for c in columns[1:]],
                    ["record", "begins", "ends"],
                )

        for batch in batches:
            for row in zip(*(batch.column(name).to_pylist() for name in ("key", "record", "body", "copies"))):
                # a shard ends with a key
                if size > shard_bytes and row[0] != key:
                    yield from flush()
                    held, size = [], 0
                key = row[0]
                held.append(row[1:])
                size += len(row[2])
        if held:
            yield from flush()

    dealt = distinct.repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(search, "record binary, begins array<bigint>, ends array<bigint>")


def _removed(texts: DataFrame) -> DataFrame:
    """``(digest, n_removed, n_spans, kept)`` of texts with their stretches."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for digest, text, spans in zip(
                batch.column("digest").to_pylist(), _binary(batch.column("text")), batch.column("spans").to_pylist()
            ):
                kept, at, removed, count = [], 0, 0, 0
                reach = -1
                for begin, end in sorted((s["begin"], s["end"]) for s in spans):
                    if begin > reach:
                        kept.append(text[at:begin])
                        count += 1
                        at = begin
                    if end > at:
                        removed += end - at
                        at = end
                    reach = at
                kept.append(text[at:])
                rows.append((digest, removed, count, b"".join(kept)))
            columns = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.binary()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.binary())],
                ["digest", "n_removed", "n_spans", "kept"],
            )

    return texts.mapInArrow(cut, "digest binary, n_removed bigint, n_spans bigint, kept binary")


def repeated_text(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, anchor: int = ANCHOR,
    shard_bytes: int = SHARD_BYTES, memory: int = MEMORY, with_text: bool = False,
) -> DataFrame:
    """``(id, n_bytes, n_removed, n_spans, kept_sha256)`` for every row, and ``kept`` (binary) if asked for.

    Every byte covered by a string of ``length`` bytes that also starts anywhere else, in the same
    text or another, goes; ``n_spans`` counts the maximal removed stretches.  Strings are bytes of UTF-8 and
    judged on the input.  A null text is empty; texts shorter than ``length`` stay whole.  Rows are
    kept apart whatever their id: null and repeated ids are rows like others.  Equal texts are searched
    once, and if there are several, all of each goes.  An empty table gives no rows; other columns
    don't matter.

    Plan: one pass over the texts for keys; counts of keys; one shuffle of the distinct texts to the runs
    of repeated keys; two of their records, by content and by key; one of the texts with repeats.
    A key with very many distinct records is one shard, whose arrays go to disk.
    """
    rows = id_text(docs, id_col, text_col).withColumn("text", F.col("text").cast("binary"))
    rows = rows.withColumn("digest", F.unhex(F.sha2("text", 256)))
    anchors = materialise(_anchors(rows, length, anchor), "anchors")
    place = F.xxhash64("digest", "first")
    keys = (
        anchors.groupBy("key").agg(F.min(place).alias("low"), F.max(place).alias("high"), F.max("inner").alias("inner"))
        .where("low <> high or inner").select("key")
    )
    runs = (
        anchors.join(keys, "key").select("digest", "key", "first", "last").distinct()
        .groupBy("digest").agg(F.collect_list(F.struct("key", "first", "last")).alias("runs"))
    )
    distinct = rows.where(F.octet_length("text") >= length).select("digest", "text").dropDuplicates(["digest"])
    texts = materialise(distinct.join(runs, "digest"), "texts")
    records = materialise(_records(texts, length), "records")
    repeats = materialise(_repeats(records, length, shard_bytes, memory), "repeats")
    spans = (
        records.select("digest", "first", "record").join(repeats, "record")
        .select("digest", "first", F.explode(F.arrays_zip("begins", "ends")).alias("s"))
        .groupBy("digest")
        .agg(F.collect_list(F.struct((F.col("first") + F.col("s.begins")).alias("begin"), (F.col("first") + F.col("s.ends")).alias("end"))).alias("spans"))
    )
    removed = _removed(texts.select("digest", "text").join(spans, "digest"))
    if not with_text:
        removed = removed.select("digest", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
    removed = materialise(removed, "removed")
    copies = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    n_bytes = F.octet_length("text").cast("bigint")
    light = rows.select("id", "digest", n_bytes.alias("n_bytes"), *(["text"] if with_text else []))
    found = light.join(removed, "digest", "left").join(copies, "digest", "left")
    whole = (F.col("copies") > 1) & (F.col("n_bytes") >= length)
    columns = [
        "id", "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("bigint").alias("n_removed"),
        F.when(whole, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("bigint").alias("n_spans"),
    ]
    if with_text:
        kept = F.when(whole, F.lit(b"")).otherwise(F.coalesce("kept", "text"))
        return found.select(*columns, F.sha2(kept, 256).alias("kept_sha256"), kept.alias("kept"))
    own = F.lower(F.hex("digest"))
    kept = F.when(whole, F.sha2(F.lit(b""), 256)).otherwise(F.coalesce("kept_sha256", own))
    return found.select(*columns, kept.alias("kept_sha256"))

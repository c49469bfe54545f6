"""Small helpers shared by the operators: column names, bounded chunks and word positions of text batches."""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.session import BROADCAST_ROWS, materialise

# Python workers look at about this much text at a time; a longer document is a chunk of its own.
CHUNK_BYTES = 4 << 20
# The separators of a word, and A-Z in lower case.
SPACES = b" \t\n\x0b\x0c\r"
BLANKS = np.isin(np.arange(256), list(SPACES))
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
# Lower-case bytes, every separator a blank.
WORD_TABLE = bytes(32 if b in SPACES else LOWER[b] for b in range(256))


def col(name: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def id_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns an operator reads, under names of its own; a null text is empty."""
    return docs.select(col(id_col).alias("id"), F.coalesce(col(text_col), F.lit("")).alias("text"))


ROW = "_lamina_row"


def with_row(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` and a column that names a row by its id and 128 bits of its text, ids first; null without an id."""
    text = F.coalesce(col(text_col), F.lit(""))
    bits = [F.xxhash64(F.lit(k), text, F.octet_length(text)) for k in (1, 2)]
    return docs.withColumn(ROW, F.when(col(id_col).isNotNull(), F.struct(col(id_col).alias("id"), bits[0].alias("a"), bits[1].alias("b"))))


def without_rows(docs: DataFrame, goes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` without the rows named in column ``id`` of ``goes``; rows without an id stay.

    Up to a checked number of names, 24 bytes and an id each, are broadcast, more meet the rows in a shuffle.
    """
    named = materialise(goes.select(F.col("id").alias("_goes")).where("_goes IS NOT NULL").distinct(), "goes")
    named = F.broadcast(named) if named.count() <= BROADCAST_ROWS else named
    return with_row(docs, id_col, text_col).join(named, F.col(ROW) == F.col("_goes"), "left_anti").drop(ROW)


def id_type(docs: DataFrame, id_col: str) -> str:
    return docs.schema[id_col].dataType.simpleString()


def column_chunks(batches: Iterable[pa.RecordBatch], limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``limit`` bytes of text each."""
    for batch in batches:
        lengths = pc.binary_length(batch.column(batch.schema.get_field_index("text")))
        begin, size = 0, 0
        for at, length in enumerate(np.asarray(lengths.fill_null(0)).tolist()):
            if size and size + length > limit:
                yield batch.slice(begin, at - begin)
                begin, size = at, 0
            size += length
        if begin < batch.num_rows:
            yield batch.slice(begin)
    give_back()


def give_back() -> None:
    """What a task has used goes back to the system before the worker waits for the next one."""
    pa.default_memory_pool().release_unused()
    # the C library keeps freed arrays unless it is asked; where it can't be asked it may have kept them
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def text_chunks(batches: Iterable[pa.RecordBatch], limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with their texts as bytes, a null text as no bytes."""
    for batch in column_chunks(batches, limit):
        texts = batch.column(batch.schema.get_field_index("text")).cast(pa.large_binary())
        yield batch, [t or b"" for t in texts.to_pylist()]


def blank_separated(texts: pa.Array) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """The pieces of texts between blanks: numbers into the distinct ones, those, and how many each text has."""
    column = texts.fill_null("").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
    offsets = offsets - offsets[0]
    inside = ~BLANKS[data]
    # a piece ends at a blank or with its text
    breaks = np.r_[True, ~inside]
    breaks[offsets] = True
    starts = np.flatnonzero(inside & breaks[:-1])
    breaks = np.r_[~inside, True]
    breaks[offsets] = True
    ends = np.flatnonzero(inside & breaks[1:]) + 1
    bounds = np.r_[0, np.cumsum(ends - starts)]
    packed = pa.Array.from_buffers(
        pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(data[inside])]
    )
    coded = packed.dictionary_encode()
    _, cuts, raw = coded.dictionary.buffers()
    raw, cuts = raw.to_pybytes() if raw else b"", np.frombuffer(cuts, np.int64)[: len(coded.dictionary) + 1].tolist()
    distinct = [raw[a:b] for a, b in zip(cuts, cuts[1:])]
    return np.asarray(coded.indices, dtype=np.int64), distinct, np.diff(np.searchsorted(starts, offsets))


class Words:
    """Word positions of some documents in one byte string, in which words stand one blank apart."""

    def __init__(self, texts: list[bytes], table: bytes = WORD_TABLE):
        joined = (b" " + b" ".join(texts) + b" ").translate(table)
        data = np.frombuffer(joined, np.uint8)
        blank = data == 32
        edges = np.flatnonzero(blank[1:] != blank[:-1]) + 1
        starts, ends = edges[0::2], edges[1::2]
        bounds = np.cumsum([1] + [len(t) + 1 for t in texts])
        # bounds[d]: index of the first word of document d
        self.bounds = np.searchsorted(starts, bounds)
        lengths = ends - starts
        if starts.size and int(blank.sum()) != starts.size + 1:
            keep = ~blank
            keep[ends] = True
            joined = b" " + data[keep].tobytes()
            ends = np.cumsum(lengths + 1)
            starts = ends - lengths
        self.data, self.starts, self.ends = joined, starts, ends

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)


def ragged(counts: np.ndarray) -> np.ndarray:
    """0..counts[0]-1, 0..counts[1]-1, ... in one array."""
    ends = np.cumsum(counts)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - counts, counts)

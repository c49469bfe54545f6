"""Rows with rows of a numbered table that each of them draws, by blocks of rows instead of single ones.

A row's draws are a hash of its id, so whoever has the hash knows them: a block of rows asks each chunk of
the numbered table for the rows it draws there by their place in the chunk, and the answers come back in the order
asked.  Between tasks goes one record for a block and chunk, some bytes for a draw, and no row is repeated.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamina.session import materialise

# Rows of a chunk, numbers that it or a block of rows holds at most, and bytes of an answer that blocks are sized for.
CHUNK_ROWS = 1 << 16
CHUNK_NUMBERS = 1 << 21
ANSWER_BYTES = 1600
_P = [np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]


def hash_int(value: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """Spark's ``xxhash64`` of one more integer, the hash of the columns before it being the seed."""
    h = (np.atleast_1d(value).astype(np.int64) & 0xFFFFFFFF).astype(np.uint64) * _P[0] ^ (seed.view(np.uint64) + (_P[4] + np.uint64(4)))
    h = (h << np.uint64(23) | h >> np.uint64(41)) * _P[1] + _P[2]
    h ^= h >> np.uint64(33)
    h *= _P[1]
    h ^= h >> np.uint64(29)
    h *= _P[2]
    h ^= h >> np.uint64(32)
    return h.view(np.int64)


class Sizes(NamedTuple):
    total: int
    draws: int
    width: int
    kind: np.dtype
    chunk: int
    rows: int


def sizes(total: int, draws: int, width: int, kind: np.dtype) -> Sizes:
    chunk = min(CHUNK_ROWS, max(1024, CHUNK_NUMBERS // width))
    lines = max(1, ANSWER_BYTES // (width * kind.itemsize)) * -(-total // chunk)
    rows = min(max(1024, lines // draws), max(1, CHUNK_NUMBERS // (draws * (width + 1))))
    return Sizes(total, draws, width, kind, chunk, rows)


def _binary(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Binary cells that lie one after another in ``data``; ``ends`` are in bytes, the first is 0."""
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def _picked(pick: np.ndarray, size: Sizes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per block: the lines in the order of chunks, each line's chunk and its place there in that order."""
    rows = hash_int(np.arange(size.draws), pick[:, None]).ravel() % size.total
    chunk = rows // size.chunk
    order = np.argsort(chunk, kind="stable")
    return order, chunk[order], (rows % size.chunk)[order]


def _runs(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin, and the end."""
    return np.concatenate([[0], np.flatnonzero(values[1:] != values[:-1]) + 1, [len(values)]]) if len(values) else np.zeros(1, int)


def _matrix(cells: pa.Array, n: int) -> np.ndarray:
    flat = cells.flatten()
    return np.asarray(flat, dtype=float).reshape(n, -1)


def with_drawn(
    own: DataFrame, row_id: str, table: DataFrame, total: int, draws: int, width: int, seed: int,
    codes: Callable[[np.ndarray], np.ndarray], kind: np.dtype, compute: Callable, columns: str, seeds: Sequence[int],
) -> tuple[DataFrame, int]:
    """``row_id``, ``_same`` (rows of its id) and the arrays that ``compute`` makes, a row each of ``own``; and the rows whose id others have too.

    ``own`` has ``row_id`` and ``_x array<double>``, ``table`` has ``_i`` from 0 to ``total`` - 1 and ``_x``.  Row r draws the rows
    ``pmod(xxhash64(seed, row_id, m), total)`` for m below ``draws``.  ``compute(x, z, h)`` gets the codes of some rows, those of the rows drawn and
    ``xxhash64(s, row_id)`` for each of ``seeds``, which :func:`hash_int` goes on from.
    """
    id_type = own.schema[row_id].dataType.simpleString()
    size = sizes(total, draws, width, kind)
    place_kind = np.min_scalar_type(size.chunk - 1)
    hashes = [F.xxhash64(F.lit(s), row_id).alias(f"_h{k}") for k, s in enumerate((seed, *seeds))]
    named = own.select(F.col(row_id).alias("_id"), "_x", *hashes).withColumn("_same", F.count(F.lit(1)).over(Window.partitionBy("_id")))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made, held, n = TaskContext.get().partitionId(), 0, [], 0

        def block(rows: pa.RecordBatch) -> pa.RecordBatch:
            count = rows.num_rows
            numbers = [np.ascontiguousarray(rows.column(k)) for k in range(2, rows.num_columns)]
            pick, same = numbers[0], int((numbers[-1] > 1).sum())
            order, chunk, place = _picked(pick, size)
            begins = _runs(chunk)
            data = np.concatenate([
                codes(_matrix(rows.column(1), count)).view(np.uint8).ravel(), *[a.view(np.uint8) for a in numbers], place.astype(place_kind).view(np.uint8),
            ])
            head = count * (size.width * kind.itemsize + 8 * len(numbers))
            ends = np.concatenate([[0], head + begins * place_kind.itemsize])
            ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.full(len(begins), count)]), pa.int32()), rows.column(0))
            chunks = np.concatenate([[-1], chunk[begins[:-1]]]).astype(np.int32)
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(chunks), task << 32 | made)), pa.array(chunks), ids, _binary(data, ends), pa.array(np.where(chunks < 0, same, 0))],
                ["src", "chunk", "ids", "data", "same"],
            )

        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, size.rows - n)
                batch, n = batch.slice(part.num_rows), n + part.num_rows
                held.append(part)
                if n == size.rows:
                    yield block(_joined(held))
                    made, held, n = made + 1, [], 0
        if n:
            yield block(_joined(held))

    stored = materialise(named.mapInArrow(blocks, f"src bigint, chunk int, ids array<{id_type}>, data binary, same bigint"), "drawn")
    repeated = stored.where("chunk < 0").agg(F.coalesce(F.sum("same"), F.lit(0))).first()[0]

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            at = np.asarray(batch.column(0))
            order = np.argsort(at // size.chunk, kind="stable")
            chunk = (at // size.chunk)[order]
            begins = _runs(chunk)
            kept = codes(_matrix(batch.column(1), batch.num_rows))[order]
            places = (at % size.chunk)[order].astype(np.uint32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(begins) - 1, -1)), pa.array(chunk[begins[:-1]].astype(np.int32)),
                 _binary(places, begins * 4), _binary(kept, begins * size.width * kind.itemsize)],
                ["src", "chunk", "at", "data"],
            )

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, now = np.zeros((size.chunk, size.width), kind), -1
        for batch in batches:
            sources, chunks = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            places, data = batch.column(2), batch.column(3)
            begins = _runs(chunks)
            for begin, end in zip(begins[:-1], begins[1:]):
                now = chunks[begin]
                first = begin
                while first < end and sources[first] < 0:
                    known[np.frombuffer(places[first].as_py(), np.uint32)] = np.frombuffer(data[first].as_py(), kind).reshape(-1, size.width)
                    first += 1
                # answers of some megabytes at a time
                while first < end:
                    last = min(end, first + 1024)
                    part = data.slice(first, last - first)
                    ends = np.frombuffer(part.buffers()[1], np.int32)[part.offset:part.offset + len(part) + 1].astype(np.int64)
                    asked = np.frombuffer(part.buffers()[2], np.uint8)[ends[0]:ends[-1]].view(place_kind)
                    lines = (ends - ends[0]) // place_kind.itemsize
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(sources[first:last]), pa.array(np.full(last - first, now, np.int32)),
                         _binary(known[asked], lines * size.width * kind.itemsize)],
                        ["src", "chunk", "data"],
                    )
                    first = last

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, data, answers, now = None, b"", [], None

        def done() -> Iterator[pa.RecordBatch]:
            n = len(ids)
            x = np.frombuffer(data, kind, n * size.width).reshape(n, size.width)
            pick, *own_hashes, same = np.frombuffer(data, np.uint8)[n * size.width * kind.itemsize:].copy().view(np.int64).reshape(-1, n)
            drawn = np.frombuffer(b"".join(answers), kind).reshape(-1, size.width)
            z = np.empty_like(drawn)
            z[_picked(pick, size)[0]] = drawn
            arrays = [
                pa.FixedSizeListArray.from_arrays(pa.array(a.ravel()), a.shape[1]).cast(pa.list_(pa.float64()))
                for a in compute(x, z.reshape(n, size.draws, size.width), own_hashes)
            ]
            yield pa.RecordBatch.from_arrays([ids, pa.array(same), *arrays], [row_id, "_same", *names])

        for batch in batches:
            sources, chunks = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            for i in range(batch.num_rows):
                if chunks[i] < 0:
                    if ids is not None:
                        yield from done()
                    ids, data, answers, now = batch.column(2)[i].values, batch.column(3)[i].as_py(), [], sources[i]
                    continue
                assert sources[i] == now
                answers.append(batch.column(3)[i].as_py())
        if ids is not None:
            yield from done()

    names = columns.split(",")
    empty = F.lit(None).cast("binary")
    background = table.select("_i", "_x").mapInArrow(packed, "src bigint, chunk int, at binary, data binary")
    asked = stored.where("chunk >= 0").select("src", "chunk", empty.alias("at"), "data")
    answers = background.unionByName(asked).repartition("chunk").sortWithinPartitions("chunk", "src").mapInArrow(answer, "src bigint, chunk int, data binary")
    rows = stored.where("chunk < 0").select("src", "chunk", "ids", "data")
    back = answers.select("src", "chunk", F.lit(None).cast(f"array<{id_type}>").alias("ids"), "data")
    schema = f"`{row_id}` {id_type}, _same bigint, " + ", ".join(f"{c} array<double>" for c in names)
    return rows.unionByName(back).repartition("src").sortWithinPartitions("src", "chunk").mapInArrow(finish, schema), repeated


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(parts).combine_chunks().to_batches()[0]

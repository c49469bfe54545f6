"""Token ids in an entropy-coded file format: a static range asymmetric numeral system over independent blocks.

A store is a folder of two Parquet tables.  ``frequencies`` (token, frequency) is shared by all
blocks; the frequencies sum to 2 ** 20.  A row of ``blocks`` holds whole documents in ascending id order,
about ``BLOCK_TOKENS`` tokens of them:

* ``shard``, ``offset``: shards follow each other in id order; tokens of the shard before the block;
* ``ids``, ``lengths``: the documents and their token counts, end token included;
* ``lanes``, ``n_tokens``: token i is on lane i mod lanes at step i div lanes;
* ``words``: the coder's 32-bit words, little endian, for each step those of its lanes in order;
* ``checkpoints``: every ``CHECKPOINT_STEPS`` steps the 64-bit states of all lanes, and ``places``,
  the number of words before, so that the stretches of a block decode side by side;
* ``crc32`` of words and checkpoints.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import accumulate
from operator import attrgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm.text import CHUNK_BYTES, blank_separated, column_chunks, id_text, id_type
from lamina.llm.token_count import byte_letters, merges
from lamina.session import discard, scratch_path

END_ID = 2
BLOCK_TOKENS = 1 << 20
LANES = 1024
CHECKPOINT_STEPS = 256
TOTAL_BITS = 20
LOW = np.uint64(1 << 31)
# Pieces whose ids a worker remembers, and twice as many words; the quarter met least goes beyond them, which changes time only.
CACHE_PIECES = 1 << 18


class Known:
    """Token ids of strings, by number; of many strings those asked for least are forgotten, lately counting more."""

    def __init__(self, most: int):
        self.most, self.numbers = most, {}
        self.ids, self.starts, self.sizes, self.used = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def add(self, names: list, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Remember strings in order of their numbers; those numbered already aren't named."""
        count = len(self.sizes)
        self.numbers.update(zip(names, range(count, count + len(names))))
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(sizes) - sizes])
        self.ids, self.sizes = np.concatenate([self.ids, ids]), np.concatenate([self.sizes, sizes])
        self.used = np.concatenate([self.used, np.zeros(len(sizes))])

    def of(self, which: np.ndarray, other: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of strings one after the other, and how many each has; number -1 stands for the id ``other``."""
        known = self.ids if other is None else np.append(self.ids, np.uint32(other))
        starts, sizes = np.append(self.starts, len(self.ids)), np.append(self.sizes, 1)
        # the number after the last stands for -1, which is counted first
        self.used += np.bincount(which + 1, minlength=len(self.used) + 1)[1:]
        starts, sizes = starts[which], sizes[which]
        at = np.repeat(starts - np.cumsum(sizes) + sizes, sizes)
        at += np.arange(len(at))
        return known[at], sizes

    def age(self) -> None:
        self.used *= 0.75
        if len(self.sizes) <= self.most:
            return
        keep = np.sort(np.argpartition(-self.used, self.most * 3 // 4)[: self.most * 3 // 4])
        # the first one may have a meaning of its own
        keep = np.concatenate([[0], keep[keep > 0]])
        used = self.used[keep]
        ids, sizes = self.of(keep)
        names = list(self.numbers)
        self.numbers = {names[k]: i for i, k in enumerate(keep.tolist())}
        self.ids, self.sizes, self.starts, self.used = ids, sizes, np.cumsum(sizes) - sizes, used


class Encoder:
    """Token ids of texts by the tokenizers library, each distinct word encoded once.

    The tokenizer drops white space and no pre-token or special token contains any, so the
    ids of a text are those of its blank-separated pieces in order.  The library's model encodes the
    pre-tokens of a new piece; a piece that may hold a special token goes through the whole tokenizer.
    """

    def __init__(self, path: str, cache_pieces: int = CACHE_PIECES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.merges = self.tokenizer.model, merges(path)
        self.letters = {b: c for b, c in enumerate(byte_letters())}
        self.words, self.pieces = Known(2 * cache_pieces), Known(cache_pieces)
        # what pre-tokens put behind a piece has no ids
        self.words.add(["\n"], np.zeros(0, np.uint32), np.zeros(1, np.int64))

    def _words(self, found: list[str]) -> np.ndarray:
        """Numbers of pre-tokens among the known words; new ones are learned from the library's model."""
        known, tokenize, ident = self.words.numbers, self.model.tokenize, attrgetter("id")
        ids, sizes = [], []
        for word in set(found).difference(known):
            # visible ASCII letters spell themselves
            plain = word.isascii() and word.isprintable()
            tokens = tokenize(word if plain else word.encode().decode("latin-1").translate(self.letters))
            ids.extend(map(ident, tokens))
            sizes.append(len(tokens))
            known[word] = len(known)
        self.words.add([], np.array(ids, np.uint32), np.array(sizes, np.int64))
        return np.fromiter(map(known.__getitem__, found), np.int64, len(found))

    def learn(self, pieces: list[bytes]) -> np.ndarray:
        """Numbers of the pieces among the known ones."""
        numbers = self.pieces.numbers
        fresh = [p for p in pieces if p not in numbers]
        marked = [p for p in fresh if b"<|" in p]
        plain = [p for p in fresh if b"<|" not in p] if marked else fresh
        if plain:
            at = self._words(self.merges.pre_tokens(plain))
            own, sizes = self.words.of(at)
            self.pieces.add(plain, own, np.diff(np.cumsum(sizes)[at == 0], prepend=0))
        if marked:
            encoded = self.tokenizer.encode_batch([p.decode("utf-8", "replace") for p in marked], add_special_tokens=False)
            ids = np.array([i for e in encoded for i in e.ids], np.uint32)
            self.pieces.add(marked, ids, np.array([len(e.ids) for e in encoded]))
        return np.fromiter(map(numbers.__getitem__, pieces), np.int64, len(pieces))

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids, each text followed by the end id, and how many each text has."""
        which, distinct, pieces = blank_separated(texts)
        which = self.learn(distinct)[which]
        # the end of a text is one more piece of one id
        ends = np.cumsum(pieces)
        out, sizes = self.pieces.of(np.insert(which, ends, -1), end_id)
        totals = np.cumsum(sizes)[ends + np.arange(len(ends))]
        self.pieces.age()
        self.words.age()
        return out, np.diff(np.r_[0, totals])


@lru_cache(maxsize=2)
def encoder(path: str, cache_pieces: int = CACHE_PIECES) -> Encoder:
    """One encoder for all tasks of a worker process."""
    return Encoder(path, cache_pieces)


def _tokeniser(path: str, end_id: int, chunk_bytes: int = CHUNK_BYTES, cache_pieces: int = CACHE_PIECES):
    def tokenise(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in column_chunks(batches, chunk_bytes):
            ids, counts = encoder(path, cache_pieces).encode(batch.column(1), end_id)
            raw, ends = ids.astype("<u4"), np.cumsum(counts)
            parts = [_packed(raw[e - c:e]) for e, c in zip(ends.tolist(), counts.tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts), pa.array(parts, pa.binary())], ["id", "n_tokens", "ids"]
            )

    return tokenise


def _packed(ids: np.ndarray) -> bytes:
    """Two bytes an id where that is enough, four otherwise; the first byte tells which."""
    return b"\2" + ids.astype("<u2").tobytes() if int(ids.max()) < 1 << 16 else b"\4" + ids.tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u2" if data[0] == 2 else "<u4", offset=1).astype(np.uint32)


def _token_totals(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals = np.zeros(0, np.int64)
    for batch in batches:
        for data in batch.column(0).to_pylist():
            seen = np.bincount(_unpacked(data), minlength=len(totals))
            seen[: len(totals)] += totals
            totals = seen
    tokens = np.flatnonzero(totals)
    yield pa.RecordBatch.from_arrays([pa.array(tokens), pa.array(totals[tokens])], ["token", "count"])


def scaled(counts: np.ndarray) -> np.ndarray:
    """Positive frequencies that sum to 2 ** 20, in proportion to the counts as far as whole numbers go."""
    total = 1 << TOTAL_BITS
    if len(counts) > total // 2:
        raise ValueError("at most 2 ** 19 different tokens can be coded")
    if len(counts) == 1:
        return np.array([total])
    spare = total - len(counts)
    exact = counts * (spare / counts.sum())
    result = np.floor(exact).astype(np.int64)
    left = spare - int(result.sum())
    order = np.argsort(result - exact, kind="stable")
    result[order[:left]] += 1
    return result + 1


class Coder:
    """Codes and decodes blocks with one frequency table."""

    def __init__(self, tokens: np.ndarray, frequencies: np.ndarray):
        self.tokens = tokens.astype(np.int64)
        self.freq = frequencies.astype(np.uint64)
        self.before = np.cumsum(self.freq) - self.freq
        self.symbol = np.zeros(int(tokens.max()) + 1, np.int64)
        self.symbol[self.tokens] = np.arange(len(tokens))
        self._slots = None

    def encode(self, ids: np.ndarray) -> dict:
        lanes = max(1, min(LANES, len(ids) // 64))
        steps = -(-len(ids) // lanes)
        symbols = self.symbol[ids]
        freq, before = self.freq[symbols], self.before[symbols]
        state = np.full(lanes, LOW, np.uint64)
        bits, mask, top = np.uint64(TOTAL_BITS), np.uint64(0xFFFFFFFF), np.uint64(63 - TOTAL_BITS)
        words, checkpoints = [], []
        for step in range(steps - 1, -1, -1):
            f, c = freq[step * lanes:(step + 1) * lanes], before[step * lanes:(step + 1) * lanes]
            x = state[: len(f)]
            # a frequency of 2 ** 20 can only be a table of one token, which needs no words
            full = (x >> top) >= f
            words.append((x[full] & mask).astype("<u4"))
            x[full] >>= np.uint64(32)
            q = x // f
            state[: len(f)] = (q << bits) + (x - q * f) + c
            if step % CHECKPOINT_STEPS == 0:
                checkpoints.append(state.copy())
        words.reverse()
        places = np.r_[0, np.cumsum([len(w) for w in words])][:-1][::CHECKPOINT_STEPS] if steps else np.zeros(0, np.int64)
        data = b"".join(w.tobytes() for w in words)
        states = b"".join(s.astype("<u8").tobytes() for s in reversed(checkpoints))
        return {"lanes": lanes, "n_tokens": len(ids), "words": data, "checkpoints": states,
                "places": places.tolist(), "crc32": zlib.crc32(states, zlib.crc32(data))}

    def slots(self) -> np.ndarray:
        if self._slots is None:
            self._slots = np.repeat(np.arange(len(self.freq), dtype=np.int32), self.freq.astype(np.int64))
        return self._slots

    def decode(self, block: dict) -> np.ndarray:
        """The ids of a block; all stretches between checkpoints advance together."""
        lanes, n = block["lanes"], block["n_tokens"]
        if zlib.crc32(block["checkpoints"], zlib.crc32(block["words"])) != block["crc32"]:
            raise ValueError("a block of tokens does not have its checksum")
        steps = -(-n // lanes)
        words = np.frombuffer(block["words"], "<u4").astype(np.uint64)
        words = np.r_[words, np.uint64(0)]
        state = np.frombuffer(block["checkpoints"], "<u8").astype(np.uint64).reshape(-1, lanes)
        place = np.array(block["places"], np.int64)
        out = np.zeros((len(state) * CHECKPOINT_STEPS, lanes), np.int64)
        bits, low = np.uint64(TOTAL_BITS), np.uint64((1 << TOTAL_BITS) - 1)
        slots, lane, stretch = self.slots(), np.arange(lanes), np.arange(len(state))
        for step in range(min(steps, CHECKPOINT_STEPS)):
            at = stretch * CHECKPOINT_STEPS + step
            # only the last stretch may have ended, and its last step may miss lanes
            active = ((at * lanes)[:, None] + lane) < n
            slot = state & low
            symbol = slots[slot.astype(np.int64)]
            out[at] = symbol
            fresh = self.freq[symbol] * (state >> bits) + slot - self.before[symbol]
            short = (fresh < LOW) & active
            ranks = np.cumsum(short, axis=1)
            next_words = words[np.minimum(place[:, None] + ranks - 1, len(words) - 1)]
            fresh = np.where(short, fresh << np.uint64(32) | next_words, fresh)
            state = np.where(active, fresh, state)
            place = place + ranks[:, -1]
        return self.tokens[out.reshape(-1)[:n]]


BLOCK_FIELDS = (
    "offset bigint, lengths array<int>, lanes int, n_tokens int, words binary, checkpoints binary, places array<int>, crc32 bigint"
)


def _block_writer(coder, id_arrow: pa.DataType, block_tokens: int):
    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, shard, offset = coder.value, None, 0
        ids, parts, size = [], [], 0

        def block() -> pa.RecordBatch:
            coded = code.encode(np.concatenate(parts))
            row = {"shard": shard, "ids": ids, "offset": offset, "lengths": [len(p) for p in parts], **coded}
            return pa.RecordBatch.from_pylist([row], schema=_block_schema(id_arrow))

        for batch in batches:
            for number, name, data in zip(*(batch.column(i).to_pylist() for i in range(3))):
                shard = number
                tokens = _unpacked(data)
                if parts and size + len(tokens) > block_tokens:
                    yield block()
                    offset += size
                    ids, parts, size = [], [], 0
                ids.append(name)
                parts.append(tokens)
                size += len(tokens)
        if parts:
            yield block()

    return write


def _block_schema(id_arrow: pa.DataType) -> pa.Schema:
    return pa.schema([
        ("shard", pa.int32()), ("ids", pa.list_(id_arrow)), ("offset", pa.int64()), ("lengths", pa.list_(pa.int32())),
        ("lanes", pa.int32()), ("n_tokens", pa.int32()), ("words", pa.binary()), ("checkpoints", pa.binary()),
        ("places", pa.list_(pa.int32())), ("crc32", pa.int64()),
    ])


def write_tokens(
    docs: DataFrame, path: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
    end_id: int = END_ID, block_tokens: int = BLOCK_TOKENS, chunk_bytes: int = CHUNK_BYTES, cache_pieces: int = CACHE_PIECES,
) -> None:
    """Write the token ids of all texts to a store at ``path``, in ascending id order.

    Every text is encoded and gets ``end_id``; the ids are written once to the shared folder.  A count of
    all tokens, at most one row per vocabulary entry, gives the table that is broadcast; then the ids
    are dealt out by ranges of document id and each task codes its range in blocks.  A worker encodes about
    ``chunk_bytes`` of text at a time, which needs many times that in memory, and remembers
    ``cache_pieces`` pieces; less takes more time.

    The tokenizer file must be where ``tokenizer_path`` says on every node.  A null text is empty and has the end
    id alone.  Null ids come first; rows that share an id stand next to each other and are not joined.  An empty table
    gives a store without blocks.  Other columns are not stored.
    """
    spark = docs.sparkSession
    kind = id_type(docs, id_col)
    scratch = scratch_path(spark, "token_ids")
    id_text(docs, id_col, text_col).mapInArrow(
        _tokeniser(tokenizer_path, end_id, chunk_bytes, cache_pieces), f"id {kind}, n_tokens bigint, ids binary"
    ).write.option("compression", "zstd").parquet(scratch)
    encoded = spark.read.parquet(scratch)
    totals = encoded.select("ids").mapInArrow(_token_totals, "token bigint, count bigint")
    totals = totals.groupBy("token").agg(F.sum("count").alias("count")).orderBy("token").toArrow()
    tokens, counts = (totals.column(i).to_numpy() for i in (0, 1))
    frequencies = scaled(counts) if len(counts) else counts
    spark.createDataFrame(
        list(zip(tokens.tolist(), frequencies.tolist())), "token bigint, frequency bigint"
    ).coalesce(1).write.parquet(f"{path}/frequencies")
    coder = spark.sparkContext.broadcast(Coder(tokens, frequencies) if len(tokens) else None)
    id_arrow = encoded.select("id").limit(0).toArrow().schema.field(0).type
    ordered = encoded.repartitionByRange("id").sortWithinPartitions("id", "n_tokens", "ids")
    ordered.select(F.spark_partition_id().alias("shard"), "id", "ids").mapInArrow(
        _block_writer(coder, id_arrow, block_tokens), f"shard int, ids array<{kind}>, {BLOCK_FIELDS}"
    ).write.option("compression", "uncompressed").parquet(f"{path}/blocks")
    discard(spark, scratch)


def _blocks(spark: SparkSession, path: str) -> tuple[DataFrame, Coder | None]:
    """Blocks with ``start``, the tokens of all documents before them, and the decoder."""
    table = spark.read.parquet(f"{path}/frequencies").orderBy("token").toArrow()
    coder = Coder(table.column(0).to_numpy(), table.column(1).to_numpy()) if table.num_rows else None
    blocks = spark.read.parquet(f"{path}/blocks")
    # one row per shard, as many as the writer had tasks
    shards = blocks.groupBy("shard").agg(F.sum("n_tokens").alias("n")).orderBy("shard").collect()
    begins = list(accumulate([r["n"] for r in shards], initial=0))
    starts = spark.createDataFrame([(r["shard"], b) for r, b in zip(shards, begins)], "shard int, _begin bigint")
    placed = blocks.join(F.broadcast(starts), "shard").withColumn("start", F.col("_begin") + F.col("offset"))
    return placed.select(
        "ids", "start", "lengths", "lanes", "n_tokens", "words", "checkpoints", "places", "crc32"
    ), coder


def _reader(coder, with_ids: bool, id_arrow: pa.DataType):
    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                block = batch.slice(at, 1).to_pylist()[0]
                tokens = coder.value.decode(block)
                lengths = np.array(block["lengths"], np.int64)
                ends = np.cumsum(lengths)
                columns = [pa.array(block["ids"], id_arrow), pa.array(block["start"] + ends - lengths), pa.array(lengths)]
                names = ["id", "start", "n_tokens"]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), pa.array(tokens)))
                else:
                    raw = tokens.astype("<u4")
                    sums = [zlib.crc32(raw[e - n:e]) for e, n in zip(ends.tolist(), lengths.tolist())]
                    columns.append(pa.array(sums, pa.int64()))
                yield pa.RecordBatch.from_arrays(columns, [*names, "ids" if with_ids else "ids_crc32"])

    return read


def _read(spark: SparkSession, path: str, with_ids: bool) -> DataFrame:
    blocks, coder = _blocks(spark, path)
    kind = blocks.schema["ids"].dataType.elementType.simpleString()
    id_arrow = blocks.select("ids").limit(0).toArrow().schema.field(0).type.value_type
    last = "ids array<bigint>" if with_ids else "ids_crc32 bigint"
    return blocks.mapInArrow(
        _reader(spark.sparkContext.broadcast(coder), with_ids, id_arrow), f"id {kind}, start bigint, n_tokens bigint, {last}"
    )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``(id, start, n_tokens, ids)`` of a store: the decoded ids and the tokens of all documents before."""
    return _read(spark, path, True)


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """``(id, start, n_tokens, ids_crc32)``: decoded as by ``read_tokens``, the CRC-32 in place of the ids."""
    return _read(spark, path, False)

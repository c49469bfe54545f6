"""SimHash near-dedup: fingerprints of word shingles, exact comparison in tiles of equal population counts."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.llm.components import components
from lamina.llm.text import ROW, Words, col, id_text, id_type, ragged, text_chunks, with_row, without_rows
from lamina.session import materialise

RADIUS = 2
SHINGLE_WORDS = 3
HASH_SEED = 42
# A fingerprint's tile is the population count of each of these 16-bit parts.
PARTS = 4
# Rows of a tile that are compared as one block, and the columns compared at once.
BLOCK_ROWS = 8192
TILE_COLUMNS = 2048
# Shingles whose bits are counted at once.
BIT_ROWS = 1 << 17


def fingerprint_texts(texts: list[bytes], width: int = SHINGLE_WORDS) -> np.ndarray:
    """One unsigned 64-bit SimHash per text; zero for a text without words."""
    words = Words(texts)
    counts = words.counts
    shingles = np.where(counts > 0, np.maximum(counts - width + 1, 1), 0)
    first = np.repeat(words.bounds[:-1], shingles) + ragged(shingles)
    last = np.minimum(first + width, np.repeat(words.bounds[1:], shingles)) - 1
    data, digest = words.data, xxhash.xxh64_intdigest
    out = np.zeros(len(texts), np.uint64)
    ends = np.cumsum(shingles)
    ones = np.zeros((len(texts), 64), np.int64)
    owner = np.repeat(np.arange(len(texts)), shingles)
    for begin in range(0, len(first), BIT_ROWS):
        part = slice(begin, begin + BIT_ROWS)
        spans = zip(words.starts[first[part]].tolist(), words.ends[last[part]].tolist())
        hashes = np.array([digest(data[a:b], HASH_SEED) for a, b in spans], dtype="<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        docs = owner[part]
        cuts = np.flatnonzero(np.r_[True, docs[1:] != docs[:-1]])
        ones[docs[cuts]] += np.add.reduceat(bits, cuts, axis=0, dtype=np.int64)
    major = ones * 2 > (ends - np.r_[0, ends[:-1]])[:, None]
    out |= np.bitwise_or.reduce(np.where(major, np.uint64(1) << np.arange(64, dtype=np.uint64), np.uint64(0)), axis=1)
    return out


def _fingerprint_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in text_chunks(batches):
        found = pa.array(fingerprint_texts(texts).view(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column(0), found], ["id", "fingerprint"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fingerprint)``: the 64 bits as a signed long, one row per row of ``docs``."""
    return id_text(docs, id_col, text_col).mapInArrow(
        _fingerprint_batches, f"id {id_type(docs, id_col)}, fingerprint bigint"
    )


def _offsets(radius: int) -> list[int]:
    """Keys from a tile to those after it whose counts differ by at most ``radius`` in all."""
    near = [d for d in product(range(-radius, radius + 1), repeat=PARTS) if 0 < sum(map(abs, d)) <= radius]
    return [sum(x << 5 * (PARTS - 1 - i) for i, x in enumerate(d)) for d in near if d > (0,) * PARTS]


def _tile() -> Column:
    """Counts of the parts in one number, 5 bits each and 4 off zero, so that neighbours never alias."""
    key = F.lit(0)
    for i in range(PARTS):
        part = F.bit_count(F.shiftrightunsigned("fingerprint", 16 * i).bitwiseAND(F.lit(0xFFFF).cast("bigint")))
        key = key + (part + 4) * (1 << 5 * (PARTS - 1 - i))
    return key.cast("int")


def links(distinct: DataFrame, radius: int = RADIUS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Edges ``(a, b)`` that connect exactly what is connected by pairs at most ``radius`` bits apart.

    ``distinct`` holds each fingerprint once.  Two fingerprints can only link when the
    population counts of their four 16-bit parts differ by ``radius`` in all, so a row
    meets its own tile and, as a guest, the half of the tiles around it that come before.  Tiles above
    ``block_rows`` are cut into blocks, each of which sees all guests.  A task
    holds one block and streams the guests; of the links it finds it emits
    a spanning forest, at most one edge per row it has seen.
    """
    if not 0 <= radius <= 4:
        raise ValueError("radius must be 0 to 4")
    tiled = distinct.select("fingerprint", _tile().alias("tile"))
    # At most 17 ** 4 = 83,521 tiles exist, whatever the input.
    sizes = tiled.groupBy("tile").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("blocks"))
    sizes = F.broadcast(materialise(sizes, "tiles"))
    placed = tiled.join(sizes, "tile").select(
        "fingerprint", "tile", F.pmod(F.xxhash64("fingerprint"), "blocks").cast("int").alias("block")
    )
    at_home = placed.select("tile", "block", F.lit(0).alias("guest"), "fingerprint")
    in_earlier_blocks = placed.where("block > 0").select(
        "tile", F.explode(F.sequence(F.lit(0), F.col("block") - 1)).alias("block"), F.lit(1).alias("guest"), "fingerprint"
    )
    offsets = _offsets(radius)
    rows = at_home.unionByName(in_earlier_blocks)
    if offsets:
        hosts = placed.select(
            F.explode(F.transform(F.array(*map(F.lit, offsets)), lambda o: F.col("tile") - o)).alias("tile"), "fingerprint"
        ).join(sizes, "tile")
        rows = rows.unionByName(hosts.select(
            "tile", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("guest"),
            "fingerprint",
        ))
    dealt = rows.repartition("tile", "block").sortWithinPartitions("tile", "block", "guest")
    return dealt.mapInArrow(_matcher(radius), "a bigint, b bigint")


def _matcher(radius: int):
    def match(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, home, closed = None, [], False
        for batch in batches:
            tile, block, guest, prints = (np.asarray(c) for c in batch.columns)
            prints = prints.view(np.uint64)
            group = tile.astype(np.int64) << 32 | block
            cuts = np.flatnonzero((group[1:] != group[:-1]) | (guest[1:] != guest[:-1])) + 1
            for begin, end in zip([0, *cuts], [*cuts, len(group)]):
                if begin == end:
                    continue
                if key != group[begin]:
                    if home and not closed:
                        yield from _out(_pairs(np.concatenate(home), None, radius))
                    key, home, closed = group[begin], [], False
                if not guest[begin]:
                    home.append(prints[begin:end])
                    continue
                if not closed:
                    home, closed = [np.concatenate(home)] if home else [np.zeros(0, np.uint64)], True
                    yield from _out(_pairs(home[0], None, radius))
                yield from _out(_pairs(home[0], prints[begin:end], radius))
        if home and not closed:
            yield from _out(_pairs(np.concatenate(home), None, radius))

    return match


def _out(pairs: tuple[np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
    if len(pairs[0]):
        yield pa.RecordBatch.from_arrays([pa.array(p.view(np.int64)) for p in pairs], ["a", "b"])


def _pairs(rows: np.ndarray, others: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the links between ``rows`` and ``others``, or inside ``rows``."""
    inside = others is None
    others = rows if inside else others
    height = max(1, (1 << 21) // TILE_COLUMNS)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    held = 0
    for top in range(0, len(rows), height):
        for begin in range(top if inside else 0, len(others), TILE_COLUMNS):
            right = others[begin:begin + TILE_COLUMNS]
            near = np.bitwise_count(rows[top:top + height, None] ^ right[None, :]) <= radius
            i, j = np.nonzero(near)
            if inside:
                later = begin + j > top + i
                i, j = i[later], j[later]
            if len(i):
                found.append((rows[top + i], right[j]))
                held += len(i)
                if held > 1 << 20:
                    found = [forest(np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]))]
                    held = 0
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return forest(np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]))


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star around the smallest node of each component of the edges."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    if len(a) < len(nodes):
        return a, b
    left, right = at[: len(a)], at[len(a):]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[left], label[right])
        fresh = label.copy()
        np.minimum.at(fresh, left, low)
        np.minimum.at(fresh, right, low)
        fresh = fresh[fresh]
        if np.array_equal(fresh, label):
            break
        label = fresh
    moved = label != np.arange(len(nodes))
    return nodes[label[moved]], nodes[moved]


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``(id, fingerprint, component_id)`` for every row of ``docs``.

    Texts are cut into words, lower-cased (A-Z), and three-word shingles, repeats included;
    a bit of the fingerprint is set if it is in over half of the shingles' hashes.
    Documents whose fingerprints differ in at most ``radius`` bits are linked; ``component_id`` is the
    smallest id reachable over links.  Only distinct fingerprints are compared.

    A null text is empty; an empty text has fingerprint zero and links like any other; fewer than three
    words are one shingle.  Rows that repeat get equal results.  A null id is never a
    component's id unless all ids of the component are null.  Other columns are not read.
    """
    prints = materialise(fingerprints(docs, id_col, text_col), "fingerprints")
    distinct = prints.groupBy("fingerprint").agg(F.min("id").alias("first"))
    roots = components(links(distinct.select("fingerprint"), radius, block_rows))
    named = distinct.join(roots.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").select(
        "fingerprint", "first", F.coalesce("root", "fingerprint").alias("root")
    )
    smallest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    answer = named.join(smallest, "root").select("fingerprint", "component_id")
    return prints.join(answer, "fingerprint").select("id", "fingerprint", "component_id")


def hex_fingerprint(name: str = "fingerprint") -> Column:
    """16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(name), 16, "0"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document per component, the one of the smallest id.

    Rows are told apart by id and text: rows equal in both become one, rows that share an id alone are documents of
    their own.  A row without an id can't be told from others by name and stays.
    """
    found = near_duplicates(with_row(docs, id_col, text_col), ROW, text_col)
    kept = without_rows(docs, found.where("component_id <> id"), id_col, text_col)
    named = with_row(docs.where(col(id_col).isNotNull()), id_col, text_col)
    if named.groupBy(ROW).count().where("count > 1").isEmpty():
        return kept
    one = with_row(kept.where(col(id_col).isNotNull()), id_col, text_col).dropDuplicates([ROW]).drop(ROW)
    return one.unionByName(kept.where(col(id_col).isNull()))

"""Line dedup: MinHash of character shingles, banding, sketches that rule pairs out, exact Jaccard verification, one line per component."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.components import components
from lamina.llm.text import CHUNK_BYTES, ROW, col, column_chunks, id_text, id_type, ragged, with_row
from lamina.session import discard, materialise, scratch_path

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 8, 4
# Buckets of up to this many lines are compared line by line; in larger ones every line meets the first few of them,
# and then, block by block, all lines of the bucket that it isn't connected with yet.
SMALL_BUCKET = 6
LEADERS = 2
# Lines and letters a block holds at most on average, and lines that are sent past it in one task.
BLOCK_ROWS = 2048
BLOCK_LETTERS = 1 << 21
GUEST_ROWS = 1 << 14
# Pairs of one line that are verified in one task.
SHARE_PAIRS = 4096
# Bits of the filter that finds the texts of candidate lines again; its size is fixed.
FILTER_BITS = 26
SIGNATURE_SHINGLES = 1 << 16
# Bits of a sketch are the power of two that this share of the line's shingles needs; few bits rule out less.
SKETCH_SHARE = 0.75
SKETCH_BITS = 64
# Pairs of sketches that are compared at once.
SKETCH_PAIRS = 1 << 16


def _multipliers(count: int) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(b"minhash%d" % i) | 1 for i in range(count)], np.uint64)


MULTIPLIERS = _multipliers(BANDS * ROWS)


def shingle_hashes(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of some lines one after the other, and how many each has; a shorter line is one shingle."""
    letters = np.frombuffer("".join(lines).encode("utf-32-le"), np.uint32)
    lengths = np.array([len(x) for x in lines], np.int64)
    counts = np.maximum(lengths - SHINGLE + 1, 1)
    begin = np.cumsum(lengths) - lengths
    letters = np.r_[letters.astype(np.uint64) + np.uint64(1), np.zeros(SHINGLE, np.uint64)]
    value, factor = letters[:1 - SHINGLE].copy(), np.uint64(0x9E3779B97F4A7C15)
    for k in range(1, SHINGLE):
        value *= factor
        value += letters[k:k + len(value)]
    short = np.flatnonzero(lengths < SHINGLE)
    if len(short):
        value = value[np.repeat(begin, counts) + ragged(counts)]
    else:
        # what begins at a line's last letters reaches into the next one
        inside = np.ones(len(letters) - SHINGLE, bool)
        inside[(begin + lengths)[:, None] - np.arange(1, SHINGLE)] = False
        value = value[:len(inside)][inside]
    # a line of fewer letters has nothing in the place of the others
    own = np.zeros(len(short), np.uint64)
    for k in range(SHINGLE):
        own = own * factor + np.where(lengths[short] > k, letters[begin[short] + k], np.uint64(0))
    value[(np.cumsum(counts) - counts)[short]] = own
    value ^= value >> np.uint64(31)
    value *= np.uint64(0xD6E8FEB86659FD93)
    return value ^ value >> np.uint64(32), counts


def signatures(lines: list[str]) -> np.ndarray:
    """One row of band hashes per line."""
    return _bands(*shingle_hashes(lines))


def _bands(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    starts = np.cumsum(counts) - counts
    bands = np.zeros((len(counts), BANDS), np.uint64)
    product = np.empty_like(hashes)
    for number, factor in enumerate(MULTIPLIERS):
        least = np.minimum.reduceat(np.multiply(hashes, factor, out=product), starts)
        band = number // ROWS
        bands[:, band] = (bands[:, band] ^ least) * np.uint64(0x9FB21C651E98DF25)
        bands[:, band] ^= bands[:, band] >> np.uint64(29)
    return bands + np.arange(BANDS, dtype=np.uint64)


def _sketches(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How many distinct shingles each line has, and its sketch: words of bits of all lines, and how many words each has.

    A bit tells whether an odd number of the line's distinct shingles fall on it.  Where the sketches of two lines differ, each bit
    is there for a shingle that only one of them has, so similar lines can't differ in many.
    """
    lines = len(counts)
    named = np.repeat(np.arange(lines, dtype=np.uint64) << np.uint64(46), counts) | hashes >> np.uint64(18)
    named.sort()
    named = named[np.r_[True, named[1:] != named[:-1]]]
    owner = (named >> np.uint64(46)).astype(np.int64)
    sizes = np.bincount(owner, minlength=lines)
    bits = np.maximum(SKETCH_BITS, 1 << np.ceil(np.log2(sizes * SKETCH_SHARE)).astype(np.int64).clip(0))
    first = np.cumsum(bits) - bits
    place = first[owner] + (named.astype(np.int64) & (bits - 1)[owner])
    odd = np.bincount(place, minlength=int(bits.sum())) & 1
    return sizes, np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64), bits >> 6


def _alike(sketch: tuple, x: np.ndarray, y: np.ndarray, similarity: float) -> np.ndarray:
    """Which of the pairs of lines ``x`` and ``y`` can be similar by their sizes and sketches; no similar pair is ruled out.

    A wider sketch folds to the width of a narrower one.
    """
    sizes, words, widths = sketch
    starts = np.cumsum(widths) - widths
    kept = np.minimum(sizes[x], sizes[y]) >= similarity * np.maximum(sizes[x], sizes[y])
    most = (1 - similarity) / (1 + similarity) * (sizes[x] + sizes[y]) + 1e-6
    wide, narrow = np.where(widths[x] < widths[y], y, x), np.where(widths[x] < widths[y], x, y)
    kind = np.where(kept, widths[wide] << 32 | widths[narrow], -1)
    for k in np.unique(kind[kept]).tolist():
        n, m = k >> 32, k & 0xFFFFFFFF
        found = np.flatnonzero(kind == k)
        step = max(1, SKETCH_PAIRS // n)
        for part in (found[i:i + step] for i in range(0, len(found), step)):
            left = words[starts[wide[part]][:, None] + np.arange(n)]
            if n > m:
                left = np.bitwise_xor.reduce(left.reshape(len(part), -1, m), axis=1)
            left ^= words[starts[narrow[part]][:, None] + np.arange(m)]
            kept[part] = np.bitwise_count(left).sum(axis=1, dtype=np.int64) <= most[part]
    return kept


def split_lines(text: str) -> list[str]:
    return text.split("\n")


def _line_key(line: str) -> int:
    return xxhash.xxh64_intdigest(line.encode()) - (1 << 63)


def _line_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per document: the keys of its lines, and of the lines that are new in the batch sizes, sketches and bands."""
    for batch in column_chunks(batches, CHUNK_BYTES):
        keys: dict[str, int] = {}
        rows_keys, fresh, ends = [], [], [0]
        for text in batch.column(1).to_pylist():
            lines = split_lines(text)
            for line in lines:
                if line not in keys:
                    keys[line] = _line_key(line) if line.strip() else None
                    if keys[line] is not None:
                        fresh.append(line)
            rows_keys.append([keys[line] for line in lines])
            ends.append(len(fresh))
        sizes, sketches, bands = _signed(fresh)
        ends = np.array(ends, np.int32)
        new = pa.array([keys[line] for line in fresh], pa.int64())
        lists = [pa.ListArray.from_arrays(pa.array(ends), x) for x in (new, pa.array(sizes, pa.int32()), pa.array(sketches, pa.binary()))]
        bands = pa.ListArray.from_arrays(pa.array(ends * BANDS), pa.array(bands.view(np.int64).ravel()))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(rows_keys, pa.list_(pa.int64())), *lists, bands], ["id", "keys", "new", "sizes", "sketches", "bands"]
        )


def _signed(lines: list[str]) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """Sizes, sketches and bands of many lines, a bounded number of shingles at a time."""
    sizes, sketches, bands = [np.zeros(0, np.int64)], [], [np.zeros((0, BANDS), np.uint64)]
    for begin, end in _runs(lines):
        hashed = shingle_hashes(lines[begin:end])
        bands.append(_bands(*hashed))
        size, words, widths = _sketches(*hashed)
        sizes.append(size)
        raw, cuts = words.tobytes(), (np.cumsum(widths) * 8).tolist()
        sketches += [raw[a:b] for a, b in zip([0, *cuts], cuts)]
    return np.concatenate(sizes), sketches, np.concatenate(bands)


def _bits(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    flags = np.zeros(1 << FILTER_BITS, np.uint8)
    for batch in batches:
        flags[_place(np.asarray(batch.column(0)))] = 1
    packed = np.packbits(flags)
    used = np.flatnonzero(packed.reshape(-1, 1 << 12).any(axis=1))
    yield pa.RecordBatch.from_arrays(
        [pa.array(used.astype(np.int32)), pa.array([p.tobytes() for p in packed.reshape(-1, 1 << 12)[used]], pa.binary())], ["part", "bits"]
    )


def _place(keys: np.ndarray) -> np.ndarray:
    return keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - FILTER_BITS)


def _text_finder(flags):
    """Texts of the lines that the filter lets through, each once in a batch."""

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(flags.value, np.uint8)
        for batch in column_chunks(batches, CHUNK_BYTES):
            lines = list({line for t in batch.column(1).to_pylist() for line in split_lines(t) if line.strip()})
            if not lines:
                continue
            keys = np.array([_line_key(line) for line in lines], np.int64)
            place = _place(keys).astype(np.int64)
            wanted = np.flatnonzero(bits[place >> 3] >> (7 - (place & 7)) & 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[wanted]), pa.array([lines[i] for i in wanted.tolist()], pa.string())], ["key", "line"]
            )

    return find


def jaccard(a: str, b: str) -> float:
    """Jaccard similarity of the shingle sets."""
    x, y = (set(shingle_hashes([line])[0].tolist()) for line in (a, b))
    both = len(x & y)
    return both / (len(x) + len(y) - both)


def _pairer(similarity: float):
    """Candidate pairs from rows sorted by bucket and line, and all lines of a large bucket as pairs of none with its name.

    Lines whose sizes are too far apart to be similar are no pair.
    """

    def pair(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the first few lines of the last bucket, and how many it has had
        held, seen = [np.zeros(0, np.int64) for _ in range(3)], 0
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [np.asarray(batch.column(i)).astype(np.int64) for i in range(3)]
            fresh = np.r_[last != (rows[0][0], rows[1][0]), (rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1])]
            last = rows[0][-1], rows[1][-1]
            old = len(held[0])
            name, key, size = (np.r_[a, b[fresh]] for a, b in zip(held, rows))
            at = np.arange(len(name))
            starts = np.flatnonzero(np.r_[True, name[1:] != name[:-1]])
            begin = np.repeat(starts, np.diff(np.r_[starts, len(name)]))
            # place in the bucket; of the held one some lines may be left out in between
            place = at - begin
            place[(begin == 0) & (at >= old)] += seen - old
            new = at >= old
            left, right = [], []
            for k in range(SMALL_BUCKET):
                x = np.flatnonzero(new & (place > k) & ((place < SMALL_BUCKET) | (k < LEADERS)))
                y = begin[x] + k
                near = (size[y] >= similarity * size[x]) & (size[x] >= similarity * size[y])
                left.append(key[y[near]])
                right.append(key[x[near]])
            # when the first line beyond the small size comes, those before it go out with it
            found = np.flatnonzero(new & (place == SMALL_BUCKET))
            large = np.r_[np.flatnonzero(new & (place >= SMALL_BUCKET)), (begin[found][:, None] + np.arange(SMALL_BUCKET)).ravel()]
            left, right = np.concatenate(left), np.concatenate(right)
            of_pair = np.repeat([True, False], [len(left), len(large)])
            yield pa.RecordBatch.from_arrays([
                pa.array(np.r_[left, key[large]], mask=~of_pair), pa.array(np.r_[right, key[large]]), pa.array(np.r_[left, name[large]], mask=of_pair),
            ], ["a", "b", "bucket"])
            first, seen = starts[-1], int(place[-1]) + 1
            held = [x[first:first + SMALL_BUCKET] for x in (name, key, size)]

    return pair


def _read_sketches(sizes: pa.Array, bits: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    column = bits.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    words = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0]:offsets[-1]].copy().view(np.uint64)
    return np.asarray(sizes).astype(np.int64), words, np.diff(offsets) >> 3


def _sifter(similarity: float):
    """The pairs that sketches don't rule out, from rows sorted by (line, share), the line's own sketch before those of its partners."""

    def sift(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([x for x in (before, batch) if x is not None]).combine_chunks().to_batches()[0]
            own = np.asarray(rows.column(1).is_null())
            at = np.maximum.accumulate(np.where(own, np.arange(len(own)), 0))
            x = np.flatnonzero(~own)
            kept = x[_alike(_read_sketches(rows.column(2), rows.column(3)), x, at[x], similarity)]
            before = rows.slice(at[-1], 1)
            yield rows.select([0, 1]).take(pa.array(kept))

    return sift


def _block_sifter(similarity: float):
    """The lines that may be similar to one of another group, from rows sorted like those of ``_block_linker``."""

    def found(rows: pa.RecordBatch) -> pa.RecordBatch:
        share, guest, group = (np.asarray(rows.column(i)) for i in (2, 3, 4))
        sketch = _read_sketches(rows.column(6), rows.column(7))
        sizes, marked = sketch[0], np.zeros(rows.num_rows, bool)
        starts = _starts(rows)
        xs, ys, held = [], [], 0

        def compare() -> None:
            x, y = np.concatenate(xs), np.concatenate(ys)
            kept = _alike(sketch, x, y, similarity)
            marked[x[kept]] = marked[y[kept]] = True

        for begin, end in zip(starts.tolist(), [*starts[1:].tolist(), rows.num_rows]):
            hosts = end - begin - int(guest[begin:end].sum())
            # the hosts meet each other in the first share only
            partners = begin if share[begin] == 0 else begin + hosts
            step = max(1, SKETCH_PAIRS // (end - begin))
            for i in range(begin, begin + hosts, step):
                mine, theirs = np.arange(i, min(i + step, begin + hosts))[:, None], np.arange(partners, end)
                small, large = np.minimum(sizes[mine], sizes[theirs]), np.maximum(sizes[mine], sizes[theirs])
                x, y = np.nonzero((group[mine] != group[theirs]) & (mine < theirs) & (small >= similarity * large))
                xs.append(x + i)
                ys.append(y + partners)
                held += len(x)
                if held >= SKETCH_PAIRS:
                    compare()
                    xs, ys, held = [], [], 0
        if held:
            compare()
        at = pa.array(np.flatnonzero(marked))
        return pa.RecordBatch.from_arrays([rows.column(0).take(at), rows.column(5).take(at)], ["bucket", "key"])

    def sift(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([x for x in (left, batch) if x is not None]).combine_chunks().to_batches()[0]
            last = int(_starts(rows)[-1])
            left = rows.slice(last)
            if last:
                yield found(rows.slice(0, last))
        if left is not None:
            yield found(left)

    return sift


def _starts(rows: pa.RecordBatch) -> np.ndarray:
    """Where the rows of each (bucket, block, share) begin."""
    names = np.stack([np.asarray(rows.column(i)).astype(np.int64) for i in range(3)])
    return np.flatnonzero(np.r_[True, (names[:, 1:] != names[:, :-1]).any(axis=0)])


def _runs(lines: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of lines with a bounded number of shingles each; a longer line is a range of its own."""
    begin, size = 0, 0
    for at, line in enumerate(lines):
        if at > begin and size + len(line) > SIGNATURE_SHINGLES:
            yield begin, at
            begin, size = at, 0
        size += len(line)
    if begin < len(lines):
        yield begin, len(lines)


def _shingle_sets(lines: list[str]) -> tuple[np.ndarray, list[int]]:
    """The distinct shingle hashes of each line in order, one line after the other, and where each begins and ends."""
    hashes, counts = shingle_hashes(lines)
    ends = np.cumsum(counts)
    for start, stop in zip((ends - counts).tolist(), ends.tolist()):
        hashes[start:stop].sort()
    fresh = np.r_[True, hashes[1:] != hashes[:-1]]
    fresh[ends - counts] = True
    return hashes[fresh], np.r_[0, np.cumsum(fresh)[ends - 1]].tolist()


def _each_set(lines: list[str]) -> Iterator[np.ndarray]:
    """The distinct shingle hashes of each line in order; those of many lines are made at once."""
    for begin, end in _runs(lines):
        sets, bounds = _shingle_sets(lines[begin:end])
        for start, stop in zip(bounds, bounds[1:]):
            yield sets[start:stop]


def _verifier(similarity: float):
    """Links from rows sorted by (line, share), the line's own text before those of its partners."""

    def verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(0, np.uint64)
        for batch in batches:
            left, right = [], []
            names, partners, lines = (batch.column(i).to_pylist() for i in range(3))
            for name, partner, found in zip(names, partners, _each_set(lines)):
                if partner is None:
                    own = found.copy()
                    continue
                small, large = sorted((len(own), len(found)))
                if small >= similarity * large:
                    place = own.searchsorted(found)
                    both = int(np.count_nonzero(own.take(place, mode="clip") == found))
                    if both >= similarity * (small + large - both):
                        left.append(name)
                        right.append(partner)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    return verify


def _with_partners(pairs: DataFrame, lines: DataFrame) -> DataFrame:
    """``(a, b)`` and the columns of ``lines`` besides the key: a line's own row, its partner none, before those of its partners, in shares if it has many.

    What is sent where is known before a row moves, so that ``lines`` is met once.
    """
    shares = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / SHARE_PAIRS).cast("int").alias("shares"))
    own = shares.select(
        F.col("a").alias("key"), "a", F.lit(None).cast("bigint").alias("b"), F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share")
    )
    partners = pairs.join(shares, "a").select(
        F.col("b").alias("key"), "a", "b", F.pmod(F.xxhash64("b"), "shares").cast("int").alias("share")
    )
    sent = lines.join(own.unionByName(partners), "key")
    dealt = sent.repartition("a", "share").sortWithinPartitions("a", "share", F.asc_nulls_first("b"))
    return dealt.select("a", "b", *[c for c in lines.columns if c != "key"])


def _sifted(pairs: DataFrame, sketches: DataFrame, similarity: float) -> DataFrame:
    """Pairs that can be similar by their sketches."""
    return _with_partners(pairs, sketches.select("key", "size", "bits")).mapInArrow(_sifter(similarity), "a bigint, b bigint")


def _verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Pairs whose lines are similar."""
    return _with_partners(pairs, texts.select("key", "line")).mapInArrow(_verifier(similarity), "a bigint, b bigint")


def _texts(docs: DataFrame, keys: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(key, line)`` of the lines with these keys, and of few others, each once and dealt by key."""
    context = docs.sparkSession.sparkContext
    flags = np.zeros((1 << FILTER_BITS) >> 3, np.uint8).reshape(-1, 1 << 12)
    for row in keys.coalesce(max(1, context.defaultParallelism)).mapInArrow(_bits, "part int, bits binary").toLocalIterator():
        flags[row["part"]] |= np.frombuffer(row["bits"], np.uint8)
    shared = context.broadcast(flags.tobytes())
    return id_text(docs, id_col, text_col).mapInArrow(_text_finder(shared), "key bigint, line string").dropDuplicates(["key"])


def _open(members: DataFrame, roots: DataFrame) -> DataFrame:
    """The members of the buckets whose lines aren't all connected."""
    group = F.coalesce("root", "key")
    named = members.join(roots.withColumnRenamed("node", "key"), "key", "left")
    several = named.groupBy("bucket").agg(F.min(group).alias("low"), F.max(group).alias("high")).where("low <> high")
    return members.join(several.select("bucket"), "bucket", "left_semi")


def _joined(early: DataFrame, joined: DataFrame) -> DataFrame:
    """``(node, root)`` after ``joined`` has connected roots of ``early`` and lines that had none."""
    later = joined.select(F.col("node").alias("root"), F.col("root").alias("next"))
    return early.join(later, "root", "left").select("node", F.coalesce("next", "root").alias("root")).unionByName(
        joined.join(early.select("node"), "node", "left_anti").select("node", "root")
    )


class Block:
    """Lines of one bucket as sets of shingles, found by the rare shingles that similar lines must share.

    Of two sets with a Jaccard similarity of t, each has a share of t in the other; so, in any one order of all
    shingles, the first (1 - t) of each set and one more can't be without a common one.  The order is by how many
    lines of the block have a shingle, so that what the whole bucket shares finds nothing.
    """

    def __init__(self, groups: list[int], lines: list[np.ndarray], similarity: float):
        self.similarity, self.parent, self.links = similarity, {g: g for g in groups}, []
        self.sizes = np.array([len(x) for x in lines], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.names, place, often = np.unique(np.concatenate(lines), return_inverse=True, return_counts=True)
        self.rank = np.empty(len(often), np.int64)
        self.rank[np.argsort(often, kind="stable")] = np.arange(len(often))
        owner = np.repeat(np.arange(len(lines)), self.sizes)
        ranks = self.rank[place]
        self.ranks = ranks[np.lexsort((ranks, owner))]
        first = ragged(self.sizes) < np.repeat([self._prefix(n) for n in self.sizes.tolist()], self.sizes)
        order = np.argsort(self.ranks[first], kind="stable")
        self.posted, self.owner = self.ranks[first][order], owner[first][order]
        self.group = np.array(groups, np.int64)
        self.mark = np.zeros(len(often), bool)

    def _prefix(self, size: int) -> int:
        return min(size, size - int(np.ceil(self.similarity * size - 1e-9)) + 1)

    def root(self, group: int) -> int:
        while self.parent.setdefault(group, group) != group:
            group = self.parent[group]
        return group

    def inside(self) -> None:
        for i, (start, size) in enumerate(zip(self.starts.tolist(), self.sizes.tolist())):
            self._meet(self.group[i].item(), self.ranks[start:start + size], 0, size, i)

    def guest(self, group: int, line: np.ndarray) -> None:
        place = np.minimum(np.searchsorted(self.names, line), len(self.names) - 1)
        known = np.sort(self.rank[place[self.names[place] == line]])
        self._meet(group, known, len(line) - len(known), len(line), len(self.sizes))

    def _meet(self, group: int, ranks: np.ndarray, unknown: int, size: int, before: int) -> None:
        """Link a line with those of the first lines of the block that it is similar to and not connected with."""
        rare = ranks[: max(0, self._prefix(size) - unknown)]
        begin, end = np.searchsorted(self.posted, rare), np.searchsorted(self.posted, rare, side="right")
        found = np.unique(self.owner[np.repeat(begin, end - begin) + ragged(end - begin)])
        own = self.root(group)
        small, large = np.minimum(self.sizes[found], size), np.maximum(self.sizes[found], size)
        found = found[(found < before) & (self.group[found] != own) & (small >= self.similarity * large)]
        if not len(found):
            return
        sizes = self.sizes[found]
        self.mark[ranks] = True
        hits = self.mark[self.ranks[np.repeat(self.starts[found], sizes) + ragged(sizes)]]
        both = np.add.reduceat(hits.astype(np.int64), np.cumsum(sizes) - sizes)
        self.mark[ranks] = False
        for other in np.unique(self.group[found[both >= self.similarity * (sizes + size - both)]]).tolist():
            self.links.append((own, other))
            self.parent[own] = other
            self.group[self.group == own] = other
            own = other


def _block_linker(similarity: float):
    """Links between groups of lines, from rows sorted by (bucket, block, share), a block's own lines before those sent past it."""

    def link(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, groups, lines, block = None, [], [], None

        def closed() -> Block:
            made = Block(groups, lines, similarity)
            if not key[2]:
                made.inside()
            return made

        for batch in batches:
            done = []
            *names, texts = (c.to_pylist() for c in batch.columns)
            for *name, guest, group, found in zip(*names, _each_set(texts)):
                if name != key:
                    if lines:
                        done += (block or closed()).links
                    key, groups, lines, block = name, [], [], None
                if not guest:
                    groups.append(group)
                    lines.append(found.copy())
                    continue
                block = block or closed()
                block.guest(group, found)
            if block:
                done += block.links
                block.links = []
            yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], pa.int64()) for i in (0, 1)], ["a", "b"])
        if lines:
            done = (block or closed()).links
            yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], pa.int64()) for i in (0, 1)], ["a", "b"])

    return link


def _blocks(members: DataFrame, roots: DataFrame, lengths: DataFrame) -> DataFrame:
    """``(bucket, block, share, guest, group, key)``: who meets whom in the large buckets.

    Of each bucket whose lines aren't all connected, the lines outside its largest group are cut into blocks.  A
    block is compared inside and with all lines of the largest group and of earlier blocks, which are sent past it in shares.
    """
    named = members.join(roots.withColumnRenamed("node", "key"), "key", "left").select(
        "bucket", "key", F.coalesce("root", "key").alias("group")
    )
    named = materialise(named.join(lengths, "key"), "members")
    sizes = named.groupBy("bucket", "group").agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("letters"))
    largest = F.max(F.struct("n", "group", "letters"))
    buckets = sizes.groupBy("bucket").agg(
        largest.alias("most"), F.count(F.lit(1)).alias("groups"), F.sum("n").alias("n"), F.sum("letters").alias("letters")
    ).where("groups > 1").select(
        "bucket", F.col("most.group").alias("most"),
        F.ceil(F.greatest((F.col("n") - F.col("most.n")) / BLOCK_ROWS, (F.col("letters") - F.col("most.letters")) / BLOCK_LETTERS)).cast("int").alias("blocks"),
        F.ceil(F.col("n") / GUEST_ROWS).cast("int").alias("shares"),
    )
    placed = named.drop("length").join(buckets, "bucket").withColumn(
        "block", F.when(F.col("group") == F.col("most"), F.col("blocks")).otherwise(F.pmod(F.xxhash64("key"), "blocks").cast("int"))
    )
    shares = F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share")
    hosts = placed.where("block < blocks").select("bucket", "block", shares, F.lit(0).alias("guest"), "group", "key")
    share = F.pmod(F.xxhash64("key", F.lit(1)), "shares").cast("int").alias("share")
    guests = placed.where("block > 0").select(
        "bucket", F.explode(F.sequence(F.lit(0), F.col("block") - 1)).alias("block"), share, F.lit(1).alias("guest"), "group", "key"
    )
    return hosts.unionByName(guests)


def _block_rows(members: DataFrame, roots: DataFrame, lines: DataFrame, lengths: DataFrame, columns: list[str]) -> DataFrame:
    rows = _blocks(members, roots, lengths).join(lines, "key").select("bucket", "block", "share", "guest", "group", *columns)
    return rows.repartition("bucket", "block", "share").sortWithinPartitions("bucket", "block", "share", "guest")


def _promising(members: DataFrame, roots: DataFrame, sketches: DataFrame, similarity: float) -> DataFrame:
    """The members of large buckets whose sketches leave a line of another group in the bucket that may be similar."""
    dealt = _block_rows(members, roots, sketches, sketches.select("key", F.col("size").alias("length")), ["key", "size", "bits"])
    return dealt.mapInArrow(_block_sifter(similarity), "bucket bigint, key bigint").distinct()


def _rest(members: DataFrame, roots: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Links between groups that have similar lines in one large bucket."""
    dealt = _block_rows(members, roots, texts, texts.select("key", F.length("line").alias("length")), ["line"])
    return dealt.mapInArrow(_block_linker(similarity), "a bigint, b bigint")


def line_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """``(id, position, key, group_key, kept)`` for every line of ``docs`` that isn't blank.

    Lines are what line feeds separate.  Two lines link when the Jaccard similarity of their sets of five-letter shingles
    is at least ``similarity``.  Candidates share one of eight bands of four MinHash values, which misses
    one pair in 65 at a similarity of 0.8 and one in 400 at 0.85; equal lines always meet.  The first six lines of a bucket
    are compared with each other and all further ones with the first two.  Lines of a bucket that are not connected then are
    compared in blocks, so that every similar pair of a bucket ends in one component; no bucket is expanded into its pairs.
    Sizes and sketches rule out most pairs, never a similar one, before a text moves; similarity is computed on whole lines.  Linked lines form components by distributed union-find; of each
    component the line with the smallest (id, position) is kept.

    Blank lines are no lines here.  A null id comes first.  Rows that repeat an id share its lines.  Lines are named by
    64-bit hashes; that two different lines share a name is as likely as a hash collision.
    """
    kind = id_type(docs, id_col)
    lists = "array<bigint>"
    spark, path = docs.sparkSession, scratch_path(docs.sparkSession, "lines")
    scanned = id_text(docs, id_col, text_col).mapInArrow(
        _line_batches, f"id {kind}, keys {lists}, new {lists}, sizes array<int>, sketches array<binary>, bands {lists}"
    )
    scanned.write.parquet(path)
    scanned = spark.read.schema(scanned.schema).parquet(path)
    own = F.expr(f"int(at div {BANDS})")
    bands = scanned.select(F.posexplode("bands").alias("at", "bucket"), "new", "sizes").select(
        "bucket", F.col("new")[own].alias("key"), F.col("sizes")[own].alias("size")
    )
    dealt = bands.repartition("bucket").sortWithinPartitions("bucket", "key")
    met = materialise(dealt.mapInArrow(_pairer(similarity), "a bigint, b bigint, bucket bigint").distinct(), "pairs")
    # the bands are the larger part of what the scan has written, and have done their work
    scanned = materialise(scanned.drop("bands"), "keys")
    discard(spark, path)
    sketched = scanned.select(F.posexplode("new").alias("at", "key"), "sizes", "sketches").select(
        "key", F.col("sizes")[F.col("at")].alias("size"), F.col("sketches")[F.col("at")].alias("bits")
    )
    # few lines are in several batches: they are told apart after the shuffle only
    sketches = sketched.repartition("key").dropDuplicates(["key"])
    members = met.where("a IS NULL").select("bucket", F.col("b").alias("key"))
    pairs = materialise(_sifted(met.where("a IS NOT NULL").select("a", "b"), sketches, similarity), "sifted")
    texts = _texts(docs, pairs.select(F.explode(F.array("a", "b")).alias("key")), id_col, text_col)
    roots = materialise(components(_verified(pairs, texts, similarity)), "roots")
    apart = materialise(_open(members, roots), "open")
    if not apart.isEmpty():
        # the blocks read sketches more than once, and only those of lines in open buckets
        marks = materialise(sketched.join(apart.select("key").distinct(), "key", "left_semi").dropDuplicates(["key"]), "marks")
        apart = materialise(_promising(apart, roots, marks, similarity), "promising")
    if not apart.isEmpty():
        texts = materialise(_texts(docs, apart.select("key"), id_col, text_col), "texts")
        roots = _joined(roots, materialise(components(_rest(apart, roots, texts, similarity)), "joined"))
    lines = scanned.select("id", F.posexplode("keys").alias("position", "key")).where("key IS NOT NULL")
    grouped = lines.join(roots.withColumnRenamed("node", "key"), "key", "left").select(
        "id", "position", "key", F.coalesce("root", "key").alias("group_key")
    )
    place = F.struct("id", "position")
    firsts = grouped.groupBy("group_key").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"))
    several = firsts.where("n > 1").select(F.col("group_key").alias("_group"), "first")
    return grouped.join(several, F.col("group_key") == F.col("_group"), "left").select(
        "id", "position", "key", "group_key", (F.col("first").isNull() | place.eqNullSafe(F.col("first"))).alias("kept")
    )


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """``(id, n_lines, n_removed, removed)`` for every document id: how many lines, and the positions of those that go.

    A document without a line that isn't blank has none.  Rows that repeat an id are one row here.
    """
    groups = line_groups(docs, id_col, text_col, similarity)
    # a line of a repeated id is one; lists are only made of lines that go
    once = groups.groupBy("id", "position").agg(F.min("kept").alias("kept"))
    counts = once.groupBy("id").agg(F.count(F.lit(1)).alias("n_lines"))
    gone = once.where(~F.col("kept")).groupBy(F.col("id").alias("_gone")).agg(F.array_sort(F.collect_list("position")).alias("removed"))
    found = counts.join(gone, F.col("id").eqNullSafe(F.col("_gone")), "left")
    ids = docs.select(col(id_col).alias("_id")).distinct()
    return ids.join(found, F.col("_id").eqNullSafe(F.col("id")), "left").select(
        F.col("_id").alias("id"), F.coalesce("n_lines", F.lit(0).cast("bigint")).alias("n_lines"),
        F.coalesce(F.size("removed"), F.lit(0)).cast("bigint").alias("n_removed"),
        F.coalesce("removed", F.expr("cast(array() as array<int>)")).alias("removed"),
    )


def drop_fuzzy_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with the lines that go cut out of the texts; blank lines, null texts and rows without an id stay as they are.

    Rows are told apart by id and text, so that a row's lines are judged as its own; rows equal in both are one.
    """
    named = with_row(docs.where(col(id_col).isNotNull()), id_col, text_col)
    report = line_report(named, ROW, text_col, similarity).where("n_removed > 0")
    cut = materialise(report.select(F.col("id").alias("_id"), "removed"), "cut").withColumnRenamed("removed", "_removed")
    joined = with_row(docs, id_col, text_col).join(cut, F.col(ROW) == F.col("_id"), "left")
    kept = F.array_join(F.filter(F.split(col(text_col), "\n", -1), lambda _, i: ~F.array_contains(F.col("_removed"), i)), "\n")
    text = F.when(F.col("_removed").isNull(), col(text_col)).otherwise(kept)
    return joined.select(*[text.alias(c) if c == text_col else col(c) for c in docs.columns])

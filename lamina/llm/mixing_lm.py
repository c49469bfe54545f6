"""LM scoring: logistic mixing of hashed-context bit predictors, with counts over the whole training part.

A text is a sequence of words and an end.  A frequent word belongs to a class of words that follow the same
very frequent word; a rarer word is an escape and its bytes.  The class, end or escape of each token is a path of yes/no
decisions in a Huffman tree, which goes on in a Huffman tree of the class's words down to the word; so are the bytes in a
second tree.  For every decision several predictors, each a table of counts addressed by a hash of a context and the place in the tree, give the
odds; weights chosen by a gate (how often the contexts have been seen) combine them, and a last table
refines the combined odds.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.text import Words, col, column_chunks, id_type, ragged
from lamina.session import materialise

# The most frequent words, which have a class and are found by their 64-bit hash; all others are spelled.
MAX_WORDS = 1 << 20
HASH_SEED = 42
# Words whose topics are counted in 64 bits; any other is at most one token in this many, for which 32 bits do.
WIDE_WORDS = 1 << 16
# Slots of a predictor: one per this many training tokens, within these powers of two; of letters, within fewer.
TOKENS_PER_SLOT = 2
SLOT_BITS = (14, 21)
LETTER_BITS = 18
# A context's topic is the last word among this many most frequent ones; each topic has a class of words.
TOPIC_WORDS = 32
CLASSES = TOPIC_WORDS + 3
# One training document in this many is kept from the counts while the weights are learned on it, then counted too.
TUNING_SHARE = 8
SLICE = 1 << 14
# Text that is split into words at once, symbols that go down their paths at once, tokens whose decisions are made at once, and
# text that is learned from at once.
SPLIT_BYTES = 1 << 20
LEVEL_SYMBOLS = 1 << 14
EVENT_TOKENS = 1 << 12
EVENT_BYTES = 1 << 18
BATCH_EVENTS = 1 << 13
FULL_EVENTS = 1 << 31
RATE = 0.2
# Fixed symbols and classes of the end and of an escape, and the byte that ends a spelled word.
END, ESCAPE, FIRST_WORD, STOP = 0, 1, 2, 32
GATE_LEVELS = 4
ODDS_STEP = np.float32(1 / 256)
REFINE_STEPS = 33
SPREAD = np.uint32(0x9E3779B1)
# Fixed values of the hash of words, XXH64.
HASH_PRIMES = tuple(np.uint64(p) for p in (
    0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5,
))
PREDICTORS = {"word": ("tree", "topic", "one", "two"), "spell": ("tree", "pair", "triple", "five")}


def huffman(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parent and side of every node of a Huffman tree: first the symbols, then inner nodes as they are made, the root last."""
    symbols = len(weights)
    order = np.argsort(weights, kind="stable").tolist()
    heavy = [int(weights[i]) for i in order]
    parent, side = np.zeros(2 * symbols - 1, np.int64), np.zeros(2 * symbols - 1, np.uint8)
    made: list[int] = []
    # inner nodes are made by rising weight, so the least of all is the first symbol or the first inner node left
    leaf = inner = 0
    for fresh in range(symbols, 2 * symbols - 1):
        total = 0
        for bit in (0, 1):
            if inner == len(made) or leaf < symbols and heavy[leaf] <= made[inner]:
                node, weight, leaf = order[leaf], heavy[leaf], leaf + 1
            else:
                node, weight, inner = symbols + inner, made[inner], inner + 1
            parent[node], side[node] = fresh, bit
            total += weight
        made.append(total)
    parent[-1] = 2 * symbols - 2
    return parent, side


def climb(parent: np.ndarray, side: np.ndarray, symbols: np.ndarray, leaves: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Where the path of each of ``symbols`` starts, its length, and all inner nodes and bits of the paths from the root, their own parent."""
    lengths = np.zeros(len(symbols), np.int64)
    nodes, bits, owners = [], [], []
    where, at = np.arange(len(symbols)), symbols
    while True:
        alive = parent[at] != at
        where, at = where[alive], at[alive]
        if not len(at):
            break
        bits.append(side[at])
        at = parent[at]
        nodes.append(at - leaves)
        owners.append(where)
        lengths[where] += 1
    begins = np.cumsum(lengths) - lengths
    node, bit = np.zeros(lengths.sum(), np.uint32), np.zeros(lengths.sum(), np.uint8)
    for level, owner in enumerate(owners):
        place = begins[owner] + lengths[owner] - 1 - level
        node[place], bit[place] = nodes[level], bits[level]
    return begins, lengths, node, bit


def paths(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Huffman tree: where each symbol's path starts, its length, and all nodes and bits of the paths."""
    return climb(*huffman(weights), np.arange(len(weights)), len(weights))


@dataclass
class Events:
    """Decisions of some texts: place in the tree, bit, text, and one hash per context after the first, which is the place alone."""

    node: np.ndarray
    bit: np.ndarray
    text: np.ndarray
    contexts: list[np.ndarray]


@dataclass
class Choices:
    """Symbols of some texts: each one's path, its text, and one hash per context after the first.

    Paths are numbered by falling length; ``steps`` has the node and bit, in one number, of all paths that reach a level.
    """

    path: np.ndarray
    text: np.ndarray
    contexts: list[np.ndarray]
    length: np.ndarray
    steps: list[np.ndarray]

    def part(self, which) -> Choices:
        return Choices(self.path[which], self.text[which], [k[which] for k in self.contexts], self.length, self.steps)

    def events(self) -> Events:
        """The decisions one symbol after the other."""
        depth = self.length[self.path]
        offsets = np.cumsum([0, *map(len, self.steps)])
        found = np.concatenate([np.zeros(0, np.uint32), *self.steps])[np.repeat(self.path, depth) + offsets[ragged(depth)]]
        return Events(found >> np.uint32(1), found & np.uint32(1), np.repeat(self.text, depth), [np.repeat(k, depth) for k in self.contexts])

    def levels(self) -> Iterator[Events]:
        """The decisions of symbols that are in the order of their paths, and in place of texts where those symbols are.

        They go down side by side, so that nothing is repeated for each decision and like ones are neighbours.
        """
        for start in range(0, len(self.path), LEVEL_SYMBOLS):
            path = self.path[start:start + LEVEL_SYMBOLS]
            for step in self.steps:
                left = len(path) if path[-1] < len(step) else int(np.searchsorted(path, len(step)))
                if not left:
                    break
                found, place = step.take(path[:left]), slice(start, start + left)
                yield Events(found >> np.uint32(1), found & np.uint32(1), place, [k[place] for k in self.contexts])

    def once(self, number: int, fold: np.ndarray) -> Choices:
        """The symbols that differ in path, fold or one context, in order; that, the fold and how often are in place of contexts."""
        key = self.path << 33 | fold << 32
        if number:
            key |= self.contexts[number - 1]
        key.sort()
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][:len(key)])
        times = np.diff(np.r_[first, len(key)]).astype(np.uint32)
        key = key[first]
        own = [key.astype(np.uint32), (key >> 32).astype(np.uint32) & np.uint32(1), times]
        return Choices(key >> 33, first, own, self.length, self.steps)


def side_by_side(begin: np.ndarray, length: np.ndarray, node: np.ndarray, bit: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """The number of each path by falling length, and lengths and steps as ``Choices`` has them."""
    order = np.argsort(-length, kind="stable")
    number = np.empty_like(order)
    number[order] = np.arange(len(order))
    step, length, at = node << np.uint32(1) | bit, length[order], begin[order]
    return number, length, [step[at[:left] + level] for level, left in enumerate(_reaching(length))]


def _reaching(length: np.ndarray) -> list[int]:
    """How many paths reach each level."""
    return (len(length) - np.cumsum(np.bincount(length, minlength=1)))[:-1].tolist()


class Pieces:
    """Distinct words as they stand in a byte string, each with one byte after it."""

    def __init__(self, data: bytes, cuts: np.ndarray):
        self.data, self.cuts = data, cuts

    @classmethod
    def of(cls, words: list[bytes]) -> Pieces:
        return cls(b"".join(w + b" " for w in words), np.cumsum([0, *(len(w) + 1 for w in words)]))

    def __len__(self) -> int:
        return len(self.cuts) - 1

    def words(self, numbers: Iterable[int]) -> list[bytes]:
        begin, end = self.cuts[numbers].tolist(), self.cuts[np.asarray(numbers) + 1].tolist()
        return [self.data[a:b - 1] for a, b in zip(begin, end)]

    @property
    def sizes(self) -> np.ndarray:
        """Letters of each word and the byte after it."""
        return np.diff(self.cuts)

    def hashes(self) -> np.ndarray:
        """XXH64 of every word; words of one length are hashed together, those of 32 letters and more one by one."""
        data, lengths, found = np.frombuffer(self.data, np.uint8), self.sizes - 1, np.zeros(len(self), np.uint64)
        order = np.argsort(np.minimum(lengths, 32).astype(np.uint8), kind="stable")
        bounds = np.searchsorted(lengths[order], np.arange(33))
        for length, begin, end in zip(range(32), bounds, bounds[1:]):
            if end > begin:
                own = order[begin:end]
                found[own] = _short_hashes(data[self.cuts[own][:, None] + np.arange(length)], length)
        long = order[bounds[32]:]
        found[long] = [xxhash.xxh64_intdigest(w, HASH_SEED) for w in self.words(long)]
        return found.view(np.int64)


def _short_hashes(letters: np.ndarray, length: int) -> np.ndarray:
    one, two, three, four, five = HASH_PRIMES

    def turned(x: np.ndarray, by: int) -> np.ndarray:
        return x << np.uint64(by) | x >> np.uint64(64 - by)

    value, at = np.full(len(letters), np.uint64(HASH_SEED + length) + five), 0
    while at + 8 <= length:
        lane = np.ascontiguousarray(letters[:, at:at + 8]).view("<u8").ravel()
        value = turned(value ^ turned(lane * two, 31) * one, 27) * one + four
        at += 8
    if at + 4 <= length:
        lane = np.ascontiguousarray(letters[:, at:at + 4]).view("<u4").ravel().astype(np.uint64)
        value = turned(value ^ lane * one, 23) * two + three
        at += 4
    for k in range(at, length):
        value = turned(value ^ letters[:, k] * five, 11) * one
    value ^= value >> np.uint64(33)
    value *= two
    value ^= value >> np.uint64(29)
    value *= three
    return value ^ value >> np.uint64(32)


class Coder:
    """Turns texts into decisions."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, ends: int, escapes: int, letters: np.ndarray):
        """Words by falling count."""
        self.order = np.argsort(hashes)
        self.sorted = hashes[self.order]
        self.counts = np.r_[ends + 1, escapes + 1, counts].astype(np.int64)
        self.byte_tree = side_by_side(*paths(letters + 1))

    def classify(self, *followed: np.ndarray) -> None:
        """Give each word the class of the topic that it follows most above that topic's usual share; ``followed`` in parts."""
        totals = sum(t.sum(axis=0, dtype=np.float64) for t in followed) - followed[0][:FIRST_WORD].sum(axis=0, dtype=np.float64) + 1.0
        self.classes = np.zeros(len(self.counts), np.uint8)
        at = 0
        for table in followed:
            for begin in range(0, len(table), WIDE_WORDS):
                lift = (table[begin:begin + WIDE_WORDS] + totals / totals.sum()) / totals
                self.classes[at:at + len(lift)] = np.argmax(lift, axis=1) + FIRST_WORD
                at += len(lift)
        self.classes[[END, ESCAPE]] = END, ESCAPE
        self._grow_tree()

    def _grow_tree(self) -> None:
        """The classes' tree, with the tree of each class's words in the place of its leaf."""
        words = len(self.counts)
        present, place = np.unique(self.classes, return_inverse=True)
        own, own_side = huffman(np.bincount(place, self.counts).astype(np.int64))
        parent, side = [np.zeros(words, np.int64), own + words], [np.zeros(words, np.uint8), own_side]
        fresh = words + len(own)
        order = np.argsort(place, kind="stable")
        for number, members in enumerate(np.split(order, np.cumsum(np.bincount(place))[:-1])):
            size = len(members)
            up, bit = huffman(self.counts[members])
            # the root of the words' tree hangs where the class did
            up = np.where(up < size, 0, up - size + fresh)
            up[-1], bit[-1] = own[number] + words, own_side[number]
            parent[0][members], side[0][members] = up[:size], bit[:size]
            parent.append(up[size:])
            side.append(bit[size:])
            fresh += size - 1
        self.parent, self.side = np.concatenate(parent).astype(np.int32), np.concatenate(side)
        self.depth, at, alive = np.zeros(words, np.uint8), np.arange(words), np.arange(words)
        while len(alive):
            up = self.parent[at]
            alive, at = alive[up != at], up[up != at]
            self.depth[alive] += 1

    @property
    def nodes(self) -> int:
        """Places in the words' tree where a decision is made."""
        return len(self.parent) - len(self.counts)

    def symbols(self, distinct: Pieces | list[bytes], training: bool = False) -> np.ndarray:
        """A word's place by count, after the fixed symbols, or an escape.

        In training a word that was seen once is spelled: it was as new then as words to come will be.
        """
        if not len(distinct) or not len(self.sorted):
            return np.full(len(distinct), ESCAPE, np.int64)
        hashes = (distinct if isinstance(distinct, Pieces) else Pieces.of(distinct)).hashes()
        # in order, neighbours are found close together
        rising = np.argsort(hashes)
        hashes = hashes[rising]
        place = np.minimum(np.searchsorted(self.sorted, hashes), len(self.sorted) - 1)
        found = np.empty(len(hashes), np.int64)
        found[rising] = np.where(self.sorted[place] == hashes, self.order[place] + FIRST_WORD, ESCAPE)
        return np.where(self.counts[found] > 1, found, ESCAPE) if training else found

    def tokens(self, which: np.ndarray, found: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
        """Symbol, text, place of the text's first token and topic of every token; ``found`` has the distinct words' symbols."""
        symbol = np.insert(found[which], np.cumsum(sizes), END)
        text = np.repeat(np.arange(len(sizes)), sizes + 1)
        first = np.repeat(np.cumsum(sizes + 1) - sizes - 1, sizes + 1)
        frequent = np.where((symbol >= FIRST_WORD) & (symbol < FIRST_WORD + TOPIC_WORDS), np.arange(len(symbol)), -1)
        last = np.r_[-1, np.maximum.accumulate(frequent)[:-1]] if len(symbol) else frequent
        topic = np.where(last >= first, symbol[np.maximum(last, 0)] - FIRST_WORD + 1, 0)
        return symbol, text, first, topic

    def events(self, which: np.ndarray, distinct: Pieces | list[bytes], sizes: np.ndarray, training: bool = False) -> tuple[dict[str, Events], np.ndarray]:
        """Decisions on tokens, and on the letters of spelled words; number of tokens per text."""
        found = self.symbols(distinct, training)
        return next(self.parts(which, distinct, found, sizes, max(1, len(which) + len(sizes)))), sizes + 1

    def parts(
        self, which: np.ndarray, distinct: Pieces | list[bytes], found: np.ndarray, sizes: np.ndarray, tokens: int = EVENT_TOKENS
    ) -> Iterator[dict[str, Events]]:
        """``events`` of so many tokens after the others; words and their paths are looked up once for all."""
        words, *rest = self._words(which, distinct, found, sizes)
        for start in range(0, max(1, len(words.path)), tokens):
            part = slice(start, start + tokens)
            yield {"word": words.part(part).events(), "spell": self._letters(words, *rest, part).events()}

    def choices(self, which: np.ndarray, distinct: Pieces, found: np.ndarray, sizes: np.ndarray) -> dict[str, Choices]:
        """The symbols of all tokens, and the letters of spelled words."""
        words, *rest = self._words(which, distinct, found, sizes)
        return {"word": words, "spell": self._letters(words, *rest, slice(None))}

    def _words(self, which, distinct, found, sizes) -> tuple:
        symbol, text, first, topic = self.tokens(which, found, sizes)
        at = np.arange(len(symbol))
        one = np.r_[END, symbol[:-1]]
        one[at == first] = END
        two = np.r_[END, one[:-1]]
        two[at == first] = END
        number, length, steps = self._paths(np.r_[END, found])
        path = np.insert(number[which + 1], np.cumsum(sizes), number[0])
        keys = [mixed(topic + 1), mixed(one * 64 + 2), mixed(one * 0x1000003 + two + 1)]
        return Choices(path, text, keys, length, steps), which, distinct, symbol, topic

    def _paths(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """``side_by_side`` of the paths of symbols; equal symbols have one path."""
        # by falling depth, then by symbol
        names, number = np.unique((255 - self.depth[symbols].astype(np.int64)) << 32 | symbols, return_inverse=True)
        length, at = 255 - (names >> 32), (names & 0xFFFFFFFF).astype(np.int32)
        leaves, steps = len(self.counts), []
        # from the deepest leaf up; a path is met where its leaf is
        for left in reversed(_reaching(length)):
            side = self.side.take(at[:left])
            at[:left] = self.parent.take(at[:left])
            steps.append((at[:left] - leaves).astype(np.uint32) << np.uint32(1) | side)
        return number, length, steps[::-1]

    def _letters(self, words: Choices, which, distinct, symbol, topic, part: slice) -> Choices:
        rare = np.arange(len(symbol))[part][symbol[part] == ESCAPE]
        # the rare tokens' numbers among words: tokens without the ends before them
        named = which[rare - words.text[rare]]
        spelled = (distinct if isinstance(distinct, Pieces) else Pieces.of(distinct)).words(named)
        data = np.frombuffer(b"".join(w + b" " for w in spelled), np.uint8).astype(np.int64)
        lengths = np.array([len(w) + 1 for w in spelled], np.int64)
        place = ragged(lengths)
        back = [np.where(place >= k, np.r_[np.zeros(min(k, len(data)), np.int64), data[:-k]], 0) for k in range(1, 6)]
        subject = np.repeat(topic[rare], lengths)
        keys = [
            mixed((back[0] << 8 | back[1]) * 64 + subject),
            mixed((back[0] << 16 | back[1] << 8 | back[2]) * 64 + subject + 1 << 8),
            mixed((back[0] << 32 | back[1] << 24 | back[2] << 16 | back[3] << 8 | back[4]) + 7),
        ]
        number, length, steps = self.byte_tree
        return Choices(number[data], np.repeat(words.text[rare], lengths), keys, length, steps)


def mixed(values: np.ndarray) -> np.ndarray:
    x = values.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (x >> np.uint64(32)).astype(np.uint32)


def slots(context: np.ndarray, spread: np.ndarray, bits: int) -> np.ndarray:
    x = context ^ spread
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x2C1B3C6D)
    x >>= np.uint32(32 - bits)
    return x


def addresses(events: Events, bits: int) -> list[np.ndarray]:
    """Slot of each predictor; the first knows the place in the tree alone and is not hashed."""
    spread = events.node * SPREAD
    return [events.node, *(slots(c, spread, bits) for c in events.contexts)]


def pack(counts: np.ndarray) -> np.ndarray:
    """Odds of (no, yes) counts in steps, and in the last two bits how sure they are: never seen, hardly, some, often."""
    no, yes = counts[:, 0].astype(np.float32), counts[:, 1].astype(np.float32)
    steps = np.clip(np.rint(np.log((yes + 0.3) / (no + 0.3)) / ODDS_STEP), -8191, 8191).astype(np.int16)
    seen = counts.sum(axis=1)
    return steps << 2 | (seen > 0).astype(np.int16) + (seen > 2) + (seen > 12)


GATES = GATE_LEVELS ** 3


@dataclass
class Mixer:
    """Weights and refining table of one tree."""

    weights: np.ndarray
    hits: np.ndarray
    seen: np.ndarray

    @classmethod
    def fresh(cls) -> Mixer:
        return cls(np.tile([1.0, 0.0, 0.0, 0.0], (GATES, 1)), np.zeros(GATES * REFINE_STEPS), np.zeros(GATES * REFINE_STEPS))

    def combine(self, inputs: list[np.ndarray], gates: np.ndarray) -> np.ndarray:
        weights = np.ascontiguousarray(self.weights.T, inputs[0].dtype)
        # gates are within the table, and are looked up sooner where that isn't checked
        total = weights[0].take(gates, mode="clip")
        total *= inputs[0]
        for i in range(1, len(inputs)):
            more = weights[i].take(gates, mode="clip")
            more *= inputs[i]
            total += more
        return np.clip(total, -16, 16, out=total)

    @staticmethod
    def step(total: np.ndarray, gates: np.ndarray) -> np.ndarray:
        return gates * REFINE_STEPS + np.rint(total).astype(np.int32) + REFINE_STEPS // 2

    def shifts(self) -> np.ndarray:
        """What such odds as each step's have meant so far, above them; a step seen rarely changes little."""
        steps = np.tile(np.arange(REFINE_STEPS) - REFINE_STEPS // 2, GATES)
        usual = 1 / (1 + np.exp(-steps))
        meant = (self.hits + 20 * usual) / (self.seen + 20)
        return np.log(meant / (1 - meant)) - steps

    def refined(self, total: np.ndarray, gates: np.ndarray, shifts: np.ndarray | None = None) -> np.ndarray:
        """Half the combined odds and half what such odds have meant so far."""
        shifts = (self.shifts() if shifts is None else shifts).astype(total.dtype, copy=False) * total.dtype.type(0.5)
        return total + shifts.take(self.step(total, gates), mode="clip")

    def learn(self, inputs: list[np.ndarray], gates: np.ndarray, bit: np.ndarray) -> None:
        """One online step per few thousand decisions: each gate moves down its mean gradient."""
        for begin in range(0, len(bit), BATCH_EVENTS):
            part = slice(begin, begin + BATCH_EVENTS)
            x, g, b = [i[part].astype(np.float64) for i in inputs], gates[part], bit[part]
            total = self.combine(x, g)
            spot = self.step(total, g)
            self.hits += np.bincount(spot, b, GATES * REFINE_STEPS)
            self.seen += np.bincount(spot, minlength=GATES * REFINE_STEPS)
            chance = 1 / (1 + np.exp(-total))
            for i in range(len(x)):
                power = np.bincount(g, chance * (1 - chance) * x[i] ** 2, GATES)
                self.weights[:, i] += RATE * np.bincount(g, (b - chance) * x[i], GATES) / (power + 50)


@dataclass
class Model:
    """Coder, counts and mixers; workers are sent the packed tables, not the counts."""

    coder: Coder
    bits: dict[str, int]
    counts: dict[str, list[np.ndarray]]
    mixers: dict[str, Mixer] = field(default_factory=dict)
    packed: dict | None = None
    shifts: dict[str, np.ndarray] = field(default_factory=dict)

    def __getstate__(self):
        return {**self.__dict__, "counts": {}, "packed": self.packed or self._packed()}

    def _packed(self) -> dict[str, list[np.ndarray]]:
        return {k: [pack(t) for t in tables] for k, tables in self.counts.items()}

    def inputs(self, kind: str, events: Events) -> tuple[list[np.ndarray], np.ndarray]:
        """Odds of every predictor and the gate of every decision."""
        if self.packed is None:
            self.packed = self._packed()
        found = [table.take(at) for table, at in zip(self.packed[kind], addresses(events, self.bits[kind]))]
        gates = np.zeros(len(events.bit), np.int16)
        for part in found[1:]:
            gates = (gates << 2) + (part & 3)
        return [(part >> 2) * ODDS_STEP for part in found], gates.astype(np.intp)

    def learn(self, events: dict[str, Events]) -> None:
        self.shifts = {}
        for kind, part in events.items():
            if len(part.bit):
                inputs, gates = self.inputs(kind, part)
                self.mixers.setdefault(kind, Mixer.fresh()).learn(inputs, gates, part.bit)

    def score(self, events: dict[str, Events], tokens: np.ndarray) -> np.ndarray:
        """log10 probability of each text; ``tokens`` has as many numbers as there are texts."""
        total, texts = np.zeros(len(tokens)), len(tokens)
        for kind, part in events.items():
            if len(part.bit):
                total -= np.bincount(part.text, self.losses(kind, part), texts)
        return total / np.log(10)

    def score_choices(self, choices: dict[str, Choices], texts: int) -> np.ndarray:
        """``score`` of so many texts, all paths of which are gone down side by side."""
        total = np.zeros(texts)
        for kind, part in choices.items():
            part = part.part(np.argsort(part.path))
            lost = np.zeros(len(part.path))
            for events in part.levels():
                lost[events.text] += self.losses(kind, events)
            total -= np.bincount(part.text, lost, texts)
        return total / np.log(10)

    def losses(self, kind: str, events: Events) -> np.ndarray:
        """The natural logarithm of each decision's probability, without the sign."""
        inputs, gates = self.inputs(kind, events)
        mixer = self.mixers[kind]
        odds = mixer.combine(inputs, gates)
        if kind not in self.shifts:
            self.shifts[kind] = mixer.shifts().astype(odds.dtype)
        z = mixer.refined(odds, gates, self.shifts[kind])
        z *= np.float32(1) - np.float32(2) * events.bit.astype(np.float32)
        np.exp(z, out=z)
        z += np.float32(1)
        return np.log(z, out=z)


def _split(texts: pa.Array) -> tuple[np.ndarray, Pieces, np.ndarray]:
    """Numbers of all words, A-Z in lower case, into the distinct ones, those, and how many words each text has."""
    words = Words([t or b"" for t in texts.cast(pa.large_binary()).to_pylist()])
    # words stand one blank apart: a word and its blank reach to the next one
    bounds = np.r_[words.starts, words.ends[-1:] + 1].astype(np.int64)
    packed = pa.Array.from_buffers(pa.large_binary(), len(words.starts), [None, pa.py_buffer(bounds), pa.py_buffer(words.data)])
    coded = packed.dictionary_encode()
    _, cuts, raw = coded.dictionary.buffers()
    cuts = np.frombuffer(cuts, np.int64)[: len(coded.dictionary) + 1] if len(words.starts) else np.zeros(1, np.int64)
    return np.asarray(coded.indices, dtype=np.int64), Pieces(raw.to_pybytes() if raw else b"", cuts), words.counts


def _word_counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in column_chunks(batches):
        which, distinct, _ = _split(batch.column(0))
        n = np.bincount(which, minlength=len(distinct))
        words = distinct.words(np.arange(len(distinct)))
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(n, pa.int64())], ["word", "n"])


def _letter_counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(256, np.int64)
    for batch in batches:
        for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            total += np.bincount(np.frombuffer(word + b" ", np.uint8), minlength=256) * n
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(256)), pa.array(total)], ["letter", "n"])


def _follower(coder):
    """How often each word has been in each topic, over one task."""

    def follow(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width, size = TOPIC_WORDS + 1, len(coder.value.counts)
        wide = np.zeros(min(WIDE_WORDS, size) * width, np.int64)
        narrow = np.zeros(max(0, size - WIDE_WORDS) * width, np.uint32)
        for batch in column_chunks(batches, SPLIT_BYTES):
            words, distinct, sizes = _split(batch.column(0))
            symbol, _, _, topic = coder.value.tokens(words, coder.value.symbols(distinct), sizes)
            place, n = np.unique(symbol * width + topic, return_counts=True)
            # the wide ones come first
            cut = np.searchsorted(place, len(wide))
            wide[place[:cut]] += n[:cut]
            narrow[place[cut:] - len(wide)] += n[cut:].astype(np.uint32)
        yield from _slices("follow", 0, 0, wide)
        yield from _slices("follow", 1, 0, narrow)

    return follow


def _slices(kind: str, number: int, fold: int, table: np.ndarray) -> Iterator[pa.RecordBatch]:
    table = table.reshape(-1)
    for begin in range(0, len(table), 2 * SLICE):
        part = table[begin:begin + 2 * SLICE].astype("<i8")
        if part.any():
            data = zlib.compress(part.tobytes(), 1)
            yield pa.RecordBatch.from_pydict(
                {"kind": [kind], "number": [number], "fold": [fold], "slice": [begin // (2 * SLICE)], "data": [data]},
                schema=pa.schema([("kind", pa.string()), ("number", pa.int32()), ("fold", pa.int32()), ("slice", pa.int32()), ("data", pa.binary())]),
            )


def _counter(coder, bits: dict[str, int]):
    """Counts of one task for both folds, in slices; they go out before 32 bits could be full."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, held = {}, 0
        for batch in column_chunks(batches, SPLIT_BYTES):
            which, distinct, sizes = _split(batch.column(0))
            tuning = np.asarray(batch.column(1)).astype(np.int64)
            for kind, part in coder.value.choices(which, distinct, coder.value.symbols(distinct, True), sizes).items():
                fold = tuning[part.text]
                for number in range(len(PREDICTORS[kind])):
                    size = _table_size(coder.value, kind, number, bits)
                    if (kind, number) not in tables:
                        tables[kind, number] = np.zeros(4 * size, np.uint32)
                    for events in part.once(number, fold).levels():
                        context, own, times = events.contexts
                        slot = slots(context, events.node * SPREAD, bits[kind]) if number else events.node
                        place = own * np.uint32(size) + slot << np.uint32(1) | events.bit
                        np.add.at(tables[kind, number], place.astype(np.intp), times)
                held += int(part.length[part.path].sum())
            if held >= FULL_EVENTS:
                yield from sent(tables)
                tables, held = {}, 0
        yield from sent(tables)

    def sent(tables: dict) -> Iterator[pa.RecordBatch]:
        for (kind, number), table in tables.items():
            for f in (0, 1):
                yield from _slices(kind, number, f, table.reshape(2, -1)[f])

    return count


def _table_size(coder: Coder, kind: str, number: int, bits: dict[str, int]) -> int:
    if number:
        return 1 << bits[kind]
    if kind == "word":
        return coder.nodes if coder else CLASSES
    return 256


def _summed(group: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(zlib.decompress(d), "<i8") for d in group["data"])
    data = zlib.compress(total.astype("<i8").tobytes(), 1)
    first = group.iloc[0]
    return pd.DataFrame({"kind": [first["kind"]], "number": [first["number"]], "fold": [first["fold"]], "slice": [first["slice"]], "data": [data]})


def _tables(counted: DataFrame, coder: Coder, bits: dict[str, int]) -> dict[int, dict[str, list[np.ndarray]]]:
    folds = {
        f: {k: [np.zeros((_table_size(coder, k, i, bits), 2), np.int64) for i in range(len(p))] for k, p in PREDICTORS.items()}
        for f in (0, 1)
    }
    _add(counted, folds)
    return folds


def _add(counted: DataFrame, folds: dict[int, dict[str, list[np.ndarray]]]) -> None:
    for row in counted.toLocalIterator():
        part = np.frombuffer(zlib.decompress(row["data"]), "<i8").reshape(-1, 2)
        table = folds[row["fold"]][row["kind"]][row["number"]]
        table[row["slice"] * SLICE:row["slice"] * SLICE + len(part)] += part


def _learner(model):
    def learn(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(model.value.coder, model.value.bits, {}, packed=model.value.packed)
        for batch in column_chunks(batches, EVENT_BYTES):
            own.learn(own.coder.events(*_split(batch.column(0)), True)[0])
        for kind, mixer in own.mixers.items():
            yield pa.RecordBatch.from_pydict({
                "kind": [kind], "events": [float(mixer.seen.sum())], "weights": [mixer.weights.ravel().tolist()],
                "hits": [mixer.hits.tolist()], "seen": [mixer.seen.tolist()],
                "used": [mixer.seen.reshape(GATES, -1).sum(axis=1).tolist()],
            })

    return learn


def _averaged(rows: list, kind: str) -> Mixer:
    """The tasks' weights, each gate averaged by how often a task has used it; the refining counts are added."""
    mixer, used, total = Mixer.fresh(), np.full(GATES, 1e-9), Mixer.fresh().weights * 1e-9
    for row in rows:
        if row["kind"] == kind:
            n = np.array(row["used"])
            total += np.array(row["weights"]).reshape(GATES, 4) * n[:, None]
            used += n
            mixer.hits += np.array(row["hits"])
            mixer.seen += np.array(row["seen"])
    mixer.weights = total / used[:, None]
    return mixer


def _scorer(model, hot, floor: float, scale: float, end_log: float, known_end: bool):
    """Score and base score of each text; words outside the hot ones go out with how often they occur."""

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs = hot.value
        for batch in column_chunks(batches, SPLIT_BYTES):
            which, distinct, sizes = _split(batch.column(2))
            found = model.value.coder.symbols(distinct)
            scores = model.value.score_choices(model.value.coder.choices(which, distinct, found, sizes), len(sizes))
            value = logs[found]
            per_word = value[which] if len(which) else np.zeros(0)
            text = np.repeat(np.arange(len(sizes)), sizes)
            rare = np.isnan(per_word)
            base = np.bincount(text, np.where(rare, 0.0, per_word), len(sizes)) + end_log
            known = np.bincount(text, ~rare, len(sizes)).astype(np.int64) + known_end
            # one number for a text and a word sorts many times as fast as pairs
            width = max(1, len(distinct))
            pairs, n = np.unique(text[rare] * width + which[rare], return_counts=True)
            bounds = np.searchsorted(pairs, np.arange(len(sizes) + 1) * width)
            words = pa.array(distinct.words(pairs % width), pa.binary())
            offsets = pa.array(bounds, pa.int32())
            n_bytes = np.bincount(text, distinct.sizes[which], len(sizes)).astype(np.int64) + 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes + 1), pa.array(n_bytes), pa.array(known), pa.array(base), pa.array(scores),
                 pa.ListArray.from_arrays(offsets, words), pa.ListArray.from_arrays(offsets, pa.array(n, pa.int64()))],
                ["id", "held_out", "n_tokens", "n_bytes", "known", "base", "score", "words", "times"],
            )

    return score


def score_texts(
    docs: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text",
    max_words: int = MAX_WORDS, slot_bits: tuple[int, int] = SLOT_BITS,
) -> DataFrame:
    """``(id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte)`` for every row of ``docs``.

    The model learns from the rows for which ``held_out(id)`` does not hold.  Word counts over all of
    them are exact: ``base_score`` is that of smoothed word frequencies.  The predictors' counts are taken over all
    of them too, in 64 bits; one document in eight is first kept apart to learn the weights, online and one task beside the other,
    whose weights are then averaged, and counted afterwards.  Tables grow with the training tokens
    up to 2 ** ``slot_bits[1]`` slots each, in which contexts then share slots; ``max_words`` bounds the word tree.  These
    sizes bound the model that is broadcast.  Words outside the tree meet their exact counts in a join.

    ``score`` is the log10 probability of the lower-cased (A-Z) words and the end; ``bits_per_byte`` divides its bits
    by the length of the words with a separator each and the end.  A null or empty text is an end alone.  A null id
    trains.  Repeated rows get equal results and count each time.  Without
    training text every count is zero.  Other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(
        col(id_col).alias("id"), F.coalesce(col(text_col), F.lit("")).alias("text"),
        F.coalesce(held_out(col(id_col)), F.lit(False)).alias("held_out"),
    )
    train = rows.where(~F.col("held_out"))
    words = materialise(
        train.select("text").mapInArrow(_word_counts, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n")), "words"
    )
    totals = words.agg(F.count(F.lit(1)).alias("v"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    ends = train.count()
    n, v = totals["n"] + ends, totals["v"] + (ends > 0)
    floor, scale = 0.1, n + 0.1 * (v + 1)

    # the words with a class: those of a count from which on there are at most max_words
    histogram = sorted(map(tuple, words.groupBy("n").count().collect()), reverse=True)
    room, least = max_words, 1
    for count, found in histogram:
        room -= found
        if room < 0:
            least = count + 1
            break
    top = words.where(F.col("n") >= least).select(F.xxhash64("word").alias("h"), "n").toArrow()
    hashes, counts = (top.column(i).to_numpy() for i in (0, 1))
    falling = np.lexsort((hashes, -counts))
    hashes, counts = hashes[falling], counts[falling]
    del top, falling
    rest = words.where(F.col("n") < least)
    spelled = words.where((F.col("n") < least) | (F.col("n") == 1))
    letters = np.zeros(256, np.int64)
    for row in spelled.mapInArrow(_letter_counts, "letter bigint, n bigint").groupBy("letter").agg(F.sum("n")).collect():
        letters[row[0]] = row[1]
    escapes = int(totals["n"] - counts[counts > 1].sum())
    coder = Coder(hashes, counts, ends, escapes, letters)
    shared = spark.sparkContext.broadcast(coder)
    # a task's tables are as large as the model: no more tasks than cores
    tasks = max(1, spark.sparkContext.defaultParallelism)
    schema = "kind string, number int, fold int, slice int, data binary"
    followed = train.select("text").coalesce(tasks).mapInArrow(_follower(shared), schema)
    followed = followed.groupBy("kind", "number", "fold", "slice").applyInPandas(_summed, schema)
    wide = min(WIDE_WORDS, len(coder.counts))
    tables = [np.zeros((rows, TOPIC_WORDS + 1), kind) for rows, kind in ((wide, np.int64), (len(coder.counts) - wide, np.uint32))]
    for row in followed.toLocalIterator():
        part = np.frombuffer(zlib.decompress(row["data"]), "<i8")
        begin = row["slice"] * 2 * SLICE
        tables[row["number"]].reshape(-1)[begin:begin + len(part)] = part
    coder.classify(*tables)
    del tables
    wanted = int(np.clip(np.ceil(np.log2(max(n, 1) / TOKENS_PER_SLOT + 1)), *slot_bits))
    bits = {"word": wanted, "spell": min(wanted, LETTER_BITS)}

    shared = spark.sparkContext.broadcast(coder)
    tuning = (F.pmod(F.xxhash64("id", F.lit(3)), F.lit(TUNING_SHARE)) == 0).alias("tuning")
    counted = train.select("text", tuning).coalesce(tasks).mapInArrow(_counter(shared, bits), schema)
    summed = materialise(counted.groupBy("kind", "number", "fold", "slice").applyInPandas(_summed, counted.schema), "counts")
    tables = _tables(summed.where("fold = 0"), coder, bits)[0]
    apart = spark.sparkContext.broadcast(Model(coder, bits, tables))
    learned = train.select("text", tuning).where("tuning").select("text").coalesce(tasks).mapInArrow(
        _learner(apart), "kind string, events double, weights array<double>, hits array<double>, seen array<double>, used array<double>"
    ).collect()
    apart.unpersist()
    _add(summed.where("fold = 1"), {1: tables})
    model = Model(coder, bits, tables, {k: _averaged(learned, k) for k in PREDICTORS})

    logs = np.r_[np.nan, np.nan, np.log10((counts + floor) / scale)]
    scored = materialise(
        rows.select("id", "held_out", "text").mapInArrow(
            _scorer(spark.sparkContext.broadcast(model), spark.sparkContext.broadcast(logs), floor, scale,
                    float(np.log10((ends + floor) / scale)), ends > 0),
            f"id {id_type(docs, id_col)}, held_out boolean, n_tokens bigint, n_bytes bigint, known bigint, base double, "
            "score double, words array<binary>, times array<bigint>",
        ).withColumn("row", F.monotonically_increasing_id()),
        "scored",
    )
    asked = scored.select("row", F.explode(F.arrays_zip("words", "times")).alias("x")).select("row", "x.words", "x.times")
    met = asked.join(rest, asked["words"] == rest["word"], "left").groupBy("row").agg(
        F.sum(F.col("times") * F.log10((F.coalesce("n", F.lit(0)) + F.lit(floor)) / F.lit(scale))).alias("more"),
        F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("also"),
    )
    return scored.drop("words", "times").join(met, "row", "left").select(
        "id", "held_out", "n_tokens", (F.col("known") + F.coalesce("also", F.lit(0))).alias("n_known"),
        F.lit(n).cast("bigint").alias("train_tokens"), (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), "score",
        (F.col("score") * float(-np.log2(10)) / F.col("n_bytes")).alias("bits_per_byte"),
    )

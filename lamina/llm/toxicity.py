"""Toxicity: Levenshtein automata over a lexicon trie find misspelled terms, their context tells quotation from abuse."""

from __future__ import annotations

from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from math import log
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.text import ROW, blank_separated, col, column_chunks, id_text, id_type, with_row, without_rows
from lamina.session import materialise

# Documents of each class that lexicon and weights are learned from, at most, picked by a hash of the id.
MAX_LABELLED = 10_000
# A term is this much likelier in toxic text, and its counts are unlikely to be chance given how many were tried.
MIN_RATIO = 8.0
EXTRA_EVIDENCE = 2.0
STEM_LENGTHS = range(5, 13)
# Whole words of this length on may have one edit, if few clean words are that near.
FUZZY_LENGTH = 5
# States an automaton keeps, and places in the trie that they hold together; it starts afresh beyond them, which changes
# time only.  So many words take their steps together.
MAX_STATES = 1 << 14
MAX_PLACES = 1 << 19
WALK_WORDS = 1 << 11
FUZZY_NEIGHBOURS = 3
FUZZY_SHARE = 0.8
# Words on each side that are a match's context, and the share of its weight a quoted match keeps.
WINDOW = 4
QUOTED_SHARE = 0.2
CACHE_PIECES = 1 << 17
# Texts are read about so many bytes at a time.
CHUNK_BYTES = 1 << 20
THRESHOLD = 0.3
# Marks of quotation, stems of words that report speech in en, de, fr and es, letters written as digits or signs.
QUOTES = "\"“”„«»‘’‹›"
REPORTS = (
    "quot", "said", "call", "word", "term", "slur", "report", "wrote", "phrase",
    "zitat", "zitier", "sagte", "nannte", "wort", "cité", "citer", "disait", "cita", "dijo", "palabra",
)
LOOKALIKES = str.maketrans("013457@$!", "oieastasi")
EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "“”„«»‘’‹›¡¿…"


def plain_word(piece: bytes) -> str:
    """The piece in lower case without marks at its ends."""
    return piece.decode("utf-8", "replace").strip(EDGE).lower()


class Automaton:
    """The trie of a lexicon walked by Levenshtein automata of one edit, made deterministic as words need it.

    A state is a set of (trie node, edits so far) and the best stem passed without an edit; one table of
    transitions serves all words, which take their steps together.
    """

    def __init__(self, whole: dict[str, float], stems: dict[str, float], fuzzy: set[str]):
        self.children: list[dict[int, int]] = [{}]
        self.stem, self.whole, self.soft, self.below = [0.0], [0.0], [None], [False]
        letters = sorted({c for term in (*whole, *stems) for c in term})
        # class 0: the end or a letter that no term has
        self.classes = np.zeros(0x110000, np.int32)
        self.classes[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.alphabet = len(letters) + 1
        self.length = max(map(len, (*whole, *stems)), default=0) + 2
        for term, weight in stems.items():
            node = self._node(term)
            self.stem[node] = weight
        for term, weight in whole.items():
            node = self._node(term, term in fuzzy)
            self.whole[node] = weight
            if term in fuzzy:
                self.soft[node] = term
        self.weights = whole
        self._restart()

    def _restart(self) -> None:
        self.numbers: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.places = 0
        self.table = np.zeros((0, self.alphabet), np.int32)
        self.start = self._number(self._closed({0}), 0.0)

    def _node(self, term: str, fuzzy: bool = False) -> int:
        node = 0
        for letter in self.classes[[ord(c) for c in term]].tolist():
            self.below[node] |= fuzzy
            if letter not in self.children[node]:
                self.children[node][letter] = len(self.children)
                self.children.append({})
                self.stem.append(0.0)
                self.whole.append(0.0)
                self.soft.append(None)
                self.below.append(False)
            node = self.children[node][letter]
        self.below[node] |= fuzzy
        return node

    def _closed(self, items: set[int]) -> bytes:
        """With the states reached by leaving out a letter of a term; an item is twice a node, plus one after an edit.

        The items of a state are packed in order, four bytes each.
        """
        more = {2 * c + 1 for item in items if not item & 1 and self.below[item >> 1]
                for c in self.children[item >> 1].values() if self.below[c]}
        return array("i", sorted(items | more)).tobytes()

    def _number(self, items: bytes, stem: float) -> int:
        key = (items, stem)
        if key not in self.numbers:
            self.numbers[key] = len(self.states)
            self.states.append(key)
            self.places += len(items) // 4
            if len(self.states) > len(self.table):
                self.table = np.concatenate([self.table, np.full((max(64, len(self.table)), self.alphabet), -1, np.int32)])
        return self.numbers[key]

    def _step(self, state: int, letter: int) -> int:
        items, stem = self.states[state]
        reached = set()
        for item in memoryview(items).cast("i"):
            node, edits = item >> 1, item & 1
            child = self.children[node].get(letter)
            if child is not None and (not edits or self.below[child]):
                reached.add(2 * child + edits)
                if not edits:
                    stem = max(stem, self.stem[child])
            if not edits and self.below[node]:
                reached.add(2 * node + 1)
                reached.update(2 * c + 1 for c in self.children[node].values() if self.below[c])
        return self._number(self._closed(reached), stem)

    def walk(self, words: list[str]) -> np.ndarray:
        """The state each word ends in; letters beyond the longest term can't lead back to one."""
        if len(self.states) > MAX_STATES or self.places > MAX_PLACES:
            self._restart()
        if not words or not self.length:
            return np.full(len(words), self.start)
        letters = np.array(words, dtype=f"U{self.length}").view(np.uint32).reshape(len(words), self.length)
        lengths = np.minimum([len(w) for w in words], self.length)
        state = np.full(len(words), self.start, np.int64)
        for at in range(int(lengths.max(initial=0))):
            rows = np.flatnonzero(lengths > at)
            letter = self.classes[letters[rows, at]]
            fresh = self.table[state[rows], letter]
            missing = np.flatnonzero(fresh < 0)
            if len(missing):
                pairs = np.unique(state[rows[missing]] * self.alphabet + letter[missing])
                for pair in pairs.tolist():
                    found = self._step(pair // self.alphabet, pair % self.alphabet)
                    self.table[pair // self.alphabet, pair % self.alphabet] = found
                fresh = self.table[state[rows], letter]
            state[rows] = fresh
        return state

    def result(self, state: int) -> tuple[float, str | None]:
        """Weight of the exact term or best stem, and the best term one edit away."""
        items, stem = self.states[state]
        exact, near = stem, None
        for item in memoryview(items).cast("i"):
            node, edits = item >> 1, item & 1
            if not edits:
                exact = max(exact, self.whole[node])
            elif self.soft[node] and (near is None or (self.weights[self.soft[node]], self.soft[node]) > (self.weights[near], near)):
                near = self.soft[node]
        return exact, near


@dataclass
class Learned:
    """What a worker has found out with a lexicon."""

    name: str
    automaton: Automaton
    weights: dict[bytes, float] = field(default_factory=dict)


_last: Learned | None = None


@dataclass
class Lexicon:
    """Terms with their weights, words that only look like one, and the weights of a document's features."""

    whole: dict[str, float]
    stems: dict[str, float]
    fuzzy: set[str]
    clean: set[str] = field(default_factory=set)
    weights: list[float] = field(default_factory=list)
    name: str = field(default_factory=lambda: uuid4().hex)

    def __getstate__(self):
        # what is sent out is a lexicon of its own, as this one may change
        return {**self.__dict__, "name": uuid4().hex}

    def _learned(self) -> Learned:
        """The automaton and cache of this lexicon; a worker keeps those of the lexicon it used last alone."""
        global _last
        if _last is None or _last.name != self.name:
            _last = Learned(self.name, Automaton(self.whole, self.stems, self.fuzzy))
        return _last

    @property
    def automaton(self) -> Automaton:
        return self._learned().automaton

    def near(self, words: list[str]) -> list[str | None]:
        """The term that each word is one edit away from, if it is no term itself."""
        results = self._results(words)
        return [term if not exact else None for exact, term in results]

    def _results(self, words: list[str]) -> list[tuple[float, str | None]]:
        results = []
        for begin in range(0, len(words), WALK_WORDS):
            states = self.automaton.walk(words[begin:begin + WALK_WORDS])
            found = {s: self.automaton.result(s) for s in np.unique(states).tolist()}
            results += [found[s] for s in states.tolist()]
        return results

    def learn(self, pieces: list[bytes]) -> None:
        known = self._learned().weights
        if len(known) > CACHE_PIECES:
            known.clear()
        fresh = [p for p in pieces if p not in known]
        words = [plain_word(p) for p in fresh]
        for piece, word, (exact, term) in zip(fresh, words, self._results(words)):
            if not exact and term and word not in self.clean:
                exact = FUZZY_SHARE * self.whole[term]
            known[piece] = exact
        # digits and signs for letters: read them as the letters
        again = [(p, r) for p, w in zip(fresh, words) if (r := w.translate(LOOKALIKES)) != w and not w.isdigit()]
        for (piece, read), (exact, _) in zip(again, self._results([r for _, r in again])):
            known[piece] = max(known[piece], FUZZY_SHARE * exact if read in self.whole else 0.0)

    def features(self, texts: pa.Array) -> np.ndarray:
        """One row per text: abuse, matches, strongest match, length."""
        which, distinct, sizes = blank_separated(texts)
        self.learn(distinct)
        weight = np.fromiter(map(self._learned().weights.__getitem__, distinct), float, len(distinct))[which]
        ends = np.cumsum(sizes)
        out = np.zeros((len(sizes), 4))
        out[:, 3] = np.log1p(sizes)
        matches = np.flatnonzero(weight)
        docs = np.searchsorted(ends, matches, side="right")
        seen: dict[int, dict[int, float]] = {}
        for at, doc in zip(matches.tolist(), docs.tolist()):
            begin, end = max(at - WINDOW, int(ends[doc] - sizes[doc])), min(at + WINDOW + 1, int(ends[doc]))
            context = [distinct[i] for i in which[begin:end].tolist()]
            value = float(weight[at]) * (QUOTED_SHARE if quoted(context, at - begin) else 1.0)
            terms = seen.setdefault(doc, {})
            terms[int(which[at])] = max(terms.get(int(which[at]), 0.0), value)
            out[doc, 1] += value / weight[at]
            out[doc, 2] = max(out[doc, 2], value)
        for doc, terms in seen.items():
            out[doc, 0] = min(sum(terms.values()), 40.0)
        out[:, 1] = np.log1p(out[:, 1])
        return out

    def score(self, texts: pa.Array) -> np.ndarray:
        rows = self.features(texts)
        return 1 / (1 + np.exp(-np.clip(np.c_[np.ones(len(rows)), rows] @ np.array(self.weights), -30, 30)))


def quoted(context: list[bytes], at: int) -> bool:
    """Whether the word at ``at`` stands between marks of quotation or just behind a word of reporting."""
    words = [c.decode("utf-8", "replace") for c in context]
    if any(plain.startswith(REPORTS) for plain in (w.strip(EDGE).lower() for w in words[:at])):
        return True
    opens = any(w[0] in QUOTES for w in words[: at + 1])
    closes = any(w.rstrip(".,;:!?").endswith(tuple(QUOTES)) for w in words[at:])
    return opens and closes


def _word_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of labelled texts with a hash of the words beside them, each once in a batch."""
    for batch in column_chunks(batches, CHUNK_BYTES):
        which, distinct, sizes = blank_separated(batch.column(1))
        words = [plain_word(p) for p in distinct]
        names = dict.fromkeys(words)
        numbers = {w: i for i, w in enumerate(names)}
        number = np.array([numbers[w] for w in words], np.int64)[which]
        hashes = np.array([hash_word(w) for w in names], np.uint64)[number] if len(number) else np.zeros(0, np.uint64)
        # beyond a text's ends there is nothing, so that copies have equal surroundings everywhere
        ends = np.cumsum(sizes)[sizes > 0]
        before, after = np.r_[np.uint64(0), hashes[:-1]], np.r_[hashes[1:], np.uint64(0)]
        before[ends - sizes[sizes > 0]] = 0
        after[ends - 1] = 0
        around = before[: len(number)] ^ after[: len(number)] * np.uint64(31)
        label = np.repeat(np.asarray(batch.column(2)).astype(np.int64), sizes)
        rows = np.unique(np.stack([number, around.view(np.int64), label]), axis=1)
        named = pa.array(list(names), pa.string()).take(pa.array(rows[0]))
        yield pa.RecordBatch.from_arrays([named, pa.array(rows[1]), pa.array(rows[2].astype(np.int32))], ["word", "around", "toxic"])


def hash_word(word: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(word)


def _labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, train, most: int) -> DataFrame:
    """``(id, text, toxic)`` of at most about ``most`` training documents of each class."""
    known = labels.where(col(label_col).isNotNull() & col(id_col).isNotNull()).groupBy(col(id_col).alias("_id")).agg(
        (F.max(col(label_col)) > 0).cast("int").alias("toxic")
    ).where(train(F.col("_id")))
    known = materialise(known, "labels")
    totals = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    place = F.pmod(F.xxhash64("_id", F.lit(7)), F.lit(1 << 20)) / float(1 << 20)
    rate = F.when(F.col("toxic") == 1, most / max(totals.get(1, 0), 1)).otherwise(most / max(totals.get(0, 0), 1))
    picked = known.where(place < rate)
    # at most about 2 * most ids
    chosen = docs.join(F.broadcast(picked), col(id_col) == F.col("_id")).select(
        F.col("_id").alias("id"), F.coalesce(col(text_col), F.lit("")).alias("text"), "toxic"
    )
    return materialise(chosen, "labelled"), totals


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    train=None, max_labelled: int = MAX_LABELLED,
) -> Lexicon:
    """Learn terms and weights from labelled documents for which ``train(id)`` holds.

    All words and stems that are much likelier in toxic text than in clean text are the terms.  They are counted
    by the distinct pairs of words around them, so that copies of a document count once.
    Whole words may be met with one edit, unless several clean words are that near; clean words
    near a term are remembered.  A logistic model over four features of a document, fitted to the same documents
    and weighted back to the classes' true shares, gives the score.

    Up to ``max_labelled`` documents of each class are used (a hash of the id picks them); more labels
    don't change the cost.  Without both classes there are no terms and the score is the share of toxic labels.
    """
    train = train or (lambda _: F.lit(True))
    sample, totals = _labelled(docs, labels, id_col, text_col, label_col, train, max_labelled)
    toxic_total, clean_total = totals.get(1, 0), totals.get(0, 0)
    lexicon = Lexicon({}, {}, set())
    prior = (toxic_total + 0.5) / (toxic_total + clean_total + 1) if toxic_total else 0.0
    lexicon.weights = [log(prior / (1 - prior)) if prior else -30.0, 0.0, 0.0, 0.0, 0.0]
    if not toxic_total or not clean_total or sample.isEmpty():
        return lexicon
    pairs = sample.select("id", "text", "toxic").mapInArrow(_word_batches, "word string, around bigint, toxic int")
    words = materialise(
        pairs.where("word <> ''").distinct().groupBy("word").agg(
            F.count_if(F.col("toxic") == 1).alias("t"), F.count_if(F.col("toxic") == 0).alias("c")
        ), "words",
    )
    sums = words.agg(F.sum("t").alias("t"), F.sum("c").alias("c")).first()
    t_all, c_all = sums["t"] or 1, sums["c"] or 1
    share = t_all / (t_all + c_all)
    lengths = F.array(*[F.lit(n) for n in STEM_LENGTHS])
    stems = F.transform(
        F.filter(lengths, lambda n: n < F.length("word")), lambda n: F.struct(F.substring("word", F.lit(1), n).alias("term"), F.lit(False).alias("whole"))
    )
    terms = F.concat(stems, F.array(F.struct(F.col("word").alias("term"), F.lit(True).alias("whole"))))
    counted = words.select(F.explode(terms).alias("x"), "t", "c").groupBy("x.term", "x.whole").agg(
        F.sum("t").alias("t"), F.sum("c").alias("c")
    )
    tried = materialise(counted.where("t > 1"), "terms")
    n = F.col("t") + F.col("c")
    evidence = F.col("t") * F.log(F.col("t") / (n * share)) + F.when(
        F.col("c") > 0, F.col("c") * F.log(F.col("c") / (n * (1 - share)))
    ).otherwise(0.0)
    ratio = (F.col("t") + 0.5) / (F.col("c") + 0.5) * (c_all / t_all)
    found = tried.withColumn("ratio", ratio).withColumn("evidence", evidence).where(
        (F.col("ratio") >= MIN_RATIO) & (F.col("evidence") >= log(max(tried.count(), 1)) + EXTRA_EVIDENCE)
    ).orderBy(F.desc("evidence"), "term").collect()
    for row in found:
        (lexicon.whole if row["whole"] else lexicon.stems)[row["term"]] = log(row["ratio"])
    lexicon.stems = telling_stems(lexicon.stems)
    lexicon.fuzzy = {w for w in lexicon.whole if len(w) >= FUZZY_LENGTH}
    _keep_apart(lexicon, words)
    lexicon.weights = _weights(sample, lexicon, toxic_total, clean_total)
    return lexicon


def telling_stems(stems: dict[str, float]) -> dict[str, float]:
    """Without the stems that weigh no more than a shorter stem of theirs: a word gets the largest weight of its stems."""
    kept: dict[str, float] = {}
    for stem in sorted(stems, key=len):
        if all(kept.get(stem[:n], -np.inf) < stems[stem] for n in STEM_LENGTHS if n < len(stem)):
            kept[stem] = stems[stem]
    return kept


def _keep_apart(lexicon: Lexicon, words: DataFrame) -> None:
    """Remember the clean words one edit from a term; a term with several of them must be spelled exactly."""
    shared = words.sparkSession.sparkContext.broadcast(lexicon)

    def near(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0).to_pylist()
            found = [(w, t) for w, t in zip(names, shared.value.near(names)) if t]
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.string()) for i in (0, 1)], ["word", "term"])

    clean = words.where("c > 0").select("word").mapInArrow(near, "word string, term string")
    rows = clean.collect()
    neighbours: dict[str, int] = {}
    for row in rows:
        neighbours[row["term"]] = neighbours.get(row["term"], 0) + 1
    lexicon.clean = {r["word"] for r in rows}
    lexicon.fuzzy = {t for t in lexicon.fuzzy if neighbours.get(t, 0) < FUZZY_NEIGHBOURS}
    lexicon.name = uuid4().hex


def _weights(sample: DataFrame, lexicon: Lexicon, toxic_total: int, clean_total: int) -> list[float]:
    """Logistic regression with a small ridge by Newton's method, over at most twice ``MAX_LABELLED`` rows."""
    shared = sample.sparkSession.sparkContext.broadcast(lexicon)

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in column_chunks(batches, CHUNK_BYTES):
            found = shared.value.features(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(2), *map(pa.array, found.T)], ["toxic", "a", "b", "c", "d"])

    table = sample.mapInArrow(rows, "toxic int, a double, b double, c double, d double").toArrow()
    y = table.column(0).to_numpy().astype(float)
    x = np.c_[np.ones(len(y)), *(table.column(i).to_numpy() for i in range(1, 5))]
    weight = np.where(y == 1, toxic_total / max((y == 1).sum(), 1), clean_total / max((y == 0).sum(), 1))
    weight = weight / weight.mean()
    ridge = np.diag([1e-6, 0.1, 0.1, 0.1, 0.1])
    beta = np.zeros(5)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (weight * (y - p)) - ridge @ beta
        step = np.linalg.solve((x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + ridge, gradient)
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return beta.tolist()


def _scorer(lexicon):
    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in column_chunks(batches, CHUNK_BYTES):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lexicon.value.score(batch.column(1)))], ["id", "score"])

    return score


def score(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``(id, score, predicted)`` for every row of ``docs``; ``predicted`` is 1 from ``threshold`` on.

    A null or empty text has no matches and gets the score of such texts.  Repeated rows get equal scores.  Only
    the text decides; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    scored = id_text(docs, id_col, text_col).mapInArrow(_scorer(shared), f"id {id_type(docs, id_col)}, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def remainder(name, parts: int):
    """crc32 of the id as text, modulo ``parts``."""
    return F.crc32(F.col(name).cast("string") if isinstance(name, str) else name.cast("string")) % parts


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without those predicted toxic, judged each by its own text; a row without an id, which can't be named, stays."""
    lexicon = fit(docs, labels, id_col, text_col, train=lambda i: remainder(i, 4) != 2)
    goes = score(with_row(docs, id_col, text_col), lexicon, ROW, text_col).where("predicted = 1")
    return without_rows(docs, goes, id_col, text_col)

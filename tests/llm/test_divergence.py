import re
from collections import Counter, defaultdict

import pytest
from oracle import compare, connect

from lamina.llm import divergence
from lamina.llm.queries import ORACLES, QUERIES

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, term string, n int, p string, `lang.source` string"


def brute(rows, min_docs, top):
    docs = [(lang or "", source or "", TERM.findall((text or "").translate(UPPER))) for text, lang, source in rows]
    seen, counts, groups = Counter(), defaultdict(Counter), defaultdict(set)
    for lang, source, terms in docs:
        seen.update((lang, t) for t in set(terms))
        counts[lang, source].update(terms)
        counts[lang, None].update(terms)
        groups[lang].add(source)
    out = []
    for lang, sources in groups.items():
        kept = [t for (own, t), n in seen.items() if own == lang and n >= min_docs]

        def rates(source):
            n = sum(counts[lang, source][t] for t in kept)
            return {t: 1 + 10**9 * (counts[lang, source][t] + 5) // (n + 5 * len(kept)) for t in kept}

        whole = rates(None)
        for source in sources:
            own = rates(source)
            pair = [(s, sum(abs(own[t] - q) for t, q in rates(s).items())) for s in sources if s != source]
            term = [(t, own[t] - whole[t]) for t in kept if counts[lang, source][t] and own[t] > whole[t]]
            for part, items in (("pair", pair), ("term", term)):
                ranked = sorted(items, key=lambda i: (-i[1], i[0].encode()))
                out += [(lang, source, part, i, v, k + 1) for k, (i, v) in enumerate(ranked) if part == "pair" or k < top]
    return sorted(out)


TEXTS = [
    ("One TWO two-three été ÉTÉ", "en", "a"), ("one one 1 2 3 _x_y", "en", "a"), ("two zwei", "en", "b"), ("", "en", "c"), (None, "en", None),
    ("one two", None, None), ("one two", None, "a"), ("one two", None, "a"), ("x\x00y\x7fz", "de", "b"), ("X y Z", "de", "a"),
    ("你好 world 你好", "de", ""), ("world", "de", ""), ("only here", "fr", "solo"), ("one " * 3000, "en", "b"), ("tie eit", "es", "a"), ("tie eit", "es", "b"),
]


def told(frame):
    return sorted(tuple(r) for r in frame.select("lang", "source", "part", "item", "value", "rank").collect())


@pytest.mark.parametrize("min_docs,top", [(1, 2), (2, 50), (4, 50), (99, 50)])
def test_awkward_rows(spark, min_docs, top):
    docs = spark.createDataFrame([(i, *r, "t", 1, "p", "q") for i, r in enumerate(TEXTS)], SCHEMA).repartition(3)
    assert told(divergence.source_audit(docs, min_docs=min_docs, top=top)) == brute(TEXTS, min_docs, top)


def test_small_slices_and_handed_sums(spark, monkeypatch):
    monkeypatch.setattr(divergence, "SLICE", 2)
    docs = spark.createDataFrame([(i, *r, "t", 1, "p", "q") for i, r in enumerate(TEXTS)], SCHEMA)
    assert told(divergence.source_audit(docs, min_docs=1)) == brute(TEXTS, 1, 50)


def test_no_rows(spark):
    assert divergence.source_audit(spark.createDataFrame([], SCHEMA)).collect() == []


def test_long_texts_are_read_in_stretches(monkeypatch):
    text = "abc déf, " * 50 + "x" * 300 + " End"
    whole = [t for part in divergence.term_lists(text) for t in part]
    monkeypatch.setattr(divergence, "PIECE", 40)
    parts = list(divergence.term_lists(text))
    assert len(parts) > 5 and [t for part in parts for t in part] == whole
    assert [t.decode() for t in whole] == TERM.findall(text.translate(UPPER))


def test_query_against_sql(spark):
    directory = "/root/testdata/sf0.001"
    name = "op13_source_divergence"
    assert compare(QUERIES[name](spark, directory), ORACLES[name], connect(directory)) is None

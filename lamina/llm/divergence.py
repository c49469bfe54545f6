"""How the sources of each language differ in their words: counts by a translate-table tokenizer, exact rates.

One ``bytes.translate`` lowers letters and blanks everything between words, ``bytes.split`` and a
``Counter`` a document give its terms; a worker adds them up by language and source before Spark
sums them.  Only occurring (source, term) pairs are ever rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamina.llm.text import col
from lamina.session import materialise

# Letters and bytes of other scripts are kept, A-Z as a-z; all else separates.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
MIN_DOCS = 30
TOP = 50
# The unit of rates and what is added to every count.
UNIT, EXTRA = 1_000_000_000, 5
# A worker hands on its sums at about this many entries; terms are compared so many at a time.
HELD = 200_000
SLICE = 2048
PIECE = 4 << 20


def term_lists(text: str) -> Iterator[list[bytes]]:
    """The terms of a text in lists, a stretch of a long text at a time."""
    data = text.encode().translate(LETTERS)
    begin = 0
    while len(data) - begin > PIECE:
        end = data.rfind(b" ", begin, begin + PIECE) + 1
        if not end:
            # a word longer than a stretch
            end = data.find(b" ", begin + PIECE) + 1 or len(data)
        yield data[begin:end].split()
        begin = end
    yield data[begin:].split()


def _term_counts(rows: DataFrame) -> DataFrame:
    """``(lang, source, term, n, docs)``: occurrences and documents of every term."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        held = 0

        def handed():
            for (lang, source), (n, docs) in sums.items():
                terms = list(n)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang] * len(terms), pa.string()), pa.array([source] * len(terms), pa.string()),
                        pa.array(terms, pa.binary()).cast(pa.string()),
                        pa.array(n.values(), pa.int64()), pa.array([docs[t] for t in terms], pa.int64()),
                    ],
                    ["lang", "source", "term", "n", "docs"],
                )

        for batch in batches:
            for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text"))):
                own: Counter = Counter()
                for terms in term_lists(text):
                    own.update(terms)
                n, docs = sums.setdefault((lang, source), (Counter(), Counter()))
                before = len(n)
                n.update(own)
                docs.update(own.keys())
                held += len(n) - before
                if held > HELD:
                    yield from handed()
                    sums, held = {}, 0
        yield from handed()

    counted = rows.mapInArrow(count, "lang string, source string, term string, n bigint, docs bigint")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _rate(count: str, total: str, terms: str):
    """``1 + floor(UNIT (count + EXTRA) / (total + EXTRA terms))`` in whole numbers of any size."""
    above = f"(CAST({count} AS DECIMAL(20,0)) + {EXTRA}) * {UNIT}BD"
    return F.expr(f"1 + ({above}) DIV (CAST({total} AS DECIMAL(20,0)) + CAST({terms} AS DECIMAL(12,0)) * {EXTRA}BD)").cast("bigint")


def _pair_sums(entries: DataFrame, groups: DataFrame) -> DataFrame:
    """``(lang, source, item, value)``: for two sources of a language the sum of differences over all kept terms.

    A slice of a language's terms is a matrix of sources by terms; its sums of differences are
    added up by Spark.
    """
    slices = F.ceil(F.col("v") / SLICE)
    own = entries.select("lang", F.pmod(F.xxhash64("term"), slices).alias("slice"), "source", "term", "p")
    base = groups.where("v > 0").select(
        "lang", F.explode(F.sequence(F.lit(0).cast("bigint"), slices - 1)).alias("slice"),
        "source", F.lit(None).cast("string").alias("term"), F.col("p0").alias("p"),
    )

    def differences(table: pa.Table) -> pa.Table:
        term = table.column("term").combine_chunks().dictionary_encode()
        source = table.column("source").combine_chunks().dictionary_encode()
        names, where = source.dictionary, np.asarray(source.indices)
        rates = np.asarray(table.column("p"))
        empty = np.asarray(term.is_null())
        plain = np.zeros(len(names), np.int64)
        plain[where[empty]] = rates[empty]
        matrix = np.repeat(plain[:, None], len(term.dictionary), axis=1)
        matrix[where[~empty], np.asarray(term.indices.fill_null(0))[~empty]] = rates[~empty]
        a = np.arange(len(names))
        sums = np.array([np.abs(matrix - row).sum(axis=1) for row in matrix])
        first, second = np.repeat(a, len(a)), np.tile(a, len(a))
        good = first != second
        return pa.table({
            "lang": pa.repeat(table.column("lang")[0], int(good.sum())),
            "source": names.take(pa.array(first[good])), "item": names.take(pa.array(second[good])),
            "value": sums.ravel()[good],
        })

    partial = own.unionByName(base).groupBy("lang", "slice").applyInArrow(
        differences, "lang string, source string, item string, value bigint"
    )
    return partial.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def source_audit(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
    min_docs: int = MIN_DOCS, top: int = TOP,
) -> DataFrame:
    """``(lang, source, part, item, value, rank)`` of every (lang, source) group.

    Null texts, languages and sources are ''.  Terms are runs of letters and of characters beyond ASCII, of which only
    A-Z are lowered.  A language keeps the terms in at least ``min_docs`` of its documents, V of them.  A group
    and a language give each kept term ``p = 1 + floor(10^9 (count + 5) / (N + 5 V))``, N being the count over kept terms.
    Part ``pair`` has every other source of the language as item, with the sum of ``|p - q|`` over all kept terms
    (0 without any), q the other's; part ``term`` the ``top`` terms that occur in the group and have
    ``p`` above the language's.  Ranks go by falling value, then by rising item in UTF-8.  Repeated rows count as
    often as they stand there, other columns don't matter, an empty table gives no rows.

    Plan: terms are summed in the worker, then by Spark; kept terms and totals are joined by key.  A window's
    partial limit keeps ``top`` rows of a group per task before its rows meet; the window of part ``pair`` holds a
    group's result rows.
    """
    def filled(name, alias):
        return F.coalesce(col(name).cast("string"), F.lit("")).alias(alias)

    rows = docs.select(filled(text_col, "text"), filled(lang_col, "lang"), filled(source_col, "source"))
    counts = materialise(_term_counts(rows), "terms")
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs"))
    kept = materialise(kept.where(F.col("docs") >= min_docs).select("lang", "term", "lang_n"), "kept")
    sparse = materialise(counts.select("lang", "source", "term", "n").join(kept, ["lang", "term"]), "sparse")
    totals = sparse.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("lang_n").alias("lang_total"))
    groups = (
        rows.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
        .select("lang", "source", *(F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("total", "v", "lang_total")))
    )
    groups = materialise(groups.withColumn("p0", F.when(F.col("v") > 0, _rate("0", "total", "v"))), "groups")
    rated = sparse.join(groups, ["lang", "source"]).select(
        "lang", "source", "term", "v", _rate("n", "total", "v").alias("p"), _rate("lang_n", "lang_total", "v").alias("q")
    )
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    terms = (
        rated.where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
        .withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= top)
    )
    other = groups.select("lang", F.col("source").alias("item"))
    pairs = (
        groups.select("lang", "source").join(other, "lang").where("source <> item")
        .join(_pair_sums(rated, groups), ["lang", "source", "item"], "left")
        .select("lang", "source", "item", F.coalesce("value", F.lit(0)).cast("bigint").alias("value"))
        .withColumn("rank", F.row_number().over(by_value))
    )
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("part", F.lit("pair")).select(columns).unionByName(terms.withColumn("part", F.lit("term")).select(columns))

"""One query per operator over its whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm import (
    decontaminate, divergence, exact, fuzzy_lines, mix_sources, mixing_lm, pseudonyms, simhash, suffix_dedup, token_count,
    token_store, toxicity, whitening,
)
from lamina.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query
def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select(F.col("id").alias("doc_id"), simhash.hex_fingerprint().alias("fingerprint"), "component_id")


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query
def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token_store")
    token_store.write_tokens(documents(spark, sf_dir), path, tokenizer_file())
    return token_store.read_digests(spark, path).withColumnRenamed("id", "doc_id")


@query
def op3_mixing_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = mixing_lm.score_texts(documents(spark, sf_dir), lambda i: toxicity.remainder(i, 10) == 0)
    return scored.withColumnRenamed("id", "doc_id")


@query
def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.duplicate_groups(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")


@query
def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = mix_sources.mix(documents(spark, sf_dir))
    return drawn.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


@query
def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.contamination(documents(spark, sf_dir), benchmark)
    return found.select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


@query
def op7_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(documents(spark, sf_dir), tokenizer_file()).withColumnRenamed("id", "doc_id")


# The key of the pseudonyms of these queries; a user keeps one of their own.
PSEUDONYM_KEY = "lamina"


@query
def op8_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonyms.pseudonymise(documents(spark, sf_dir), PSEUDONYM_KEY).withColumnRenamed("id", "doc_id")


@query
def op9_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzy_lines.line_report(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")


@query
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    lexicon = toxicity.fit(docs, labels, train=lambda i: toxicity.remainder(i, 4) != 2)
    held_out = (toxicity.remainder("id", 4) == 2).alias("held_out")
    return toxicity.score(docs, lexicon).select(F.col("id").alias("doc_id"), held_out, "score", "predicted")


@query
def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_text(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")


@query
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).withColumnRenamed("id", "vec_id")


@query
def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_audit(documents(spark, sf_dir))


ORACLES["op4_exact_dedup"] = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""

ORACLES["op13_source_divergence"] = r"""
WITH docs AS (
    SELECT row_number() OVER () AS r, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents
), terms AS (
    SELECT r, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM docs
), kept AS (
    SELECT lang, term, count(*) AS n FROM terms GROUP BY lang, term HAVING count(DISTINCT r) >= 30
), langs AS (
    SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang
), counts AS (
    SELECT lang, source, term, count(*) AS n FROM terms SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term
), groups AS (
    SELECT lang, source, coalesce(v, 0) AS v, coalesce((SELECT sum(c.n) FROM counts c WHERE c.lang = g.lang AND c.source = g.source), 0) AS total
    FROM (SELECT DISTINCT lang, source FROM docs) g LEFT JOIN langs USING (lang)
), rates AS (
    SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
           1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (g.total + 5 * g.v)::HUGEINT AS p,
           1 + (1000000000::HUGEINT * (k.n + 5)) // (l.total + 5 * l.v)::HUGEINT AS q
    FROM groups g JOIN kept k USING (lang) JOIN langs l USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), items AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item,
           coalesce((SELECT sum(abs(x.p - y.p)) FROM rates x JOIN rates y USING (lang, term)
                     WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0)::BIGINT AS value
    FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
    UNION ALL
    SELECT lang, source, 'term', term, (p - q)::BIGINT FROM rates WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM (
    SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM items
) WHERE part = 'pair' OR rank <= 50
"""

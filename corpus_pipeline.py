"""A training corpus in stages, each an operator whose result is written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lamina.llm import decontaminate, mix_sources, simhash, token_store, toxicity
from lamina.llm.queries import tokenizer_file
from lamina.session import materialise, scratch_path


# Text that a worker encodes at a time, and pieces it remembers: an executor still holds what the stages before have used.
TOKEN_CHUNK_BYTES = 1 << 20
TOKEN_CACHE_PIECES = 1 << 17


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go; the lexicon is learned from the labelled documents among ``docs``."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component stays, the one of the smallest id."""
    return simhash.drop_near_duplicates(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated with passages of the benchmark go."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the source weights take them."""
    return mix_sources.take_mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids written to a store and read back: where each document starts, its tokens and their checksum."""
    path = scratch_path(spark, "corpus")
    token_store.write_tokens(docs, path, tokenizer_file(), chunk_bytes=TOKEN_CHUNK_BYTES, cache_pieces=TOKEN_CACHE_PIECES)
    return token_store.read_digests(spark, path).withColumnRenamed("id", "doc_id")


STAGES = [
    ("toxicity", without_toxic),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", without_benchmark),
    ("mixing sources", mixing),
    ("token-ID output", tokens),
]
# Learned scores, fingerprints, draws and entropy coding have no SQL counterpart; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written to the shared folder in between."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number + 1 < len(STAGES):
            docs = materialise(docs, "stage")
    return docs

"""The domain bundle: main table, field catalog, section map and null tokens in one folder."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.operators.rows import normalise_nulls
from lamina.sources.datasets import DatasetError, path_exists, read_csv


class Bundle(NamedTuple):
    table: DataFrame
    catalog: DataFrame
    section_map: DataFrame
    null_tokens: tuple[str, ...]


def section_rows(documents: DataFrame, column: str = "value") -> DataFrame:
    """``(section, fields)`` from a column of JSON objects."""
    parsed = documents.select(F.from_json(column, "map<string,array<string>>").alias("m"))
    return parsed.select(F.explode("m").alias("section", "fields"))


def read_section_map(spark: SparkSession, path: str) -> DataFrame:
    """``(section, fields)`` from a JSON object of section name to field list."""
    return section_rows(spark.read.text(path, wholetext=True))


def read_null_tokens(spark: SparkSession, path: str) -> tuple[str, ...]:
    """Keys of a JSON object; they end up inside one expression."""
    text = spark.read.text(path, wholetext=True)
    parsed = text.select(F.explode(F.map_keys(F.from_json("value", "map<string,string>"))).alias("token"))
    return tuple(sorted(r["token"] for r in parsed.collect()))


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """``(section, Field, Pattern)`` as CSV, JSON lines or Parquet."""
    if path.lower().endswith(".csv"):
        table = read_csv(spark, path, infer=False)
    elif path.lower().endswith(".json"):
        table = spark.read.json(path)
    else:
        table = spark.read.parquet(path)
    return table.select("section", "Field", "Pattern")


def catalog_rows(catalog: DataFrame, sections: Sequence[str] | None = None) -> list[tuple[str, str, str | None]]:
    """The catalog as column metadata: one entry per field of the table."""
    chosen = catalog if sections is None else catalog.filter(F.col("section").isin(*sections))
    return [tuple(r) for r in chosen.select("section", "Field", "Pattern").collect()]


def load_bundle(
    spark: SparkSession, folder: str, data_file: str = "database.csv", catalog_file: str = "catalog.csv",
    section_file: str = "section_keys.json", token_file: str = "nan_equivalents.json",
) -> Bundle:
    """All four parts; null tokens are applied to the table as it is read."""
    root = folder.rstrip("/")
    if not path_exists(spark, root):
        raise DatasetError(f"no folder {folder}")
    tokens = read_null_tokens(spark, f"{root}/{token_file}")
    table = normalise_nulls(read_csv(spark, f"{root}/{data_file}"), tokens)
    return Bundle(
        table, read_catalog(spark, f"{root}/{catalog_file}"), read_section_map(spark, f"{root}/{section_file}"), tokens
    )

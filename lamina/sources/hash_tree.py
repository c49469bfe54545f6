"""A fingerprint in leaves, so that a change is found by row bucket and column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.functions.hashing import key_hash
from lamina.operators.split import row_key

BUCKETS = 256


def _cell(name: str) -> Column:
    """A cell with its length, so that no text looks like a null or like two cells."""
    text = F.col(name).cast("string")
    return F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("~"))


def hash_tree(df: DataFrame, keys: Sequence[str], buckets: int = BUCKETS) -> DataFrame:
    """``(bucket, column_name, n, leaf)``: rows and the sum of cell hashes of each row bucket and column.

    A row's bucket is a hash of its keys; a cell's hash is of key, column and value, 52 bits.  Sums are of whole numbers,
    so leaves neither depend on order nor lose equal rows, and the trees of two parts of a table add up to the tree
    of both.  One pass; sums are combined before the shuffle, of which each task has at most buckets x columns.
    """
    key = row_key(*keys)
    names = list(df.columns)
    leaves = F.array(*[F.struct(F.lit(c).alias("column_name"), key_hash(F.col("_key"), F.lit(c), _cell(c)).alias("h")) for c in names])
    rows = df.withColumn("_key", key).select(F.pmod(key_hash("bucket", F.col("_key")), F.lit(buckets)).cast("int").alias("bucket"), F.explode(leaves).alias("e"))
    return rows.groupBy("bucket", "e.column_name").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("e.h").cast("decimal(38,0)")).alias("leaf")
    )


def merged(*trees: DataFrame) -> DataFrame:
    """The tree of the union of tables from their trees."""
    every = trees[0]
    for tree in trees[1:]:
        every = every.unionByName(tree)
    return every.groupBy("bucket", "column_name").agg(F.sum("n").alias("n"), F.sum("leaf").cast("decimal(38,0)").alias("leaf"))


def columns_of(tree: DataFrame) -> DataFrame:
    """``(column_name, n, leaf_hash)``: one node per column above its buckets."""
    text = F.concat_ws(":", F.col("bucket").cast("string"), F.col("n").cast("string"), F.col("leaf").cast("string"))
    listed = F.array_sort(F.collect_list(F.struct("bucket", text.alias("t"))))
    return tree.groupBy("column_name").agg(
        F.sum("n").cast("bigint").alias("n"), F.sha2(F.array_join(F.transform(listed, lambda e: e["t"]), ","), 256).alias("leaf_hash")
    )


def root(tree: DataFrame) -> DataFrame:
    """``(n_columns, root)``: one hash of the column nodes."""
    text = F.concat_ws(":", "column_name", "leaf_hash")
    return columns_of(tree).agg(
        F.count(F.lit(1)).alias("n_columns"), F.sha2(F.array_join(F.array_sort(F.collect_list(text)), ","), 256).alias("root")
    )


def damaged(stored: DataFrame, seen: DataFrame) -> DataFrame:
    """``(bucket, column_name, stored_n, seen_n)`` of the leaves that differ or are on one side only."""
    left = stored.select("bucket", "column_name", F.col("n").alias("stored_n"), F.col("leaf").alias("_a"))
    right = seen.select("bucket", "column_name", F.col("n").alias("seen_n"), F.col("leaf").alias("_b"))
    return left.join(right, ["bucket", "column_name"], "full").where(~F.col("_a").eqNullSafe(F.col("_b")) | ~F.col("stored_n").eqNullSafe(F.col("seen_n"))).select(
        "bucket", "column_name", "stored_n", "seen_n"
    )


def damaged_rows(df: DataFrame, keys: Sequence[str], damage: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """The rows of the damaged buckets, which is where to look."""
    bucket = F.pmod(key_hash("bucket", row_key(*keys)), F.lit(buckets)).cast("int")
    # at most ``buckets`` numbers
    return df.withColumn("_bucket", bucket).join(F.broadcast(damage.select(F.col("bucket").alias("_bucket")).distinct()), "_bucket", "left_semi").drop("_bucket")

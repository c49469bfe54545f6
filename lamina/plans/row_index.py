"""Global row numbers without a one-task window."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.session import scratch_path


class Indexed(NamedTuple):
    frame: DataFrame
    total: int


def with_row_index(df: DataFrame, order: Sequence[str | Column], name: str = "row_index") -> Indexed:
    """Add 0-based positions in the order of ``order`` (which should identify a row).

    One range shuffle on the whole tuple, so a hot leading value is split by the later
    columns.  The sorted table is written to the shared folder; a row's position is its
    place in its file plus the rows of all earlier files.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "ordered")
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.parquet(path)
    stored = (
        spark.read.schema(df.schema)
        .parquet(path)
        .select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_pos"))
    )
    files = (
        stored.groupBy("_file")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .withColumn("_task", F.regexp_extract("_file", r"part-(\d+)-", 1).cast("int"))
        .withColumn("_chunk", F.regexp_extract("_file", r"-c(\d+)", 1).cast("int"))
    )
    # One row per written file: bounded by the number of shuffle partitions.
    sizes = files.select("_file", "_rows", "_task", "_chunk").collect()
    offsets, total = [], 0
    for row in sorted(sizes, key=lambda r: (r["_task"], r["_chunk"])):
        offsets.append((row["_file"], total))
        total += row["_rows"]
    starts = spark.createDataFrame(offsets, "_file string, _start bigint")
    frame = stored.join(F.broadcast(starts), "_file").withColumn(name, F.col("_start") + F.col("_pos"))
    return Indexed(frame.drop("_file", "_start", "_pos"), total)


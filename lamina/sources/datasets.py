"""CSV and Parquet datasets with a one-row metadata table beside the Parquet files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamina.functions.text import CSV_MISSING, null_token
from lamina.operators.rows import promote_numeric

# The fields of a dataset's metadata.
METADATA = T.StructType(
    [
        T.StructField("creation_date", T.TimestampType()),
        T.StructField("data_hash", T.StringType()),
        T.StructField("source_path", T.StringType()),
        T.StructField("feature_count", T.IntegerType()),
        T.StructField("sample_count", T.LongType()),
        T.StructField("target_feature", T.StringType()),
        T.StructField("processing_history", T.ArrayType(T.StringType())),
        T.StructField("tags", T.ArrayType(T.StringType())),
    ]
)
FORMATS = (".csv", ".parquet")
_BOOLEANS = ("True", "TRUE", "true", "False", "FALSE", "false")


class DatasetError(Exception):
    """Loading, saving or validation failed."""


def _suffix(path: str) -> str:
    name = path.rstrip("/").rsplit("/", 1)[-1]
    suffix = "." + name.rsplit(".", 1)[-1].lower() if "." in name else ""
    if suffix not in FORMATS:
        raise DatasetError(f"unsupported file format {suffix!r} of {path}; supported: {FORMATS}")
    return suffix


def _metadata_path(path: str) -> str:
    # Beside the data folder, so that a reader of the data never meets it.
    return path.rstrip("/") + ".metadata"


def path_exists(spark: SparkSession, path: str) -> bool:
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    return location.getFileSystem(spark._jsc.hadoopConfiguration()).exists(location)


# -- fingerprint and statistics --------------------------------------------------


def dataset_fingerprint(df: DataFrame) -> DataFrame:
    """``(rows, data_hash)``: equal for equal multisets of rows, whatever their order.

    Two independent 64-bit row hashes are summed, so equal rows do not cancel out; floats
    are exact because only integers are added.
    """
    # each cell with its length, so that neither a separator nor a null mark can occur in a text
    texts = [F.col(c).cast("string") for c in df.columns]
    row = F.concat(F.lit(""), *[F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit("~")) for t in texts])
    first, second = F.xxhash64(F.lit(1), row), F.xxhash64(F.lit(2), row)
    sums = df.select(first.alias("a"), second.alias("b")).agg(
        F.count(F.lit(1)).alias("rows"),
        F.coalesce(F.sum(F.col("a").cast("decimal(38,0)")), F.lit(0)).alias("a"),
        F.coalesce(F.sum(F.col("b").cast("decimal(38,0)")), F.lit(0)).alias("b"),
    )
    text = F.concat_ws(",", F.lit(",".join(df.columns)), F.col("rows").cast("string"), F.col("a").cast("string"), F.col("b").cast("string"))
    return sums.select("rows", F.sha2(text, 256).alias("data_hash"))


def dataset_stats(df: DataFrame, source_path: str = "") -> DataFrame:
    """``(sample_count, feature_count, source_path)``."""
    return df.agg(F.count(F.lit(1)).alias("sample_count")).select(
        "sample_count", F.lit(len(df.columns)).alias("feature_count"), F.lit(source_path).alias("source_path")
    )


def describe(
    df: DataFrame, source_path: str = "", target_feature: str = "", history: Sequence[str] = (), tags: Sequence[str] = ()
) -> DataFrame:
    """The metadata row; always a fresh one."""

    def texts(values: Sequence[str]):
        return F.array(*map(F.lit, values)).cast("array<string>")

    return dataset_fingerprint(df).select(
        F.current_timestamp().alias("creation_date"),
        "data_hash",
        F.lit(source_path).alias("source_path"),
        F.lit(len(df.columns)).alias("feature_count"),
        F.col("rows").alias("sample_count"),
        F.lit(target_feature).alias("target_feature"),
        texts(history).alias("processing_history"),
        texts(tags).alias("tags"),
    )


def validate(df: DataFrame, metadata: DataFrame) -> None:
    """Row count and fingerprint must equal the stored ones."""
    stored, seen = metadata.first(), dataset_fingerprint(df).first()
    if stored["sample_count"] != seen["rows"]:
        raise DatasetError(f"stored sample count {stored['sample_count']} but {seen['rows']} rows")
    if stored["data_hash"] != seen["data_hash"]:
        raise DatasetError("fingerprint mismatch: data changed since they were saved")


# -- reading and writing ---------------------------------------------------------


def read_csv(spark: SparkSession, path: str, infer: bool = True, multi_line: bool = False) -> DataFrame:
    """A CSV table with a header.

    All cells are read as text; whole columns then become numeric or boolean.  ``multi_line``
    allows line breaks inside quoted cells, at the price of one task per file.
    """
    raw = (
        spark.read.option("header", True).option("escape", '"').option("multiLine", multi_line)
        .option("inferSchema", False).option("nullValue", "").csv(path)
    )
    cells = raw.select(*[null_token(F.col(f"`{c}`"), CSV_MISSING).alias(c) for c in raw.columns])
    return promote_boolean(promote_numeric(cells)) if infer else cells


def promote_boolean(df: DataFrame) -> DataFrame:
    """String columns that only hold true and false, without gaps, become BOOLEAN."""
    names = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    if not names:
        return df
    tests = [F.every(F.coalesce(F.col(c).isin(*_BOOLEANS), F.lit(False))).alias(f"b{i}") for i, c in enumerate(names)]
    verdict = df.agg(*tests).first()
    flags = {c for i, c in enumerate(names) if verdict[f"b{i}"]}
    return df.select(*[(F.lower(c) == "true").alias(c) if c in flags else F.col(c) for c in df.columns])


def read_parquet(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The table and its metadata row; a missing metadata table is an error."""
    if not path_exists(spark, _metadata_path(path)):
        raise DatasetError(f"no dataset metadata beside {path}")
    return spark.read.parquet(path), spark.read.schema(METADATA).parquet(_metadata_path(path))


def load(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Table and metadata by file suffix, in any letter case."""
    suffix = _suffix(path)
    if not path_exists(spark, path):
        raise DatasetError(f"no dataset at {path}")
    if suffix == ".csv":
        df = read_csv(spark, path)
        return df, describe(df, path)
    return read_parquet(spark, path)


def save(
    df: DataFrame, path: str, overwrite: bool = False, target_feature: str = "",
    history: Sequence[str] = (), tags: Sequence[str] = (),
) -> None:
    """Write by suffix; an existing path is refused unless ``overwrite``.

    Parquet gets its metadata afterwards, computed from what was written.
    """
    spark = df.sparkSession
    suffix = _suffix(path)
    if path_exists(spark, path) and not overwrite:
        raise DatasetError(f"already exists: {path}")
    mode = "overwrite" if overwrite else "errorifexists"
    if suffix == ".csv":
        writer = df.write.mode(mode).option("header", True).option("escape", '"').option("nullValue", "")
        writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
        return
    df.write.mode(mode).parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    metadata = describe(stored, path, target_feature, history, tags)
    metadata.coalesce(1).write.mode("overwrite").parquet(_metadata_path(path))

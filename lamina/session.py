"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

# One rows-per-frame bound for every hand-written broadcast in the package.
BROADCAST_ROWS = 100_000


def build_session(app: str = "lamina", cpus: int | str = "*", **conf: str) -> SparkSession:
    """A session with adaptive execution; cluster settings are left to spark-submit."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if cpus:
        builder = builder.master(f"local[{cpus}]")
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def _setting(spark: SparkSession, key: str) -> str | None:
    value = spark.conf.get(key, None)
    return value or spark.sparkContext.getConf().get(key)


_local_scratch: str | None = None
_shipped: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints; a temporary one in local mode only."""
    global _local_scratch
    folder = _setting(spark, "spark.checkpoint.dir")
    if folder:
        return folder
    # one process with one file system; local-cluster has several
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    if _local_scratch is None:
        _local_scratch = tempfile.mkdtemp(prefix="lamina-")
    return _local_scratch


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once, for workers whose Python path doesn't have it."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    # the driver's own copy of the code; Spark's file service hands it out
    archive = os.path.join(tempfile.mkdtemp(prefix="lamina-"), "lamina.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(os.path.dirname(os.path.abspath(__file__))):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, root))
    context.addPyFile(archive)
    _shipped.add(context.applicationId)


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/lamina/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back, which cuts its lineage."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table written below the shared folder, once nothing will read it again."""
    if f"{shared_folder(spark).rstrip('/')}/lamina/" not in path:
        raise ValueError(f"{path} is not an intermediate table")
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)

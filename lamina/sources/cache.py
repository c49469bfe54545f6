"""Expanded tables, written once per target and reused."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.operators.layers import Catalog, build_catalog, expand_catalog, feature_records
from lamina.operators.rows import promote_numeric
from lamina.sources.datasets import DatasetError, load, path_exists, save, validate


def _root(folder: str, target: str) -> str:
    return f"{folder.rstrip('/')}/target={target}"


def _places(version: str) -> tuple[str, str]:
    return f"{version}/dataset.parquet", f"{version}/features"


def _published(spark, root: str) -> str | None:
    """The folder of the newest complete version; a version is complete once its marker has been written."""
    marks = f"{root}/published"
    if not path_exists(spark, marks):
        return None
    newest = spark.read.schema("version string, at bigint").json(marks).orderBy(F.desc("at"), F.desc("version")).first()
    return f"{root}/{newest['version']}" if newest else None


def save_catalog(catalog: Catalog, path: str) -> None:
    """Feature records as JSON lines, and the tables behind them."""
    feature_records(catalog).coalesce(1).write.mode("overwrite").json(f"{path}/records.json")
    for name in ("records", "histogram", "leaves"):
        getattr(catalog, name).coalesce(1).write.mode("overwrite").parquet(f"{path}/{name}.parquet")


def load_catalog(spark, path: str) -> Catalog:
    return Catalog(*[spark.read.parquet(f"{path}/{name}.parquet") for name in ("records", "histogram", "leaves")])


def cache_or_compute(
    source: Callable[[], DataFrame], reference: Sequence[tuple[str, str, str | None]], target: str, folder: str,
    spark, force_recompute: bool = False, keep: Sequence[str] = (),
) -> tuple[DataFrame, Catalog]:
    """The expanded table of rows with a target, from the cache if it is complete and sound.

    ``source`` is only called when the expansion has to be computed.
    """
    if not target:
        raise DatasetError("a target feature is needed")
    root = _root(folder, target)
    if not force_recompute:
        try:
            published = _published(spark, root)
            if published:
                data_path, catalog_path = _places(published)
                return load(spark, data_path)[0], load_catalog(spark, catalog_path)
        except (DatasetError, PySparkException, Py4JJavaError):
            # whatever can't be read counts as missing
            pass
    version = f"version-{uuid.uuid4().hex}"
    data_path, catalog_path = _places(f"{root}/{version}")
    rows = source().filter(F.col(target).isNotNull())
    catalog = build_catalog(rows, reference)
    wide = promote_numeric(expand_catalog(rows, catalog, keep=keep))
    save(wide, data_path, overwrite=True, target_feature=target)
    save_catalog(catalog, catalog_path)
    # the last write: until it is done, earlier versions are served
    mark = spark.createDataFrame([(version, time.time_ns())], "version string, at bigint")
    mark.coalesce(1).write.mode("append").json(f"{root}/published")
    return load(spark, data_path)[0], load_catalog(spark, catalog_path)


def check_cache(folder: str, target: str, spark) -> None:
    published = _published(spark, _root(folder, target))
    if published is None:
        raise DatasetError(f"nothing is published for {target}")
    data, metadata = load(spark, _places(published)[0])
    validate(data, metadata)


def target_and_features(
    expanded: DataFrame, columns: Sequence[str], target: str, drop_target: bool = True, keep: Sequence[str] = ()
) -> DataFrame:
    """The listed features and ``label``; all rows have a target already."""
    features = [c for c in columns if not (drop_target and c == target)]
    return expanded.select(*keep, *[c for c in features if c not in keep], F.col(target).alias("label"))

"""Trained models saved with their configuration."""

from __future__ import annotations

import json
from collections.abc import Mapping
from typing import Any

from pyspark.ml.regression import GBTRegressionModel, RandomForestRegressionModel
from pyspark.sql import SparkSession

from lamina.operators.models import Fitted, Neighbours


def save_model(fitted: Fitted, config: Mapping[str, Any], path: str, spark: SparkSession) -> None:
    """The model and one JSON row with its config, features and missing-value stand-ins under one path."""
    if isinstance(fitted.model, Neighbours):
        fitted.model.rows.write.mode("overwrite").parquet(f"{path}/model")
    else:
        fitted.model.write().overwrite().save(f"{path}/model")
    document = {"config": dict(config), "features": list(fitted.features), "missing": fitted.missing}
    spark.createDataFrame([(json.dumps(document),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/config")


def load_model(path: str, spark: SparkSession) -> tuple[Fitted, dict[str, Any]]:
    document = json.loads(spark.read.text(f"{path}/config").first()["value"])
    config = document["config"]
    if config["model_type"] == "knn":
        options = {k: config[k] for k in ("n_neighbors", "weights") if k in config}
        model = Neighbours(spark.read.parquet(f"{path}/model"), **options)
        return Fitted(model, tuple(document["features"]), document["missing"]), config
    kind = RandomForestRegressionModel if config["model_type"] == "random_forest" else GBTRegressionModel
    model = kind.load(f"{path}/model")
    return Fitted(model, tuple(document["features"]), document["missing"]), config

"""An experiment from one nested config: prune, expand, split, transform, validate, train, report.

Config sections (all optional but ``data`` and ``model``): ``data.target_feature``,
``experiment.test_size`` and ``.seed``, ``pruning`` (a pruner step or chain), ``process`` with
``numerical`` and ``categorical`` step lists, ``model``, ``validation`` with ``method``, ``metrics``
and the method's options.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Callable, Iterable, Mapping, Sequence
from concurrent.futures import Future
from threading import Lock
from typing import Any, NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.operators import models, split, sweep
from lamina.operators.layers import Catalog, expand_catalog, surviving_columns
from lamina.operators.prune import prune
from lamina.operators.rows import promote_numeric
from lamina.operators.transform import apply_pipeline, fit_pipeline
from lamina.session import discard, scratch_path

VALIDATORS = ("kfold", "stratified_kfold", "shuffle_split", "leave_one_out", "time_series_split")


class Prepared(NamedTuple):
    """``frame``: keys, ``split``, ``label`` and numeric ``features``."""

    frame: DataFrame
    features: tuple[str, ...]


class Preparations:
    """Model tables of many experiments on one table, each distinct step made once.

    A table is named by the parts of the config that it depends on: the wide one by target, pruning and
    split, the model table by those and the transforms.  Trials that differ in the model alone share both.
    With the configs of all trials announced by :meth:`expect`, a table is deleted when its last trial has ended.
    """

    def __init__(self, df: DataFrame, catalog: Catalog | None, keys: Sequence[str], fit_scope: str = "train"):
        self.df, self.catalog, self.keys, self.fit_scope = df, catalog, list(keys), fit_scope
        self._made: dict[str, Future] = {}
        self._left: Counter = Counter()
        self._lock = Lock()

    def names(self, config: Mapping[str, Any]) -> tuple[str, str]:
        """Canonical names of the wide table and of the model table."""
        options = config.get("experiment", {})
        wide = {"data": config["data"], "pruning": config.get("pruning"), "test_size": options.get("test_size", 0.25), "seed": options.get("seed", 42)}
        shaped = {"wide": wide, "process": config.get("process") or {}}
        return tuple(json.dumps(part, sort_keys=True, default=str) for part in (wide, shaped))

    def expect(self, configs: Iterable[Mapping[str, Any]]) -> None:
        for config in configs:
            self._left.update(self.names(config))

    def get(self, config: Mapping[str, Any]) -> Prepared:
        return self._once(self.names(config)[1], lambda: self._shaped(config))[1]

    def release(self, config: Mapping[str, Any]) -> None:
        """A trial of this config has ended."""
        for name in self.names(config):
            with self._lock:
                self._left[name] -= 1
                gone = self._made.pop(name, None) if self._left[name] == 0 else None
            if gone is not None and gone.exception() is None:
                discard(self.df.sparkSession, gone.result()[0])

    def _once(self, name: str, make: Callable[[], tuple]) -> tuple:
        with self._lock:
            mine = name not in self._made
            made = self._made.setdefault(name, Future())
        if mine:
            try:
                made.set_result(make())
            except BaseException as error:
                made.set_exception(error)
        return made.result()

    def _written(self, frame: DataFrame, name: str) -> tuple[str, DataFrame]:
        path = scratch_path(self.df.sparkSession, name)
        frame.write.parquet(path)
        return path, self.df.sparkSession.read.schema(frame.schema).parquet(path)

    def _wide(self, config: Mapping[str, Any]) -> tuple[str, DataFrame, list[str]]:
        target, options, keys = config["data"]["target_feature"], config.get("experiment", {}), self.keys
        rows = self.df.filter(F.col(target).isNotNull()).withColumn("_label", F.col(target).cast("double"))
        if self.catalog is None:
            if config.get("pruning"):
                raise ValueError("pruning needs a field catalog")
            columns = list(config["data"].get("features") or [c for c in self.df.columns if c != target and c not in keys])
            wide = rows.select(*keys, "_label", *columns)
        else:
            catalog = prune(self.catalog, config["pruning"]) if config.get("pruning") else self.catalog
            columns = [c for c in surviving_columns(catalog) if c != target and c not in keys]
            wide = expand_catalog(rows, catalog, keep=[*keys, "_label"]).select(*keys, "_label", *columns)
        parted = split.train_test_split(wide, keys, options.get("test_size", 0.25), options.get("seed", 42))
        return (*self._written(parted, "wide"), columns)

    def _shaped(self, config: Mapping[str, Any]) -> tuple[str, Prepared]:
        _, parted, columns = self._once(self.names(config)[0], lambda: self._wide(config))
        parted = promote_numeric(parted, columns)
        process = config.get("process") or {}
        steps = (process.get("numerical", ()), process.get("categorical", ()))
        aside = [*self.keys, "_label", "split"]
        if self.fit_scope == "all":
            shaped, _ = fit_pipeline(parted, *steps, exclude=aside)
        else:
            _, fitted = fit_pipeline(parted.filter(F.col("split") == "train"), *steps, exclude=aside)
            shaped = apply_pipeline(parted, fitted, exclude=aside)
        features = [c for c in shaped.columns if c not in aside]
        numbers = [F.col(f"`{c}`").cast("double").alias(c) for c in features]
        path, frame = self._written(shaped.select(*self.keys, "split", F.col("_label").alias("label"), *numbers), "prepared")
        return path, Prepared(frame, tuple(features))


def prepare(
    df: DataFrame, catalog: Catalog | None, config: Mapping[str, Any], keys: Sequence[str], fit_scope: str = "train"
) -> Prepared:
    """The model table of one experiment, written once so that every fit reads the same rows.

    Without a catalog the columns are taken as they are: those of ``data.features``, or all but target and keys.
    Steps are fitted on the training part; ``fit_scope="all"`` fits them on all rows.
    """
    return Preparations(df, catalog, keys, fit_scope).get(config)


def assign_folds(df: DataFrame, keys: Sequence[str], validation: Mapping[str, Any]) -> tuple[DataFrame, str | None]:
    """Rows with ``fold``, and the name of the role column for methods whose parts overlap."""
    options = {k: v for k, v in validation.items() if k not in ("method", "metrics")}
    if "random_state" in options:
        options["seed"] = options.pop("random_state")
    method = validation.get("method", "kfold")
    if method == "kfold":
        return split.kfold(df, keys, **options), None
    if method == "stratified_kfold":
        return split.stratified_kfold(df, options.pop("label", "label"), keys, **options), None
    if method == "shuffle_split":
        return split.shuffle_split(df, keys, **options).withColumnRenamed("split_no", "fold"), "role"
    if method == "time_series_split":
        return split.time_series_split(df, keys, **options).withColumnRenamed("split_no", "fold"), "role"
    if method == "leave_one_out":
        # one fit per row, however many; the neighbour regressor has a way without fits
        return split.number_rows(df, keys, "fold"), None
    raise ValueError(f"unknown validation method {method!r}; known: {VALIDATORS}")


def validate(prepared: Prepared, config: Mapping[str, Any], keys: Sequence[str]) -> DataFrame:
    """``(fold, split, metric, value)`` of the training part."""
    validation = config["validation"]
    # there is no third part to stop on
    config = {**config, "model": models.stopping_patience(config["model"])[1]}
    train = prepared.frame.filter(F.col("split") == "train").drop("split")
    if validation.get("method") == "leave_one_out" and config["model"].get("model_type") == "knn":
        missing = models.fit_missing(train, prepared.features)
        numbered = split.number_rows(train.select(*keys, "label", *models.filled(prepared.features, missing)), keys, "_row")
        options = {k: v for k, v in config["model"].items() if k in ("n_neighbors", "weights")}
        scored = models.knn_leave_one_out(numbered, prepared.features, "label", "_row", **options)
        return models.leave_one_out_scores(scored, "_row", validation.get("metrics", ["rmse"]))
    folded, role = assign_folds(train, keys, validation)
    return models.cross_validate(
        folded, prepared.features, "label", config["model"], validation.get("metrics", ["rmse"]), role=role
    )


def objective(
    df: DataFrame, catalog: Catalog | None, config: Mapping[str, Any], keys: Sequence[str], score_on: str = "val"
) -> float:
    """Mean test RMSE over the folds, or the RMSE of one fit on ``score_on``."""
    return score(prepare(df, catalog, config, keys), config, keys, score_on)


def score(prepared: Prepared, config: Mapping[str, Any], keys: Sequence[str], score_on: str = "val") -> float:
    """The objective on a model table."""
    if config.get("validation"):
        wanted = dict(config["validation"])
        wanted["metrics"] = sorted({"rmse", *wanted.get("metrics", [])})
        return sweep.mean_test_score(validate(prepared, {**config, "validation": wanted}, keys))
    _, report = models.train_report(prepared.frame, prepared.features, "label", config["model"])
    return sweep.split_score(report, score_on=score_on)


def run_experiment(
    df: DataFrame, catalog: Catalog | None, config: Mapping[str, Any], keys: Sequence[str]
) -> tuple[models.Fitted, Prepared, DataFrame]:
    """Fitted model, model table and ``(split, metric, value)``, with fold means as ``cv_`` splits."""
    prepared = prepare(df, catalog, config, keys)
    fitted, report = models.train_report(prepared.frame, prepared.features, "label", config["model"])
    if config.get("validation"):
        means = validate(prepared, config, keys).groupBy("split", "metric").agg(F.avg("value").alias("value"))
        report = report.unionByName(means.withColumn("split", F.concat(F.lit("cv_"), "split")))
    return fitted, prepared, report


def run_sweep(
    df: DataFrame, catalog: Catalog | None, config: Mapping[str, Any], keys: Sequence[str], n_trials: int = 100,
    direction: str = "minimize", seed: int = 42, budgets: Sequence[int] = (), budget_option: str = "n_estimators", keep: float = 1 / 3,
) -> tuple[DataFrame, dict]:
    """The study table and the completed config of its best trial.

    With ``budgets`` the search is by successive halving: all trials are scored with the first number of
    ``budget_option``, the best share ``keep`` of them with the next one, and so on.  Trials share what they prepare alike.
    """
    spark, space = df.sparkSession, sweep.search_space(config)
    shared = Preparations(df, catalog, keys)
    shared.expect(sweep.filled_config(config, {p: row[p] for p in space}) for row in sweep.trial_rows(spark, space, n_trials, seed))

    def scored(filled: dict, budget: int | None = None) -> float:
        model = filled["model"] if budget is None else {**filled["model"], budget_option: budget}
        return score(shared.get(filled), {**filled, "model": model}, keys)

    if budgets:
        study = sweep.successive_halving(spark, config, scored, n_trials, budgets, keep, direction, seed, ended=shared.release)
        last = study.filter(F.col("rung") == len(budgets) - 1)
        best = sweep.best_trial(last, direction).first()
    else:
        study = sweep.run_study(spark, config, scored, n_trials, seed, ended=shared.release)
        best = sweep.best_trial(study, direction).first()
    found = sweep.filled_config(config, {p: best[p] for p in space})
    if budgets:
        found = {**found, "model": {**found["model"], budget_option: budgets[-1]}}
    return study, found

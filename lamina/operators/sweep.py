"""Hyper-parameter search: a seeded trial table, trials fitted as Spark jobs, the best one refitted."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.functions.hashing import uniform

SAMPLED = ("float", "int", "categorical")
TRIAL_THREADS = 4


def search_space(config: Any, path: str = "") -> dict[str, Mapping]:
    """Sampled leaves of a nested config by full path; lists of steps are numbered."""
    if isinstance(config, Mapping):
        if config.get("type") in SAMPLED:
            return {path: config}
        items = config.items()
    elif isinstance(config, list) and config and all(isinstance(c, Mapping) for c in config):
        items = enumerate(config)
    else:
        return {}
    found: dict[str, Mapping] = {}
    for key, value in items:
        found.update(search_space(value, f"{path}.{key}" if path else str(key)))
    return found


def filled_config(config: Any, values: Mapping[str, Any], path: str = "") -> Any:
    """The config with every sampled leaf replaced by its value."""
    if path in values:
        return values[path]
    if isinstance(config, Mapping):
        return {k: filled_config(v, values, f"{path}.{k}" if path else str(k)) for k, v in config.items()}
    if isinstance(config, list) and config and all(isinstance(c, Mapping) for c in config):
        return [filled_config(v, values, f"{path}.{i}" if path else str(i)) for i, v in enumerate(config)]
    return config


def sample(trial: Column, path: str, leaf: Mapping, seed: int) -> Column:
    """One draw: a pure function of seed, path and trial number."""
    u = uniform(seed, path, trial)
    kind = leaf["type"]
    if kind == "float":
        low, high = float(leaf["low"]), float(leaf["high"])
        if leaf.get("log"):
            return F.exp(u * F.lit(math.log(high) - math.log(low)) + F.lit(math.log(low)))
        return u * F.lit(high - low) + F.lit(low)
    if kind == "int":
        low, high = int(leaf["low"]), int(leaf["high"])
        if leaf.get("log"):
            span = math.log(high + 0.5) - math.log(low - 0.5)
            value = F.round(F.exp(u * F.lit(span) + F.lit(math.log(low - 0.5))))
            return F.greatest(F.lit(low), F.least(F.lit(high), value.cast("int")))
        return (F.floor(u * F.lit(float(high - low + 1))) + F.lit(low)).cast("int")
    choices = list(leaf["choices"])
    return F.element_at(F.array(*map(F.lit, choices)), (F.floor(u * F.lit(float(len(choices)))) + 1).cast("int"))


def sample_trials(trials: DataFrame, space: Mapping[str, Mapping], seed: int = 42, trial: str = "trial") -> DataFrame:
    """``trials`` with one column per sampled path."""
    return trials.select("*", *[sample(F.col(trial), p, leaf, seed).alias(p) for p, leaf in space.items()])


def trial_rows(spark, space: Mapping[str, Mapping], n_trials: int, seed: int) -> list:
    """The sampled values of every trial, in order."""
    trials = spark.range(n_trials).withColumnRenamed("id", "trial")
    return sample_trials(trials, space, seed).orderBy("trial").collect()


def run_study(
    spark, config: Mapping, objective: Callable[[dict], float], n_trials: int = 100, seed: int = 42,
    threads: int = TRIAL_THREADS, ended: Callable[[dict], None] = lambda _: None,
) -> DataFrame:
    """``(trial, <path>..., score)``: every trial's config is completed, scored and tabled.

    The objective runs Spark jobs; a few trials are in flight at a time.  ``ended`` is told each config that was scored.
    """
    space = search_space(config)
    table = sample_trials(spark.range(n_trials).withColumnRenamed("id", "trial"), space, seed)
    rows = trial_rows(spark, space, n_trials, seed)

    def score(row) -> tuple:
        filled = filled_config(config, {p: row[p] for p in space})
        try:
            return (row["trial"], float(objective(filled)))
        finally:
            ended(filled)

    with ThreadPoolExecutor(threads) as pool:
        scores = list(pool.map(score, rows))
    return table.join(spark.createDataFrame(scores, "trial bigint, score double"), "trial")


def promoted(scores: DataFrame, keep: float = 1 / 3, direction: str = "minimize") -> DataFrame:
    """``scores`` of ``(trial, rung, score)`` with ``place`` in the rung and whether the trial goes on.

    The best ``ceil(keep * n)`` of a rung's n trials go on, lower trials first on ties; a missing score comes last and
    never goes on.  A rung's window holds a row per trial.
    """
    if direction not in ("minimize", "maximize"):
        raise ValueError(f"unknown direction {direction!r}")
    known = F.when(~F.isnan("score"), F.col("score"))
    order = F.asc_nulls_last(known) if direction == "minimize" else F.desc_nulls_last(known)
    rung = Window.partitionBy("rung")
    placed = scores.withColumn("place", F.row_number().over(rung.orderBy(order, "trial")))
    share = F.ceil(F.count(F.lit(1)).over(rung) * F.lit(float(keep)))
    return placed.withColumn("promoted", known.isNotNull() & (F.col("place") <= share))


def successive_halving(
    spark, config: Mapping, objective: Callable[[dict, int], float], n_trials: int, budgets: Sequence[int], keep: float = 1 / 3,
    direction: str = "minimize", seed: int = 42, threads: int = TRIAL_THREADS, ended: Callable[[dict], None] = lambda _: None,
) -> DataFrame:
    """``(trial, <path>..., rung, budget, score, place, promoted)``, a row per trial and rung it reached.

    All trials are scored with the first budget, those promoted with the next one; ``ended`` is told a config
    when its trial goes no further.
    """
    space = search_space(config)
    rows = {r["trial"]: filled_config(config, {p: r[p] for p in space}) for r in trial_rows(spark, space, n_trials, seed)}
    alive, tables = sorted(rows), []
    for rung, budget in enumerate(budgets):
        with ThreadPoolExecutor(threads) as pool:
            scores = list(pool.map(lambda t: (t, rung, int(budget), float(objective(rows[t], budget))), alive))
        table = promoted(spark.createDataFrame(scores, "trial bigint, rung int, budget int, score double"), keep, direction)
        tables.append(table)
        on = {r["trial"] for r in table.where("promoted").select("trial").collect()} if rung + 1 < len(budgets) else set()
        for trial in set(alive) - on:
            ended(rows[trial])
        alive = sorted(on)
        if not alive:
            break
    trials = sample_trials(spark.range(n_trials).withColumnRenamed("id", "trial"), space, seed)
    return trials.join(reduce(DataFrame.unionByName, tables), "trial")


def best_trial(study: DataFrame, direction: str = "minimize", score: str = "score", trial: str = "trial") -> DataFrame:
    """The one row with the best score, the lowest trial on ties; missing scores never win."""
    if direction not in ("minimize", "maximize"):
        raise ValueError(f"unknown direction {direction!r}")
    scored = study.filter(F.col(score).isNotNull() & ~F.isnan(score))
    first = F.asc(score) if direction == "minimize" else F.desc(score)
    return scored.orderBy(first, F.asc(trial)).limit(1)


def mean_test_score(scores: DataFrame, metric: str = "rmse") -> float:
    """Mean over folds of the test score; the objective when there is cross-validation."""
    row = scores.filter((F.col("split") == "test") & (F.col("metric") == metric)).agg(F.avg("value")).first()
    return row[0]


def split_score(report: DataFrame, metric: str = "rmse", score_on: str = "val") -> float:
    """A score of one fit; ``score_on="train"`` scores the training part."""
    return report.filter((F.col("split") == score_on) & (F.col("metric") == metric)).first()["value"]


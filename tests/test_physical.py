"""What the plans must and must not contain."""

import io
import re
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

from lamina.operators import layers, split, stats
from lamina.queries import QUERIES
from lamina.queries.fixtures import LINE_KEYS, fixture, table

JVM_ONLY = [
    "null_token_normalise", "numeric_promotion", "numeric_coerce", "expand_long", "depth_histogram", "coverage_cutoff",
    "expand_wide", "chain_prune", "composition_formula", "composition_ions", "group_mode_lines", "topk_other", "ion_counts_all",
    "corr_matrix", "regression_metrics", "scale_standard", "split_kfold", "split_train_test", "sweep_trials",
]


def plan(df) -> str:
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.mark.parametrize("name", JVM_ONLY)
def test_no_python_and_no_cross_join(name, spark, sf_dir):
    text = plan(QUERIES[name](spark, sf_dir))
    for node in ("Python", "Pandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert node not in text


@pytest.mark.parametrize("name", ["null_token_normalise", "expand_long", "expand_wide", "composition_ions", "scale_standard",
                                  "split_kfold", "split_train_test", "sweep_trials", "null_counts"])
def test_no_shuffle_in_row_operators(name, spark, sf_dir):
    exchanges = re.findall(r"\) Exchange\n", plan(QUERIES[name](spark, sf_dir)))
    # an aggregate to one row is the only exchange allowed
    assert len(exchanges) <= (1 if name == "null_counts" else 0)


def test_scan_reads_needed_columns_and_pushes_filters(spark, sf_dir):
    df = fixture(spark, sf_dir, "numeric").filter("label > 5e4").select("x3")
    text = plan(df)
    assert re.search(r"ReadSchema: struct<l_extendedprice:double,l_tax:double>", text)
    assert "GreaterThan(l_extendedprice,50000.0)" in text


def test_profile_has_one_scan(spark, sf_dir):
    df = fixture(spark, sf_dir, "layered")
    text = plan(layers.depth_histogram(layers.node_profile(df, ["stack"])))
    assert len(re.findall(r"\) Scan parquet", text)) == 1


def test_pruned_leaves_are_not_decoded(spark, sf_dir):
    text = plan(QUERIES["chain_prune"](spark, sf_dir))
    assert "p_retailprice" not in re.search(r"ReadSchema: (.*)", text).group(1)


def test_window_limits_apply_before_the_shuffle(spark, sf_dir):
    df = table(spark, sf_dir, "orders")
    text = plan(stats.best_per_group(df, "o_orderpriority", [F.desc("o_totalprice")]))
    assert re.search(r"WindowGroupLimit[\s\S]*Exchange[\s\S]*WindowGroupLimit", text)


def test_fold_assignment_is_a_projection(spark, sf_dir):
    df = fixture(spark, sf_dir, "numeric").select(*LINE_KEYS)
    assert "Exchange" not in plan(split.kfold(df, LINE_KEYS, 5))


def test_saved_models_are_compared_without_a_join(spark, sf_dir):
    # the only join gives a row's file its first number
    assert not re.search(r"Join \[row_id", QUERIES["model_store_facts"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString())

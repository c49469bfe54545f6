"""Layered cells against a plain recursive reading of the grammar."""

import random

import pytest
from pyspark.sql import functions as F

from lamina.functions.text import token_count, tokenise
from lamina.operators import layers, prune

MARKS = ("|", ";", ">>")
NAMES = ("Layer", "Feature", "Deposition")


def entries(cell, mark):
    if cell is None:
        return []
    packed = cell.replace(" ", "")
    return [] if packed in ("Unknown", "nan") else packed.split(mark)


def brute_tree(name, cells, level=0):
    """(path parts, column, histogram) of every leaf and node, by direct recursion."""
    lists = [entries(c, MARKS[level]) for c in cells] if level < 3 else []
    width = max(map(len, lists), default=0)
    if width == 0:
        return {"leaf": cells, "children": [], "hist": {}}
    children = [[x[i] if i < len(x) else None for x in lists] for i in range(width)]
    hist = {d: sum(len(x) == d for x in lists) for d in range(width + 1)}
    return {"leaf": None, "hist": hist, "children": [brute_tree(name, c, level + 1) for c in children]}


def brute_leaves(name, tree, level=0):
    if not tree["children"]:
        yield name, tree["leaf"]
    for i, child in enumerate(tree["children"]):
        part = f"{name}_{NAMES[level]}_{i}" if len(tree["children"]) > 1 else name
        yield from brute_leaves(part, child, level + 1)


def brute_prune(tree, share):
    kids = tree["children"]
    if len(kids) > 1:
        counts = [tree["hist"][i] for i in range(len(kids))]
        total, upto = sum(counts), 0
        for k, n in enumerate(counts):
            upto += n
            if upto >= total * share:
                break
        kids = kids[: max(1, k)]
    # names keep the width before pruning
    return {**tree, "kept": [brute_prune(c, share) for c in kids]}


def brute_kept(name, tree, level=0):
    if not tree["children"]:
        yield name
    for i, child in enumerate(tree["kept"]):
        part = f"{name}_{NAMES[level]}_{i}" if len(tree["children"]) > 1 else name
        yield from brute_kept(part, child, level + 1)


FIXED = [
    "SLG | FTO | A; B >> C", "X | Unknown", "Y", None, "P; Q | R >> S | T", "", "nan", "Unknown", " ; ", "a||b", ">>", "a >> ; b",
]


def frame(spark, cells):
    return spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "row_id int, F string")


def random_cells(seed):
    rng = random.Random(seed)
    atoms = ["a", "b c", "Unknown", "nan", "", "d"]

    def text(level):
        if level == 3:
            return rng.choice(atoms)
        return f" {MARKS[level]} ".join(text(level + 1) for _ in range(rng.choice([1, 1, 2, 3])))

    return [rng.choice([None, "Unknown", text(0), text(0)]) for _ in range(40)]


@pytest.mark.parametrize("cells", [FIXED, ["Unknown", None, "nan"], ["a", "b"], ["a | b"], *map(random_cells, range(3))])
def test_wide_form_and_pruning(spark, cells):
    df = frame(spark, cells)
    tree = brute_tree("F", cells)
    expected = dict(brute_leaves("F", tree))
    wide = layers.expand_wide(df, ["F"], keep=["row_id"])
    assert wide.columns[1:] == list(expected)
    rows = sorted(wide.collect())
    for i, name in enumerate(expected):
        assert [r[i + 1] for r in rows] == expected[name]
    catalog = layers.build_catalog(df, [("s", "F", "[a | b]")])
    for share in (0.0, 0.3, 0.5, 0.75, 0.95):
        kept = list(brute_kept("F", brute_prune(tree, share)))
        assert layers.surviving_columns(prune.prune_depth(catalog, share)) == kept


@pytest.mark.parametrize("cells", [FIXED, random_cells(7)])
def test_histogram(spark, cells):
    rows = layers.depth_histogram(layers.node_profile(frame(spark, cells), ["F"])).collect()
    got = {(r["level"], r["layer"], r["feature"], r["depth"]): r["n"] for r in rows}
    tree = brute_tree("F", cells)

    def walk(node, level, layer, feature):
        if level == 3 or not node["hist"]:
            return
        for depth, n in node["hist"].items():
            if depth == 0 or n:
                assert got[level, layer, feature, depth] == n
        for i, child in enumerate(node["children"]):
            walk(child, level + 1, i if level == 0 else layer, i if level == 1 else feature)

    walk(tree, 0, -1, -1)
    by_node = {}
    for (level, layer, feature, _), n in got.items():
        by_node[level, layer, feature] = by_node.get((level, layer, feature), 0) + n
    assert set(by_node.values()) == {len(cells)}


def test_long_form_loses_nothing(spark):
    df = frame(spark, FIXED)
    long = layers.expand_long(df, ["F"]).collect()
    for i, cell in enumerate(FIXED):
        values = [r for r in long if r["row_id"] == i]
        if not entries(cell, "|"):
            assert [(r["layer"], r["value"]) for r in values] == [(None, cell)]
    assert [r["value"] for r in sorted(long) if r["row_id"] == 0] == ["SLG", "FTO", "A", "B", "C"]
    unknown = [r for r in long if r["row_id"] == 1 and r["layer"] == 1]
    assert [(r["feature"], r["value"]) for r in unknown] == [(None, "Unknown")]


def test_token_count_agrees(spark):
    texts = ["a>>b", ">>", ">>>", "a", "", "Unknown", "a>>>>b", None]
    df = spark.createDataFrame([(t,) for t in texts], "c string")
    for mark in MARKS:
        rows = df.select(F.size(tokenise(F.col("c"), mark)).alias("a"), token_count(F.col("c"), mark).alias("b")).collect()
        assert all(r["a"] == r["b"] for r in rows)


def test_hand_computed_names(spark):
    cells = FIXED[:5]
    df = frame(spark, cells)
    catalog = layers.build_catalog(df, [("Stack", "F", "[A | B]")])
    assert layers.surviving_columns(prune.prune_depth(catalog, 0.75)) == ["F_Layer_0_Feature_0", "F_Layer_1_Deposition_0"]
    assert layers.surviving_columns(prune.prune_depth(catalog, 0.5)) == ["F_Layer_0_Feature_0"]
    # the catalog keeps its counts, so pruning can be repeated
    again = prune.prune_depth(prune.prune_depth(catalog, 0.75), 0.5)
    assert layers.surviving_columns(again) == ["F_Layer_0_Feature_0"]
    assert again.history == ("depth_pruner", "depth_pruner")


def test_deepest_child_is_cut_below_full_coverage(spark):
    # 1 row of depth 1 and 9 of depth 2: the depth-2 rows are no child's, so one child stays
    cells = ["a"] + ["a | b"] * 9
    catalog = layers.build_catalog(frame(spark, cells), [("s", "F", "[a | b]")])
    assert layers.surviving_columns(prune.prune_depth(catalog, 0.99)) == ["F_Layer_0"]
    assert layers.surviving_columns(prune.prune_depth(catalog, 1.0)) == ["F_Layer_0", "F_Layer_1"]


def test_prune_options(spark):
    df = spark.createDataFrame([("a | b", 1, None), (None, 2, "x")], "F string, H int, K string")
    catalog = layers.build_catalog(df, [("s", "F", "[a | b]"), ("t", "H", None), ("t", "K", None)])
    assert layers.surviving_columns(prune.prune_breadth(catalog, 0.0)) == ["F_Layer_0", "F_Layer_1", "H", "K"]
    assert layers.surviving_columns(prune.prune_breadth(catalog, 0.5)) == ["H"]
    assert layers.surviving_columns(prune.prune_features(catalog, sections=["t"])) == ["F_Layer_0", "F_Layer_1"]
    sections = spark.createDataFrame([("u", ["F", "K"])], "section string, fields array<string>")
    assert layers.surviving_columns(prune.prune_features(catalog, sections=["u"], section_map=sections)) == ["H"]
    for bad in ({"method": "nothing"}, {"method": "chain_pruner", "steps": []}, {"method": "breadth_pruner", "sparsity_threshold": 2}):
        with pytest.raises(ValueError):
            prune.prune(catalog, bad)


def test_layered_fields(spark):
    rows = [("s", "A", "[Mat.1; Mat.2 | Mat.3]"), ("s", "B_concentrations", "[a | b]"), ("s", "C", None), ("t", "D", "x >> y")]
    reference = spark.createDataFrame(rows, "section string, Field string, Pattern string")
    layered, plain = layers.pattern_fields(reference, ["s"])
    assert [r["Field"] for r in layered.collect()] == ["A"]
    assert sorted(r["Field"] for r in plain.collect()) == ["B_concentrations", "C"]

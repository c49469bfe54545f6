"""Decoding of layered cells: ``layer | layer``, then ``entry; entry``, then ``step >> step``.

A field's cells form a tree of depth three.  Its shape (how many children each node has,
how often each depth occurs) comes from one aggregated scan, :func:`node_profile`; names,
cut-offs and catalogs are derived from that small table, and the data are only touched
again by the final projection of the leaves that are wanted.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.functions.text import LEVELS, is_layered, token_count, tokenise
from lamina.session import materialise

(LAYER, LAYER_MARK), (FEATURE, FEATURE_MARK), (STEP, STEP_MARK) = LEVELS


def _layers(cell: Column) -> Column:
    return tokenise(cell, LAYER_MARK)


def _features(layers: Column) -> Column:
    return F.transform(layers, lambda c: tokenise(c, FEATURE_MARK, packed=True))


def _steps(features: Column) -> Column:
    return F.transform(features, lambda fs: F.transform(fs, lambda c: tokenise(c, STEP_MARK, packed=True)))


def child_columns(df: DataFrame, column: str, delimiter: str, keep: Sequence[str] = ()) -> DataFrame:
    """One column per list position, null past the end; the width is that of the longest list."""
    entries = tokenise(F.col(column), delimiter)
    width = df.agg(F.max(F.size(entries))).first()[0] or 0
    listed = df.select(*keep, entries.alias("_entries"))
    return listed.select(*keep, *[F.get("_entries", F.lit(i)).alias(f"child_{i}") for i in range(width)])


def expand_long(df: DataFrame, fields: Sequence[str], keep: Sequence[str] = ("row_id",)) -> DataFrame:
    """``(keep..., field, layer, feature, deposition, value)``, one row per leaf.

    A branch ends where a cell has no entries: the deeper positions are null and the
    value is the raw cell of that level.
    """
    cells = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("cell")) for f in fields])
    rows = df.select(*keep, F.explode(cells).alias("e")).select(*keep, "e.field", "e.cell")
    rows = rows.select(*keep, "field", "cell", F.posexplode_outer(_layers(F.col("cell"))).alias("layer", "c1"))
    rows = rows.select("*", F.posexplode_outer(tokenise(F.col("c1"), FEATURE_MARK, packed=True)).alias("feature", "c2"))
    rows = rows.select("*", F.posexplode_outer(tokenise(F.col("c2"), STEP_MARK, packed=True)).alias("deposition", "c3"))
    return rows.select(
        *keep, "field", "layer", "feature", "deposition", F.coalesce("c3", "c2", "c1", "cell").alias("value")
    )


# -- shape of the trees ----------------------------------------------------------


def _shape(cell: Column) -> Column:
    """Entries per step list, per feature, per layer: the tree of one cell without its text."""

    def of_layer(text: Column) -> Column:
        return F.transform(tokenise(text, FEATURE_MARK, packed=True), lambda c: token_count(c, STEP_MARK))

    return F.transform(_layers(cell), of_layer)


def node_profile(df: DataFrame, fields: Sequence[str], plain: Sequence[str] = ()) -> DataFrame:
    """``(field, level, layer, feature, depth, n)``: rows whose node has ``depth`` children.

    Level 0 is the field, 1 a layer, 2 a feature; absent positions are -1.  Level -1 holds
    the presence of the raw cell (depth 0 null, 1 not null), also for the ``plain``
    fields.  One scan reduces every cell to its shape and counts equal shapes, combined
    before the shuffle; nodes are only listed for the distinct shapes that are left.
    """
    no_shape = F.lit(None).cast("array<array<int>>")
    cells = F.array(
        *[
            F.struct(
                F.lit(f).alias("field"), F.col(f).isNotNull().alias("present"),
                (_shape(F.col(f).cast("string")) if f in fields else no_shape).alias("shape"),
            )
            for f in [*fields, *plain]
        ]
    )
    shapes = (
        df.select(F.explode(cells).alias("e"))
        .groupBy("e.field", "e.present", "e.shape")
        .agg(F.count(F.lit(1)).alias("rows"))
    )

    def node(level: int, layer: Column, feature: Column, depth: Column) -> Column:
        return F.struct(
            F.lit(level).alias("level"), layer.alias("layer"), feature.alias("feature"), depth.alias("depth")
        )

    none = F.lit(-1)
    presence = node(-1, none, none, F.col("present").cast("int"))
    root = node(0, none, none, F.size("shape"))
    layers = F.transform("shape", lambda steps, i: node(1, i, none, F.size(steps)))
    features = F.flatten(
        F.transform("shape", lambda steps, i: F.transform(steps, lambda n, j: node(2, i, j, n)))
    )
    nodes = F.when(F.col("shape").isNull(), F.array(presence)).otherwise(
        F.concat(F.array(presence, root), layers, features)
    )
    listed = shapes.select("field", "rows", F.explode(nodes).alias("e"))
    return listed.groupBy("field", "e.level", "e.layer", "e.feature", "e.depth").agg(F.sum("rows").alias("n"))


def depth_histogram(profile: DataFrame) -> DataFrame:
    """``(field, level, layer, feature, depth, n)`` for every node, with the zero bucket.

    The zero bucket counts all rows in which the node has no children: its cell is
    empty, or the row does not reach the node at all.
    """
    # One field's part of the profile: bounded by the size of its tree, not by its rows.
    rows = F.sum(F.when(F.col("level") == -1, F.col("n"))).over(Window.partitionBy("field"))
    node = ["field", "level", "layer", "feature"]
    bucket = F.struct("depth", "n")
    nodes = (
        profile.withColumn("rows", rows)
        .filter("level >= 0")
        .groupBy(*node)
        .agg(
            F.collect_list(F.when(F.col("depth") > 0, bucket)).alias("found"),
            (F.max("rows") - F.coalesce(F.sum(F.when(F.col("depth") > 0, F.col("n"))), F.lit(0))).alias("none"),
        )
    )
    zero = F.array(F.struct(F.lit(0).alias("depth"), F.col("none").alias("n")))
    return nodes.select(*node, F.explode(F.concat(zero, "found")).alias("e")).select(*node, "e.depth", "e.n")


def coverage_cutoff(histogram: DataFrame, coverage: float) -> DataFrame:
    """``(field, level, layer, feature, width, keep)``: how many children a node keeps.

    Child i stands for the rows of depth i, so the deepest bucket is no child's and the
    share is taken over the rows below it.  The cut-off is the first index whose running
    count reaches the share, at least 1; an only child always stays.
    """
    node = ["field", "level", "layer", "feature"]
    # One node's depths: bounded by the width of the tree.
    running = Window.partitionBy(*node).orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.partitionBy(*node)
    children = histogram.withColumn("width", F.max("depth").over(everything)).filter(
        (F.col("depth") < F.col("width")) | (F.col("width") == 0)
    )
    reached = children.withColumn("upto", F.sum("n").over(running)).withColumn("total", F.sum("n").over(everything))
    first = F.min(F.when(F.col("upto") >= F.col("total") * F.lit(float(coverage)), F.col("depth")))
    return reached.groupBy(*node, "width").agg(F.greatest(F.lit(1), first).alias("first")).select(
        *node,
        F.col("width").cast("int").alias("width"),
        F.when(F.col("width") > 1, F.col("first")).otherwise(F.col("width")).cast("int").alias("keep"),
    )


def node_map(table: DataFrame, value: str) -> DataFrame:
    """``(field, nodes)``: a value per node as a map; its size is that of one field's tree."""
    entry = F.struct(F.struct("level", "layer", "feature").alias("node"), F.col(value).alias("value"))
    return table.groupBy("field").agg(F.map_from_entries(F.collect_list(entry)).alias("nodes"))


def _of_node(level: int, layer: Column, feature: Column) -> Column:
    key = F.struct(F.lit(level).alias("level"), layer.alias("layer"), feature.alias("feature"))
    return F.try_element_at(F.col("nodes"), key)


def values_on_path() -> list[Column]:
    """The values of a leaf's nodes at the three levels, null below the leaf."""
    none = F.lit(-1)
    return [
        _of_node(0, none, none),
        F.when(F.col("layer").isNotNull(), _of_node(1, F.coalesce("layer", none), none)),
        F.when(F.col("feature").isNotNull(), _of_node(2, F.coalesce("layer", none), F.coalesce("feature", none))),
    ]


def leaf_table(histogram: DataFrame) -> DataFrame:
    """``(field, layer, feature, deposition, w0, w1, w2, child)``, one row per leaf of each tree.

    Positions are null below a leaf.  In the name, a part appears only where its parent has
    several children.
    """
    widths = histogram.groupBy("field", "level", "layer", "feature").agg(F.max("depth").alias("width"))

    def children(width: Column) -> Column:
        return F.explode_outer(F.when(width > 0, F.sequence(F.lit(0), width - 1)))

    nothing = F.lit(None).cast("int")
    tree = node_map(widths, "width").withColumns({"layer": nothing, "feature": nothing})
    for level, position in enumerate(("layer", "feature", "deposition")):
        tree = tree.withColumn(f"w{level}", values_on_path()[level]).withColumn(position, children(F.col(f"w{level}")))
    name = F.concat_ws(
        "_",
        "field",
        *[
            F.when(F.col(w) > 1, F.concat(F.lit(part + "_"), F.col(position)))
            for w, part, position in (("w0", LAYER, "layer"), ("w1", FEATURE, "feature"), ("w2", STEP, "deposition"))
        ],
    )
    return tree.select("field", "layer", "feature", "deposition", "w0", "w1", "w2", name.alias("child"))


# -- wide form -------------------------------------------------------------------


def _ordered_leaves(leaves: DataFrame, fields: Sequence[str]) -> list:
    # Becomes the schema of the result, one row per column of the wide table.
    rows = leaves.select("field", "layer", "feature", "deposition", "child").collect()
    place = {f: i for i, f in enumerate(fields)}

    def position(row) -> tuple:
        return (place[row["field"]], *(-1 if row[p] is None else row[p] for p in ("layer", "feature", "deposition")))

    return sorted((r for r in rows if r["field"] in place), key=position)


def expand_wide(
    df: DataFrame, fields: Sequence[str] | Mapping[str, str], leaves: DataFrame | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """One column per leaf.  ``fields`` may map a column to the name its leaves start with.

    Pass a (pruned) ``leaves`` table to decode only those; otherwise the shape is profiled
    first.  Every cell is split once into a nested array and the leaves pick from it.
    """
    names = dict(fields) if isinstance(fields, Mapping) else {f: f for f in fields}
    if leaves is None:
        leaves = leaf_table(depth_histogram(node_profile(df, list(names))))
    return _pick_leaves(df, names, _ordered_leaves(leaves, list(names)), keep)


def _pick_leaves(df: DataFrame, names: Mapping[str, str], wanted: Sequence, keep: Sequence[str]) -> DataFrame:
    nested: dict[str, Column] = {}
    picks: list[Column] = []
    slots = {field: i for i, field in enumerate(names)}
    for leaf in wanted:
        field, slot = leaf["field"], slots[leaf["field"]]
        layers = _layers(F.col(field).cast("string"))
        if leaf["layer"] is None:
            name, column = f"_r{slot}", F.col(field)
        elif leaf["feature"] is None:
            name, column = f"_l{slot}", layers
        elif leaf["deposition"] is None:
            name, column = f"_f{slot}", _features(layers)
        else:
            name, column = f"_s{slot}", _steps(_features(layers))
        nested[name] = column
        pick = F.col(name)
        for position in ("layer", "feature", "deposition"):
            if leaf[position] is not None:
                pick = F.get(pick, F.lit(leaf[position]))
        picks.append(pick.alias(names[field] + leaf["child"][len(field):]))
    inner = df.select(*keep, *[c.alias(n) for n, c in nested.items()])
    return inner.select(*keep, *picks)


# -- field catalog ---------------------------------------------------------------


class Catalog(NamedTuple):
    """Small tables that describe an expansion; pruners return new ones.

    ``records``: ``(ordinal, section, parent, sparsity, layered)``; ``histogram``: see
    :func:`depth_histogram`; ``leaves``: see :func:`leaf_table`, plain fields included;
    ``history``: names of the steps applied so far.
    """

    records: DataFrame
    histogram: DataFrame
    leaves: DataFrame
    history: tuple[str, ...] = ()


def flag_layered(reference: DataFrame) -> DataFrame:
    """Catalog rows with ``layered``: whether the field's cells are to be decoded."""
    return reference.withColumn("layered", is_layered(F.col("Pattern"), F.col("Field")))


def pattern_fields(reference: DataFrame, sections: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Fields of the chosen sections: layered ones and the others."""
    chosen = flag_layered(reference.filter(F.col("section").isin(*sections)))
    return chosen.filter("layered").drop("layered"), chosen.filter("not layered").drop("layered")


def build_catalog(df: DataFrame, reference: Sequence[tuple[str, str, str | None]]) -> Catalog:
    """Profile ``df`` for catalog rows ``(section, Field, Pattern)`` given in catalog order."""
    spark = df.sparkSession
    listed = spark.createDataFrame(
        [(i, *row) for i, row in enumerate(reference)], "ordinal int, section string, Field string, Pattern string"
    )
    flagged = flag_layered(listed)
    verdict = {r["Field"]: r["layered"] for r in flagged.collect()}
    layered = [f for _, f, _ in reference if verdict[f]]
    plain = [f for _, f, _ in reference if not verdict[f]]
    profile = materialise(node_profile(df, layered, plain), "profile")
    presence = profile.filter("level = -1").groupBy(F.col("field").alias("parent")).agg(
        (F.coalesce(F.sum(F.when(F.col("depth") == 0, F.col("n"))), F.lit(0)) / F.sum("n")).alias("sparsity")
    )
    records = (
        flagged.withColumnRenamed("Field", "parent")
        .join(presence, "parent", "left")
        .select("ordinal", "section", "parent", F.coalesce("sparsity", F.lit(float("nan"))).alias("sparsity"), "layered")
    )
    histogram = depth_histogram(profile)
    pass_through = records.filter("not layered").select(
        F.col("parent").alias("field"),
        *[F.lit(None).cast("int").alias(c) for c in ("layer", "feature", "deposition", "w0", "w1", "w2")],
        F.col("parent").alias("child"),
    )
    leaves = leaf_table(histogram).unionByName(pass_through)
    return Catalog(records, histogram, leaves)


def feature_records(catalog: Catalog) -> DataFrame:
    """``(ordinal, parent, sparsity, children, nodes)``, sparsest last, ties in catalog order.

    ``nodes`` lists every tree node as ``(path, name, counts)``; ``counts`` of child i is its
    parent's histogram at i.  All lists are bounded by the width of one field's tree.
    """
    order = F.struct(*[F.coalesce(c, F.lit(-1)) for c in ("layer", "feature", "deposition")], F.col("child"))
    children = catalog.leaves.groupBy(F.col("field").alias("parent")).agg(
        F.transform(F.array_sort(F.collect_list(order)), lambda s: s["child"]).alias("children")
    )
    nodes = tree_nodes(catalog).groupBy(F.col("field").alias("parent")).agg(
        F.array_sort(F.collect_list(F.struct("path", "name", "counts"))).alias("nodes")
    )
    empty = F.array().cast("array<struct<path:string,name:string,counts:bigint>>")
    return (
        catalog.records.join(children, "parent")
        .join(nodes, "parent", "left")
        .select("ordinal", "parent", "sparsity", "children", F.coalesce("nodes", empty).alias("nodes"))
        .orderBy("sparsity", "ordinal")
    )


def tree_nodes(catalog: Catalog) -> DataFrame:
    """``(field, path, name, counts)`` of every node of the layered fields' trees."""

    def part(label: str, width: str, position: str) -> Column:
        return F.when(F.col(width) > 1, F.concat(F.lit(label + "_"), F.col(position))).otherwise(F.lit(label))

    layered = catalog.records.filter("layered").select(F.col("parent").alias("field"))
    tree = catalog.leaves.join(layered, "field")
    steps = [
        (1, ("layer",), part(LAYER, "w0", "layer")),
        (2, ("layer", "feature"), part(FEATURE, "w1", "feature")),
        (3, ("layer", "feature", "deposition"), part(STEP, "w2", "deposition")),
    ]
    entries = [
        F.struct(F.lit(0).alias("level"), *[F.lit(-1).alias(c) for c in ("layer", "feature", "position")],
                 F.col("field").alias("path"), F.col("field").alias("name"))
    ]
    labels: list[Column] = []
    for level, positions, label in steps:
        labels.append(label)
        deepest = level == 3
        is_leaf = F.lit(True) if deepest else F.col(steps[level][1][-1]).isNull()
        entries.append(
            F.when(
                F.col(positions[-1]).isNotNull(),
                F.struct(
                    F.lit(level).alias("level"),
                    (F.col("layer") if level > 1 else F.lit(-1)).alias("layer"),
                    (F.col("feature") if level > 2 else F.lit(-1)).alias("feature"),
                    F.col(positions[-1]).alias("position"),
                    F.concat_ws("/", "field", *labels).alias("path"),
                    F.when(is_leaf, F.col("child")).otherwise(label).alias("name"),
                ),
            )
        )
    nodes = (
        tree.select("field", F.explode(F.array(*entries)).alias("e")).filter("e is not null").select("field", "e.*").distinct()
    )
    counts = catalog.histogram.select(
        "field", (F.col("level") + 1).alias("level"), "layer", "feature", F.col("depth").alias("position"), "n"
    )
    return nodes.join(counts, ["field", "level", "layer", "feature", "position"], "left").select(
        "field", "path", "name", F.coalesce("n", F.lit(0)).alias("counts")
    )


def _surviving(catalog: Catalog) -> tuple[list[str], list]:
    """Parents in catalog order, and the leaves that are left, in column order."""
    fields = [r["parent"] for r in sorted(catalog.records.select("ordinal", "parent").collect())]
    return fields, _ordered_leaves(catalog.leaves, fields)


def surviving_columns(catalog: Catalog) -> list[str]:
    """Leaf names in record order; this is the column list of the expanded table."""
    return [r["child"] for r in _surviving(catalog)[1]]


def expand_catalog(df: DataFrame, catalog: Catalog, keep: Sequence[str] = ()) -> DataFrame:
    """The columns the catalog still lists, decoded from ``df``; pruned leaves are never computed."""
    fields, wanted = _surviving(catalog)
    wanted = [r for r in wanted if r["child"] not in keep]
    return _pick_leaves(df, {f: f for f in fields}, wanted, keep)

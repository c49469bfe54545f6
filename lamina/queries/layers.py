"""Layer decoding, profiles and pruning."""

from __future__ import annotations

from pyspark.sql import functions as F

from lamina.operators import layers, prune, stats
from lamina.queries.fixtures import LINE_KEYS, fixture, oracle
from lamina.queries.registry import query
from lamina.session import scratch_path
from lamina.sources.cache import cache_or_compute, target_and_features

KEYS_SQL = ", ".join(LINE_KEYS)
# Catalog of the layered_small columns, in order: (section, field, pattern).
REFERENCE = [
    ("Stack", "F", "[Mat.1; Mat.2; ... | Mat.3; ... | Mat.4 | ...]"),
    ("Stack", "G", "[Proc. 1 >> Proc. 2 | Proc. 3]"),
    ("Cell", "H", None),
    ("Cell", "K", "TRUE or FALSE"),
    ("Result", "target", None),
]
# Leaves of layered_small: name -> positions.
LEAVES = {
    "F_Layer_0_Feature_0": ("F", 0, 0, 0),
    "F_Layer_0_Feature_1": ("F", 0, 1, 0),
    "F_Layer_1_Deposition_0": ("F", 1, 0, 0),
    "F_Layer_1_Deposition_1": ("F", 1, 0, 1),
    "F_Layer_2_Feature_0": ("F", 2, 0, 0),
    "F_Layer_2_Feature_1_Deposition_0": ("F", 2, 1, 0),
    "F_Layer_2_Feature_1_Deposition_1": ("F", 2, 1, 1),
    "G_Deposition_0": ("G", 0, 0, 0),
    "G_Deposition_1": ("G", 0, 0, 1),
}
KEPT_AT_075 = ["F_Layer_0_Feature_0", "F_Layer_1_Deposition_0", "G_Deposition_0"]
KEPT_AT_050 = ["F_Layer_0_Feature_0", "G_Deposition_0"]


def tok(cell: str, delimiter: str) -> str:
    return (
        f"CASE WHEN {cell} IS NULL OR replace({cell}, ' ', '') IN ('Unknown', 'nan') THEN CAST([] AS VARCHAR[]) "
        f"ELSE string_split(replace({cell}, ' ', ''), '{delimiter}') END"
    )


def leaf_sql(name: str) -> str:
    field, i, j, k = LEAVES[name]
    layer = f"({tok(field, '|')})[{i + 1}]"
    feature = f"({tok(layer, ';')})[{j + 1}]"
    return f"({tok(feature, '>>')})[{k + 1}] AS {name}"


def wide_sql(names, *more: str) -> str:
    return "\nSELECT " + ",\n  ".join([*more, *[leaf_sql(n) for n in names]]) + "\nFROM src"


WALK_SQL = f"""
, a AS (SELECT {KEYS_SQL}, stack AS c0, {tok('stack', '|')} AS ls FROM src)
, b0 AS (SELECT *, unnest(CASE WHEN len(ls) = 0 THEN [NULL] ELSE range(0, len(ls)) END) AS layer FROM a)
, b1 AS (SELECT *, ls[layer + 1] AS c1 FROM b0)
, b AS (SELECT *, {tok('c1', ';')} AS fs FROM b1)
, d0 AS (SELECT *, unnest(CASE WHEN len(fs) = 0 THEN [NULL] ELSE range(0, len(fs)) END) AS feature FROM b)
, d1 AS (SELECT *, fs[feature + 1] AS c2 FROM d0)
, d AS (SELECT *, {tok('c2', '>>')} AS ds FROM d1)"""

HISTOGRAM_SQL = WALK_SQL + """
, sizes AS (
  SELECT 0 AS level, -1 AS layer, -1 AS feature, len(ls) AS depth FROM a
  UNION ALL SELECT 1, layer, -1, len(fs) FROM b WHERE layer IS NOT NULL
  UNION ALL SELECT 2, layer, feature, len(ds) FROM d WHERE feature IS NOT NULL)
, found AS (SELECT level, layer, feature, depth, count(*) AS n FROM sizes WHERE depth > 0 GROUP BY ALL)
, nodes AS (SELECT DISTINCT level, layer, feature FROM sizes)
, zero AS (SELECT o.level, o.layer, o.feature, 0 AS depth,
    (SELECT count(*) FROM src) - coalesce((SELECT sum(n) FROM found f WHERE f.level = o.level AND f.layer = o.layer AND f.feature = o.feature), 0) AS n
  FROM nodes o)
, hist AS (SELECT 'stack' AS field, CAST(level AS INTEGER) AS level, CAST(layer AS INTEGER) AS layer,
    CAST(feature AS INTEGER) AS feature, CAST(depth AS INTEGER) AS depth, CAST(n AS BIGINT) AS n
  FROM (SELECT * FROM found UNION ALL SELECT * FROM zero))"""


@query("tokenise_layers", oracle("layered", f"""
SELECT {KEYS_SQL}, array_to_string({tok('stack', '|')}, '~') AS entries, CAST(len({tok('stack', '|')}) AS INTEGER) AS depth FROM src"""))
def tokenise_layers(spark, sf_dir):
    df = fixture(spark, sf_dir, "layered")
    entries = layers.tokenise(F.col("stack"), "|")
    return df.select(*LINE_KEYS, F.array_join(entries, "~").alias("entries"), F.size(entries).alias("depth"))


@query("expand_long", oracle("layered", WALK_SQL + f"""
, e0 AS (SELECT *, unnest(CASE WHEN len(ds) = 0 THEN [NULL] ELSE range(0, len(ds)) END) AS deposition FROM d)
SELECT {KEYS_SQL}, 'stack' AS field, CAST(layer AS INTEGER) AS layer, CAST(feature AS INTEGER) AS feature,
  CAST(deposition AS INTEGER) AS deposition, coalesce(ds[deposition + 1], c2, c1, c0) AS value FROM e0"""))
def expand_long(spark, sf_dir):
    return layers.expand_long(fixture(spark, sf_dir, "layered"), ["stack"], keep=LINE_KEYS)


@query("depth_histogram", oracle("layered", HISTOGRAM_SQL + "\nSELECT * FROM hist"))
def depth_histogram(spark, sf_dir):
    return layers.depth_histogram(layers.node_profile(fixture(spark, sf_dir, "layered"), ["stack"]))


@query("coverage_cutoff", oracle("layered", HISTOGRAM_SQL + """
, w AS (SELECT *, max(depth) OVER node AS width FROM hist WINDOW node AS (PARTITION BY field, level, layer, feature))
, c AS (SELECT *, sum(n) OVER (PARTITION BY field, level, layer, feature ORDER BY depth ROWS UNBOUNDED PRECEDING) AS upto,
    sum(n) OVER (PARTITION BY field, level, layer, feature) AS total FROM w WHERE depth < width OR width = 0)
SELECT field, level, layer, feature, width,
  CAST(CASE WHEN width > 1 THEN greatest(1, min(CASE WHEN upto >= total * CAST(0.75 AS DOUBLE) THEN depth END)) ELSE width END AS INTEGER) AS keep
FROM c GROUP BY field, level, layer, feature, width"""))
def coverage_cutoff(spark, sf_dir):
    profile = layers.node_profile(fixture(spark, sf_dir, "layered"), ["stack"])
    return layers.coverage_cutoff(layers.depth_histogram(profile), 0.75)


@query("null_fraction", oracle("layered", """
SELECT 'stack' AS column_name, round(1.0e0 - count(stack) / CAST(count(*) AS DOUBLE), 9) AS sparsity FROM src
UNION ALL SELECT 'l_orderkey', round(1.0e0 - count(l_orderkey) / CAST(count(*) AS DOUBLE), 9) FROM src"""))
def null_fraction(spark, sf_dir):
    table = stats.null_fraction(fixture(spark, sf_dir, "layered"), ["stack", "l_orderkey"])
    return table.select("column_name", F.round("sparsity", 9).alias("sparsity"))


@query("generate_children", oracle("layered_small", f"""
SELECT row_id, ({tok('F', '|')})[1] AS child_0, ({tok('F', '|')})[2] AS child_1, ({tok('F', '|')})[3] AS child_2 FROM src"""))
def generate_children(spark, sf_dir):
    return layers.child_columns(fixture(spark, sf_dir, "layered_small"), "F", "|", keep=["row_id"])


@query("expand_leaf_names", oracle("layered_small", "\n, leaves(field, layer, feature, deposition, child) AS (VALUES " + ", ".join(
    f"('{f}', {i}, {j}, {k}, '{n}')" for n, (f, i, j, k) in LEAVES.items()) + """)
, c AS (SELECT """ + ", ".join(f"count({leaf_sql(n).rsplit(' AS ', 1)[0]}) AS {n}" for n in LEAVES) + """ FROM src)
, u AS (UNPIVOT c ON COLUMNS(*) INTO NAME child VALUE filled)
SELECT field, CAST(layer AS INTEGER) AS layer, CAST(feature AS INTEGER) AS feature, CAST(deposition AS INTEGER) AS deposition,
  child, CAST(filled AS BIGINT) AS filled FROM leaves JOIN u USING (child)"""))
def expand_leaf_names(spark, sf_dir):
    df = fixture(spark, sf_dir, "layered_small")
    names = layers.leaf_table(layers.depth_histogram(layers.node_profile(df, ["F", "G"])))
    # How often each leaf is filled, from the long form of the same cells.
    long = layers.expand_long(df, ["F", "G"]).filter("deposition is not null")
    filled = long.groupBy("field", "layer", "feature", "deposition").agg(F.count("value").alias("filled"))
    return names.join(filled, ["field", "layer", "feature", "deposition"], "left").select(
        "field", "layer", "feature", "deposition", "child", F.coalesce("filled", F.lit(0)).alias("filled")
    )


@query("expand_wide", oracle("layered_small", wide_sql([n for n in LEAVES if n[0] == "F"], "row_id")))
def expand_wide(spark, sf_dir):
    return layers.expand_wide(fixture(spark, sf_dir, "layered_small"), ["F"], keep=["row_id"])


@query("expand_many", oracle("layered_small", wide_sql(LEAVES, "row_id").replace("AS F_", "AS first_").replace("AS G_", "AS second_")))
def expand_many(spark, sf_dir):
    df = fixture(spark, sf_dir, "layered_small")
    return layers.expand_wide(df, {"F": "first", "G": "second"}, keep=["row_id"])


def _catalog(spark, sf_dir):
    df = fixture(spark, sf_dir, "layered_small")
    return df, layers.build_catalog(df, REFERENCE)


def _counts_sql() -> str:
    """Nodes of the F and G trees with their counts, as (field, path, name, counts) rows."""
    def rows_with(cell: str, delimiter: str, depth: int) -> str:
        size = f"len({tok(cell, delimiter)})"
        return f"(SELECT count(*) FROM src WHERE coalesce({size}, 0) = {depth})"

    lf = {i: f"({tok('F', '|')})[{i + 1}]" for i in range(3)}
    ff = {(i, j): f"({tok(lf[i], ';')})[{j + 1}]" for i in range(3) for j in range(2)}
    lg = f"({tok('G', '|')})[1]"
    fg = f"({tok(lg, ';')})[1]"
    nodes = [("F", "F", "F", "0"), ("G", "G", "G", "0")]
    nodes += [("F", f"F/Layer_{i}", f"Layer_{i}", rows_with("F", "|", i)) for i in range(3)]
    nodes += [("F", f"F/Layer_{i}/Feature_{j}", f"Feature_{j}", rows_with(lf[i], ";", j)) for i in (0, 2) for j in (0, 1)]
    nodes += [("F", "F/Layer_1/Feature", "Feature", rows_with(lf[1], ";", 0))]
    nodes += [("F", f"F/Layer_0/Feature_{j}/Deposition", f"F_Layer_0_Feature_{j}", rows_with(ff[0, j], ">>", 0)) for j in (0, 1)]
    nodes += [("F", f"F/Layer_1/Feature/Deposition_{k}", f"F_Layer_1_Deposition_{k}", rows_with(ff[1, 0], ">>", k)) for k in (0, 1)]
    nodes += [("F", "F/Layer_2/Feature_0/Deposition", "F_Layer_2_Feature_0", rows_with(ff[2, 0], ">>", 0))]
    nodes += [("F", f"F/Layer_2/Feature_1/Deposition_{k}", f"F_Layer_2_Feature_1_Deposition_{k}", rows_with(ff[2, 1], ">>", k)) for k in (0, 1)]
    nodes += [("G", "G/Layer", "Layer", rows_with("G", "|", 0)), ("G", "G/Layer/Feature", "Feature", rows_with(lg, ";", 0))]
    nodes += [("G", f"G/Layer/Feature/Deposition_{k}", f"G_Deposition_{k}", rows_with(fg, ">>", k)) for k in (0, 1)]
    return "\nUNION ALL ".join(
        f"SELECT '{f}' AS parent, '{p}' AS path, '{n}' AS name, {c} AS counts" for f, p, n, c in nodes
    )


def _records_sql() -> str:
    def children(field: str) -> str:
        return ",".join(n for n in LEAVES if n.startswith(field + "_")) or field

    rows = "\nUNION ALL ".join(
        f"SELECT {i} AS ordinal, '{f}' AS parent, 1.0e0 - count({f}) / CAST(count(*) AS DOUBLE) AS sparsity, '{children(f)}' AS children FROM src"
        for i, (_, f, _) in enumerate(REFERENCE)
    )
    return f"""
, nodes AS ({_counts_sql()})
, n AS (SELECT parent, string_agg(path || ':' || name || ':' || counts, ';' ORDER BY path) AS nodes FROM nodes GROUP BY parent)
, r AS ({rows})
SELECT CAST(ordinal AS INTEGER) AS ordinal, parent, round(sparsity, 9) AS sparsity, children, coalesce(nodes, '') AS nodes,
  CAST(row_number() OVER (ORDER BY round(sparsity, 9), ordinal) AS INTEGER) AS place
FROM r LEFT JOIN n USING (parent)"""


@query("feature_catalog", oracle("layered_small", _records_sql()))
def feature_catalog(spark, sf_dir):
    from pyspark.sql import Window

    _, catalog = _catalog(spark, sf_dir)
    nodes = F.transform("nodes", lambda n: F.concat_ws(":", n["path"], n["name"], n["counts"].cast("string")))
    # One row per catalog field.
    place = F.row_number().over(Window.orderBy(F.round("sparsity", 9), "ordinal"))
    return layers.feature_records(catalog).select(
        "ordinal", "parent", F.round("sparsity", 9).alias("sparsity"), F.array_join("children", ",").alias("children"),
        F.array_join(nodes, ";").alias("nodes"), place.alias("place"),
    )


@query("feature_prune", oracle("layered_small", wide_sql([n for n in LEAVES if n[0] == "F"], "row_id", "K")))
def feature_prune(spark, sf_dir):
    df, catalog = _catalog(spark, sf_dir)
    pruned = prune.prune_features(catalog, features=["G", "H"], sections=["Result"])
    return layers.expand_catalog(df, pruned, keep=["row_id"])


@query("breadth_prune", oracle("layered_small", wide_sql(
    [n for n in LEAVES if n[0] == "F"], "row_id", "H", "target")))
def breadth_prune(spark, sf_dir):
    # null shares: F 1/5, G 1/3, H 0, K 9/10, target 1/9
    df, catalog = _catalog(spark, sf_dir)
    return layers.expand_catalog(df, prune.prune_breadth(catalog, 0.25), keep=["row_id"])


@query("depth_prune", oracle("layered_small", wide_sql(KEPT_AT_075, "row_id", "H", "K", "target")))
def depth_prune(spark, sf_dir):
    df, catalog = _catalog(spark, sf_dir)
    return layers.expand_catalog(df, prune.prune_depth(catalog, 0.75), keep=["row_id"])


@query("chain_prune", oracle("layered_small", wide_sql([n for n in KEPT_AT_050 if n[0] == "F"], "row_id", "H")))
def chain_prune(spark, sf_dir):
    df, catalog = _catalog(spark, sf_dir)
    steps = [
        {"method": "feature_pruner", "sections": ["Result"], "features": []},
        {"method": "breadth_pruner", "sparsity_threshold": 0.25},
        {"method": "depth_pruner", "layer_coverage": 0.5},
    ]
    return layers.expand_catalog(df, prune.prune(catalog, {"method": "chain_pruner", "steps": steps}), keep=["row_id"])


@query("preprocess_wide", oracle("layered_small", wide_sql(
    KEPT_AT_075, "row_id", "CASE WHEN H = 'nan' THEN NULL ELSE CAST(H AS DOUBLE) END AS H")))
def preprocess_wide(spark, sf_dir):
    df = fixture(spark, sf_dir, "layered_small")
    return prune.preprocess_wide(
        df, REFERENCE, threshold=0.5, depth=0.75, sections=["Stack", "Cell", "Result"], exclude=["target"], keep=["row_id"]
    )


EXPANDED_SQL = wide_sql(LEAVES, "row_id", "H", "K", "target") + " WHERE target IS NOT NULL"


@query("expand_cached", oracle("layered_small", EXPANDED_SQL))
def expand_cached(spark, sf_dir):
    folder = scratch_path(spark, "cache")

    def run(source):
        return cache_or_compute(source, REFERENCE, "target", folder, spark, keep=["row_id"])[0]

    def unused():
        raise AssertionError("the second call must read the cache")

    run(lambda: fixture(spark, sf_dir, "layered_small"))
    return run(unused)


@query("expanded_target_split", oracle("layered_small", wide_sql(
    KEPT_AT_075, "row_id", "H", "K", "target AS label") + " WHERE target IS NOT NULL"))
def expanded_target_split(spark, sf_dir):
    rows = fixture(spark, sf_dir, "layered_small").filter("target is not null")
    catalog = prune.prune_depth(layers.build_catalog(rows, REFERENCE), 0.75)
    expanded = layers.expand_catalog(rows, catalog, keep=["row_id"])
    return target_and_features(expanded, layers.surviving_columns(catalog), "target", keep=["row_id"])

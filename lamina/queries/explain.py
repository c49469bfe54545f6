"""Attributions."""

from __future__ import annotations

from pyspark.sql import functions as F

from lamina.operators import attributions, explain, models
from lamina.operators.split import number_rows
from lamina.queries.fixtures import LINE_KEYS, table
from lamina.queries.models import FEATURES, FOREST, GRADIENT, model_table
from lamina.queries.registry import query
from lamina.session import materialise

ATTRIBUTIONS_SQL = """WITH a AS (SELECT vec_id AS row_id, concat('f', cast(i AS varchar)) AS feature, CAST(embedding[i + 1] AS DOUBLE) AS value
  FROM embeddings, (SELECT unnest(range(64)) AS i))
, pairs AS (SELECT x.row_id, x.feature AS feature_i, y.feature AS feature_j, x.value * y.value AS value FROM a x JOIN a y USING (row_id))
, sums AS (SELECT feature_i, feature_j, CASE WHEN feature_i = feature_j THEN 0.0e0 ELSE sum(abs(value)) END AS total FROM pairs GROUP BY feature_i, feature_j)
, weights AS (SELECT feature_i AS feature, sum(total) AS weight FROM sums GROUP BY feature_i)
, w AS (SELECT feature, row_number() OVER (ORDER BY weight DESC, feature) - 1 AS place FROM weights)"""


def _values(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("row_id"), *[F.get("embedding", F.lit(i)).cast("double").alias(f"f{i}") for i in range(64)])


def _attributions(spark, sf_dir):
    return _values(spark, sf_dir).unpivot(["row_id"], [f"f{i}" for i in range(64)], "feature", "value")


def _pairs(spark, sf_dir, features=64):
    """A row x feature x feature tensor of the first features: the product of both coordinates."""
    cells = F.transform(F.slice("embedding", 1, features), lambda x: x.cast("double"))
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_id"), cells.alias("e"))
    firsts = rows.select("row_id", "e", F.posexplode("e").alias("i", "x"))
    both = firsts.select("row_id", "i", "x", F.posexplode("e").alias("j", "y"))
    name = [F.concat(F.lit("f"), F.col(c).cast("string")).alias(f"feature_{c}") for c in ("i", "j")]
    return both.select("row_id", *name, (F.col("x") * F.col("y")).alias("value"))


@query("attribution_rank", ATTRIBUTIONS_SQL + "\nSELECT feature, round(avg(abs(value)), 9) AS importance FROM a GROUP BY feature")
def attribution_rank(spark, sf_dir):
    ranked = explain.attribution_rank(_attributions(spark, sf_dir))
    return ranked.select("feature", F.round("importance", 9).alias("importance"))


@query("interaction_matrix", ATTRIBUTIONS_SQL + """
SELECT feature_i, feature_j, round(total, 6) AS total, CAST(p.place AS INTEGER) AS place_i, CAST(q.place AS INTEGER) AS place_j
FROM sums JOIN w p ON feature_i = p.feature JOIN w q ON feature_j = q.feature""")
def interaction_matrix(spark, sf_dir):
    matrix = explain.interaction_matrix(_pairs(spark, sf_dir))
    return matrix.withColumn("total", F.round("total", 6))


@query("interaction_pairs", ATTRIBUTIONS_SQL + "\nSELECT feature_i, feature_j, round(total, 6) AS total FROM sums WHERE total > 5.0e0")
def interaction_pairs(spark, sf_dir):
    pairs = explain.interaction_pairs(explain.interaction_matrix(_pairs(spark, sf_dir)), 5.0)
    return pairs.withColumn("total", F.round("total", 6))


@query("dependence_points", ATTRIBUTIONS_SQL + """
, plan(feature_i, feature_j, colour_by) AS (VALUES ('f0', 'f0', NULL), ('f0', 'f1', 'f1'), ('f0', 'f2', 'f2'), ('f3', 'f3', NULL), ('f3', 'f1', 'f1'))
SELECT x.row_id, feature_i, feature_j, x.value AS x, x.value * y.value AS attribution, c.value AS colour
FROM plan JOIN a x ON x.feature = feature_i JOIN a y ON y.row_id = x.row_id AND y.feature = feature_j
LEFT JOIN a c ON c.row_id = x.row_id AND c.feature = colour_by""")
def dependence_points(spark, sf_dir):
    pairs = spark.createDataFrame([("f0", "f1"), ("f0", "f2"), ("f3", "f1")], "feature_i string, feature_j string")
    plan = explain.dependence_plan(pairs)
    # the tensor of the features that the plan names
    return explain.dependence_points(_values(spark, sf_dir), _pairs(spark, sf_dir, 4), "row_id", plan)


def _numbered(spark, sf_dir):
    return number_rows(model_table(spark, sf_dir), LINE_KEYS)


@query("shapley_sampled")
def shapley_sampled(spark, sf_dir):
    df = _numbered(spark, sf_dir)
    values, _ = explain.sampled_shapley(models.fit(df, FEATURES, "label", GRADIENT), df, "row_id")
    return values


@query("shapley_interactions")
def shapley_interactions(spark, sf_dir):
    df = _numbered(spark, sf_dir)
    fitted = models.fit(df, FEATURES, "label", FOREST)
    return explain.sampled_interactions(fitted, df, "row_id")


@query("shapley_rank")
def shapley_rank(spark, sf_dir):
    df = _numbered(spark, sf_dir)
    values, _ = explain.sampled_shapley(models.fit(df, FEATURES, "label", FOREST), df, "row_id")
    return explain.attribution_rank(materialise(values, "shapley"))


# -- exact attributions ------------------------------------------------------------

EXACT_FEATURES = ["l_discount", "l_tax", "l_quantity", "l_linenumber"]
# A tree of given splits (feature, threshold, left, right); what reaches its nodes and the mean of its leaves come from the table.
EXACT_TREE = (2, 25.0, (0, 0.05, 0, (1, 0.03, 0, 0)), (3, 2.0, (2, 40.0, (1, 0.05, 0, 0), 0), (0, 0.02, 0, (2, 33.0, 0, (1, 0.06, 0, 0)))))


def _tree_rows(tree):
    """``(node, condition, feature, threshold, left, right)``, parents first."""
    rows = []

    def grow(node, condition):
        number = len(rows)
        rows.append(None)
        if not node:
            rows[number] = (number, condition, None, None, -1, -1)
            return number
        feature, threshold, left, right = node
        name = EXACT_FEATURES[feature]
        children = [grow(child, f"{condition} AND {name} {sign} {threshold}e0") for child, sign in ((left, "<="), (right, ">"))]
        rows[number] = (number, condition, feature, threshold, *children)
        return number

    grow(tree, "TRUE")
    return rows


def _tree_sums():
    """SQL columns: rows and label sum of every node, all whole numbers."""
    return ", ".join(
        f"CAST(count(CASE WHEN {c} THEN 1 END) AS DOUBLE) AS n{k}, "
        f"CAST(coalesce(sum(CASE WHEN {c} THEN l_partkey % 100 END), 0) AS DOUBLE) AS s{k}"
        for k, c, *_ in _tree_rows(EXACT_TREE)
    )


def _exact_trees(spark, sf_dir):
    row = spark.sql(f"SELECT {_tree_sums()} FROM {{lineitem}}", lineitem=table(spark, sf_dir, "lineitem")).first()
    return attributions.flatten(
        {"tree": 0, "node": k, "feature": f, "threshold": t, "left": a, "right": b, "weight": 1.0, "cover": row[f"n{k}"],
         "value": row[f"s{k}"] / row[f"n{k}"] if row[f"n{k}"] else 0.0}
        for k, _, f, t, a, b in _tree_rows(EXACT_TREE)
    )


def _leaf_products(known):
    """SQL of the tree's value when the features of a bit set follow the row."""
    nodes = {k: rest for k, *rest in _tree_rows(EXACT_TREE)}

    def walk(k):
        _, feature, threshold, left, right = nodes[k]
        if feature is None:
            return f"(s{k} / greatest(n{k}, 1))"
        if known >> feature & 1:
            return f"(CASE WHEN {EXACT_FEATURES[feature]} <= {threshold}e0 THEN {walk(left)} ELSE {walk(right)} END)"
        return f"(({walk(left)} * n{left} + {walk(right)} * n{right}) / greatest(n{k}, 1))"

    return walk(0)


EXACT_SQL = f"WITH t AS (SELECT {_tree_sums()} FROM lineitem), f AS (SELECT {', '.join(LINE_KEYS)}, " + ", ".join(
    f"{_leaf_products(s)} AS f{s}" for s in range(16)
) + " FROM lineitem, t)\n"


def _subset_sum(i):
    """SQL of the attribution of feature ``i`` by all subsets of the others."""
    sizes = {0: "6e0", 1: "2e0", 2: "2e0", 3: "6e0"}
    return " + ".join(f"{sizes[s.bit_count()]} * (f{s | 1 << i} - f{s})" for s in range(16) if not s >> i & 1)


def _pair_sum(i, j):
    sizes = {0: "2e0", 1: "1e0", 2: "2e0"}
    return " + ".join(
        f"{sizes[s.bit_count()]} * (f{s | 1 << i | 1 << j} - f{s | 1 << i} - f{s | 1 << j} + f{s})"
        for s in range(16) if not s >> i & 1 and not s >> j & 1
    )


@query("shapley_exact", EXACT_SQL + "\nUNION ALL ".join(
    f"SELECT {', '.join(LINE_KEYS)}, '{name}' AS feature, round(({_subset_sum(i)}) / 24e0, 6) + 0e0 AS value, round(f0, 6) AS base FROM f"
    for i, name in enumerate(EXACT_FEATURES)
))
def shapley_exact(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    trees = _exact_trees(spark, sf_dir)
    keyed = df.withColumn("row_id", F.to_json(F.struct(*LINE_KEYS)))
    values, _ = attributions.shapley_from(trees, EXACT_FEATURES, keyed, "row_id", [F.col(c).cast("double") for c in EXACT_FEATURES])
    return _with_keys(df, values).select(*LINE_KEYS, "feature", (F.round("value", 6) + 0.0).alias("value"), F.round(F.lit(trees.base), 6).alias("base"))


@query("interactions_exact", EXACT_SQL + "\nUNION ALL ".join(
    f"SELECT {', '.join(LINE_KEYS)}, '{a}' AS feature_i, '{b}' AS feature_j, round(({_pair_sum(i, j)}) / 12e0, 6) + 0e0 AS value FROM f"
    for i, a in enumerate(EXACT_FEATURES) for j, b in enumerate(EXACT_FEATURES) if i != j
))
def interactions_exact(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    trees = _exact_trees(spark, sf_dir)
    keyed = df.withColumn("row_id", F.to_json(F.struct(*LINE_KEYS)))
    pairs = attributions.interactions_from(trees, EXACT_FEATURES, keyed, "row_id", [F.col(c).cast("double") for c in EXACT_FEATURES])
    return _with_keys(df, pairs).select(*LINE_KEYS, "feature_i", "feature_j", (F.round("value", 6) + 0.0).alias("value"))


def _with_keys(df, long):
    """The key columns again from their text."""
    schema = df.select(*LINE_KEYS).schema
    return long.select(F.from_json("row_id", schema).alias("_k"), *[c for c in long.columns if c != "row_id"]).select("_k.*", "*")


@query("shapley_exact_model", f"""SELECT model_type, count(*) AS n_rows, count(*) * {len(FEATURES)} AS n_values, 0.0e0 AS largest_gap
FROM lineitem, (VALUES ('random_forest'), ('xgboost')) AS m(model_type) GROUP BY model_type""")
def shapley_exact_model(spark, sf_dir):
    """Of trained models: how far attributions and base are from the prediction at most, over all rows."""
    df = _numbered(spark, sf_dir)
    parts = []
    for config in (FOREST, GRADIENT):
        fitted = models.fit(df, FEATURES, "label", config)
        values, ends = attributions.tree_shapley(fitted, df, "row_id")
        sums = values.groupBy("row_id").agg(F.sum("value").alias("total"), F.count("value").alias("n"))
        both = sums.join(ends, "row_id").join(models.predict(fitted, df, ["row_id"]).withColumnRenamed("prediction", "model"), "row_id")
        gap = F.max(F.abs(F.col("base") + F.col("total") - F.col("model")))
        parts.append(both.agg(
            F.lit(config["model_type"]).alias("model_type"), F.count("*").alias("n_rows"), F.sum("n").alias("n_values"),
            (F.round(gap, 6) + 0.0).alias("largest_gap"),
        ))
    return parts[0].unionByName(parts[1])


@query("shapley_sampled_facts", f"SELECT count(*) AS n_rows, count(*) * {len(FEATURES)} AS n_values, 0.0e0 AS largest_gap FROM lineitem")
def shapley_sampled_facts(spark, sf_dir):
    """Sampled attributions add up to the prediction less the background's mean, over all rows."""
    df = _numbered(spark, sf_dir)
    fitted = models.fit(df, FEATURES, "label", GRADIENT)
    values, ends = explain.sampled_shapley(fitted, df, "row_id", written=True)
    sums = values.groupBy("row_id").agg(F.sum("value").alias("total"), F.count("value").alias("n"))
    gap = F.abs(F.col("base") + F.col("total") - F.col("model"))
    both = sums.join(ends, "row_id").join(models.predict(fitted, df, ["row_id"]).withColumnRenamed("prediction", "model"), "row_id")
    return both.agg(F.count("*").alias("n_rows"), F.sum("n").alias("n_values"), (F.round(F.max(gap), 6) + 0.0).alias("largest_gap"))

from pyspark.sql import functions as F

from lamina.sources import hash_tree


def leaves(tree):
    return {(r["bucket"], r["column_name"]): (r["n"], r["leaf"]) for r in tree.collect()}


def table(spark):
    return spark.range(500).select("id", (F.col("id") % 7).alias("a"), F.when(F.col("id") % 5 != 0, F.concat(F.lit("t"), "id")).alias("b"))


def test_a_change_is_found_by_bucket_and_column(spark):
    df = table(spark)
    tree = hash_tree.hash_tree(df, ["id"], 16)
    changed = df.withColumn("b", F.when(F.col("id") == 123, F.lit("other")).otherwise(F.col("b")))
    damage = hash_tree.damaged(tree, hash_tree.hash_tree(changed, ["id"], 16)).collect()
    assert [r["column_name"] for r in damage] == ["b"]
    found = hash_tree.damaged_rows(changed, ["id"], hash_tree.damaged(tree, hash_tree.hash_tree(changed, ["id"], 16)), 16)
    ids = [r["id"] for r in found.collect()]
    assert 123 in ids and len(ids) < 100
    assert hash_tree.root(tree).first() != hash_tree.root(hash_tree.hash_tree(changed, ["id"], 16)).first()


def test_lost_rows_swapped_cells_and_nulls(spark):
    df = table(spark)
    tree = hash_tree.hash_tree(df, ["id"], 8)
    lost = hash_tree.damaged(tree, hash_tree.hash_tree(df.where("id <> 7"), ["id"], 8)).collect()
    assert {r["column_name"] for r in lost} == {"id", "a", "b"} and len({r["bucket"] for r in lost}) == 1
    assert all(r["stored_n"] == r["seen_n"] + 1 for r in lost)
    swapped = df.withColumn("a", F.when(F.col("id") == 1, 2).when(F.col("id") == 2, 1).otherwise(F.col("a")))
    assert {r["column_name"] for r in hash_tree.damaged(tree, hash_tree.hash_tree(swapped, ["id"], 8)).collect()} == {"a"}
    marked = df.withColumn("b", F.coalesce("b", F.lit("~")))
    assert {r["column_name"] for r in hash_tree.damaged(tree, hash_tree.hash_tree(marked, ["id"], 8)).collect()} == {"b"}


def test_order_and_parts_do_not_matter(spark):
    df = table(spark)
    tree = leaves(hash_tree.hash_tree(df, ["id"], 8))
    assert tree == leaves(hash_tree.hash_tree(df.repartition(7).orderBy(F.desc("a")), ["id"], 8))
    parts = [hash_tree.hash_tree(df.where(c), ["id"], 8) for c in ("a < 3", "a >= 3")]
    assert tree == leaves(hash_tree.merged(*parts))
    assert hash_tree.damaged(hash_tree.hash_tree(df, ["id"], 8), hash_tree.merged(*parts)).isEmpty()
    twice = hash_tree.hash_tree(df.union(df), ["id"], 8)
    assert hash_tree.damaged(hash_tree.hash_tree(df, ["id"], 8), twice).count() == 24
    assert hash_tree.root(hash_tree.hash_tree(df.limit(0), ["id"])).first()["n_columns"] == 0

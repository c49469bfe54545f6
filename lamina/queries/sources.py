"""Round trips through files, statistics and fingerprints."""

from __future__ import annotations

from pyspark.sql import functions as F

from lamina.queries.fixtures import LINE_KEYS, fixture, oracle, table
from lamina.queries.registry import query
from lamina.queries.stats import _rounded, long_metrics_sql, ROUND_SQL
from lamina.operators.stats import regression_metrics
from lamina.session import scratch_path
from lamina.sources import bundle, datasets, runs
from lamina.sources import hash_tree as hash_tree_of

KEYS = ", ".join(LINE_KEYS)


@query("scan_csv_roundtrip", oracle("numeric", f"SELECT {KEYS}, cat, x1, x2, x3, label, label > 5e4 AS big FROM src"))
def scan_csv_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "csv") + ".CSV"
    df = fixture(spark, sf_dir, "numeric").select(*LINE_KEYS, "cat", "x1", "x2", "x3", "label", (F.col("label") > 5e4).alias("big"))
    datasets.save(df, path)
    read, _ = datasets.load(spark, path)
    return read.withColumn("l_linenumber", F.col("l_linenumber").cast("int"))


@query("scan_parquet_roundtrip", oracle("numeric", f"""
SELECT {KEYS}, cat, x1, x2, label, (SELECT CAST(count(*) AS BIGINT) FROM src) AS sample_count FROM src"""))
def scan_parquet_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "table") + ".parquet"
    datasets.save(fixture(spark, sf_dir, "numeric").select(*LINE_KEYS, "cat", "x1", "x2", "label"), path, target_feature="label")
    read, metadata = datasets.load(spark, path)
    datasets.validate(read, metadata)
    return read.withColumn("sample_count", F.lit(metadata.first()["sample_count"]).cast("bigint"))


@query("dataset_stats", """
SELECT CAST(count(*) AS BIGINT) AS sample_count, CAST(11 AS INTEGER) AS feature_count, 'lineitem' AS source_path FROM lineitem""")
def dataset_stats(spark, sf_dir):
    from lamina.queries.fixtures import table

    return datasets.dataset_stats(table(spark, sf_dir, "lineitem"), "lineitem")


@query("dataset_fingerprint")
def dataset_fingerprint(spark, sf_dir):
    return datasets.dataset_fingerprint(fixture(spark, sf_dir, "numeric"))


@query("metric_table", oracle("numeric", long_metrics_sql("cat") + f"""
SELECT 'run-' || cat AS run_id, 'val' AS split, metric, {ROUND_SQL} AS value FROM l"""))
def metric_table(spark, sf_dir):
    """Reports of several runs appended to one table."""
    path = scratch_path(spark, "metrics")
    df = fixture(spark, sf_dir, "numeric").select("cat", "label", "prediction", F.lit("val").alias("split"))
    for cat in ("A", "N", "R"):
        runs.append_metrics(regression_metrics(df.filter(F.col("cat") == cat), ["split"]), f"run-{cat}", path)
    return _rounded(spark.read.parquet(path))


@query("bundle_load", oracle("tokens", """
SELECT row_id, CASE WHEN raw_text IN ('Unknown', 'nan; nan', 'None') THEN NULL ELSE raw_text END AS raw_text,
  CASE WHEN raw_numeric = 'nan' THEN NULL ELSE CAST(raw_numeric AS DOUBLE) END AS raw_numeric,
  CAST(raw_integer AS BIGINT) AS raw_integer FROM src"""))
def bundle_load(spark, sf_dir):
    folder = scratch_path(spark, "bundle")
    df = fixture(spark, sf_dir, "tokens").select("row_id", "raw_text", "raw_numeric", "raw_integer")
    datasets.save(df, f"{folder}/database.csv")
    datasets.save(fixture(spark, sf_dir, "catalog"), f"{folder}/catalog.csv")
    tokens = spark.createDataFrame([('{"Unknown": null, "nan; nan": null, "None": null, "nan": null}',)], "value string")
    tokens.coalesce(1).write.text(f"{folder}/nan_equivalents.json")
    fixture(spark, sf_dir, "section_json").select("value").write.text(f"{folder}/section_keys.json")
    return bundle.load_bundle(spark, folder).table


PART_COLUMNS = ["p_partkey", "p_name", "p_brand", "p_type", "p_size"]
PART_CELLS = ", ".join(
    f"{{'column_name': '{c}', 'cell': coalesce(concat(CAST(length(CAST({c} AS VARCHAR)) AS VARCHAR), ':', CAST({c} AS VARCHAR)), '~')}}" for c in PART_COLUMNS
)
TREE_SQL = f"""WITH cells AS (SELECT CAST(p_partkey AS VARCHAR) AS k, unnest([{PART_CELLS}]) AS e FROM part)
, hashed AS (SELECT CAST(CAST(concat('0x', substr(md5(concat('bucket|', k)), 1, 13)) AS BIGINT) % 256 AS INTEGER) AS bucket, e.column_name AS column_name,
  CAST(concat('0x', substr(md5(concat(k, '|', e.column_name, '|', e.cell)), 1, 13)) AS BIGINT) AS h FROM cells)
, tree AS (SELECT bucket, column_name, count(*) AS n, CAST(sum(h) AS VARCHAR) AS leaf FROM hashed GROUP BY bucket, column_name)
"""


def _part_tree(spark, sf_dir):
    return hash_tree_of.hash_tree(table(spark, sf_dir, "part").select(*PART_COLUMNS), ["p_partkey"])


@query("hash_tree", TREE_SQL + "SELECT bucket, column_name, n, leaf FROM tree")
def hash_tree(spark, sf_dir):
    return _part_tree(spark, sf_dir).withColumn("leaf", F.col("leaf").cast("string"))


@query("hash_tree_root", TREE_SQL + """, nodes AS (SELECT column_name, sha256(string_agg(concat(bucket, ':', n, ':', leaf), ',' ORDER BY bucket)) AS leaf_hash FROM tree GROUP BY column_name)
SELECT count(*) AS n_columns, sha256(string_agg(concat(column_name, ':', leaf_hash), ',' ORDER BY concat(column_name, ':', leaf_hash))) AS root FROM nodes""")
def hash_tree_root(spark, sf_dir):
    return hash_tree_of.root(_part_tree(spark, sf_dir))


@query("hash_tree_damage", TREE_SQL + """
, hit AS (SELECT DISTINCT CAST(CAST(concat('0x', substr(md5(concat('bucket|', p_partkey)), 1, 13)) AS BIGINT) % 256 AS INTEGER) AS bucket FROM part WHERE p_size = 7 AND p_partkey % 10 = 0)
SELECT bucket, column_name, n AS stored_n, n AS seen_n FROM tree JOIN hit USING (bucket) WHERE column_name = 'p_size'""")
def hash_tree_damage(spark, sf_dir):
    """Some sizes change; the buckets that hold them are found, in that column alone."""
    part = table(spark, sf_dir, "part").select(*PART_COLUMNS)
    changed = part.withColumn("p_size", F.when((F.col("p_size") == 7) & (F.col("p_partkey") % 10 == 0), -7).otherwise(F.col("p_size")))
    return hash_tree_of.damaged(_part_tree(spark, sf_dir), hash_tree_of.hash_tree(changed, ["p_partkey"]))

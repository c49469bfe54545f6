"""Row filters, projections and type conversion."""

from __future__ import annotations

from pyspark.sql import functions as F

from lamina.functions.composition import ALLOWED_FORMULA
from lamina.functions.text import NULL_TOKENS
from lamina.operators import rows
from lamina.operators.prune import section_fields
from lamina.operators.layers import pattern_fields
from lamina.operators.stats import density_filter, null_counts
from lamina.queries.fixtures import fixture, oracle
from lamina.queries.registry import query
from lamina.sources.bundle import section_rows

TOKENS_SQL = ", ".join(f"'{t}'" for t in NULL_TOKENS)
NUMBER_SQL = r"'\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?)\s*'"


def number_sql(c: str) -> str:
    return f"CASE WHEN regexp_full_match({c}, {NUMBER_SQL}) THEN try_cast(trim({c}) AS DOUBLE) END"


@query("null_token_normalise", oracle("tokens", f"""
SELECT row_id, CASE WHEN raw_text IN ({TOKENS_SQL}) THEN NULL ELSE raw_text END AS raw_text,
  CASE WHEN raw_numeric IN ({TOKENS_SQL}) THEN NULL ELSE raw_numeric END AS raw_numeric,
  raw_integer, raw_mixed FROM src"""))
def null_token_normalise(spark, sf_dir):
    return rows.normalise_nulls(fixture(spark, sf_dir, "tokens"))


@query("numeric_promotion", oracle("tokens", f"""
SELECT row_id, CASE WHEN raw_text IN ({TOKENS_SQL}) THEN NULL ELSE raw_text END AS raw_text,
  CASE WHEN raw_numeric = 'nan' THEN NULL ELSE CAST(raw_numeric AS DOUBLE) END AS raw_numeric,
  CAST(raw_integer AS BIGINT) AS raw_integer, raw_mixed FROM src"""))
def numeric_promotion(spark, sf_dir):
    return rows.promote_numeric(rows.normalise_nulls(fixture(spark, sf_dir, "tokens")))


@query("numeric_coerce", oracle("tokens", f"""
SELECT row_id, {number_sql('raw_text')} AS raw_text, {number_sql('raw_numeric')} AS raw_numeric,
  {number_sql('raw_mixed')} AS raw_mixed FROM src"""))
def numeric_coerce(spark, sf_dir):
    df = fixture(spark, sf_dir, "tokens").drop("raw_integer")
    return rows.coerce_numeric(df, "raw_text", "raw_numeric", "raw_mixed")


@query("null_counts", oracle("tokens", f""", n AS (
SELECT count(*) - count(CASE WHEN raw_text IN ({TOKENS_SQL}) THEN NULL ELSE raw_text END) AS t,
  count(*) - count(CASE WHEN raw_numeric IN ({TOKENS_SQL}) THEN NULL ELSE raw_numeric END) AS n,
  count(*) - count(raw_integer) AS i FROM src)
SELECT 'raw_text' AS column_name, CAST(t AS BIGINT) AS nulls FROM n
UNION ALL SELECT 'raw_numeric', CAST(n AS BIGINT) FROM n UNION ALL SELECT 'raw_integer', CAST(i AS BIGINT) FROM n"""))
def null_counts_query(spark, sf_dir):
    df = rows.normalise_nulls(fixture(spark, sf_dir, "tokens"))
    return null_counts(df, ["raw_text", "raw_numeric", "raw_integer"])


@query("density_filter", oracle("tokens", f"""
SELECT row_id, CASE WHEN raw_numeric IN ({TOKENS_SQL}) THEN NULL ELSE raw_numeric END AS raw_numeric,
  raw_integer, raw_mixed FROM src"""))
def density_filter_query(spark, sf_dir):
    # raw_text is present in 3 of 7 rows, raw_numeric in 4 of 5
    df = rows.normalise_nulls(fixture(spark, sf_dir, "tokens"))
    return density_filter(df, 0.75, keep=["row_id"])


@query("quality_filter", oracle("compounds", """
SELECT row_id, long_form, band_gap FROM src
WHERE band_gap IS NOT NULL AND abc3 IS NOT NULL AND a_ions IS NOT NULL AND c_ions IS NOT NULL AND dimension_3d AND abc3"""))
def quality_filter(spark, sf_dir):
    df = rows.drop_null_rows(fixture(spark, sf_dir, "compounds"), ["band_gap", "abc3"])
    df = rows.drop_null_rows(rows.keep_true(df, "dimension_3d", "abc3"))
    return rows.project(df, ["row_id", "long_form", "band_gap"])


@query("multi_layer_filter", oracle("compounds", """
, m AS (SELECT count(*) FILTER (WHERE contains(long_form, '|')) AS n FROM src)
SELECT row_id, long_form, CAST(m.n AS BIGINT) AS multi_layer_rows FROM src, m WHERE NOT contains(long_form, '|')"""))
def multi_layer_filter(spark, sf_dir):
    df = fixture(spark, sf_dir, "compounds")
    marked = df.agg(F.count_if(rows.is_multi_layer("long_form")).alias("n")).first()["n"]
    return rows.single_layer(df, "long_form").select("row_id", "long_form", F.lit(marked).cast("bigint").alias("multi_layer_rows"))


@query("ion_list_filter", oracle("compounds", """
SELECT row_id, a_ions, a_coeff FROM src WHERE a_ions IS NOT NULL AND NOT contains(a_ions, 'nan')"""))
def ion_list_filter(spark, sf_dir):
    df = fixture(spark, sf_dir, "compounds").select("row_id", "a_ions", "a_coeff")
    return rows.exclude_containing(df, "a_ions", "nan")


@query("formula_allowlist", oracle("compounds", rf"""
, t AS (SELECT row_id, coalesce(CASE WHEN abc3 THEN long_form END, 'nan') AS long_form FROM src)
SELECT row_id, long_form FROM t WHERE regexp_matches(long_form, '{ALLOWED_FORMULA}')"""))
def formula_allowlist(spark, sf_dir):
    df = fixture(spark, sf_dir, "compounds").withColumn("long_form", F.when(F.col("abc3"), F.col("long_form")))
    text = df.select("row_id", rows.text_or_nan("long_form").alias("long_form"))
    return rows.allowed_formulas(text, "long_form")


@query("target_split", oracle("numeric", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, x2, x3, x1 AS label FROM src WHERE x1 IS NOT NULL"""))
def target_split(spark, sf_dir):
    df = rows.drop_columns(
        fixture(spark, sf_dir, "numeric"), ["label", "prediction", "fold", "cat", "l_shipdate", "absent"]
    )
    return rows.split_target(df, "x1")


@query("pattern_fields", oracle("catalog", r"""
, f AS (SELECT *, coalesce(regexp_matches(Pattern, '>>|;|\|'), false) AND NOT contains(Field, 'concentrations') AS layered FROM src)
SELECT section, Field, Pattern, layered FROM f WHERE section IN ('ECONOMY', 'SMALL', 'PROMO')"""))
def pattern_fields_query(spark, sf_dir):
    layered, plain = pattern_fields(fixture(spark, sf_dir, "catalog"), ["ECONOMY", "SMALL", "PROMO"])
    return layered.withColumn("layered", F.lit(True)).unionByName(plain.withColumn("layered", F.lit(False)))


@query("section_fields", """
SELECT p_brand AS section, concat(p_type, '_', cast(p_partkey AS varchar)) AS field FROM part WHERE p_brand IN ('Brand#2', 'Brand#17', 'Brand#4')
UNION ALL SELECT p_brand, concat('size_', cast(p_size AS varchar)) FROM part WHERE p_brand IN ('Brand#2', 'Brand#17', 'Brand#4')""")
def section_fields_query(spark, sf_dir):
    return section_fields(section_rows(fixture(spark, sf_dir, "section_json")), ["Brand#2", "Brand#17", "Brand#4"])

"""Imputation, encoding and scaling."""

from __future__ import annotations

from pyspark.sql import functions as F

from lamina.operators import target_stats, transform
from lamina.queries.fixtures import LINE_KEYS, fixture, oracle, table
from lamina.queries.registry import query
from lamina.queries.splits import TEXT_KEY, hash_sql

KEYS = ", ".join(LINE_KEYS)


def _numeric(spark, sf_dir, *columns):
    return fixture(spark, sf_dir, "numeric").select(*LINE_KEYS, *columns)


def _rounded(df, columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


def impute_sql(expression: str) -> str:
    return oracle("numeric", f"""
, p AS (SELECT {expression.format(c='x1')} AS p1, {expression.format(c='x2')} AS p2 FROM src)
SELECT {KEYS}, round(coalesce(x1, p1), 6) AS x1, round(coalesce(x2, p2), 6) AS x2 FROM src, p""")


def _impute(spark, sf_dir, strategy, **options):
    df = _numeric(spark, sf_dir, "x1", "x2")
    return _rounded(transform.apply_impute(df, transform.fit_impute(df, ["x1", "x2"], strategy, **options)), ["x1", "x2"])


@query("impute_simple", impute_sql("avg({c})"))
def impute_mean(spark, sf_dir):
    return _impute(spark, sf_dir, "mean")


@query("impute_median", impute_sql("quantile_cont({c}, 0.5)"))
def impute_median(spark, sf_dir):
    return _impute(spark, sf_dir, "median")


@query("impute_most_frequent", impute_sql(
    "(SELECT v FROM (SELECT {c} AS v, count(*) AS n FROM src WHERE {c} IS NOT NULL GROUP BY {c}) ORDER BY n DESC, v LIMIT 1)"
).replace(" FROM src)\nSELECT l_orderkey", ")\nSELECT l_orderkey"))
def impute_most_frequent(spark, sf_dir):
    return _impute(spark, sf_dir, "most_frequent")


@query("impute_constant", impute_sql("any_value(-1.5e0)"))
def impute_constant(spark, sf_dir):
    return _impute(spark, sf_dir, "constant", fill_value=-1.5)


# All coordinates, two of them with gaps.
COORDINATES = [f"f{i}" for i in range(64)]
VECTORS_SQL = """SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN NULL ELSE CAST(embedding[1] AS DOUBLE) END AS f0,
  CASE WHEN vec_id % 5 = 1 THEN NULL ELSE CAST(embedding[2] AS DOUBLE) END AS f1,
  """ + ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS f{i}" for i in range(2, 64)) + " FROM embeddings"


def knn_fill_sql(c: str, donors: str = "true", receivers: str = "true") -> str:
    def part(f: str, out: str) -> str:
        return f"CASE WHEN q.{f} IS NULL OR d.{f} IS NULL THEN {out} ELSE "

    total = " + ".join(f"{part(f, '0.0e0')}(q.{f} - d.{f}) * (q.{f} - d.{f}) END" for f in COORDINATES)
    shared = " + ".join(f"{part(f, '0')}1 END" for f in COORDINATES)
    return f"""
, r_{c} AS (SELECT q.vec_id, d.{c} AS v, row_number() OVER (PARTITION BY q.vec_id ORDER BY ({total}) * (64.0e0 / ({shared})), d.vec_id) AS rn
  FROM v q JOIN v d ON q.{c} IS NULL AND d.{c} IS NOT NULL AND {donors} AND {receivers})
, fill_{c} AS (SELECT vec_id, avg(v) AS fill FROM r_{c} WHERE rn <= 5 GROUP BY vec_id)"""


FILLED_SQL = "SELECT v.vec_id, round(coalesce(f0, a.fill), 6) AS f0, round(coalesce(f1, b.fill), 6) AS f1, " + ", ".join(
    f"round({c}, 6) AS {c}" for c in COORDINATES[2:]
) + " FROM v LEFT JOIN fill_f0 a ON v.vec_id = a.vec_id LEFT JOIN fill_f1 b ON v.vec_id = b.vec_id"


def _gappy_vectors(spark, sf_dir):
    cells = [F.get("embedding", F.lit(i)).cast("double") for i in range(64)]
    cells[0] = F.when(F.col("vec_id") % 7 != 0, cells[0])
    cells[1] = F.when(F.col("vec_id") % 5 != 1, cells[1])
    return table(spark, sf_dir, "embeddings").select("vec_id", *[c.alias(n) for c, n in zip(cells, COORDINATES)])


@query("impute_knn", f"WITH v AS ({VECTORS_SQL}){knn_fill_sql('f0')}{knn_fill_sql('f1')}\n{FILLED_SQL}")
def impute_knn(spark, sf_dir):
    return _rounded(transform.impute_knn(_gappy_vectors(spark, sf_dir), COORDINATES, "vec_id"), COORDINATES)


TRAIN_ONLY = ("d.vec_id % 3 <> 0", "q.vec_id % 3 = 0")


@query(
    "impute_knn_train_only",
    f"WITH v AS ({VECTORS_SQL}){knn_fill_sql('f0', *TRAIN_ONLY)}{knn_fill_sql('f1', *TRAIN_ONLY)}\n{FILLED_SQL} WHERE v.vec_id % 3 = 0",
)
def impute_knn_train_only(spark, sf_dir):
    """Donors are the training rows alone; the other rows are filled from them."""
    df = _gappy_vectors(spark, sf_dir)
    fitted = transform.fit_impute_knn(df.filter("vec_id % 3 <> 0"), COORDINATES, row_id="vec_id")
    return _rounded(transform.apply_impute_knn(df.filter("vec_id % 3 = 0"), fitted, "vec_id"), COORDINATES)


def scale_sql(shift: str, divisor: str) -> str:
    return oracle("numeric", f"""
, p AS (SELECT {", ".join(f"{shift.format(c=c)} AS s_{c}, {divisor.format(c=c)} AS d_{c}" for c in ("x1", "x2", "x3"))} FROM src)
SELECT {KEYS}, {", ".join(f"round(({c} - s_{c}) / (CASE WHEN d_{c} = 0 THEN 1.0e0 ELSE d_{c} END), 6) AS {c}" for c in ("x1", "x2", "x3"))} FROM src, p""")


def _scale(spark, sf_dir, method):
    columns = ["x1", "x2", "x3"]
    df = _numeric(spark, sf_dir, *columns)
    return _rounded(transform.apply_scale(df, transform.fit_scale(df, columns, method)), columns)


@query("scale_standard", scale_sql("avg({c})", "stddev_pop({c})"))
def scale_standard(spark, sf_dir):
    return _scale(spark, sf_dir, "standard")


@query("scale_minmax", scale_sql("min({c})", "(max({c}) - min({c}))"))
def scale_minmax(spark, sf_dir):
    return _scale(spark, sf_dir, "minmax")


@query("scale_robust", scale_sql("quantile_cont({c}, 0.5)", "(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25))"))
def scale_robust(spark, sf_dir):
    return _scale(spark, sf_dir, "robust")


NORM_SQL = "sqrt(x3 * x3 + label * label + prediction * prediction)"


@query("scale_row_norm", oracle("numeric", f"""
SELECT {KEYS}, """ + ", ".join(
    f"round({c} / (CASE WHEN {NORM_SQL} = 0 THEN 1.0e0 ELSE {NORM_SQL} END), 9) AS {c}" for c in ("x3", "label", "prediction")) + " FROM src"))
def scale_row_norm(spark, sf_dir):
    columns = ["x3", "label", "prediction"]
    return _rounded(transform.normalise_rows(_numeric(spark, sf_dir, *columns), columns), columns, 9)


@query("encode_onehot", oracle("numeric", f"""
SELECT {KEYS}, {", ".join(f"CAST(CASE WHEN cat = '{v}' THEN 1 ELSE 0 END AS DOUBLE) AS cat_{v}" for v in "ANR")} FROM src"""))
def encode_onehot(spark, sf_dir):
    df = _numeric(spark, sf_dir, "cat")
    return transform.apply_onehot(df, "cat", transform.fit_onehot(df, "cat"))


@query("encode_ordinal", oracle("numeric", f"""
, kept AS (SELECT DISTINCT cat FROM src WHERE cat <> 'N')
, codes AS (SELECT cat, CAST(row_number() OVER (ORDER BY cat) - 1 AS DOUBLE) AS code FROM kept)
SELECT {KEYS}, CASE WHEN l_linenumber = 1 THEN NULL ELSE coalesce(code, -1.0e0) END AS cat FROM src LEFT JOIN codes USING (cat)"""))
def encode_ordinal(spark, sf_dir):
    df = _numeric(spark, sf_dir, "cat")
    # Codes from rows without N, applied where N is unknown and the first lines are null.
    codes = transform.fit_ordinal(df.filter("cat <> 'N'"), "cat")
    gaps = df.withColumn("cat", F.when(F.col("l_linenumber") != 1, F.col("cat")))
    return transform.apply_ordinal(gaps, "cat", codes, "use_encoded_value", -1)


@query("encode_ordinal_parts", f"""
WITH codes AS (SELECT p_name, CAST(dense_rank() OVER (ORDER BY p_name) - 1 AS DOUBLE) AS code, p_partkey FROM part)
SELECT {KEYS}, code AS p_name FROM lineitem JOIN codes ON l_partkey = p_partkey""")
def encode_ordinal_parts(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(*LINE_KEYS)
    named = lines.join(table(spark, sf_dir, "part").select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
    df = named.select(*LINE_KEYS, "p_name")
    return transform.apply_ordinal(df, "p_name", transform.fit_ordinal(df, "p_name"))


@query("transform_by_dtype", oracle("numeric", f"""
, p AS (SELECT avg(x1) AS m1, avg(x3) AS s3, stddev_pop(x3) AS d3 FROM src)
, q AS (SELECT avg(coalesce(x1, m1)) AS s1, stddev_pop(coalesce(x1, m1)) AS d1 FROM src, p)
, codes AS (SELECT cat, CAST(row_number() OVER (ORDER BY cat) - 1 AS DOUBLE) AS code FROM (SELECT DISTINCT cat FROM src))
, big AS (SELECT big, CAST(row_number() OVER (ORDER BY big) - 1 AS DOUBLE) AS bcode FROM (SELECT DISTINCT label > 5e4 AS big FROM src))
SELECT {KEYS}, round((coalesce(x1, m1) - s1) / d1, 6) AS x1, round((x3 - s3) / d3, 6) AS x3, code AS cat, bcode AS big
FROM src JOIN codes USING (cat) JOIN big ON (label > 5e4) = big, p, q"""))
def transform_by_dtype(spark, sf_dir):
    # The timestamp is neither numeric nor categorical and drops out.
    df = fixture(spark, sf_dir, "numeric").select(*LINE_KEYS, "x1", "x3", "cat", (F.col("label") > 5e4).alias("big"), "l_shipdate")
    result, _ = transform.fit_pipeline(
        df,
        numerical=[{"type": "impute", "method": "simple", "strategy": "mean"}, {"type": "scale", "method": "standard"}],
        categorical=[{"type": "encode", "method": "ordinal"}],
        exclude=LINE_KEYS,
    )
    return _rounded(result, ["x1", "x3"])


@query("encode_ordered_target", oracle("numeric", f"""
, r AS (SELECT *, {hash_sql('42')} AS h, {TEXT_KEY} AS k, avg(prediction) OVER () AS m FROM src)
SELECT {KEYS}, round((coalesce(sum(prediction) OVER w, 0.0e0) + m) / (count(*) OVER w + 1.0e0), 6) AS cat FROM r
WINDOW w AS (PARTITION BY cat ORDER BY h, k, prediction ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""))
def encode_ordered_target(spark, sf_dir):
    df = _numeric(spark, sf_dir, "cat", "prediction")
    encoded, _ = target_stats.ordered_target_statistics(df, ["cat"], "prediction", LINE_KEYS, chunk_rows=5000)
    return encoded.select(*LINE_KEYS, F.round("cat", 6).alias("cat"))


@query("apply_target_statistics", oracle("numeric", f"""
, m AS (SELECT avg(prediction) AS m FROM src WHERE fold <> 0)
, t AS (SELECT cat, sum(prediction) AS total, count(*) AS n FROM src WHERE fold <> 0 GROUP BY cat)
SELECT {KEYS}, round((coalesce(total, 0.0e0) + m) / (coalesce(n, 0) + 1.0e0), 6) AS cat FROM src LEFT JOIN t USING (cat), m WHERE fold = 0"""))
def apply_target_statistics(spark, sf_dir):
    df = _numeric(spark, sf_dir, "cat", "prediction", "fold")
    _, fitted = target_stats.ordered_target_statistics(df.where("fold <> 0"), ["cat"], "prediction", LINE_KEYS)
    coded = target_stats.apply_target_statistics(df.where("fold = 0"), fitted)
    return coded.select(*LINE_KEYS, F.round("cat", 6).alias("cat"))

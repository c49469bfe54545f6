"""Composition tables, ion counts and correlation."""

from __future__ import annotations

from pyspark.sql import functions as F

from lamina.functions.composition import (
    ALLOWED_FORMULA, FORMULA_PART, SITE_RANGES, SITE_SUMS, SITES, SYMBOLS, formula_map,
)
from lamina.operators import composition as comp
from lamina.operators import rows, stats
from lamina.queries.fixtures import fixture, oracle
from lamina.queries.registry import query
from lamina.queries.rows import number_sql

FLAGS = ["abc3", "dimension_3d"]
CLEAN_SQL = "long_form IS NOT NULL AND abc3 IS NOT NULL AND dimension_3d IS NOT NULL AND dimension_3d AND abc3 AND NOT contains(long_form, '|')"


def mode_sql(source: str, key: str, value: str, name: str) -> str:
    """CTE text: most frequent value per key, smallest on ties, null when there is none."""
    return f"""{name}_n AS (SELECT {key}, {value}, count({value}) AS n FROM {source} WHERE {key} IS NOT NULL GROUP BY {key}, {value})
, {name} AS (SELECT {key}, {value} FROM {name}_n QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY n DESC, {value}) = 1)"""


def symbol_sql(symbol: str) -> str:
    names = f"regexp_extract_all(compound, '{FORMULA_PART}', 1)"
    parts = f"regexp_extract_all(compound, '{FORMULA_PART}', 2)"
    last = f"([{parts}[i] FOR i IN range(1, len({names}) + 1) IF {names}[i] = '{symbol}'])[-1]"
    return f"coalesce(CASE WHEN {last} = '' THEN 1.0e0 ELSE try_cast({last} AS DOUBLE) END, 0.0e0) AS \"{symbol}\""


FORMULA_SQL = f"""
, clean AS (SELECT long_form, {number_sql('band_gap')} AS gap FROM src WHERE band_gap IS NOT NULL AND {CLEAN_SQL})
, {mode_sql('clean', 'long_form', 'gap', 'm')}
, formulas AS (SELECT long_form AS compound, gap AS E_g FROM m WHERE regexp_matches(long_form, '{ALLOWED_FORMULA}'))
, parsed AS (SELECT compound, E_g, {', '.join(symbol_sql(s) for s in SYMBOLS)} FROM formulas)
, summed AS (SELECT *, Cs + FA + MA AS a, Pb + Sn AS b, I + Br AS c FROM parsed)"""
VALID_SQL = " AND ".join(f"{s} BETWEEN {lo}e0 AND {hi}e0" for s, (lo, hi) in SITE_RANGES.items())
SYMBOLS_SQL = ", ".join(SYMBOLS)


def _formulas(spark, sf_dir):
    return comp.formula_route(fixture(spark, sf_dir, "compounds"), "long_form", "band_gap", FLAGS)


@query("composition_formula", oracle("compounds", FORMULA_SQL + f"\nSELECT compound, E_g, {SYMBOLS_SQL} FROM parsed"))
def composition_formula(spark, sf_dir):
    return _formulas(spark, sf_dir)


@query("formula_symbols", oracle("compounds", f"""
, named AS (SELECT row_id, long_form AS compound FROM src)
, w AS (SELECT row_id, {', '.join(symbol_sql(s) for s in SYMBOLS)} FROM named)
, u AS (UNPIVOT w ON {SYMBOLS_SQL} INTO NAME symbol VALUE fraction)
SELECT symbol, CAST(count(*) AS BIGINT) AS formulas, round(sum(fraction), 6) AS total FROM u WHERE fraction > 0 GROUP BY symbol"""))
def formula_symbols(spark, sf_dir):
    df = fixture(spark, sf_dir, "compounds")
    entries = df.select(F.explode(formula_map(F.col("long_form"))).alias("symbol", "fraction"))
    return entries.groupBy("symbol").agg(F.count(F.lit(1)).alias("formulas"), F.round(F.sum("fraction"), 6).alias("total"))


@query("tolerance_filter", oracle("compounds", FORMULA_SQL + f"\nSELECT E_g, {SYMBOLS_SQL} FROM summed WHERE {VALID_SQL}"))
def tolerance_filter(spark, sf_dir):
    return comp.valid_compositions(_formulas(spark, sf_dir)).select("E_g", *SYMBOLS)


@query("stoichiometry_counts", oracle("compounds", FORMULA_SQL + "\n" + " UNION ALL ".join(
    f"SELECT '{s}' AS site, CAST(count(*) FILTER (WHERE {s} = {v}e0) AS BIGINT) AS valid, CAST(count(*) FILTER (WHERE {s} <> {v}e0) AS BIGINT) AS invalid FROM summed"
    for s, v in SITE_SUMS.items())))
def stoichiometry_counts(spark, sf_dir):
    return stats.count_exact(_formulas(spark, sf_dir), comp.site_sums(), SITE_SUMS)


@query("stoichiometry_audit", oracle("compounds", FORMULA_SQL + f"\nSELECT compound, E_g, {SYMBOLS_SQL} FROM summed WHERE "
       + " OR ".join(f"{s} <> {v}e0" for s, v in SITE_SUMS.items())))
def stoichiometry_audit(spark, sf_dir):
    return rows.off_stoichiometry(_formulas(spark, sf_dir), comp.site_sums())


@query("composition_normalised", oracle("compounds", FORMULA_SQL + f"""
SELECT E_g, Cs, FA, MA, Pb, Sn, round(I / c, 9) AS I, round(Br / c, 9) AS Br FROM summed WHERE {VALID_SQL}"""))
def composition_normalised(spark, sf_dir):
    valid = comp.valid_compositions(_formulas(spark, sf_dir)).select("E_g", *SYMBOLS)
    df = comp.normalise_group(valid, list(SITES["c"]))
    return df.withColumns({c: F.round(c, 9) for c in SITES["c"]})


def corr_sql(source: str, columns) -> str:
    parts = [
        f"SELECT '{x}' AS x, '{y}' AS y, round(CASE WHEN count(CASE WHEN {x} IS NOT NULL AND {y} IS NOT NULL THEN 1 END) > 0 "
        f"THEN corr({y}, {x}) END, 6) AS r FROM {source}" for x in columns for y in columns
    ]
    return " UNION ALL ".join(parts)


@query("corr_matrix", oracle("numeric", "\n" + corr_sql("src", ["x1", "x2", "x3", "label", "prediction"])))
def corr_matrix(spark, sf_dir):
    columns = ["x1", "x2", "x3", "label", "prediction"]
    table = stats.corr_matrix(fixture(spark, sf_dir, "numeric").select(*columns), columns)
    return table.withColumn("r", F.round("r", 6))


@query("composition_corr", oracle("compounds", FORMULA_SQL + f"""
, valid AS (SELECT E_g, {SYMBOLS_SQL} FROM summed WHERE {VALID_SQL})
, r AS ({corr_sql('valid', ['E_g', *SYMBOLS])})
SELECT x, y, CASE WHEN r IS NULL OR isnan(r) THEN NULL ELSE r END AS r FROM r"""))
def composition_corr(spark, sf_dir):
    valid = comp.valid_compositions(_formulas(spark, sf_dir))
    table = stats.corr_matrix(valid, ["E_g", *SYMBOLS])
    return table.withColumn("r", F.round(F.nanvl("r", F.lit(None).cast("double")), 6))


# -- ion lists -------------------------------------------------------------------


def ion_sql(site: str, ion: str) -> str:
    names = f"string_split(replace({site}_ions, ' ', ''), ';')"
    parts = f"string_split(replace({site}_coeff, ' ', ''), ';')"
    found = f"[i FOR i IN range(1, least(len({names}), len({parts})) + 1) IF {names}[i] = '{ion}']"
    return (f"CASE WHEN len({found}) = 0 THEN 0.0e0 ELSE coalesce(try_cast({parts}[({found})[-1]] AS DOUBLE), 0.0e0) END AS {site}_{ion}")


ION_COLUMNS = [f"{s}_{n}" for s, names in SITES.items() for n in names]
IONS_SQL = f"""
, clean AS (SELECT long_form AS compound, band_gap AS E_g, a_ions, a_coeff, b_ions, b_coeff, c_ions, c_coeff FROM src WHERE {CLEAN_SQL})
, lists AS (SELECT * REPLACE ({number_sql('E_g')} AS E_g) FROM clean WHERE E_g IS NOT NULL AND a_ions IS NOT NULL AND a_coeff IS NOT NULL
  AND b_ions IS NOT NULL AND b_coeff IS NOT NULL AND c_ions IS NOT NULL AND c_coeff IS NOT NULL AND NOT contains(a_ions, 'nan'))
, ions AS (SELECT compound, E_g, {', '.join(ion_sql(s, n) for s, names in SITES.items() for n in names)} FROM lists)"""
ION_MODES_SQL = IONS_SQL + "".join(
    f"\n, {mode_sql('ions', 'compound', c, 'm_' + c)}" for c in ["E_g", *ION_COLUMNS]
) + "\n, modes AS (SELECT * FROM m_E_g " + " ".join(f"JOIN m_{c} USING (compound)" for c in ION_COLUMNS) + """)
, summed AS (SELECT *, a_Cs + a_FA + a_MA AS a, b_Pb + b_Sn AS b, c_I + c_Br AS c FROM modes)"""


def _cleaned_lists(spark, sf_dir):
    df = comp.clean_composition(fixture(spark, sf_dir, "compounds"), "long_form", FLAGS)
    return df.withColumnsRenamed({"long_form": "compound", "band_gap": "E_g"})


def _parsed_lists(spark, sf_dir):
    columns = ["compound", "E_g", *[f"{s}_{p}" for s in "abc" for p in ("ions", "coeff")]]
    df = rows.coerce_numeric(comp.clean_ions(_cleaned_lists(spark, sf_dir), columns), "E_g")
    return comp.ion_composition(df, SITES)


@query("composition_ions", oracle("compounds", IONS_SQL + "\nSELECT * FROM ions"))
def composition_ions(spark, sf_dir):
    return _parsed_lists(spark, sf_dir)


def long_site_sql(site: str) -> str:
    return f"""SELECT row_id, '{site}' AS site, n[i] AS ion, coalesce(try_cast(c[i] AS DOUBLE), 0.0e0) AS coeff
FROM (SELECT row_id, n, c, unnest(range(1, least(len(n), len(c)) + 1)) AS i FROM
  (SELECT row_id, string_split(replace({site}_ions, ' ', ''), ';') AS n, string_split(replace({site}_coeff, ' ', ''), ';') AS c FROM src
   WHERE {site}_ions IS NOT NULL AND {site}_coeff IS NOT NULL))"""


@query("composition_long", oracle("compounds", "\n" + "\nUNION ALL ".join(long_site_sql(s) for s in "abc")))
def composition_long(spark, sf_dir):
    return comp.ion_long(fixture(spark, sf_dir, "compounds"), ["row_id"])


@query("group_mode_all", oracle("compounds", ION_MODES_SQL + f"\nSELECT compound, E_g, {', '.join(ION_COLUMNS)} FROM modes"))
def group_mode_all(spark, sf_dir):
    return comp.ion_route(_cleaned_lists(spark, sf_dir))


@query("composition_ions_normalised", oracle("compounds", ION_MODES_SQL + f"""
SELECT E_g, a_Cs AS Cs, a_FA AS FA, a_MA AS MA, b_Pb AS Pb, b_Sn AS Sn, round(c_I / c, 9) AS I, round(c_Br / c, 9) AS Br
FROM summed WHERE {VALID_SQL}"""))
def composition_ions_normalised(spark, sf_dir):
    valid = comp.valid_compositions(comp.ion_route(_cleaned_lists(spark, sf_dir)), prefix=True)
    df = comp.normalise_group(valid, ["c_I", "c_Br"])
    return comp.plain_names(df.drop("compound")).withColumns({c: F.round(c, 9) for c in SITES["c"]})


@query("group_mode", oracle("compounds", f"""
, g AS (SELECT long_form, {number_sql('band_gap')} AS gap FROM src)
, {mode_sql('g', 'long_form', 'gap', 'm')}
SELECT long_form, gap FROM m"""))
def group_mode(spark, sf_dir):
    df = rows.coerce_numeric(fixture(spark, sf_dir, "compounds").select("long_form", F.col("band_gap").alias("gap")), "gap")
    return stats.group_mode(df, "long_form", ["gap"])


@query("group_mode_lines", """
WITH n AS (SELECT l_suppkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL)
, q AS (SELECT l_suppkey, l_quantity, count(*) AS n FROM lineitem GROUP BY ALL)
, s AS (SELECT l_suppkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL)
, n1 AS (SELECT l_suppkey, l_linenumber FROM n QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, l_linenumber) = 1)
, q1 AS (SELECT l_suppkey, l_quantity FROM q QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, l_quantity) = 1)
, s1 AS (SELECT l_suppkey, l_returnflag FROM s QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, l_returnflag) = 1)
SELECT * FROM n1 JOIN q1 USING (l_suppkey) JOIN s1 USING (l_suppkey)""")
def group_mode_lines(spark, sf_dir):
    from lamina.queries.fixtures import table

    df = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_linenumber", "l_quantity", "l_returnflag")
    return stats.group_mode(df, "l_suppkey")


@query("group_mean", oracle("compounds", f"""
SELECT long_form, round(avg({number_sql('band_gap')}), 6) AS gap FROM src WHERE long_form IS NOT NULL GROUP BY long_form"""))
def group_mean(spark, sf_dir):
    df = rows.coerce_numeric(fixture(spark, sf_dir, "compounds").select("long_form", F.col("band_gap").alias("gap")), "gap")
    return stats.group_mean(df, "long_form", "gap").withColumn("gap", F.round("gap", 6))


def exploded_sql(*columns: str) -> str:
    return " UNION ALL ".join(
        rf"SELECT unnest(string_split(regexp_replace({c}, '[()\s]', '', 'g'), ';')) AS ion FROM src" for c in columns
    )


@query("ion_counts", oracle("compounds", f"""
, e AS ({exploded_sql('a_ions')})
SELECT ion AS value, CAST(count(*) AS BIGINT) AS n FROM e WHERE ion IS NOT NULL GROUP BY ion"""))
def ion_counts(spark, sf_dir):
    return stats.value_counts(comp.explode_ions(fixture(spark, sf_dir, "compounds"), "a_ions"), "ion")


@query("ion_counts_all", oracle("compounds", f"""
, e AS ({exploded_sql('a_ions', 'b_ions', 'c_ions')})
SELECT ion AS value, CAST(count(*) AS BIGINT) AS n FROM e WHERE ion IS NOT NULL GROUP BY ion"""))
def ion_counts_all(spark, sf_dir):
    df = comp.explode_all_ions(fixture(spark, sf_dir, "compounds"), ["a_ions", "b_ions", "c_ions"])
    return stats.value_counts(df, "ion")


@query("topk_other", oracle("compounds", f"""
, e AS ({exploded_sql('a_ions', 'b_ions', 'c_ions')})
, c AS (SELECT ion, count(*) AS n FROM e WHERE ion IS NOT NULL GROUP BY ion)
, r AS (SELECT *, row_number() OVER (ORDER BY n DESC, ion) AS place FROM c)
SELECT ion AS value, CAST(n AS BIGINT) AS n FROM r WHERE place <= 4
UNION ALL SELECT 'other', CAST(coalesce(sum(n), 0) AS BIGINT) FROM r WHERE place > 4"""))
def topk_other(spark, sf_dir):
    df = comp.explode_all_ions(fixture(spark, sf_dir, "compounds"), ["a_ions", "b_ions", "c_ions"])
    return stats.topk_other(df, "ion", 4)


@query("topk_other_parts", """
WITH c AS (SELECT cast(l_partkey AS varchar) AS value, count(*) AS n FROM lineitem GROUP BY l_partkey)
, r AS (SELECT *, row_number() OVER (ORDER BY n DESC, value) AS place FROM c)
SELECT value, CAST(n AS BIGINT) AS n FROM r WHERE place <= 20
UNION ALL SELECT 'other', CAST(coalesce(sum(n), 0) AS BIGINT) FROM r WHERE place > 20""")
def topk_other_parts(spark, sf_dir):
    from lamina.queries.fixtures import table

    df = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").cast("string").alias("part"))
    return stats.topk_other(df, "part", 20)

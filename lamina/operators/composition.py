"""Composition tables from formulas or ion lists."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.functions.composition import (
    SITES, SYMBOLS, formula_pairs, ion_names, ion_pairs, pair_columns, row_sum,
)
from lamina.operators.rows import (
    allowed_formulas, coerce_numeric, drop_null_rows, exclude_containing, keep_true, project, single_layer,
    within_tolerance,
)
from lamina.operators.stats import group_mode


def clean_composition(df: DataFrame, formula: str, flags: Sequence[str]) -> DataFrame:
    """Rows with a formula of one layer whose structure flags are all true."""
    return single_layer(keep_true(drop_null_rows(df, [formula, *flags]), *flags), formula)


def formula_composition(df: DataFrame, formula: str = "compound", keep: Sequence[str] = ("E_g",)) -> DataFrame:
    """``(formula, keep..., Cs, FA, MA, Pb, Sn, I, Br)`` with 0 for absent symbols."""
    return df.select(
        formula, *keep, formula_pairs(F.col(formula)).alias("_pairs")
    ).select(formula, *keep, *pair_columns(F.col("_pairs"), SYMBOLS))


def formula_route(df: DataFrame, formula: str, gap: str, flags: Sequence[str]) -> DataFrame:
    """Formulas to compositions: numeric gap, clean rows, gap mode per formula, grammar, parse."""
    with_gap = coerce_numeric(drop_null_rows(df, [gap]), gap)
    cleaned = clean_composition(with_gap, formula, flags)
    named = project(cleaned, [formula, gap], {formula: "compound", gap: "E_g"})
    modes = group_mode(named, "compound", ["E_g"])
    return formula_composition(allowed_formulas(modes, "compound"))


def ion_vocabulary(df: DataFrame, ions: str, coefficients: str, max_ions: int | None = None) -> list[str]:
    """Distinct ion names of one site, sorted; they become columns.  More than ``max_ions``, if given, are an error."""
    names = F.transform(ion_pairs(F.col(ions), F.col(coefficients)), lambda p: p["name"])
    found = df.select(F.explode(names).alias("name")).distinct()
    rows = (found if max_ions is None else found.limit(max_ions + 1)).collect()
    if max_ions is not None and len(rows) > max_ions:
        raise ValueError(f"more than {max_ions} ions in {ions}; use ion_long")
    return sorted(r["name"] for r in rows)


def ion_composition(
    df: DataFrame, vocabulary: Mapping[str, Sequence[str]] | None = None, keep: Sequence[str] = ("compound", "E_g")
) -> DataFrame:
    """``(keep..., a_Cs, ..., c_Br)`` from ``<site>_ions`` and ``<site>_coeff``; 0 where absent.

    Without a vocabulary all ions found become columns.
    """
    sites = ("a", "b", "c")
    if vocabulary is None:
        vocabulary = {s: ion_vocabulary(df, f"{s}_ions", f"{s}_coeff") for s in sites}
    pairs = [ion_pairs(F.col(f"{s}_ions"), F.col(f"{s}_coeff")).alias(f"_{s}") for s in sites]
    columns = [c for s in sites for c in pair_columns(F.col(f"_{s}"), vocabulary[s], f"{s}_")]
    return df.select(*keep, *pairs).select(*keep, *columns)


def ion_long(df: DataFrame, keep: Sequence[str] = ("compound",)) -> DataFrame:
    """``(keep..., site, ion, coeff)``: the composition for any number of ions.  A repeated ion keeps its last value."""

    def site_entries(site: str) -> Column:
        pairs = F.col(f"_{site}")
        last = F.filter(
            pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs), F.lit(1))), lambda q: q["name"] == p["name"])
        )
        return F.transform(last, lambda p: F.struct(F.lit(site).alias("site"), p["name"].alias("ion"), p["value"].alias("coeff")))

    pairs = [ion_pairs(F.col(f"{s}_ions"), F.col(f"{s}_coeff")).alias(f"_{s}") for s in SITES]
    entries = F.concat(*[F.coalesce(site_entries(s), F.array().cast("array<struct<site:string,ion:string,coeff:double>>")) for s in SITES])
    return df.select(*keep, *pairs).select(*keep, F.explode(entries).alias("e")).select(*keep, "e.*")


def clean_ions(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows with all given columns and no missing A-site ion."""
    return exclude_containing(drop_null_rows(df.select(*columns)), "a_ions", "nan")


def ion_route(df: DataFrame) -> DataFrame:
    """Ion lists to compositions: clean, numeric gap, parse, mode of every column per compound."""
    columns = ["compound", "E_g", *[f"{s}_{p}" for s in "abc" for p in ("ions", "coeff")]]
    cleaned = coerce_numeric(clean_ions(df, columns), "E_g")
    # Only the accepted ions are needed below, so the others never become columns.
    return group_mode(ion_composition(cleaned, SITES), "compound")


def site_columns(prefix: bool = False) -> dict[str, list[str]]:
    return {s: [f"{s}_{n}" if prefix else n for n in names] for s, names in SITES.items()}


def site_sums(prefix: bool = False) -> dict[str, Column]:
    return {s: row_sum(columns) for s, columns in site_columns(prefix).items()}


def plain_names(df: DataFrame) -> DataFrame:
    """Site prefixes removed from the accepted ions' columns."""
    return df.withColumnsRenamed({f"{s}_{n}": n for s, names in SITES.items() for n in names})


def valid_compositions(df: DataFrame, prefix: bool = False) -> DataFrame:
    return within_tolerance(df, site_sums(prefix))


def normalise_group(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns divided by their row sum; null where the sum is 0."""
    total = row_sum(columns)
    return df.select(
        *[F.try_divide(F.col(c), total).alias(c) if c in columns else F.col(c) for c in df.columns]
    )


def explode_ions(df: DataFrame, column: str) -> DataFrame:
    return df.select(F.explode(ion_names(F.col(column))).alias("ion"))


def explode_all_ions(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Ions of several sites with duplicates; one scan instead of a union of scans."""
    return df.select(F.explode(F.flatten(F.array(*[F.coalesce(ion_names(F.col(c)), F.array().cast("array<string>")) for c in columns]))).alias("ion"))

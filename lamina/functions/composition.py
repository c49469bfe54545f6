"""Chemical formulas and ion lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from lamina.functions.text import number

# Symbols per site, the formula grammar and the accepted site sums.
SITES = {"a": ("Cs", "FA", "MA"), "b": ("Pb", "Sn"), "c": ("I", "Br")}
SYMBOLS = ("Cs", "FA", "MA", "Pb", "Sn", "I", "Br")
ALLOWED_FORMULA = r"^(?:Cs|MA|FA|Pb|Sn|I|Br|[0-9.])+\s*$"
FORMULA_PART = r"(Cs|MA|FA|Pb|Sn|I|Br)(\d*\.\d+|\d*)"
SITE_SUMS = {"a": 1.0, "b": 1.0, "c": 3.0}
SITE_RANGES = {"a": (0.90, 1.10), "b": (0.90, 1.10), "c": (2.90, 3.10)}
ION_NOISE = r"[()\s]"
NUMBER_WORDS = r"(?i)^[+-]?(?:nan|inf|infinity)$"


def _last(pairs: Column, name: str) -> Column:
    """Value of the last ``(name, value)`` struct with that name."""
    return F.try_element_at(F.filter(pairs, lambda p: p["name"] == name), F.lit(-1))["value"]


def formula_pairs(formula: Column) -> Column:
    """``array<struct<name, value>>`` of symbols and fractions; no fraction means 1."""
    names = F.regexp_extract_all(formula, F.lit(FORMULA_PART), F.lit(1))
    parts = F.regexp_extract_all(formula, F.lit(FORMULA_PART), F.lit(2))
    return F.zip_with(
        names,
        parts,
        lambda n, p: F.struct(
            n.alias("name"), F.when(p == "", F.lit(1.0)).otherwise(p.try_cast("double")).alias("value")
        ),
    )


def ion_pairs(ions: Column, coefficients: Column) -> Column:
    """Two ``;`` lists zipped to the shorter one; a coefficient that is no number counts 0."""

    def entries(text: Column) -> Column:
        return F.split(F.replace(text, F.lit(" "), F.lit("")), ";")

    names, parts = entries(ions), entries(coefficients)
    shared = F.least(F.size(names), F.size(parts))
    return F.zip_with(
        F.slice(names, F.lit(1), shared),
        F.slice(parts, F.lit(1), shared),
        lambda n, p: F.struct(
            n.alias("name"), F.coalesce(coefficient(p), F.lit(0.0)).alias("value")
        ),
    )


def coefficient(text: Column) -> Column:
    """Double value of numeric text or of ``nan`` and ``inf``; null for other text, also for ``1d``."""
    return F.coalesce(number(text), F.when(text.rlike(NUMBER_WORDS), F.regexp_replace(text, r"^\+", "").try_cast("double")))


def pair_columns(pairs: Column, names: Sequence[str], prefix: str = "") -> list[Column]:
    """One column per name, 0 where absent.  A repeated name keeps its last value."""
    return [F.coalesce(_last(pairs, n), F.lit(0.0)).alias(prefix + n) for n in names]


def formula_map(formula: Column, names: Sequence[str] = SYMBOLS) -> Column:
    pairs = formula_pairs(formula)
    entries = F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*[_last(pairs, n) for n in names]))
    return F.map_filter(entries, lambda _, v: v.isNotNull())


def ion_names(ions: Column) -> Column:
    return F.split(F.regexp_replace(ions, ION_NOISE, ""), ";")


def row_sum(columns: Sequence[str]) -> Column:
    """Left-to-right sum, nulls as 0; the order matters for exact equality tests."""
    total = F.coalesce(F.col(columns[0]), F.lit(0.0))
    for c in columns[1:]:
        total = total + F.coalesce(F.col(c), F.lit(0.0))
    return total

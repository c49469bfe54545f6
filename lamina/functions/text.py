"""Null tokens, layer tokens and numeric text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cell texts that mean "no value" (whole cell, never a substring).
NULL_TOKENS = (
    "Unknown",
    "unknown",
    "None",
    "none",
    "NULL",
    "Null",
    "null",
    "NAN",
    "NaN",
    "Nan",
    "nan",
    "NAN; NAN",
    "NaN; NaN",
    "Nan; Nan",
    "nan; nan",
)

# Cells without any layer entry, delimiters and part names from the outside in.
EMPTY_CELLS = ("Unknown", "nan")
LEVELS = (("Layer", "|"), ("Feature", ";"), ("Deposition", ">>"))

# Texts a CSV reader takes as missing (the pandas documentation's default list).
CSV_MISSING = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# Catalog grammar that marks a layered field, and the exception by name.
LAYERED_PATTERN = r">>|;|\|"
UNLAYERED_NAME = "concentrations"

_NUMBER = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?)\s*$"
_INTEGER = r"^\s*[+-]?\d+\s*$"


def null_token(cell: Column, tokens: Sequence[str] = NULL_TOKENS) -> Column:
    return F.when(~cell.isin(*tokens), cell)


def _is_empty(packed: Column) -> Column:
    return packed.isNull() | packed.isin(*EMPTY_CELLS)


def tokenise(cell: Column, delimiter: str, packed: bool = False) -> Column:
    """Entries of a delimited cell with all spaces removed; empty list when there are none.

    ``packed`` says that the cell has no spaces, as every entry of an outer level.  Cells
    without the delimiter skip the regular expression.
    """
    text = cell if packed else F.replace(cell, F.lit(" "), F.lit(""))
    pattern = "\\" + delimiter if len(delimiter) == 1 else delimiter
    entries = F.when(text.contains(delimiter), F.split(text, pattern)).otherwise(F.array(text))
    return F.when(_is_empty(text), F.array().cast("array<string>")).otherwise(entries)


def token_count(packed: Column, delimiter: str) -> Column:
    """Number of entries :func:`tokenise` would return for a cell without spaces."""
    marks = F.length(packed) - F.length(F.replace(packed, F.lit(delimiter), F.lit("")))
    several = F.when(packed.contains(delimiter), (marks / F.lit(len(delimiter))).cast("int") + 1).otherwise(F.lit(1))
    return F.when(_is_empty(packed), F.lit(0)).otherwise(several)


def number(cell: Column) -> Column:
    """Double value of numeric text, otherwise null.

    The grammar is stricter than the engine's own cast, which takes ``1d`` and ``nan``.
    Digits that overflow to infinity are not a number either.
    """
    value = cell.try_cast("double")
    overflow = (F.abs(value) == F.lit(float("inf"))) & ~F.lower(cell).contains("inf")
    return F.when(cell.rlike(_NUMBER) & ~overflow, value)


def is_number_or_empty(cell: Column) -> Column:
    return cell.isNull() | (cell == "") | number(cell).isNotNull()


def is_integer(cell: Column) -> Column:
    return F.coalesce(cell.rlike(_INTEGER) & cell.try_cast("bigint").isNotNull(), F.lit(False))


def is_layered(pattern: Column, field: Column) -> Column:
    """Whether a catalog row describes a field with layered cells."""
    return F.coalesce(pattern.rlike(LAYERED_PATTERN), F.lit(False)) & ~F.coalesce(
        field.contains(UNLAYERED_NAME), F.lit(False)
    )

import math

from pyspark.sql import functions as F

from lamina.functions.text import number
from lamina.operators import rows


def test_number_grammar(spark):
    cases = {
        "1": 1.0, "1d": None, "1.5f": None, "nan": None, "inf": math.inf, "-Infinity": -math.inf, " 1 ": 1.0, "1e5": 1e5,
        "1_000": None, ".5": 0.5, "5.": 5.0, "+3": 3.0, "0x10": None, "": None, "TRUE": None, "1e400": None, "-": None,
        "e5": None, "1e": None, "1E+5": 1e5, " ": None, "iNf": math.inf,
    }
    df = spark.createDataFrame([(c,) for c in cases], "c string")
    got = {r["c"]: r["n"] for r in df.select("c", number(F.col("c")).alias("n")).collect()}
    assert got == cases


def test_promotion(spark):
    df = spark.createDataFrame(
        [("1", "1", "1.5", "a", None, "1", True), ("2", None, "", "1", None, "nan", False)],
        "whole string, gap string, empty string, text string, none string, word string, flag boolean",
    )
    types = dict(rows.promote_numeric(df).dtypes)
    assert types == {"whole": "bigint", "gap": "double", "empty": "double", "text": "string", "none": "double",
                     "word": "string", "flag": "boolean"}


def test_null_tokens_are_whole_cells(spark):
    df = spark.createDataFrame([("Unknown",), ("Unknown | A",), ("nan; nan",), ("nan; nan; nan",), (None,)], "c string")
    assert [r["c"] for r in rows.normalise_nulls(df).collect()] == [None, "Unknown | A", None, "nan; nan; nan", None]


def test_split_target(spark):
    df = spark.createDataFrame([(1, 2.0), (2, None)], "a int, y double")
    assert rows.split_target(df, "y").collect() == [(1, 2.0)]
    assert rows.split_target(df, "y", drop_target=False).columns == ["a", "y", "label"]


def test_dtype_selection(spark):
    df = spark.createDataFrame([], "a int, b double, c string, d boolean, e timestamp, f array<int>")
    assert rows.numeric_columns(df) == ["a", "b"]
    assert rows.categorical_columns(df) == ["c", "d"]

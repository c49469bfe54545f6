import datetime
import re

import pytest
from brute import luhn
from pyspark.sql import functions as F

from lamina.llm.pseudonyms import permuted, pseudonymise

TEXTS = [
    "card 4111 1111 1111 1111, 4111111111111111; not 4111111111111112", "call +1 (017) 555-7713 or 017-555-7713", "ip 10.0.0.1. not 300.1.2.3 v2.0",
    "born 1980-02-29, 29.02.1980, 29/2/1980; not 31/02/1980", "ssn 123-45-6789 not 000-12-3456", "für.34@mail7.example.com A.B@x.org.",
    'token = "b44e15e09fd311c3cf3163b66d5a9875b883d8ce"', "2353820953013749 4550997810720808", "nothing 12 here", None, "", "not 1500-01-01",
    "card 4111111111111111 and again 4111111111111111" + " x" * 20_000,
]


@pytest.fixture(scope="module")
def replaced(spark):
    frame = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, kinds int")
    return {r["id"]: r for r in pseudonymise(frame, "key").collect()}


def test_formats(replaced):
    out = {i: r["text"] for i, r in replaced.items()}
    first = re.findall(r"\d[\d ]+\d", out[0])
    assert len(first) == 3 and first[0].replace(" ", "") == first[1] and luhn(first[1]) and first[1] != "4111111111111111"
    assert first[2] == "4111111111111112"
    assert [len(p) for p in first[0].split()] == [4] * 4
    assert out[12].count(first[1]) == 2 and len(out[12]) == len(TEXTS[12])
    phones = re.findall(r"\(?\d{3}\)?[ -]\d{3}-\d{4}", out[1])
    assert re.sub(r"\D", "", phones[0]) == re.sub(r"\D", "", phones[1]) != "0175557713" and out[1].startswith("call +1 (")
    assert all(int(p) < 256 for p in re.search(r"ip ([\d.]+)\. not 300", out[2])[1].split("."))
    iso, dotted, short = re.search(r"born (\S+), (\S+), (\S+);", out[3]).groups()
    day = datetime.date.fromisoformat(iso)
    assert dotted == day.strftime("%d.%m.%Y") and short == f"{day.day}/{day.month}/{day.year}" and out[3].endswith("31/02/1980")
    assert re.fullmatch(r"ssn \d{3}-\d{2}-\d{4} not 000-12-3456", out[4]) and out[4] != TEXTS[4]
    assert out[5].endswith("@x.org.") and "für" not in out[5]
    assert re.fullmatch(r'token = "[0-9a-f]{40}"', out[6]) and out[6] != TEXTS[6]
    assert [out[i] for i in (8, 9, 10, 11)] == [TEXTS[i] for i in (8, 9, 10, 11)]
    assert dict(replaced[0]["replaced"]) == {"card": 2} and replaced[3]["n_replaced"] == 3 and replaced[9]["n_replaced"] == 0


def test_permutations(spark):
    for size in (2, 10, 997, 4096):
        seen = spark.range(size).select(permuted(F.col("id"), size, "k", "x").alias("v")).agg(F.countDistinct("v"), F.min("v"), F.max("v")).first()
        assert tuple(seen) == (size, 0, size - 1)
    odd = spark.range(1, 999, 2).select(permuted(F.col("id"), 1000, "k", "x", lambda v: v % 2 == 1).alias("v"))
    assert odd.where("v % 2 = 1").distinct().count() == 499
    big = spark.range(10**18 - 300, 10**18).select(permuted(F.col("id"), 10**18, "k", "x").alias("v"))
    assert big.distinct().count() == 300 and big.where("v < 0 or v >= 1000000000000000000").count() == 0


def test_keys_differ(spark):
    frame = spark.createDataFrame([(1, TEXTS[0])], "doc_id long, text string")
    assert pseudonymise(frame, "a").first()["text"] != pseudonymise(frame, "b").first()["text"] == pseudonymise(frame, "b").first()["text"]


def test_awkward_rows_and_plan(spark, sf_dir, awkward, rows, nothing):
    frame = pseudonymise(awkward, "k")
    assert sorted(((r["id"], r["text"]) for r in frame.collect()), key=repr) == sorted(((i, t) for i, t, _ in rows), key=repr)
    assert pseudonymise(nothing, "k").count() == 0
    plan = pseudonymise(spark.read.parquet(f"{sf_dir}/documents.parquet"), "k")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan

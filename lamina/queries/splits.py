"""Splits, folds and row numbers."""

from __future__ import annotations

from lamina.operators import split
from lamina.queries.fixtures import LINE_KEYS, fixture, oracle, table
from lamina.queries.registry import query

KEYS = ", ".join(LINE_KEYS)
TEXT_KEY = "concat_ws('|', " + ", ".join(f"cast({k} AS varchar)" for k in LINE_KEYS) + ")"


def hash_sql(prefix: str, key: str = TEXT_KEY) -> str:
    return f"CAST(concat('0x', substr(md5(concat('{prefix}|', {key})), 1, 13)) AS BIGINT)"


def _lines(spark, sf_dir, *more):
    return fixture(spark, sf_dir, "numeric").select(*LINE_KEYS, *more)


@query("split_train_test", oracle("numeric", f"""
, r AS (SELECT *, row_number() OVER (ORDER BY {hash_sql('42')}, {TEXT_KEY}) AS place, count(*) OVER () AS n FROM src)
SELECT {KEYS}, CASE WHEN place <= ceil(n * 0.3e0) THEN 'test' ELSE 'train' END AS split FROM r"""))
def split_train_test(spark, sf_dir):
    return split.train_test_split(_lines(spark, sf_dir), LINE_KEYS, 0.3, seed=42)


@query("split_shuffle", oracle("numeric", " UNION ALL ".join(
    f"""{'' if s else ' '}SELECT {KEYS}, CAST({s} AS INTEGER) AS split_no,
  CASE WHEN row_number() OVER (ORDER BY {hash_sql(f'7|{s}')}, {TEXT_KEY}) <= ceil(count(*) OVER () * 0.1e0) THEN 'test' ELSE 'train' END AS role FROM src"""
    for s in range(3))))
def split_shuffle(spark, sf_dir):
    return split.shuffle_split(_lines(spark, sf_dir), LINE_KEYS, 3, 0.1, seed=7)


@query("split_kfold", oracle("numeric", f"""
, r AS (SELECT *, row_number() OVER (ORDER BY {KEYS}) - 1 AS place, count(*) OVER () AS n FROM src)
SELECT {KEYS}, CAST(CASE WHEN place < (n % 7) * (n // 7 + 1) THEN place // (n // 7 + 1)
  ELSE n % 7 + (place - (n % 7) * (n // 7 + 1)) // (n // 7) END AS INTEGER) AS fold FROM r"""))
def split_kfold(spark, sf_dir):
    return split.kfold(_lines(spark, sf_dir), LINE_KEYS, 7)


@query("split_kfold_shuffled", oracle("numeric", f"""
, r AS (SELECT *, row_number() OVER (ORDER BY {hash_sql('3')}, {KEYS}) - 1 AS place, count(*) OVER () AS n FROM src)
SELECT {KEYS}, CAST(CASE WHEN place < (n % 7) * (n // 7 + 1) THEN place // (n // 7 + 1)
  ELSE n % 7 + (place - (n % 7) * (n // 7 + 1)) // (n // 7) END AS INTEGER) AS fold FROM r"""))
def split_kfold_shuffled(spark, sf_dir):
    return split.kfold(_lines(spark, sf_dir), LINE_KEYS, 7, shuffle=True, seed=3)


@query("split_stratified", oracle("numeric", f"""
, r AS (SELECT *, row_number() OVER (ORDER BY {KEYS}) - 1 AS place FROM src)
, c AS (SELECT cat, min(place) AS first, count(*) AS size FROM r GROUP BY cat)
, s AS (SELECT cat, size, coalesce(sum(size) OVER (ORDER BY first ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM c)
, f AS (SELECT cat, fold, (SELECT count(*) FROM range(CAST(start AS BIGINT), CAST(start + size AS BIGINT)) t(p) WHERE p % 4 = fold) AS share
  FROM s, (SELECT unnest(range(4)) AS fold))
, e AS (SELECT cat, fold, sum(share) OVER (PARTITION BY cat ORDER BY fold ROWS UNBOUNDED PRECEDING) AS upto FROM f)
, k AS (SELECT *, row_number() OVER (PARTITION BY cat ORDER BY place) - 1 AS rank FROM r)
SELECT {KEYS}, cat, CAST((SELECT count(*) FROM e WHERE e.cat = k.cat AND e.upto <= k.rank) AS INTEGER) AS fold FROM k"""))
def split_stratified(spark, sf_dir):
    return split.stratified_kfold(_lines(spark, sf_dir, "cat"), "cat", LINE_KEYS, 4)


@query("split_time_series", """
WITH r AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS place, count(*) OVER () AS n FROM events)
, s AS (SELECT split_no, n // 6 AS size, n - 5 * (n // 6) + split_no * (n // 6) AS start FROM (SELECT DISTINCT n FROM r), (SELECT unnest(range(5)) AS split_no))
SELECT event_id, CAST(split_no AS INTEGER) AS split_no, CASE WHEN place < start THEN 'train' ELSE 'test' END AS role
FROM r, s WHERE place < start + size""")
def split_time_series(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "ts")
    return split.time_series_split(events, ["ts", "event_id"], 5).drop("ts")


@query("row_numbers", oracle("numeric", f"""
SELECT {KEYS}, CAST(row_number() OVER (ORDER BY {KEYS}) - 1 AS BIGINT) AS row_id FROM src WHERE x1 IS NOT NULL"""))
def row_numbers(spark, sf_dir):
    return split.number_rows(_lines(spark, sf_dir, "x1").filter("x1 is not null").drop("x1"), LINE_KEYS)


@query("head_rows", oracle("numeric", f"""
SELECT {KEYS}, label FROM src ORDER BY {KEYS} LIMIT 1000"""))
def head_rows(spark, sf_dir):
    return split.head_rows(_lines(spark, sf_dir, "label"), LINE_KEYS, 1000)

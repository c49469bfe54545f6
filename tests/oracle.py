"""Runs a registered query and its SQL on the same tables and compares the rows."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(0.0 if value == 0 else value)
    return repr(value)


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


SPARK_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
               "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP"}


def compare(df, sql: str, con) -> str | None:
    """None when equal, otherwise what differs."""
    relation = con.execute(sql)
    names = [d[0] for d in relation.description]
    types = {d[0]: str(d[1]) for d in relation.description}
    expected = _rows(names, relation.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} but expected {sorted(names)}"
    kinds = {f.name: SPARK_TYPES.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema}
    wrong = {c: (kinds[c], types[c]) for c in names if kinds[c] != types[c]}
    if wrong:
        return f"types {wrong}"
    actual = _rows(df.columns, [tuple(r) for r in df.collect()])
    if len(actual) != len(expected):
        return f"{len(actual)} rows but expected {len(expected)}"
    differing = [(a, e) for a, e in zip(actual, expected) if a != e]
    if differing:
        return f"{len(differing)} rows differ, first {differing[0]}"
    return None

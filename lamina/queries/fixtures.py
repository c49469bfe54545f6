"""Inputs in the engine's shape, derived row by row from the given tables.

``{table}`` marks a table; the same text runs in Spark and as the oracle's first CTE.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

LINE_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]

FIXTURES = {
    # Layered cells of 1 to 13 layers with nulls and unknown cells.
    "layered": """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  CASE WHEN l_orderkey % 17 = 0 THEN NULL WHEN l_orderkey % 19 = 0 THEN 'Unknown'
    ELSE concat(l_returnflag, CASE WHEN l_quantity >= 40 THEN ' >> X' ELSE '' END,
      CASE WHEN l_discount >= 0.05 THEN concat('; ', l_linestatus) ELSE '' END,
      repeat(concat(' | ', l_linestatus, CASE WHEN l_tax >= 0.04 THEN ' >> Y; Z >> Y >> V' ELSE '' END,
        CASE WHEN l_partkey % 5 = 0 THEN ' | Unknown' ELSE '' END), l_linenumber - 1)) END AS stack
FROM {lineitem}""",
    # Cells whose tree is the same at every size, so that wide results have fixed columns.
    "layered_small": """
SELECT p_partkey AS row_id,
  CASE p_partkey % 5 WHEN 0 THEN 'SLG | FTO | A; B >> C' WHEN 1 THEN 'X | Unknown' WHEN 2 THEN 'Y'
    WHEN 3 THEN NULL ELSE 'P; Q | R >> S | T' END AS F,
  CASE p_partkey % 6 WHEN 0 THEN 'm >> n' WHEN 1 THEN NULL WHEN 2 THEN NULL WHEN 3 THEN 'nan' ELSE 'm' END AS G,
  CASE WHEN p_partkey % 8 = 0 THEN 'nan' ELSE cast(p_size AS varchar(10)) END AS H,
  CASE WHEN p_partkey % 10 <> 0 THEN NULL ELSE p_type END AS K,
  CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE p_retailprice END AS target
FROM {part}""",
    # One field catalog row per part.
    "catalog": """
SELECT p_type AS section,
  concat(replace(p_name, ' ', '_'), '_', cast(p_partkey AS varchar(10)),
    CASE WHEN p_size % 7 = 0 THEN '_concentrations' ELSE '' END) AS Field,
  CASE p_partkey % 5 WHEN 0 THEN '[Mat.1; Mat.2; ... | Mat.3; ... | Mat.4 | ...]' WHEN 1 THEN '[Proc. 1 >> Proc. 2]'
    WHEN 2 THEN NULL WHEN 3 THEN 'TRUE or FALSE' ELSE '[A | B]' END AS Pattern
FROM {part}""",
    # One JSON section map per part.
    "section_json": """
SELECT p_partkey,
  concat('{{"', p_brand, '": ["', p_type, '_', cast(p_partkey AS varchar(10)), '", "size_', cast(p_size AS varchar(10)),
    '"]}}') AS value
FROM {part}""",
    "tokens": """
SELECT o_orderkey AS row_id,
  CASE o_orderkey % 7 WHEN 0 THEN 'Unknown' WHEN 1 THEN 'nan; nan' WHEN 2 THEN 'None' WHEN 3 THEN 'FTO | Unknown'
    WHEN 4 THEN cast(o_custkey AS varchar(20)) WHEN 5 THEN NULL ELSE 'TRUE' END AS raw_text,
  CASE WHEN o_orderkey % 5 = 0 THEN 'nan' ELSE concat(cast(o_custkey AS varchar(20)), '.5') END AS raw_numeric,
  cast(o_custkey AS varchar(20)) AS raw_integer,
  CASE o_orderkey % 4 WHEN 0 THEN '1d' WHEN 1 THEN '-2.5e3' WHEN 2 THEN '' ELSE ' 7 ' END AS raw_mixed
FROM {orders}""",
    "compounds": """
SELECT p_partkey AS row_id,
  concat(CASE WHEN p_partkey % 23 = 0 THEN 'Cs0.5FA0.2' ELSE CASE p_partkey % 5 WHEN 0 THEN 'MA' WHEN 1 THEN 'FA' WHEN 2 THEN 'Cs0.05FA0.79MA0.16' WHEN 3 THEN 'Cs' ELSE 'Cs0.2FA0.8' END END,
    CASE WHEN p_partkey % 37 = 0 THEN 'Pb0.5' ELSE CASE p_partkey % 7 WHEN 0 THEN 'Sn' WHEN 1 THEN 'Pb0.5Sn0.5' WHEN 2 THEN 'Ag' ELSE 'Pb' END END,
    CASE WHEN p_partkey % 29 = 0 THEN 'I2.5' WHEN p_partkey % 31 = 0 THEN 'Br2' ELSE CASE p_partkey % 4 WHEN 0 THEN 'I3' WHEN 1 THEN 'Br3' WHEN 2 THEN 'I2.5Br0.5' ELSE CASE WHEN p_size % 3 = 0 THEN 'IBr2 | MAPbI3' ELSE 'IBr2I ' END END END) AS long_form,
  CASE WHEN p_size % 11 = 0 THEN 'nan' WHEN p_size % 13 = 0 THEN NULL ELSE cast(1 + p_size AS varchar(10)) END AS band_gap,
  p_size % 9 <> 0 AS dimension_3d,
  CASE WHEN p_size % 17 = 0 THEN NULL ELSE p_size % 8 <> 0 END AS abc3,
  CASE p_partkey % 4 WHEN 0 THEN 'MA' WHEN 1 THEN 'Cs; FA; MA' WHEN 2 THEN '(PEA); MA' ELSE CASE WHEN p_size % 2 = 0 THEN 'Cs; nan' ELSE 'Cs; FA' END END AS a_ions,
  CASE p_partkey % 6 WHEN 0 THEN '1' WHEN 1 THEN '0.05; 0.79; 0.16' WHEN 2 THEN 'x; 0.5' ELSE '0.17; 0.83' END AS a_coeff,
  CASE p_partkey % 3 WHEN 0 THEN 'Pb' WHEN 1 THEN 'Pb; Sn' ELSE 'Sn' END AS b_ions,
  CASE p_partkey % 3 WHEN 1 THEN '0.5; 0.5' ELSE '1' END AS b_coeff,
  CASE WHEN p_size % 19 = 0 THEN NULL WHEN p_partkey % 4 = 0 THEN 'I' WHEN p_partkey % 4 = 1 THEN 'Br; I' ELSE 'Br' END AS c_ions,
  CASE p_partkey % 4 WHEN 1 THEN '0.5; 2.5' ELSE '3' END AS c_coeff
FROM {part}""",
    "numeric": """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag AS cat, l_shipdate,
  CASE WHEN l_linenumber = 3 THEN NULL ELSE l_quantity END AS x1,
  CASE WHEN l_partkey % 10 = 0 THEN NULL ELSE l_discount END AS x2,
  l_tax AS x3, l_extendedprice AS label, l_quantity * 1.5e3 AS prediction, cast(l_orderkey % 5 AS int) AS fold
FROM {lineitem}""",
    "runs": """
SELECT o_orderkey AS run_id, o_orderpriority AS model_type, o_orderstatus AS status,
  CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE o_totalprice / 1e6 END AS val_r,
  (o_custkey % 1000) / 1e3 AS test_r_mean
FROM {orders}""",
}


@lru_cache(maxsize=None)
def _tables_in(text: str) -> tuple[str, ...]:
    return tuple(sorted(set(re.findall(r"(?<!\{)\{(\w+)\}", text))))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = FIXTURES[name]
    return spark.sql(text, **{t: table(spark, sf_dir, t) for t in _tables_in(text)})


def oracle(name: str, body: str) -> str:
    """SQL with the fixture as CTE ``src``, followed by ``body`` (more CTEs may come first)."""
    text = FIXTURES[name]
    plain = text.format(**{t: t for t in _tables_in(text)})
    return f"WITH src AS ({plain}\n){body}"

"""Messy tables derived from the given ones, in SQL that Spark and DuckDB both run."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.columns import q, replace_columns

ORDERS_MESSY = """
SELECT o_orderkey,
  CAST(o_orderkey AS BIGINT) AS row_num,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_totalprice END AS price,
  CASE WHEN o_orderkey % 10 < 6 THEN NULL ELSE o_custkey END AS mostly_null,
  CASE WHEN o_orderkey % 1000 = 7 THEN 'B' ELSE 'A' END AS near_const,
  CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE concat(
    substr('ABCDEF', CAST(o_orderkey % 6 + 1 AS INT), 1), '/',
    CAST(o_custkey % 40 AS VARCHAR(10)), '/',
    CASE WHEN o_custkey % 2 = 0 THEN 'P' ELSE 'S' END) END AS code,
  CASE WHEN o_orderkey % 17 = 0 THEN NULL
       ELSE substr(CAST(o_orderdate AS VARCHAR(30)), 1, 10) END AS odate,
  CASE WHEN o_orderkey % 211 = 0 THEN 'rare1' WHEN o_orderkey % 307 = 0 THEN 'rare2'
       ELSE o_orderpriority END AS prio,
  CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE
    CAST((o_custkey * 7 + o_orderkey) % 100 AS DOUBLE) * ((o_custkey * 7 + o_orderkey) % 100)
    * ((o_custkey * 7 + o_orderkey) % 100) * ((o_custkey * 7 + o_orderkey) % 100) END AS skewed,
  o_totalprice * 2 + o_orderkey % 500 AS price_twin,
  CASE WHEN (o_orderkey * 31 + 7) % 997 < 5 THEN 5000.0E0
       ELSE CAST(o_custkey % 50 AS DOUBLE) END AS spiky,
  o_custkey % 37 AS shop,
  concat('z', CAST(o_custkey % 37 AS VARCHAR(10))) AS shop_txt,
  o_orderstatus AS y_cls,
  CASE WHEN o_totalprice > 480000 THEN 1 ELSE 0 END AS y_imb,
  CASE WHEN o_totalprice > 250000 THEN 'big' ELSE 'small' END AS y_bin,
  o_totalprice / 1000 + 20 * (o_custkey % 3) AS y_reg
FROM orders
"""
TEXT_COLUMNS = ["near_const", "code", "odate", "prio", "shop_txt", "y_cls", "y_bin"]
INTEGER_COLUMNS = ["o_orderkey", "row_num", "mostly_null", "shop", "y_imb"]
DOUBLE_COLUMNS = ["price", "skewed", "price_twin", "spiky", "y_reg"]
ALL_COLUMNS = [
    "o_orderkey", "row_num", "price", "mostly_null", "near_const", "code", "odate", "prio", "skewed",
    "price_twin", "spiky", "shop", "shop_txt", "y_cls", "y_imb", "y_bin", "y_reg",
]
# the rows the split sends to the test side
IS_TEST = "substr(md5(concat('42:', CAST(o_orderkey AS VARCHAR(20)))), 1, 4) < '3333'"
MESSY = f"m AS ({ORDERS_MESSY})"
SPLIT = f"{MESSY}, s AS (SELECT m.*, CASE WHEN {IS_TEST} THEN 'test' ELSE 'train' END AS _split FROM m)"
TRAINED = f"{SPLIT}, t AS (SELECT * FROM s WHERE _split = 'train')"


def with_messy(body: str) -> str:
    return f"WITH {MESSY} {body}"


def with_split(body: str) -> str:
    """`s` is the messy table with `_split`, `t` its training rows."""
    return f"WITH {TRAINED} {body}"


def union_all(parts: list[str]) -> str:
    return " UNION ALL ".join(parts)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def on_spark(spark: SparkSession, sf_dir: str, sql: str, *names: str) -> DataFrame:
    """Run shared SQL over the given tables without leaving views behind."""
    for n in names:
        sql = re.sub(rf"\b(FROM|JOIN) {n}\b", rf"\1 {{{n}}}", sql)
    return spark.sql(sql, **{n: table(spark, sf_dir, n) for n in names})


def messy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return on_spark(spark, sf_dir, ORDERS_MESSY, "orders")


def split(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.split import train_test_split

    return train_test_split(messy(spark, sf_dir), "o_orderkey")


def train_rows(df: DataFrame) -> DataFrame:
    return df.where(F.col("_split") == "train")


def rounded(df: DataFrame, places: int, *columns: str) -> DataFrame:
    """-0.0 and 0.0 are one value to SQL but not to a hash, so zeros are made positive."""

    def fix(c: str) -> Column:
        return F.round(q(c), places) + F.lit(0.0)

    return replace_columns(df, {c: fix(c) for c in columns})


def whole(df: DataFrame, *columns: str) -> DataFrame:
    return replace_columns(df, {c: q(c).cast("long") for c in columns})

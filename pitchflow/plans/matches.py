"""The match table: one row per match, projected from ``orders`` where no match data is at hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Runs unchanged in Spark and DuckDB: whole-number arithmetic only.
MATCHES_SQL = """
SELECT o_orderkey AS match_id, CAST(o_orderdate AS DATE) AS match_date, CAST(year(o_orderdate) AS INT) AS season,
  CONCAT('T', CAST(o_custkey % 20 AS STRING)) AS home,
  CONCAT('T', CAST((o_custkey % 20 + 1 + o_orderkey % 19) % 20 AS STRING)) AS away,
  CAST((o_orderkey * 7919 + o_custkey * 31) % 5 AS INT) AS hg,
  CAST((o_orderkey * 104729 + o_custkey * 17) % 4 AS INT) AS ag,
  CASE WHEN (o_orderkey * 7919 + o_custkey * 31) % 5 > (o_orderkey * 104729 + o_custkey * 17) % 4 THEN 'H'
       WHEN (o_orderkey * 7919 + o_custkey * 31) % 5 < (o_orderkey * 104729 + o_custkey * 17) % 4 THEN 'A' ELSE 'D' END AS result,
  CASE WHEN o_orderkey % 89 = 0 THEN NULL ELSE CAST(110 + (o_orderkey * 31) % 400 AS DOUBLE) / CAST(100 AS DOUBLE) END AS odd_1,
  CAST(250 + (o_orderkey * 37) % 200 AS DOUBLE) / CAST(100 AS DOUBLE) AS odd_x,
  CAST(120 + (o_orderkey * 41) % 600 AS DOUBLE) / CAST(100 AS DOUBLE) AS odd_2,
  CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE CAST((o_orderkey * 13) % 11 AS INT) END AS hst,
  CASE WHEN o_orderkey % 101 = 0 THEN NULL ELSE CAST((o_orderkey * 17) % 9 AS INT) END AS ast,
  CAST((o_orderkey * 19) % 12 AS INT) AS hc, CAST((o_orderkey * 23) % 10 AS INT) AS ac
FROM {orders}
"""


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return spark.sql(MATCHES_SQL, orders=orders)

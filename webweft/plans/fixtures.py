"""The wiki tables that the registered queries run on, derived from part and lineitem.

The same text runs in Spark and in other engines; ``{part}`` and ``{lineitem}``
stand for the tables' names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from webweft.plans.graph import LinkGraph
from webweft.runtime import table

DUMP_SQL = """
t AS (
  SELECT p_partkey AS k, p_size,
         CASE p_partkey % 3
           WHEN 0 THEN 'item_' || CAST(CAST(floor(p_partkey / 3) AS BIGINT) AS VARCHAR(20))
           WHEN 1 THEN 'Item_' || CAST(CAST(floor(p_partkey / 3) AS BIGINT) AS VARCHAR(20))
           ELSE 'solo_' || CAST(p_partkey AS VARCHAR(20)) END AS title
  FROM {part}),
page AS (SELECT k AS page_id, title, p_size % 5 = 0 AS is_redirect FROM t),
redirect AS (
  SELECT k AS rd_from,
         CASE WHEN p_size = 50 THEN 'missing_' || CAST(k AS VARCHAR(20))
              WHEN p_size = 25 THEN title
              WHEN k % 3 = 1 THEN 'item_' || CAST(CAST(floor(k / 3) AS BIGINT) AS VARCHAR(20))
              WHEN k % 3 = 0 THEN 'Item_' || CAST(CAST(floor((k + 1) / 3) AS BIGINT) AS VARCHAR(20))
              ELSE 'item_' || CAST(CAST(floor((k + 1) / 3) AS BIGINT) AS VARCHAR(20)) END AS rd_title
  FROM t WHERE p_size % 5 = 0),
x AS (
  SELECT l_partkey AS a,
         lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate) AS b
  FROM {lineitem} WHERE l_returnflag = 'R'),
pagelink AS (SELECT DISTINCT x.a AS pl_from, t.title AS pl_title FROM x JOIN t ON t.k = x.b)
"""


#: The same with a few titles that two or three pages share, redirects among them.
SHARED_SQL = DUMP_SQL.replace("CASE p_partkey % 3", "CASE WHEN p_partkey % 11 = 0 THEN 'twin_' || CAST(CAST(floor(p_partkey / 25) AS BIGINT) AS VARCHAR(20)) ELSE CASE p_partkey % 3", 1).replace(
    "END AS title", "END END AS title", 1
)


def dump_tables(spark: SparkSession, sf_dir: str, sql: str = DUMP_SQL) -> tuple[DataFrame, DataFrame, DataFrame]:
    """page, redirect, pagelink."""
    tables = {n: table(spark, sf_dir, n) for n in ("part", "lineitem")}
    return tuple(spark.sql(f"WITH {sql} SELECT * FROM {name}", **tables) for name in ("page", "redirect", "pagelink"))


def graph(spark: SparkSession, sf_dir: str, sql: str = DUMP_SQL) -> LinkGraph:
    return LinkGraph.build(*dump_tables(spark, sf_dir, sql))

"""The test tables seen as a typed graph, and symbol-like views of the text tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _edge(df: DataFrame, a: str, a_col: str, b: str, b_col: str, kind: str, conf) -> DataFrame:
    return df.select(
        F.concat(F.lit(f"{a}:"), F.col(a_col).cast("string")).alias("src_id"),
        F.concat(F.lit(f"{b}:"), F.col(b_col).cast("string")).alias("dst_id"),
        F.lit(kind).alias("kind"),
        (conf if not isinstance(conf, float) else F.lit(conf)).cast("double").alias("confidence"),
    )


def small_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer -> nation, supplier -> nation, nation -> region."""
    c = _edge(table(spark, sf_dir, "customer"), "c", "c_custkey", "n", "c_nationkey", "calls", 1.0)
    s = _edge(table(spark, sf_dir, "supplier"), "s", "s_suppkey", "n", "s_nationkey", "imports", 0.5)
    n = _edge(table(spark, sf_dir, "nation"), "n", "n_nationkey", "r", "n_regionkey", "inherits", 0.75)
    return c.unionByName(s).unionByName(n)


def tree_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """supplier -> nation, nation -> region only."""
    s = _edge(table(spark, sf_dir, "supplier"), "s", "s_suppkey", "n", "s_nationkey", "calls", 0.5)
    n = _edge(table(spark, sf_dir, "nation"), "n", "n_nationkey", "r", "n_regionkey", "inherits", 0.75)
    return s.unionByName(n)


def full_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also order -> customer, and part -> supplier weighted by quantity."""
    o = _edge(table(spark, sf_dir, "orders"), "o", "o_orderkey", "c", "o_custkey", "reads", 1.0)
    q = table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.sum("l_quantity").alias("q"))
    p = _edge(q, "p", "l_partkey", "s", "l_suppkey", "writes", F.col("q"))
    return small_edges(spark, sf_dir).unionByName(o).unionByName(p)


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src_id", "dst_id")).alias("id")).distinct()


SMALL_SQL = """
  SELECT 'c:' || c_custkey AS src_id, 'n:' || c_nationkey AS dst_id, 'calls' AS kind, CAST(1.0 AS DOUBLE) AS confidence FROM customer
  UNION ALL SELECT 's:' || s_suppkey, 'n:' || s_nationkey, 'imports', 0.5 FROM supplier
  UNION ALL SELECT 'n:' || n_nationkey, 'r:' || n_regionkey, 'inherits', 0.75 FROM nation"""
TREE_SQL = """
  SELECT 's:' || s_suppkey AS src_id, 'n:' || s_nationkey AS dst_id, 'calls' AS kind, CAST(0.5 AS DOUBLE) AS confidence FROM supplier
  UNION ALL SELECT 'n:' || n_nationkey, 'r:' || n_regionkey, 'inherits', 0.75 FROM nation"""
FULL_SQL = SMALL_SQL + """
  UNION ALL SELECT 'o:' || o_orderkey, 'c:' || o_custkey, 'reads', 1.0 FROM orders
  UNION ALL SELECT 'p:' || l_partkey, 's:' || l_suppkey, 'writes', sum(l_quantity) FROM lineitem GROUP BY l_partkey, l_suppkey"""

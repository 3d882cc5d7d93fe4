"""The test tables as the engine's data model: symbols, edges, facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.plans.registry import table
from corvane.session import spread


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as symbols: the first line is the signature, the language the doc string."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text"))
    return docs.select("doc_id", F.col("source").alias("path"), F.substring_index("text", "\n", 1).alias("signature"), F.col("lang").alias("docstring"), F.col("text").alias("body"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, target, kind, confidence): regions contain nations contain customers; suppliers import from their nation."""
    nation, customer, supplier = (table(spark, sf_dir, t) for t in ("nation", "customer", "supplier"))
    e = lambda df, a, b, kind, c: df.select(F.concat(*a).alias("source"), F.concat(*b).alias("target"), F.lit(kind).alias("kind"), F.lit(c).alias("confidence"))
    key = lambda p, c: (F.lit(p), F.col(c).cast("string"))
    return (
        e(nation, key("r", "n_regionkey"), key("n", "n_nationkey"), "contains", 1.0)
        .unionByName(e(customer, key("n", "c_nationkey"), key("c", "c_custkey"), "contains", 1.0))
        .unionByName(e(supplier, key("s", "s_suppkey"), key("n", "s_nationkey"), "imports", 0.5))
        .unionByName(e(customer.filter("c_custkey % 3 = 0"), key("c", "c_custkey"), key("n", "c_nationkey"), "calls", 0.9))
    )


EDGES_SQL = """
edges AS (
  SELECT 'r' || n_regionkey AS source, 'n' || n_nationkey AS target, 'contains' AS kind, 1.0::DOUBLE AS confidence FROM nation
  UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey, 'contains', 1.0 FROM customer
  UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'imports', 0.5 FROM supplier
  UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 'calls', 0.9 FROM customer WHERE c_custkey % 3 = 0
)"""


def nodes(edge_table: DataFrame) -> DataFrame:
    return edge_table.select(F.explode(F.array("source", "target")).alias("id")).distinct()

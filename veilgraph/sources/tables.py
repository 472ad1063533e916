"""Graphs derived from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilgraph.functions import hashrand
from veilgraph.graph import Graph


def _read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def _pairs(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Distinct pairs of values that share a key, the smaller first."""
    rows = rows.select(key, value).distinct()
    met = rows.alias("x").join(rows.alias("y"), F.col(f"x.{key}") == F.col(f"y.{key}")).where(F.col(f"x.{value}") < F.col(f"y.{value}"))
    return met.select(F.col(f"x.{value}").alias("src"), F.col(f"y.{value}").alias("dst")).distinct()


def part_graph(spark: SparkSession, folder: str, quantity: float = 45) -> Graph:
    """Parts bought in one order, both in lines of this quantity or more."""
    lines = _read(spark, folder, "lineitem").where(F.col("l_quantity") >= quantity)
    return Graph(_read(spark, folder, "part").select(F.col("p_partkey").alias("id")), _pairs(lines, "l_orderkey", "l_partkey"))


def customer_graph(spark: SparkSession, folder: str, quantity: float = 48) -> Graph:
    """Customers who bought one part, both in lines of this quantity or more."""
    lines = _read(spark, folder, "lineitem").where(F.col("l_quantity") >= quantity).select("l_orderkey", "l_partkey")
    bought = lines.join(_read(spark, folder, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    nodes = _read(spark, folder, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"))
    return Graph(nodes, _pairs(bought, "l_partkey", "o_custkey"))


def thinned(graph: Graph, seed: int = 42, tenths: int = 1) -> Graph:
    """The graph without some tenths of its edges, chosen by hash."""
    return graph.with_edges(graph.edges.where(hashrand.integer(seed, "src", "dst") % 10 >= tenths))

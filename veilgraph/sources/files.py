"""Graph files: edge lists, JSON edge lists, GML, and Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilgraph.functions.ordered import numbered
from veilgraph.graph import Graph, canonical
from veilgraph.plans.workspace import materialize


def read_edge_list(spark: SparkSession, path: str, comment: str = "#") -> Graph:
    """Lines of two ids between white space, plain or compressed; comments, loops and repeats go. Ids that are all whole numbers stay; names are numbered."""
    line = F.trim(F.substring_index("value", comment, 1))
    ends = spark.read.text(path).select(F.split(line, r"\s+").alias("f")).where("size(f) >= 2").select(F.get("f", F.lit(0)).alias("src"), F.get("f", F.lit(1)).alias("dst"))
    return _graph(ends)


def read_json_edges(spark: SparkSession, path: str) -> Graph:
    """One JSON list of [u, v]; nodes are 0 to the largest id."""
    edges = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "array<array<bigint>>")).alias("e"))
    edges = materialize(edges.select(F.col("e")[0].alias("src"), F.col("e")[1].alias("dst")))
    top = edges.agg(F.max(F.greatest("src", "dst"))).first()[0]
    return Graph(spark.range(0 if top is None else top + 1), canonical(edges))


def read_gml(spark: SparkSession, path: str) -> Graph:
    """Nodes (id, label) and edges of a GML file; ids are numbered from 0."""
    text = spark.read.text(path, wholetext=True)
    block = lambda kind: F.explode(F.regexp_extract_all("value", F.lit(rf"(?s)\b{kind}\s*\[(.*?)\]"), F.lit(1)))
    field = lambda c, name: F.regexp_extract(c, rf"(?m)\b{name}\s+(-?\d+)", 1).cast("long")
    nodes = text.select(block("node").alias("b")).select(field("b", "id").alias("id"), F.nullif(F.regexp_extract("b", r'\blabel\s+"([^"]*)"', 1), F.lit("")).alias("label"))
    edges = text.select(block("edge").alias("b")).select(field("b", "source").alias("src"), field("b", "target").alias("dst"))
    return Graph(materialize(nodes), canonical(edges)).relabel()[0]


def _graph(ends: DataFrame) -> Graph:
    ends = materialize(ends)
    whole = r"-?\d{1,18}"
    if not ends.where(~(F.col("src").rlike(f"^{whole}$") & F.col("dst").rlike(f"^{whole}$"))).limit(1).count():
        return Graph.from_edges(ends.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")))
    names = materialize(numbered(ends.select(F.col("src").alias("name")).union(ends.select("dst")).distinct(), [F.col("name")], name="id"))
    joined = ends.join(names.select(F.col("name").alias("src"), F.col("id").alias("a")), "src").join(names.select(F.col("name").alias("dst"), F.col("id").alias("b")), "dst")
    return Graph(names.select("id", "name"), canonical(joined, "a", "b"))


def write_graph(graph: Graph, path: str) -> None:
    graph.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    graph.edges.write.mode("overwrite").parquet(f"{path}/edges")


def read_graph(spark: SparkSession, path: str) -> Graph:
    return Graph(spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges"))


def write_edge_list(graph: Graph, path: str, compression: str = "gzip") -> None:
    """Lines of two ids."""
    graph.edges.select(F.concat_ws(" ", "src", "dst")).write.mode("overwrite").option("compression", compression).text(path)

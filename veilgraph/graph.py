"""A graph as two DataFrames.

``nodes`` has one row per node: ``id BIGINT`` and any attribute columns. ``edges`` has each undirected edge once,
``src < dst``, without loops or repeats. Isolated nodes live in ``nodes`` only.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from threading import RLock

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilgraph.functions.ordered import numbered
from veilgraph.plans.workspace import hold, materialize


def canonical(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Each undirected edge once, smaller end first; loops, repeats and rows with a null end go."""
    return edges.select(F.least(src, dst).alias("src"), F.greatest(src, dst).alias("dst"), (F.col(src) != F.col(dst)).alias("_proper")).where("_proper").drop("_proper").distinct()


def flipped(edges: DataFrame) -> DataFrame:
    """Every edge from its other end."""
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def both_ways(edges: DataFrame) -> DataFrame:
    """Each edge in both directions. One pass: a union would compute the edges twice."""
    ways = F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return edges.select(F.explode(ways).alias("way")).select("way.src", "way.dst")


@dataclass(frozen=True)
class Graph:
    nodes: DataFrame
    edges: DataFrame
    _memo: dict = field(default_factory=dict, compare=False, repr=False)

    @classmethod
    def from_edges(cls, edges: DataFrame, nodes: DataFrame | None = None, src: str = "src", dst: str = "dst") -> Graph:
        """A graph of any edge rows; without ``nodes`` the ends of edges (loops included) are the nodes."""
        if nodes is None:
            nodes = edges.select(F.col(src).alias("id")).unionByName(edges.select(F.col(dst).alias("id"))).where("id is not null").distinct()
        return cls(nodes, canonical(edges, src, dst))

    def written(self) -> Graph:
        """The same graph, computed once and read from the shared folder; what is derived from it is kept too."""
        return self if self.kept else Graph(materialize(self.nodes), materialize(self.edges), {"keep": RLock()})

    @property
    def kept(self) -> bool:
        """Whether this graph has been written, so that what is derived from it is kept."""
        return "keep" in self._memo

    def remember(self, key: str, make):
        """``make()``, called once on a written graph, whichever threads ask; a DataFrame that it gives is held."""
        if not self.kept:
            return make()
        with self._memo["keep"]:
            if key not in self._memo:
                found = make()
                self._memo[key] = hold(found) if isinstance(found, DataFrame) else found
            return self._memo[key]

    def with_edges(self, edges: DataFrame) -> Graph:
        """The same nodes and attributes with other edges."""
        return Graph(self.nodes, edges)

    def both_ways(self) -> DataFrame:
        return both_ways(self.edges)

    def count_nodes(self) -> int:
        if "n" not in self._memo:
            self._memo["n"] = self.nodes.count()
        return self._memo["n"]

    def count_edges(self) -> int:
        if "m" not in self._memo:
            self._memo["m"] = self.edges.count()
        return self._memo["m"]

    def degrees(self) -> DataFrame:
        """(id, deg) of every node; isolated nodes have 0."""
        return self.remember("degrees", self._degrees)

    def _degrees(self) -> DataFrame:
        counted = self.both_ways().groupBy(F.col("src").alias("id")).agg(F.count("*").alias("deg"))
        return self.nodes.select("id").join(counted, "id", "left").select("id", F.coalesce("deg", F.lit(0)).cast("long").alias("deg"))

    def validate(self, contiguous: bool = True) -> Graph:
        """Raise ValueError unless ids are unique and not null (and 0 to n-1), and edges proper, single and between nodes."""
        n, distinct, low, high = self.nodes.agg(F.count("*"), F.count_distinct("id"), F.min("id"), F.max("id")).first()
        if n != distinct:
            raise ValueError("node ids must be unique and not null")
        if contiguous and n and (low != 0 or high != n - 1):
            raise ValueError("node ids must be 0 to n - 1; use relabel()")
        improper = self.edges.agg(F.count("*"), F.count_if(F.col("src") < F.col("dst"))).first()
        if improper[0] != improper[1] or self.edges.groupBy("src", "dst").count().where("count > 1").limit(1).count():
            raise ValueError("edges must have src < dst, once each; use Graph.from_edges()")
        if self.both_ways().join(self.nodes, F.col("src") == F.col("id"), "left_anti").limit(1).count():
            raise ValueError("every edge must end in nodes")
        return self

    def relabel(self, order: list[Column] | None = None) -> tuple[Graph, DataFrame]:
        """The graph with ids 0 to n-1 in ``order`` (of attributes and ``old``, the old id; by it if none is given), and (old, id)."""
        renamed = numbered(self.nodes.withColumnRenamed("id", "old"), order or [F.col("old")], name="id")
        renamed = hold(renamed)
        names = renamed.select("old", "id")
        ends = self.edges.join(names.select(F.col("old").alias("src"), F.col("id").alias("a")), "src").join(names.select(F.col("old").alias("dst"), F.col("id").alias("b")), "dst")
        return Graph(renamed.drop("old").select("id", *[c for c in self.nodes.columns if c != "id"]), canonical(ends, "a", "b")), names

    def first_appearance_labels(self, rows: DataFrame, position: str, src: str = "src", dst: str = "dst") -> DataFrame:
        """(old, id): ids in the order in which the ends of ``rows`` first appear, src before dst within a row."""
        seen = rows.select(F.col(src).alias("old"), (F.col(position) * 2).alias("at")).unionByName(rows.select(F.col(dst).alias("old"), (F.col(position) * 2 + 1).alias("at")))
        return numbered(seen.groupBy("old").agg(F.min("at").alias("at")), [F.col("at"), F.col("old")], name="id").select("old", "id")


def dense(df: DataFrame, column: str, name: str) -> DataFrame:
    """``df`` with the rank of ``column`` among its distinct values, from 0."""
    ranks = hold(numbered(df.select(column).distinct(), [F.col(column)], name=name))
    return df.join(ranks, column)


def tagged_union(a: Graph, b: Graph) -> tuple[DataFrame, DataFrame]:
    """Nodes (which, id) and edges in both directions (which, src, dst) of two graphs side by side."""
    nodes = a.nodes.select(F.lit(0).alias("which"), "id").unionByName(b.nodes.select(F.lit(1).alias("which"), "id"))
    edges = a.both_ways().withColumn("which", F.lit(0)).unionByName(b.both_ways().withColumn("which", F.lit(1)))
    return nodes, edges


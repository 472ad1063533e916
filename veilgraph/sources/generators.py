"""Random and regular graphs, from hashes of a seed."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilgraph.functions import hashrand
from veilgraph.functions.ordered import running_sums
from veilgraph.graph import Graph, canonical
from veilgraph.plans.workspace import materialize


#: Pairs up to which each is drawn by itself.
ENUMERATED = 20_000_000


def _pair(position: Column, n: int) -> tuple[Column, Column]:
    """Nodes of the pair at a position among all pairs u < v in order."""
    m = 2.0 * n - 1
    guess = F.floor((F.lit(m) - F.sqrt(F.lit(m * m) - 8 * position.cast("double"))) / 2).cast("long")
    begin = lambda u: F.expr("0L") + F.floor(u * (2 * n - u - 1) / 2)
    u = F.when(begin(guess) > position, guess - 1).when(begin(guess + 1) <= position, guess + 1).otherwise(guess)
    return u, (position - begin(u) + u + 1).cast("long")


def erdos_renyi(spark: SparkSession, n: int, p: float, seed: int = 0) -> Graph:
    """Each pair an edge with probability p. Of many pairs, the number of edges is drawn first and then that many edges, which is the same distribution."""
    pairs = n * (n - 1) // 2
    if pairs > ENUMERATED:
        return gnm(spark, n, int(np.random.default_rng(seed).binomial(pairs, p)), seed)
    chosen = spark.range(pairs).where(hashrand.uniform(seed, "id") < p)
    u, v = _pair(F.col("id"), n)
    return Graph(spark.range(n), chosen.select(u.alias("src"), v.alias("dst")))


def gnm(spark: SparkSession, n: int, m: int, seed: int = 0) -> Graph:
    """m edges, uniformly among all pairs."""
    if m > n * (n - 1) // 2:
        raise ValueError("more edges than pairs")
    from veilgraph.operators.anonymize import RandomEdgeAddDelAnonymizer

    graph = Graph(spark.range(n), spark.createDataFrame([], "src long, dst long"))
    return graph.with_edges(RandomEdgeAddDelAnonymizer.new_edges(graph, graph.edges, 0, m, seed))


def barabasi_albert(spark: SparkSession, n: int, m: int, seed: int = 0) -> Graph:
    """Preferential attachment: each node after a star of the first m + 1 joins m distinct earlier ones in proportion to degree.

    All edges are made at once (Sanders and Schulz, "Scalable generation of scale-free graphs", 2016): an edge's other end is a random place in the list of
    earlier nodes' ends; at an even place stands the node that brings the edge, an odd place is looked up in turn. A look-up of all open places is a
    join, and about half of them are open after it. Edges that meet another of their node draw again, until none do.
    """
    if not 1 <= m < n:
        raise ValueError("m is 1 to n - 1")
    edges = spark.range(m, m + (n - m - 1) * m).select(F.col("id").alias("e"), F.lit(0).alias("turn"))
    while True:
        made = _attached(edges, m, seed)
        again = made.withColumn("nth", F.row_number().over(Window.partitionBy("src", "dst").orderBy("e"))).where("nth > 1").select("e", F.lit(1).alias("more"))
        again = materialize(again)
        if not again.limit(1).count():
            break
        edges = materialize(edges.join(again, "e", "left").select("e", (F.col("turn") + F.coalesce("more", F.lit(0))).alias("turn")))
    star = spark.range(1, m + 1).select(F.lit(0).cast("long").alias("src"), F.col("id").alias("dst"))
    return Graph(spark.range(n), star.unionByName(made.select("src", "dst")))


def _attached(edges: DataFrame, m: int, seed: int) -> DataFrame:
    """(e, src, dst) of edges (e, turn): the ends that their draws lead to. The first m edges are a star around node 0."""
    drawn = hashrand.integer(f"{seed}:end", "e", "turn", digits=13)
    chosen = materialize(edges.select("e", (drawn % (2 * (F.col("e") - F.col("e") % m))).alias("at")))
    brought = lambda e: F.when(e < m, e + 1).otherwise(F.floor((e - m) / m) + m + 1).cast("long")
    found, left = [], chosen.select("e", "at")
    while True:
        e = F.floor(F.col("at") / 2).cast("long")
        known = (F.col("at") % 2 == 0) | (F.col("at") < 2 * m)
        end = F.when(F.col("at") % 2 == 0, brought(e)).otherwise(0).cast("long")
        found.append(left.where(known).select("e", end.alias("src"), brought(F.col("e")).alias("dst")))
        through = left.where(~known).select("e", e.alias("through"))
        left = materialize(through.join(chosen.select(F.col("e").alias("through"), "at"), "through").select("e", "at"))
        if not left.limit(1).count():
            return materialize(reduce(DataFrame.unionByName, found))


def planted_communities(spark: SparkSession, n: int, mean_degree: float, mixing: float, degree_power: float = 2.5, size_power: float = 1.5, min_size: int = 10, seed: int = 0) -> Graph:
    """Communities of power-law sizes, a fifth of the nodes at most, and nodes of power-law degrees; a part ``mixing`` of a node's stubs leaves its community.

    Stubs are matched at random inside the community or over all; loops and repeats go. Nodes carry ``community``. Sizes and degrees are hashes, so tables make all of it.
    """
    power = lambda low, u, exponent: F.lit(float(low)) * F.pow(1 - u, F.lit(-1.0 / exponent))
    drawn = spark.range(-(-n // min_size)).select(F.col("id").alias("community"), F.least(F.floor(power(min_size, hashrand.uniform(f"{seed}:size", "id"), size_power)), F.lit(max(min_size, n // 5))).cast("long").alias("size"))
    placed = running_sums(drawn, "community", ["size"]).select("community", (F.col("cum_size") - F.col("size")).alias("first"), F.least("cum_size", F.lit(n)).alias("upto")).where(F.col("first") < n)
    nodes = placed.select("community", F.explode(F.sequence(F.col("first"), F.col("upto") - 1)).alias("id"))
    low = mean_degree * (degree_power - 2) / (degree_power - 1)
    degree = power(low, hashrand.uniform(f"{seed}:degree", "id"), degree_power - 1)
    nodes = materialize(nodes.select("id", "community", F.least(F.greatest(F.lit(1.0), degree), F.lit(2 * n**0.5)).cast("long").alias("d")))
    stubs = nodes.select("id", "community", F.explode(F.sequence(F.lit(1).cast("long"), F.col("d"))).alias("no"))
    group = F.when(hashrand.uniform(f"{seed}:out", "id", "no") < mixing, F.lit(-1).cast("long")).otherwise(F.col("community"))
    return Graph(nodes.drop("d"), _matched(stubs.select("id", "no", group.alias("group")), seed))


def _matched(stubs: DataFrame, seed: int) -> DataFrame:
    from veilgraph.functions.ordered import numbered

    placed = numbered(stubs.withColumn("h", hashrand.digest(f"{seed}:stub", "id", "no")), [F.col("h"), F.col("id"), F.col("no")], ["group"], "place")
    met = placed.groupBy("group", F.floor(F.col("place") / 2).alias("pair")).agg(F.min("id").alias("src"), F.max("id").alias("dst"))
    return canonical(met)


def path(spark: SparkSession, n: int, first: int = 0) -> Graph:
    """A line of n nodes."""
    return Graph(spark.range(first, first + n), spark.range(first, first + max(0, n - 1)).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst")))


def grid(spark: SparkSession, rows: int, columns: int, first: int = 0) -> Graph:
    """A grid, numbered by rows."""
    nodes = spark.range(rows * columns)
    right = nodes.where(F.col("id") % columns < columns - 1).select((F.col("id") + first).alias("src"), (F.col("id") + first + 1).alias("dst"))
    down = nodes.where(F.col("id") < (rows - 1) * columns).select((F.col("id") + first).alias("src"), (F.col("id") + first + columns).alias("dst"))
    return Graph(nodes.select((F.col("id") + first).alias("id")), right.unionByName(down))


def compose(*graphs: Graph) -> Graph:
    """All nodes and edges of several graphs; equal ids are one node."""
    nodes, edges = graphs[0].nodes.select("id"), graphs[0].edges
    for g in graphs[1:]:
        nodes, edges = nodes.unionByName(g.nodes.select("id")), edges.unionByName(g.edges)
    return Graph(nodes.distinct(), canonical(edges))


def two_grids(spark: SparkSession) -> Graph:
    """Two 4 x 4 grids joined by a path of ten nodes: 42 nodes, 59 edges."""
    link = spark.createDataFrame([(15, 16), (25, 26)], "src long, dst long")
    return compose(grid(spark, 4, 4), path(spark, 10, 16), grid(spark, 4, 4, 26), Graph.from_edges(link))

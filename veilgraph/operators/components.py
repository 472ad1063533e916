"""Connected components by alternating large-star and small-star steps.

Each step keeps connectivity and moves every node's links towards the smallest
node it knows; the links become one star per component after O(log^2 n) steps
(Kiveris et al., "Connected Components in MapReduce and Beyond", 2014). Nothing
is collected: a step is a grouped minimum with map-side combine, and a join of
two written tables on the node, whose large partitions adaptive execution can
split, so the centre of a star holding most of the links is no bottleneck.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilgraph.plans.workspace import discard, materialize


def _star(links: DataFrame, rows: int, large: bool) -> DataFrame:
    """One star step over ``rows`` links (a, b) with a > b."""
    if large:
        ways = F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))
        around = links.select(F.explode(ways).alias("way")).select("way.u", "way.v")
    else:
        around = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    # written before the join, so that the join has an exchange on either side and its large partitions can be split
    least = materialize(around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), 2 * rows)
    joined = around.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    stepped = materialize(out.where("a <> b").distinct(), 2 * rows)
    discard(least)
    return stepped


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) for every node that has an edge to another; component is the smallest node id.

    Rows with a null end and loops are dropped; repeated and reversed edges
    count once. A node without edges does not appear: join from the node list.
    """
    links = materialize(
        edges.where(F.col(src) != F.col(dst)).select(F.greatest(src, dst).alias("a"), F.least(src, dst).alias("b")).distinct()
    )
    state = _state(links)
    while state[0]:
        big = _star(links, state[0], large=True)
        small = _star(big, 2 * state[0], large=False)
        after = _state(small)
        discard(links, big)
        links = small
        if after == state:
            break
        state = after
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )

"""Weisfeiler-Lehman colours.

A round gives two nodes one colour if they had one colour and equal multisets of neighbours' colours. A multiset is
summed up as four sums of 31-bit hashes of its members (with the own colour, 124 bits), so
that hubs are added up with map-side combine and no list of neighbours is ever held. A colour is a pair
of 64-bit hashes until the caller asks for names. Graphs held as arrays are compared in numpy, by two sums of 64 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilgraph.graph import Graph
from veilgraph.operators.centrality import Arrays, own_arrays
from veilgraph.plans.workspace import discard, hold, materialize


def _parts(a: Column, b: Column) -> list[Column]:
    h, g = F.xxhash64(F.lit(1), a, b), F.xxhash64(F.lit(2), b, a)
    low = lambda x: x.bitwiseAND(F.lit((1 << 31) - 1))
    return [low(h), low(F.shiftrightunsigned(h, 32)), low(g), low(F.shiftrightunsigned(g, 32))]


def refine(labels: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """One round: (keys, a, b) from ``labels`` (keys, a, b) over ``edges`` (other keys, src, dst); the last key is the node id."""
    *group, node = keys
    seen = edges.join(labels.withColumnRenamed(node, "dst"), [*group, "dst"])
    sums = [F.sum(p).alias(f"s{i}") for i, p in enumerate(_parts(F.col("a"), F.col("b")))]
    around = seen.groupBy(*group, F.col("src").alias(node)).agg(*sums, F.count("*").alias("s4"))
    joined = labels.join(around, keys, "left")
    state = [F.col("a"), F.col("b"), *(F.coalesce(f"s{i}", F.lit(0)) for i in range(5))]
    return joined.select(*keys, F.xxhash64(F.lit(3), *state).alias("a"), F.xxhash64(F.lit(4), *reversed(state)).alias("b"))


def start(nodes: DataFrame, keys: list[str], initial: str | None = None) -> DataFrame:
    """Colours of round 0: one for all, or by the column ``initial``."""
    return nodes.select(*keys, *((F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b")) if initial is None else (F.xxhash64(F.lit(5), initial).alias("a"), F.xxhash64(F.lit(6), initial).alias("b"))))


def colour_rounds(graph: Graph, max_iter: int = 200, initial: DataFrame | None = None) -> list[DataFrame]:
    """Labellings (id, a, b) of rounds 0, 1, ...: at most ``max_iter``, and no further than colours keep splitting.

    ``initial`` has (id, color).
    """
    if max_iter <= 0:
        raise ValueError("max_iter must be positive")
    edges = hold(graph.both_ways())
    nodes = graph.nodes.select("id") if initial is None else graph.nodes.select("id").join(initial.select("id", "color"), "id")
    labels = materialize(start(nodes, ["id"], None if initial is None else "color"))
    out, colours = [labels], labels.select("a", "b").distinct().count()
    while len(out) < max_iter:
        labels = materialize(refine(labels, edges, ["id"]))
        split = labels.select("a", "b").distinct().count()
        if split <= colours:
            discard(labels)
            break
        out.append(labels)
        colours = split
    return out


def named(labels: DataFrame) -> DataFrame:
    """(id, color): colours named by their smallest node id."""
    names = hold(labels.groupBy("a", "b").agg(F.min("id").alias("color")))
    return labels.join(names, ["a", "b"]).select("id", "color")


def wl_colors(graph: Graph, rounds: int, initial: DataFrame | None = None) -> DataFrame:
    """(id, color) after ``rounds`` rounds, or earlier where colours stop splitting."""
    return named(colour_rounds(graph, rounds + 1, initial)[-1])


def wl_table(graph: Graph, max_iter: int = 200) -> DataFrame:
    """(round, id, color) of all rounds."""
    rounds = [named(labels).select(F.lit(i).alias("round"), "id", "color") for i, labels in enumerate(colour_rounds(graph, max_iter))]
    out = rounds[0]
    for r in rounds[1:]:
        out = out.unionByName(r)
    return out


def canonical_labels(colors: DataFrame) -> DataFrame:
    """(id, label): colours as 0, 1, ... in the order of their smallest id."""
    from veilgraph.functions.ordered import numbered

    firsts = hold(numbered(colors.groupBy("color").agg(F.min("id").alias("first")), [F.col("first")], name="label").select("color", "label"))
    return colors.join(firsts, "color").select("id", "label")


def combine(a: DataFrame, b: DataFrame) -> DataFrame:
    """(id, color): one colour per pair of colours in two labellings (id, color), named by its smallest id."""
    both = a.join(b.select("id", F.col("color").alias("other")), "id")
    names = hold(both.groupBy("color", "other").agg(F.min("id").alias("name")))
    return both.join(names, ["color", "other"]).select("id", F.col("name").alias("color"))


def wl_directed(nodes: DataFrame, arcs: DataFrame, rounds: int) -> DataFrame:
    """(id, color) after refining by in- and by out-neighbours of directed ``arcs`` (src, dst) in every round."""
    labels = materialize(start(nodes.select("id"), ["id"]))
    back = arcs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    for _ in range(rounds):
        out, into = refine(labels, arcs, ["id"]), refine(labels, back, ["id"])
        labels = materialize(out.join(into.select("id", F.col("a").alias("c"), F.col("b").alias("d")), "id").select("id", F.xxhash64("a", "c").alias("a"), F.xxhash64("d", "b").alias("b")))
    return named(labels)


def wl_distance(first: Graph, second: Graph, depth: int) -> DataFrame:
    """(dist): total variation between the two graphs' colours after ``depth`` rounds on their disjoint union."""
    from veilgraph.functions.distances import distribution_gap
    from veilgraph.graph import tagged_union

    mine = own_arrays(first), own_arrays(second)
    if all(g is not None and g.n for g in mine):
        return first.nodes.sparkSession.createDataFrame(pa.table({"dist": [distance_between(*mine, depth)]}))
    nodes, edges = tagged_union(first, second)
    edges = hold(edges)
    labels = materialize(start(nodes, ["which", "id"]))
    for _ in range(depth):
        labels = materialize(refine(labels, edges, ["which", "id"]))
    counted = labels.groupBy("a", "b").agg(F.count_if(F.col("which") == 0).alias("p"), F.count_if(F.col("which") == 1).alias("q"))
    return distribution_gap(counted)


def _mixed(x: np.ndarray, salt: int) -> np.ndarray:
    """64-bit hashes of numbers (the finalizer of splitmix64)."""
    x = x.astype(np.uint64) + np.uint64(salt * 0x9E3779B97F4A7C15 % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def distance_between(first: Arrays, second: Arrays, depth: int) -> float:
    """The same of two graphs as arrays, both with nodes."""
    graphs = [(first, slice(0, first.n)), (second, slice(first.n, first.n + second.n))]
    colour = np.zeros(first.n + second.n, np.int64)
    for _ in range(depth):
        sums = [_mixed(colour, 1), _mixed(colour, 2)]
        for total, salt in zip(sums, (3, 4), strict=True):
            each = _mixed(colour, salt)
            for g, part in graphs:
                linked = np.flatnonzero(g.degree)
                if len(linked):
                    total[part][linked] += np.add.reduceat(each[part][g.dst], g.first[linked])
        order = np.argsort(sums[0])
        a, b = (s[order] for s in sums)
        if ((a[1:] == a[:-1]) & (b[1:] != b[:-1])).any():
            order = np.lexsort(sums)
            a, b = (s[order] for s in sums)
        colour[order] = np.concatenate(([0], np.cumsum((a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
    p, q = (np.bincount(colour[part], minlength=colour.max() + 1) / g.n for g, part in graphs)
    return float(np.abs(p - q).sum() / 2)


def equal_labellings(a: DataFrame, b: DataFrame) -> bool:
    """Whether two labellings (id, color) split the nodes alike and name classes alike."""
    from veilgraph.operators.structure import differing

    return not differing(a.select("id", "color"), b.select("id", "color")).limit(1).count()

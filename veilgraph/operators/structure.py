"""Degrees, triangles, clustering, joint degrees and set measures of graphs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilgraph.graph import Graph
from veilgraph.operators.centrality import VALUES, Arrays, dealt, own_arrays, small
from veilgraph.operators.components import connected_components
from veilgraph.plans.workspace import hold

#: Wedges up to which the triangles of a graph that is held as arrays are found in numpy; more are joined.
WEDGES = 1 << 25
#: Wedges that numpy closes at a time.
CLOSED = 1 << 21


def degree_stats(graph: Graph) -> DataFrame:
    """(max_degree, median_degree, mean_degree) in one pass; null without nodes."""
    arrays = own_arrays(graph)
    if arrays is not None and arrays.n:
        found = arrays.degree.max(), float(np.median(arrays.degree)), arrays.degree.sum() / arrays.n
        return dealt(graph.nodes.sparkSession, "max_degree long, median_degree double, mean_degree double", *(np.array([x]) for x in found))
    return graph.degrees().agg(F.max("deg").alias("max_degree"), F.median("deg").alias("median_degree"), F.avg("deg").alias("mean_degree"))


def degree_histogram(graph: Graph) -> DataFrame:
    """(deg, cnt)."""
    return graph.degrees().groupBy("deg").agg(F.count("*").alias("cnt"))


def triangles(graph: Graph) -> DataFrame:
    """(a, b, c): each triangle once.

    Edges point from the end with the smaller (degree, id), so that no node has more than about sqrt(2E)
    edges out of it and the wedges that are closed number at most E**1.5, hubs or not.
    """
    deg = graph.degrees()
    ends = graph.edges.join(deg.select(F.col("id").alias("src"), F.col("deg").alias("ds")), "src").join(deg.select(F.col("id").alias("dst"), F.col("deg").alias("dd")), "dst")
    forward = F.struct("ds", "src") < F.struct("dd", "dst")
    out = hold(ends.select(F.when(forward, F.col("src")).otherwise(F.col("dst")).alias("u"), F.when(forward, F.col("dst")).otherwise(F.col("src")).alias("v")))
    wedges = out.alias("x").join(out.alias("y"), F.col("x.u") == F.col("y.u")).where("x.v < y.v").select(F.col("x.u").alias("a"), F.col("x.v").alias("b"), F.col("y.v").alias("c"))
    closing = graph.edges.select(F.col("src").alias("b"), F.col("dst").alias("c"))
    return wedges.join(closing, ["b", "c"], "left_semi").select("a", "b", "c")


def corners(arrays: Arrays) -> np.ndarray | None:
    """How many triangles each node is in, by closing the same wedges as ``triangles``; None where they are over ``WEDGES``."""
    degree, src, dst = arrays.degree, arrays.src, arrays.dst
    forward = (degree[src] < degree[dst]) | (degree[src] == degree[dst]) & (src < dst)
    u, v = src[forward], dst[forward]
    later = np.cumsum(np.bincount(u, minlength=arrays.n))[u] - np.arange(len(u)) - 1  # edges out of the same node that follow an edge
    upto = np.concatenate(([0], np.cumsum(later)))
    if upto[-1] > WEDGES:
        return None
    edges, found, begin = (src * arrays.n + dst)[src < dst], np.zeros(arrays.n, np.int64), 0
    while begin < len(u):
        end = max(begin + 1, int(np.searchsorted(upto, upto[begin] + CLOSED, "right")) - 1)
        x = np.repeat(np.arange(begin, end), later[begin:end])
        y = x + 1 + np.arange(len(x)) - np.repeat(upto[begin:end] - upto[begin], later[begin:end])
        key = np.minimum(v[x], v[y]) * arrays.n + np.maximum(v[x], v[y])
        closed = edges[np.minimum(np.searchsorted(edges, key), len(edges) - 1)] == key
        for corner in (u[x[closed]], v[x[closed]], v[y[closed]]):
            found += np.bincount(corner, minlength=arrays.n)
        begin = end
    return found


def _clustering_arrays(graph: Graph) -> tuple[Arrays, np.ndarray, np.ndarray] | None:
    """A small graph's arrays, the triangles at its nodes and their clustering, if it keeps them."""
    arrays = own_arrays(graph)
    tri = None if arrays is None or not arrays.n else graph.remember("corners", lambda: corners(arrays))
    return None if tri is None else (arrays, tri, 2 * tri / np.maximum(arrays.degree * (arrays.degree - 1), 1))


def triangles_per_node(graph: Graph) -> DataFrame:
    """(id, deg, tri, clustering): clustering is 2 tri / (deg (deg - 1)), 0 for degrees under 2."""
    return graph.remember("clustering", lambda: _triangles_per_node(graph))


def local_clustering(graph: Graph) -> DataFrame:
    """(id, val): the clustering of each node."""
    mine = _clustering_arrays(graph)
    if mine is not None:
        return dealt(graph.nodes.sparkSession, VALUES, mine[0].ids, mine[2])
    return triangles_per_node(graph).select("id", F.col("clustering").alias("val"))


def _triangles_per_node(graph: Graph) -> DataFrame:
    counted = triangles(graph).select(F.explode(F.array("a", "b", "c")).alias("id")).groupBy("id").agg(F.count("*").alias("tri"))
    joined = graph.degrees().join(counted, "id", "left").withColumn("tri", F.coalesce("tri", F.lit(0)))
    wedges = F.col("deg") * (F.col("deg") - 1)
    return joined.withColumn("clustering", F.when(F.col("deg") < 2, F.lit(0.0)).otherwise(2 * F.col("tri") / F.nullif(wedges, F.lit(0))))


def clustering_summary(graph: Graph) -> DataFrame:
    """(triangles, avg_clustering, transitivity) from one triangle listing."""
    mine = _clustering_arrays(graph)
    if mine is not None:
        arrays, tri, clustering = mine
        found = tri.sum() / 3, clustering.sum() / arrays.n, 2 * tri.sum() / max(1, (arrays.degree * (arrays.degree - 1)).sum())
        return dealt(graph.nodes.sparkSession, "triangles double, avg_clustering double, transitivity double", *(np.array([x]) for x in found))
    per = triangles_per_node(graph)
    wedges = F.sum(F.col("deg") * (F.col("deg") - 1))
    return per.agg(
        (F.sum("tri") / 3).alias("triangles"),
        F.avg("clustering").alias("avg_clustering"),
        F.coalesce(2 * F.sum("tri") / F.nullif(wedges, F.lit(0)), F.lit(0.0)).alias("transitivity"),
    )


def components(graph: Graph) -> DataFrame:
    """(id, component): the smallest node id of each node's component, isolated nodes included.

    A small graph is labelled in numpy by passing on least labels and then labels of labels; a larger one by star steps over tables.
    """
    arrays = small(graph)
    if arrays is not None:
        return dealt(graph.nodes.sparkSession, "id long, component long", arrays.ids, arrays.ids[arrays.component])
    found = connected_components(graph.edges).withColumnRenamed("node", "id")
    return graph.nodes.select("id").join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def count_components(graph: Graph) -> int:
    """How many components there are; isolated nodes are components."""
    arrays = small(graph)
    if arrays is not None:
        return int((arrays.component == np.arange(arrays.n)).sum())
    return components(graph).where("id = component").count()


def joint_degrees(graph: Graph) -> DataFrame:
    """(k1, k2, cnt) with k1 <= k2: edges by the degrees of their ends."""
    deg = graph.degrees()
    ends = graph.edges.join(deg.select(F.col("id").alias("src"), F.col("deg").alias("ds")), "src").join(deg.select(F.col("id").alias("dst"), F.col("deg").alias("dd")), "dst")
    return ends.groupBy(F.least("ds", "dd").alias("k1"), F.greatest("ds", "dd").alias("k2")).agg(F.count("*").alias("cnt"))


def edge_jaccard(a: Graph, b: Graph) -> DataFrame:
    """(jaccard): common edges by all edges; null without edges. One shuffle by edge; of graphs held as arrays, a sort of both."""
    mine = own_arrays(a), own_arrays(b)
    if all(g is not None and len(g.src) for g in mine):
        ids = np.union1d(mine[0].ids, mine[1].ids)
        x, y = (_edge_keys(g, ids) for g in mine)
        common = len(np.intersect1d(x, y, assume_unique=True))
        return dealt(a.nodes.sparkSession, "jaccard double", np.array([common / (len(x) + len(y) - common)]))
    sides = a.edges.select("src", "dst", F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(b.edges.select("src", "dst", F.lit(0).alias("a"), F.lit(1).alias("b")))
    merged = sides.groupBy("src", "dst").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    return merged.agg((F.sum(F.col("a") * F.col("b")) / F.nullif(F.count("*"), F.lit(0))).alias("jaccard"))


def _edge_keys(arrays: Arrays, ids: np.ndarray) -> np.ndarray:
    """A number for each edge, ascending, by the places of its ends in ``ids``."""
    once, place = arrays.src < arrays.dst, np.searchsorted(ids, arrays.ids)
    keys = place[arrays.src[once]] * len(ids) + place[arrays.dst[once]]
    return keys[np.concatenate((keys[:1] == keys[:1], keys[1:] != keys[:-1]))]


def edge_difference(a: Graph, b: Graph) -> DataFrame:
    """(side, src, dst): edges of only one of two graphs."""
    return a.edges.join(b.edges, ["src", "dst"], "left_anti").withColumn("side", F.lit("a")).unionByName(b.edges.join(a.edges, ["src", "dst"], "left_anti").withColumn("side", F.lit("b"))).select("side", "src", "dst")


def differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that two tables of the same columns don't hold equally often. One pass over each."""
    both = a.withColumn("_n", F.lit(1)).unionByName(b.withColumn("_n", F.lit(-1)))
    return both.groupBy(*a.columns).agg(F.sum("_n").alias("_n")).where("_n <> 0").drop("_n")


def k_degree_fraction(graph: Graph, k: int) -> DataFrame:
    """(fraction) of nodes whose degree at least k nodes have."""
    arrays = own_arrays(graph)
    if arrays is not None and arrays.n:
        count = np.bincount(arrays.degree)
        return dealt(graph.nodes.sparkSession, "fraction double", np.array([count[count >= k].sum() / arrays.n]))
    hist = degree_histogram(graph)
    return hist.agg((F.sum(F.when(F.col("cnt") >= k, F.col("cnt")).otherwise(0)) / F.nullif(F.sum("cnt"), F.lit(0))).alias("fraction"))


def erdos_gallai(degrees: DataFrame) -> bool:
    """Whether some simple graph has these degrees (column ``deg``): an even sum, and no k highest ask for more than the rest can give.

    Works on the histogram: the inequality need only hold where the sorted degree sequence drops.
    """
    rows = degrees.groupBy("deg").agg(F.count("*").alias("cnt")).orderBy(F.desc("deg")).toPandas()  # one row per degree
    if rows.empty:
        return True
    if (rows.deg < 0).any() or int((rows.deg * rows.cnt).sum()) % 2:
        return False
    k, left = 0, 0
    for i in range(len(rows)):
        k += int(rows.cnt[i])
        left += int(rows.cnt[i]) * int(rows.deg[i])
        rest = rows.iloc[i + 1 :]
        if left > k * (k - 1) + int((rest.cnt * rest.deg.clip(upper=k)).sum()):
            return False
    return True

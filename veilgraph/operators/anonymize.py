"""Anonymisers: a graph in, a graph out.

All share ``anonymize(graph, random_seed)``; without a seed, 0 is used, so that every run can be repeated. Node
attributes stay wherever the node set does.
"""

from __future__ import annotations

from abc import ABC, abstractmethod

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilgraph.functions import hashrand
from veilgraph.functions.ordered import numbered
from veilgraph.graph import Graph, canonical
from veilgraph.operators import kdegree, optimisers
from veilgraph.operators.centrality import KERNEL_EDGES, Arrays, dealt, eigenvector, small
from veilgraph.operators.clustering import line_cluster, pool_adjacent
from veilgraph.operators.rewiring import rewire
from veilgraph.operators.structure import joint_degrees
from veilgraph.operators.wl import colour_rounds, equal_labellings, named
from veilgraph.plans.workspace import hold, materialize


class AbstractAnonymizer(ABC):
    """Subclass and implement ``anonymize`` to add a method."""

    @abstractmethod
    def anonymize(self, graph: Graph, random_seed: int | None = None) -> Graph: ...


def _seed(random_seed: int | None) -> int:
    return 0 if random_seed is None else int(random_seed)


def _arrays(graph: Graph, what: str) -> Arrays:
    arrays = small(graph)
    if arrays is None:
        raise ValueError(f"{what} is sequential and takes at most {KERNEL_EDGES} nodes and edges")
    return arrays


def _colors(graph: Graph, arrays: Arrays, color: np.ndarray) -> DataFrame:
    return dealt(graph.nodes.sparkSession, "id long, color long", arrays.ids, np.asarray(color, np.int64))


class ConfigurationModelAnonymizer(AbstractAnonymizer):
    """A random graph on the degrees dealt anew to the nodes; parallel edges collapse and loops go."""

    def anonymize(self, graph: Graph, random_seed: int | None = None) -> Graph:
        seed = _seed(random_seed)
        degrees = hold(graph.degrees())
        giving = numbered(degrees.withColumn("h", hashrand.digest(f"{seed}:give", "id")), [F.col("h"), F.col("id")], name="place").select("place", "deg")
        taking = numbered(degrees.select("id", hashrand.digest(f"{seed}:take", "id").alias("h")), [F.col("h"), F.col("id")], name="place").select("place", "id")
        dealt = taking.join(giving, "place").where("deg > 0")
        stubs = dealt.select("id", F.explode(F.sequence(F.lit(1).cast("long"), F.col("deg"))).alias("stub"))
        placed = hold(numbered(stubs.withColumn("h", hashrand.digest(f"{seed}:stub", "id", "stub")), [F.col("h"), F.col("id"), F.col("stub")], name="place").select("place", "id"))
        half = graph.count_edges()
        met = placed.groupBy((F.col("place") % max(1, half)).alias("edge")).agg(F.min("id").alias("src"), F.max("id").alias("dst"))
        return graph.with_edges(canonical(met))


class RandomEdgeAddDelAnonymizer(AbstractAnonymizer):
    """Deletes ``m`` random edges (all, if there are fewer), then adds as many random ones as fit; deleted ones may come back."""

    def __init__(self, m: int):
        self.m = m

    def anonymize(self, graph: Graph, random_seed: int | None = None) -> Graph:
        if self.m < 0:
            raise ValueError("m must not be negative")
        if self.m == 0:
            return graph
        seed, n, edges = _seed(random_seed), graph.count_nodes(), graph.count_edges()
        kept = materialize(self.delete(graph, seed))
        left = edges - min(self.m, edges)
        need = min(self.m, n * (n - 1) // 2 - left)
        return graph.with_edges(materialize(kept.unionByName(self.new_edges(graph, kept, left, need, seed))))

    def delete(self, graph: Graph, seed: int) -> DataFrame:
        """Edges but the ``m`` of the least hash."""
        placed = numbered(graph.edges.select("src", "dst", hashrand.digest(f"{seed}:delete", "src", "dst").alias("h")), [F.col("h"), F.col("src"), F.col("dst")], name="place")
        return placed.where(F.col("place") >= self.m).select("src", "dst")

    @staticmethod
    def new_edges(graph: Graph, kept: DataFrame, left: int, need: int, seed: int) -> DataFrame:
        """``need`` edges that ``kept`` doesn't have: the first of a stream of random pairs, or of all pairs by hash where most are needed."""
        spark, n = graph.nodes.sparkSession, graph.count_nodes()
        every = n * (n - 1) // 2
        names = hold(numbered(graph.nodes.select("id"), [F.col("id")], name="at"))
        if need <= 0:
            return kept.limit(0)
        if 2 * (left + need) > every:  # pair p of n nodes by its row, without a join
            row = F.floor((F.lit(2.0 * n - 1) - F.sqrt(F.lit((2.0 * n - 1) ** 2) - 8 * F.col("p"))) / 2)
            begin = row * (2 * n - row - 1) / 2
            row = F.when(begin > F.col("p"), row - 1).when((row + 1) * (2 * n - row - 2) / 2 <= F.col("p"), row + 1).otherwise(row).cast("long")
            pairs = spark.range(every).withColumnRenamed("id", "p").select(F.col("p").alias("turn"), row.alias("u"), "p")
            pairs = pairs.select(F.col("p").alias("turn"), "u", (F.col("p") - F.col("u") * (2 * n - F.col("u") - 1) / 2 + F.col("u") + 1).cast("long").alias("v"))
        else:
            count, rounds = int(need * 2.5) + 64, 1
            pairs = spark.range(count * rounds).select(F.col("id").alias("turn"), (hashrand.integer(f"{seed}:u", "id", digits=13) % n).alias("u"), (hashrand.integer(f"{seed}:v", "id", digits=13) % n).alias("v")).where("u <> v")
        low = names.select(F.col("at").alias("u"), F.col("id").alias("a"))
        high = names.select(F.col("at").alias("v"), F.col("id").alias("b"))
        met = pairs.join(low, "u").join(high, "v").select("turn", F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"))
        fresh = met.join(kept, ["src", "dst"], "left_anti").groupBy("src", "dst").agg(F.min("turn").alias("turn"))
        order = [F.col("turn")] if 2 * (left + need) <= every else [hashrand.digest(f"{seed}:add", "src", "dst")]
        ordered = hold(numbered(fresh.withColumn("h", order[0]), [F.col("h"), F.col("src"), F.col("dst")], name="place"))
        if ordered.count() < need:  # very unlikely: the stream held too many repeats
            return RandomEdgeAddDelAnonymizer.new_edges(graph, kept, left, need, seed + 1_000_003)
        return ordered.where(F.col("place") < need).select("src", "dst")


class KDegreeAnonymizer(AbstractAnonymizer):
    """Each degree shared by ``k`` nodes at least; original edges first. ``exact`` uses true group costs in place of the published recurrence."""

    def __init__(self, k: int, noise: int = 10, with_deletions: bool = True, exact: bool = False):
        if k < 1:
            raise ValueError("k must be positive")
        self.k, self.noise, self.with_deletions, self.exact = k, noise, with_deletions, exact

    def anonymize(self, graph: Graph, random_seed: int | None = None) -> Graph:
        g = _arrays(graph, "k-degree anonymity")
        near = [set(g.dst[g.first[v] : g.first[v] + g.degree[v]].tolist()) for v in range(g.n)]
        edges = kdegree.k_degree_edges(g.degree, near, self.k, self.noise, self.with_deletions, self.exact, _seed(random_seed))
        pairs = np.array(sorted(edges), np.int64).reshape(-1, 2)
        frame = pd.DataFrame({"src": g.ids[pairs[:, 0]], "dst": g.ids[pairs[:, 1]]})
        return graph.with_edges(graph.nodes.sparkSession.createDataFrame(frame, "src long, dst long"))


def anonymise_degree_sequence(graph: Graph, k: int, deletions: bool = True, exact: bool = False) -> DataFrame:
    """(id, deg, target): degrees with k equals each at least, by dynamic programming over the whole descending sequence, in one task whose memory is a few numbers a node."""
    placed = numbered(graph.degrees(), [F.col("deg").desc(), F.col("id").desc()], name="place")

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("place")
        return pd.DataFrame({"id": frame["id"], "deg": frame["deg"], "target": kdegree.anonymise_degrees(frame["deg"].to_numpy(), k, deletions, exact)})

    return placed.withColumn("part", F.col("place") * 0).groupBy("part").applyInPandas(solve, "id long, deg long, target long")


class NestModelAnonymizer(AbstractAnonymizer):
    """Rewiring inside Weisfeiler-Lehman colours, so that colours to ``depth`` rounds stay; ``parallel`` swaps in rounds over all executors."""

    def __init__(self, depth: int, r=1, parallel: bool = False):
        if depth <= 0:
            raise ValueError("depth must be positive")
        self.depth, self.r, self.parallel = depth, r, parallel

    def anonymize(self, graph: Graph, random_seed: int | None = None, initial_colors: DataFrame | None = None) -> Graph:
        labels = colour_rounds(graph, self.depth, initial_colors)[-1]
        return rewire(graph, hold(named(labels)), self.r, _seed(random_seed), parallel=self.parallel)


def validate_nest(graph: Graph, other: Graph, depth: int, initial_colors: DataFrame | None = None) -> bool:
    """Whether two graphs have the same WL colours, node by node, after ``depth`` rounds."""
    from veilgraph.operators.wl import refine, start

    def colours(g: Graph) -> DataFrame:
        labels = start(g.nodes.select("id") if initial_colors is None else g.nodes.select("id").join(initial_colors, "id"), ["id"], None if initial_colors is None else "color")
        for _ in range(depth):
            labels = materialize(refine(labels, g.both_ways(), ["id"]))
        return named(labels)

    return equal_labellings(colours(graph), colours(other))


class VariantNestModelAnonymizer(AbstractAnonymizer):
    """Rewiring inside ``k`` clusters of the eigenvector centrality: optimal medians (mode 1) or means (mode 2) on the line."""

    def __init__(self, k: int, min_cluster_size: int = 0, mode: int = 2, r=1, parallel: bool = False):
        if k <= 0:
            raise ValueError("k must be positive")
        if mode not in (1, 2):
            raise ValueError("mode is 1 (medians) or 2 (means)")
        self.k, self.min_cluster_size, self.mode, self.r, self.parallel = k, min_cluster_size, mode, r, parallel

    def colours(self, graph: Graph) -> DataFrame:
        g = _arrays(graph, "clustering on the line")
        values = eigenvector(graph).toPandas().sort_values("id")["val"].round(12).to_numpy()
        return _colors(graph, g, line_cluster(values, self.k, self.mode == 1, self.min_cluster_size))

    def anonymize(self, graph: Graph, random_seed: int | None = None) -> Graph:
        return rewire(graph, self.colours(graph), self.r, _seed(random_seed), parallel=self.parallel)


class PygmalionModelAnonymizer(AbstractAnonymizer):
    """A random graph on the joint degree counts with Laplace noise for ``eps`` differential privacy. Its nodes are new.

    Counts are smoothed to stay ascending; loops stay unless ``drop_loops``.
    """

    def __init__(self, eps: float, drop_loops: bool = False):
        if eps <= 0:
            raise ValueError("eps must be positive")
        self.eps, self.drop_loops = eps, drop_loops

    def noisy_counts(self, graph: Graph, seed: int) -> DataFrame:
        """(k1, k2, cnt, noisy): noisy is rounded half to even. One row per pair of degrees."""
        counts = joint_degrees(graph).withColumn("cnt", F.col("cnt").cast("double"))
        scale = (4.0 * (F.greatest("k1", "k2") - 1) + 1) / F.lit(float(self.eps))
        rows = counts.withColumn("moved", F.col("cnt") + hashrand.laplace(f"{seed}:noise", scale, "k1", "k2")).toPandas().sort_values(["cnt", "k1", "k2"])
        rows["noisy"] = np.rint(pool_adjacent(rows["moved"].to_numpy())).astype(np.int64)
        return graph.nodes.sparkSession.createDataFrame(rows[["k1", "k2", "cnt", "noisy"]], "k1 long, k2 long, cnt double, noisy long")

    @staticmethod
    def pseudograph(counts: DataFrame, seed: int) -> Graph:
        """A graph of edges (k1, k2, noisy): stubs of one degree, in random order, are cut into nodes of that many; the last may be short."""
        edges = counts.where("noisy > 0").select("k1", "k2", F.explode(F.sequence(F.lit(1).cast("long"), F.col("noisy"))).alias("no"))
        edge = F.concat_ws(":", "k1", "k2", "no")
        stubs = edges.select(edge.alias("edge"), F.explode(F.array(F.struct(F.col("k1").alias("k"), F.lit(0).alias("end")), F.struct(F.col("k2").alias("k"), F.lit(1).alias("end")))).alias("s")).select("edge", "s.k", "s.end")
        placed = hold(numbered(stubs.withColumn("h", hashrand.digest(f"{seed}:stub", "edge", "end")), [F.col("h"), F.col("edge"), F.col("end")], ["k"], "place"))
        owned = placed.withColumn("slot", F.floor(F.col("place") / F.col("k")))
        nodes = hold(numbered(owned.select("k", "slot").distinct(), [F.col("k"), F.col("slot")], name="id"))
        ends = owned.join(nodes, ["k", "slot"]).groupBy("edge").agg(F.min("id").alias("src"), F.max("id").alias("dst"))
        return Graph(nodes.select("id"), ends.select("src", "dst").distinct())

    def anonymize(self, graph: Graph, random_seed: int | None = None) -> Graph:
        out = self.pseudograph(self.noisy_counts(graph, _seed(random_seed)), _seed(random_seed))
        return Graph(out.nodes, out.edges.where("src <> dst")) if self.drop_loops else out


class PrivateColorAnonymizer(AbstractAnonymizer):
    """Rewiring inside colours that trade Katz utility against privacy, from clusterings on the line or from local search."""

    def __init__(self, w: float, alpha: float = 0.1, is_eager: bool = True, use_optimal1d: bool = True, beta: float = 1.0, r: int = 10):
        self.w, self.alpha, self.beta, self.is_eager, self.use_optimal1d, self.r = w, alpha, beta, is_eager, use_optimal1d, r

    def colours(self, graph: Graph, seed: int = 0) -> DataFrame:
        g = _arrays(graph, "the search for colours")
        if self.use_optimal1d:
            return _colors(graph, g, optimisers.optimal_line(g, self.w, True, self.alpha, self.beta))
        return _colors(graph, g, optimisers.local_search(g, self.w, self.alpha, self.beta, self.is_eager, seed))

    def anonymize(self, graph: Graph, random_seed: int | None = None, colors: DataFrame | None = None) -> Graph:
        """``colors`` (id, color) are those of ``colours``, if they have been found already."""
        return rewire(graph, self.colours(graph, _seed(random_seed)) if colors is None else colors, self.r, _seed(random_seed))


class SoftColorAnonymizer(AbstractAnonymizer):
    """Rewiring inside colours found by gradient descent on soft assignments; options go to ``optimisers.SoftColours``."""

    def __init__(self, k: int, w: float, r: int = 10, seed: int = 0, **options):
        self.k, self.w, self.r, self.seed, self.options = k, w, r, seed, options

    def anonymize(self, graph: Graph, random_seed: int | None = None) -> Graph:
        seed = self.seed if random_seed is None else random_seed
        g = _arrays(graph, "soft assignment")
        color = optimisers.SoftColours(g, self.k, self.w, seed=seed, **self.options).fit()
        return rewire(graph, _colors(graph, g, color), self.r, seed)


class PrivateClosenessColors(AbstractAnonymizer):
    """Rewiring inside colours merged while closeness and privacy gain; for graphs of some dozens of nodes."""

    def __init__(self, w: float, closeness_samples: int = 100, r: int = 10):
        self.w, self.closeness_samples, self.r = w, closeness_samples, r

    def anonymize(self, graph: Graph, random_seed: int | None = None) -> Graph:
        g = _arrays(graph, "merging by closeness")
        color = optimisers.closeness_colours(g, self.w, self.closeness_samples, self.r, _seed(random_seed))
        return rewire(graph, _colors(graph, g, color), self.r, _seed(random_seed))

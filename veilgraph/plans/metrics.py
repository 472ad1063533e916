"""Metrics of an original and an anonymised graph, and an evaluator that runs several.

Scalar metrics give both graphs' values; node metrics the distance of the two distributions of node
values; others a single distance. A new metric is a subclass with ``compute_scalar``, ``compute_node_distribution`` or ``evaluate``.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame

from veilgraph.functions.distances import wasserstein
from veilgraph.graph import Graph
from veilgraph.operators import centrality, structure, wl


def _begin(pool: ThreadPoolExecutor, graph: Graph, f, *args):
    """``f(*args)`` in a thread of ``pool``."""
    spark = graph.nodes.sparkSession
    inherit = inheritable_thread_target(spark)  # job groups hold in threads too; gives the session back where threads aren't told apart
    return pool.submit(f if inherit is spark else inherit(f), *args)


class AbstractMetric(ABC):
    #: Whether an evaluator begins it before others, as it takes the longest.
    first = False

    @abstractmethod
    def evaluate(self, graph: Graph, anonymized: Graph):
        """A number, or a dict of both graphs' numbers."""


class AbstractGraphMetric(AbstractMetric):
    """One number per graph."""

    @abstractmethod
    def compute_scalar(self, graph: Graph): ...

    def evaluate(self, graph: Graph, anonymized: Graph) -> dict:
        return {"G": self.compute_scalar(graph), "Ga": self.compute_scalar(anonymized)}


class AbstractNodeMetric(AbstractMetric):
    """A distance between the two distributions of a node value (id, val)."""

    @abstractmethod
    def compute_node_distribution(self, graph: Graph) -> DataFrame: ...

    def distribution_distance_func(self, p: DataFrame, q: DataFrame):
        """Wasserstein; override for another."""
        return wasserstein(p, q).first()[0]

    def evaluate(self, graph: Graph, anonymized: Graph):
        return self.distribution_distance_func(self.compute_node_distribution(graph), self.compute_node_distribution(anonymized))


class NumberOfNodesMetric(AbstractGraphMetric):
    def compute_scalar(self, graph: Graph):
        return graph.count_nodes()


class NumberOfEdgesMetric(AbstractGraphMetric):
    def compute_scalar(self, graph: Graph):
        return graph.count_edges()


class ConnectedComponentsMetric(AbstractGraphMetric):
    def compute_scalar(self, graph: Graph):
        return structure.count_components(graph)


class MaxDegreeMetric(AbstractGraphMetric):
    def compute_scalar(self, graph: Graph):
        return structure.degree_stats(graph).first()["max_degree"]


class MedianDegreeMetric(AbstractGraphMetric):
    def compute_scalar(self, graph: Graph):
        return structure.degree_stats(graph).first()["median_degree"]


class MeanDegreeMetric(AbstractGraphMetric):
    def compute_scalar(self, graph: Graph):
        return structure.degree_stats(graph).first()["mean_degree"]


class NumberOfTrianglesMetric(AbstractGraphMetric):
    def compute_scalar(self, graph: Graph):
        return structure.clustering_summary(graph).first()["triangles"]


class AverageClusteringCoefficientMetric(AbstractGraphMetric):
    def compute_scalar(self, graph: Graph):
        return structure.clustering_summary(graph).first()["avg_clustering"]


class TransitivityMetric(AbstractGraphMetric):
    def compute_scalar(self, graph: Graph):
        return structure.clustering_summary(graph).first()["transitivity"]


class DegreeCentralityMetric(AbstractNodeMetric):
    def compute_node_distribution(self, graph: Graph) -> DataFrame:
        return centrality.degree_centrality(graph)


class LocalClusteringCoefficientMetric(AbstractNodeMetric):
    def compute_node_distribution(self, graph: Graph) -> DataFrame:
        return structure.local_clustering(graph)


class _CentralityMetric(AbstractNodeMetric):
    """Options go to the centrality."""

    function = None

    def __init__(self, **options):
        self.options = options

    def compute_node_distribution(self, graph: Graph) -> DataFrame:
        return type(self).function(graph, **self.options)


class EigenvectorMetric(_CentralityMetric):
    function = staticmethod(centrality.eigenvector)


class KatzCentralityMetric(_CentralityMetric):
    function = staticmethod(centrality.katz)


class PageRankMetric(_CentralityMetric):
    function = staticmethod(centrality.pagerank)


class ClosenessCentralityMetric(_CentralityMetric):
    """Of both graphs at a time: while the executors search one, the other is made ready."""

    first = True
    function = staticmethod(centrality.closeness)

    def evaluate(self, graph: Graph, anonymized: Graph):
        with ThreadPoolExecutor(1) as pool:
            other = _begin(pool, graph, self.compute_node_distribution, anonymized)
            return self.distribution_distance_func(self.compute_node_distribution(graph), other.result())


class WLColorMetric(AbstractMetric):
    """Total variation distance of the colours after ``depth`` rounds."""

    def __init__(self, depth: int):
        self.depth = depth

    def evaluate(self, graph: Graph, anonymized: Graph):
        return wl.wl_distance(graph, anonymized, self.depth).first()[0]


class EdgeJaccardMetric(AbstractMetric):
    def evaluate(self, graph: Graph, anonymized: Graph):
        return structure.edge_jaccard(graph, anonymized).first()[0]


class PercentageKDegreeAnonMetric(AbstractGraphMetric):
    """The fraction, 0 to 1, of nodes that share their degree with k - 1 others or more."""

    def __init__(self, k: int):
        self.k = k

    def compute_scalar(self, graph: Graph):
        return structure.k_degree_fraction(graph, self.k).first()[0]


def _ready(graph: Graph) -> Graph:
    """The graph written, and collected if it is small."""
    graph = graph.written()
    centrality.small(graph)
    return graph


#: Metrics that an evaluator runs at a time.
THREADS = 4


class Evaluator:
    """Runs a dict of metrics over graphs that are written once first, some at a time: while one works on the driver, others use the executors."""

    def __init__(self, metrics: dict[str, AbstractMetric], use_igraph: bool = False):
        self.metrics = metrics  # there is one representation of graphs, so ``use_igraph`` changes nothing

    def evaluate(self, graph: Graph, anonymized: Graph) -> dict:
        with ThreadPoolExecutor(THREADS) as pool:
            graph, anonymized = (each.result() for each in [_begin(pool, g, _ready, g) for g in (graph, anonymized)])
            found = {name: _begin(pool, graph, metric.evaluate, graph, anonymized) for name, metric in sorted(self.metrics.items(), key=lambda named: not named[1].first)}
            try:
                return {name: found[name].result() for name in self.metrics}
            finally:  # after an error, what hasn't begun isn't begun
                for each in found.values():
                    each.cancel()

    def table(self, graph: Graph, anonymized: Graph) -> DataFrame:
        """(metric, g, ga, dist): scalar metrics fill g and ga, others dist."""
        rows = []
        for name, found in self.evaluate(graph, anonymized).items():
            pair = found if isinstance(found, dict) else {}
            number = lambda x: None if x is None else float(x)
            rows.append((name, number(pair.get("G")), number(pair.get("Ga")), None if pair else number(found)))
        return graph.nodes.sparkSession.createDataFrame(rows, "metric string, g double, ga double, dist double")

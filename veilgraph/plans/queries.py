"""Registered queries of the graph engine over graphs derived from the tables.

G is the part graph, Ga the same without the tenth of its edges that a hash picks, C the customer graph. Floating results are
rounded, as sums come in any order.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilgraph.functions.distances import total_variation, wasserstein
from veilgraph.functions.ordered import numbered
from veilgraph.graph import Graph, both_ways, canonical, dense
from veilgraph.operators import anonymize, centrality, colours, rewiring, structure, wl
from veilgraph.operators.components import connected_components
from veilgraph.plans import metrics, reports
from veilgraph.plans.workspace import materialize, shared_root
from veilgraph.sources import files, generators
from veilgraph.sources.tables import customer_graph, part_graph, thinned

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _g(spark, folder) -> Graph:
    g = part_graph(spark, folder)
    return Graph(g.nodes, materialize(g.edges))


def _both(spark, folder) -> tuple[Graph, Graph]:
    g = _g(spark, folder)
    return g, thinned(g)


def _c(spark, folder) -> Graph:
    g = customer_graph(spark, folder)
    return Graph(g.nodes, materialize(g.edges))


def _by_degree(g: Graph) -> DataFrame:
    return materialize(g.degrees().withColumnRenamed("deg", "color"))


def _rounded(df: DataFrame, *columns: str, digits: int = 9) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) for c in columns})


# sources, projections, validation


@query
def edges_canonical(spark: SparkSession, folder: str) -> DataFrame:
    return part_graph(spark, folder).edges


@query
def edges_both_ways(spark: SparkSession, folder: str) -> DataFrame:
    return both_ways(part_graph(spark, folder).edges)


@query
def canonical_from_raw_pairs(spark: SparkSession, folder: str) -> DataFrame:
    lines = spark.read.parquet(f"{folder}/lineitem.parquet")
    return canonical(lines.select((F.col("l_partkey") % 500).alias("a"), (F.col("l_suppkey") * 7 % 500).alias("b")), "a", "b")


@query
def relabel_by_name(spark: SparkSession, folder: str) -> DataFrame:
    names = spark.read.parquet(f"{folder}/customer.parquet").select("c_name")
    return numbered(names, [F.col("c_name")], name="id")


@query
def first_appearance_labels(spark: SparkSession, folder: str) -> DataFrame:
    rows = spark.read.parquet(f"{folder}/orders.parquet").select(F.col("o_orderkey").alias("at"), F.col("o_custkey").alias("src"), (F.col("o_custkey") * 3 % 1000).alias("dst"))
    return Graph.from_edges(rows).first_appearance_labels(rows, "at")


@query
def dense_colors(spark: SparkSession, folder: str) -> DataFrame:
    return dense(spark.read.parquet(f"{folder}/part.parquet").select(F.col("p_partkey").alias("id"), "p_brand"), "p_brand", "color").select("id", "color")


@query
def validation_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Counts of the graph with ids from 0, as ``validate`` lets it through, and whether it refuses one with an edge to a node that isn't there."""
    g = _g(spark, folder).relabel()[0].validate()
    astray = Graph(g.nodes, g.edges.unionByName(spark.range(1).select(F.lit(-1).cast("long").alias("src"), F.col("id").alias("dst"))))
    try:
        astray.validate()
        refused = False
    except ValueError:
        refused = True
    found = g.nodes.agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"), F.min("id").alias("low"), F.max("id").alias("high"))
    return found.withColumns({"edges": F.lit(g.count_edges()), "refused": F.lit(refused)})


@query
def generated_random_graph(spark: SparkSession, folder: str) -> DataFrame:
    return generators.erdos_renyi(spark, 200, 0.05, 7).edges


@query
def generated_two_grids(spark: SparkSession, folder: str) -> DataFrame:
    return generators.two_grids(spark).degrees()


@query
def generated_gnm(spark: SparkSession, folder: str) -> DataFrame:
    return generators.gnm(spark, 300, 500, 8).edges


@query
def generated_preferential(spark: SparkSession, folder: str) -> DataFrame:
    return generators.barabasi_albert(spark, 400, 1, 5).edges


@query
def generated_preferential_degrees(spark: SparkSession, folder: str) -> DataFrame:
    """Of 200 nodes bringing 3 edges each: their number, and that no node has fewer."""
    g = generators.barabasi_albert(spark, 200, 3, 5).validate()
    return g.degrees().agg(F.count("*").alias("nodes"), F.sum("deg").alias("ends"), (F.min("deg") >= 1).alias("joined"), F.count_if((F.col("id") > 3) & (F.col("deg") < 3)).alias("short"))


@query
def generated_communities(spark: SparkSession, folder: str) -> DataFrame:
    """Edges with the communities of both ends."""
    g = generators.planted_communities(spark, 500, 6.0, 0.2, seed=3)
    ends = g.nodes.select(F.col("id").alias("src"), F.col("community").alias("c1")), g.nodes.select(F.col("id").alias("dst"), F.col("community").alias("c2"))
    return g.edges.join(ends[0], "src").join(ends[1], "dst")


def _path(spark) -> str:
    return f"{shared_root(spark)}/veilgraph/files-{uuid.uuid4().hex}"


@query
def edge_list_read(spark: SparkSession, folder: str) -> DataFrame:
    """Written as compressed lines and read again."""
    path = _path(spark)
    files.write_edge_list(part_graph(spark, folder), path)
    return files.read_edge_list(spark, path).edges


@query
def json_edges_read(spark: SparkSession, folder: str) -> DataFrame:
    path = _path(spark)
    pairs = F.to_json(F.sort_array(F.collect_list(F.array("src", "dst"))))
    part_graph(spark, folder).edges.agg(pairs.alias("value")).write.text(path)
    return files.read_json_edges(spark, path).edges


@query
def gml_read(spark: SparkSession, folder: str) -> DataFrame:
    """Degrees by the label of the nodes, which are numbered anew."""
    path, g = _path(spark), part_graph(spark, folder)
    line = lambda *parts: F.concat(*(F.lit(p) if i % 2 == 0 else F.col(p).cast("string") for i, p in enumerate(parts)))
    nodes = g.nodes.agg(F.array_join(F.sort_array(F.collect_list(line('  node [\n    id ', "id", '\n    label "p', "id", '"\n  ]\n'))), "").alias("n"))
    edges = g.edges.agg(F.array_join(F.sort_array(F.collect_list(line("  edge [\n    source ", "src", "\n    target ", "dst", "\n  ]\n"))), "").alias("e"))
    nodes.join(edges).select(F.concat(F.lit("graph [\n"), "n", "e", F.lit("]\n")).alias("value")).write.text(path)
    read = files.read_gml(spark, path)
    return read.degrees().join(read.nodes, "id").select("label", "deg")


@query
def graph_written_and_read(spark: SparkSession, folder: str) -> DataFrame:
    path = _path(spark)
    files.write_graph(_c(spark, folder), path)
    return files.read_graph(spark, path).degrees()


@query
def edges_oriented(spark: SparkSession, folder: str) -> DataFrame:
    """By size of the part, then by brand, then as they are."""
    parts = spark.read.parquet(f"{folder}/part.parquet")
    labellings = [parts.select(F.col("p_partkey").alias("id"), F.col(c).alias("color")) for c in ("p_size", "p_brand")]
    return rewiring.oriented(part_graph(spark, folder).edges, labellings)


# scalar metrics


@query
def num_nodes_edges(spark: SparkSession, folder: str) -> DataFrame:
    g, ga = _both(spark, folder)
    one = lambda x, name: x.nodes.agg(F.lit(name).alias("graph"), F.lit("nodes").alias("what"), F.count("*").alias("n")).unionByName(x.edges.agg(F.lit(name).alias("graph"), F.lit("edges").alias("what"), F.count("*").alias("n")))
    return one(g, "G").unionByName(one(ga, "Ga"))


@query
def degrees(spark: SparkSession, folder: str) -> DataFrame:
    return part_graph(spark, folder).degrees()


@query
def degree_histogram(spark: SparkSession, folder: str) -> DataFrame:
    return structure.degree_histogram(part_graph(spark, folder))


@query
def degree_stats(spark: SparkSession, folder: str) -> DataFrame:
    g, ga = _both(spark, folder)
    return _rounded(structure.degree_stats(g).withColumn("graph", F.lit("G")).unionByName(structure.degree_stats(ga).withColumn("graph", F.lit("Ga"))), "mean_degree")


@query
def triangles(spark: SparkSession, folder: str) -> DataFrame:
    return structure.triangles(_g(spark, folder)).select(F.array_sort(F.array("a", "b", "c")).alias("t")).select(F.col("t")[0].alias("x"), F.col("t")[1].alias("y"), F.col("t")[2].alias("z"))


@query
def local_clustering(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(structure.triangles_per_node(_g(spark, folder)), "clustering")


@query
def clustering_summary(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(structure.clustering_summary(_c(spark, folder)), "triangles", "avg_clustering", "transitivity")


@query
def components(spark: SparkSession, folder: str) -> DataFrame:
    return structure.components(_g(spark, folder))


@query
def components_by_stars(spark: SparkSession, folder: str) -> DataFrame:
    """The form for graphs of any size."""
    return connected_components(_g(spark, folder).edges)


@query
def component_count(spark: SparkSession, folder: str) -> DataFrame:
    return components(spark, folder).agg(F.count_distinct("component").alias("components"))


# node metrics


@query
def degree_centrality_w1(spark: SparkSession, folder: str) -> DataFrame:
    g, ga = _both(spark, folder)
    return _rounded(wasserstein(centrality.degree_centrality(g), centrality.degree_centrality(ga)), "dist", digits=12)


@query
def clustering_w1(spark: SparkSession, folder: str) -> DataFrame:
    g, ga = _both(spark, folder)
    values = [structure.triangles_per_node(x).select(F.col("clustering").alias("val")) for x in (g, ga)]
    return _rounded(wasserstein(*values), "dist")


STEPS = 10


@query
def pagerank(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(centrality.pagerank(_c(spark, folder)), "val", digits=10)


@query
def katz(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(centrality.katz(_c(spark, folder)), "val", digits=10)


@query
def eigenvector(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(centrality.eigenvector(_c(spark, folder)), "val", digits=10)


@query
def katz_vector(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(centrality.katz_vector(_c(spark, folder), alpha=0.05), "val", digits=9)


@query
def pagerank_by_joins(spark: SparkSession, folder: str) -> DataFrame:
    """The form for graphs of any size; this and the next two take a few steps of the same kind."""
    return _rounded(centrality.pagerank(_c(spark, folder), max_iter=STEPS, tol=0, by_joins=True), "val", digits=10)


@query
def katz_by_joins(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(centrality.katz(_c(spark, folder), max_iter=STEPS, tol=0, by_joins=True), "val", digits=10)


@query
def eigenvector_by_joins(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(centrality.eigenvector(_c(spark, folder), max_iter=STEPS, tol=0, by_joins=True), "val", digits=10)


@query
def closeness(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(centrality.closeness(_g(spark, folder)), "val")


def _w1(spark, folder, function, **options) -> DataFrame:
    c = _c(spark, folder)
    return _rounded(wasserstein(function(c, **options), function(thinned(c), **options)), "dist", digits=10)


@query
def pagerank_w1(spark: SparkSession, folder: str) -> DataFrame:
    return _w1(spark, folder, centrality.pagerank)


@query
def katz_w1(spark: SparkSession, folder: str) -> DataFrame:
    return _w1(spark, folder, centrality.katz)


@query
def eigenvector_w1(spark: SparkSession, folder: str) -> DataFrame:
    return _w1(spark, folder, centrality.eigenvector)


@query
def closeness_w1(spark: SparkSession, folder: str) -> DataFrame:
    g, ga = _both(spark, folder)
    return _rounded(wasserstein(centrality.closeness(g), centrality.closeness(ga)), "dist", digits=9)


# colours


@query
def wl_colors_d1(spark: SparkSession, folder: str) -> DataFrame:
    return wl.wl_colors(_g(spark, folder), 1)


@query
def wl_colors_d2(spark: SparkSession, folder: str) -> DataFrame:
    return wl.wl_colors(_g(spark, folder), 2)


@query
def wl_canonical_labels(spark: SparkSession, folder: str) -> DataFrame:
    return wl.canonical_labels(wl.wl_colors(_g(spark, folder), 2))


@query
def wl_combined(spark: SparkSession, folder: str) -> DataFrame:
    g = _g(spark, folder)
    types = dense(spark.read.parquet(f"{folder}/part.parquet").select(F.col("p_partkey").alias("id"), "p_size"), "p_size", "color").select("id", "color")
    return wl.combine(_by_degree(g), types)


@query
def wl_tvd_d2(spark: SparkSession, folder: str) -> DataFrame:
    g, ga = _both(spark, folder)
    return _rounded(wl.wl_distance(g, ga, 2), "dist")


@query
def degree_tvd(spark: SparkSession, folder: str) -> DataFrame:
    g, ga = _both(spark, folder)
    return _rounded(total_variation(g.degrees(), ga.degrees(), ["deg"]), "dist")


@query
def color_degree(spark: SparkSession, folder: str) -> DataFrame:
    g = _c(spark, folder)
    return colours.colour_degrees(g, _by_degree(g))


@query
def color_histogram_directed(spark: SparkSession, folder: str) -> DataFrame:
    """Neighbours by segment of customers; arcs go from the smaller id."""
    g = _c(spark, folder)
    colors = g.nodes.select("id", F.col("segment").alias("color"))
    return colours.colour_histogram(g, colors, g.edges)


@query
def distinct_colors(spark: SparkSession, folder: str) -> DataFrame:
    g = _g(spark, folder)
    return wl.wl_table(g, 4).groupBy("round").agg(F.count_distinct("color").alias("colors"))


@query
def wl_directed_d2(spark: SparkSession, folder: str) -> DataFrame:
    g = _g(spark, folder)
    return wl.wl_directed(g.nodes, g.edges, 2)


@query
def nest_validated(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the colours to depth 1 are alike in a graph and its NeSt sample, and in a graph and one without some edges."""
    g = _g(spark, folder)
    h = anonymize.NestModelAnonymizer(1, 1, parallel=True).anonymize(g, 2)
    return spark.createDataFrame([(anonymize.validate_nest(g, h, 1), anonymize.validate_nest(g, thinned(g), 1))], "sampled boolean, thinned boolean")


@query
def color_pair_totals(spark: SparkSession, folder: str) -> DataFrame:
    g = _c(spark, folder)
    return colours.colour_pairs(g, _by_degree(g))


@query
def joint_degree_matrix(spark: SparkSession, folder: str) -> DataFrame:
    return structure.joint_degrees(_c(spark, folder))


@query
def privacy_loss(spark: SparkSession, folder: str) -> DataFrame:
    g = _c(spark, folder)
    return _rounded(colours.privacy_loss(g, _by_degree(g)), "loss", "multi", digits=6)


@query
def utility_loss_katz(spark: SparkSession, folder: str) -> DataFrame:
    g = _c(spark, folder)
    return _rounded(colours.katz_loss(centrality.katz(g, alpha=0.05, max_iter=STEPS, tol=0, normalized=False), _by_degree(g)), "loss", digits=6)


@query
def utility_loss_short_term(spark: SparkSession, folder: str) -> DataFrame:
    g = _c(spark, folder)
    return _rounded(colours.short_term_loss(g, _by_degree(g)), "loss", digits=6)


@query
def suboptimality_gap(spark: SparkSession, folder: str) -> DataFrame:
    g = _c(spark, folder)
    return _rounded(colours.evaluate_colouring(g, _by_degree(g), 0.01, use_katz_utility=False), "utility", "privacy", "total", "gap", digits=6)


@query
def equivalence_class_stats(spark: SparkSession, folder: str) -> DataFrame:
    g = _g(spark, folder)
    return _rounded(colours.equivalence_stats(g, _by_degree(g)), "mean_guess", "mean_guess_without_singletons", "mean_size")


# privacy


@query
def edge_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(structure.edge_jaccard(*_both(spark, folder)), "jaccard")


@query
def edge_difference(spark: SparkSession, folder: str) -> DataFrame:
    return structure.edge_difference(*_both(spark, folder))


@query
def k_degree_fraction(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(structure.k_degree_fraction(_g(spark, folder), 20), "fraction")


@query
def erdos_gallai(spark: SparkSession, folder: str) -> DataFrame:
    return spark.createDataFrame([(structure.erdos_gallai(_c(spark, folder).degrees()),)], "graphical boolean")


# anonymisers


@query
def random_edge_del(spark: SparkSession, folder: str) -> DataFrame:
    return anonymize.RandomEdgeAddDelAnonymizer(100).delete(_g(spark, folder), 5)


@query
def random_edge_add_del(spark: SparkSession, folder: str) -> DataFrame:
    return anonymize.RandomEdgeAddDelAnonymizer(100).anonymize(_g(spark, folder), 5).edges


@query
def configuration_model(spark: SparkSession, folder: str) -> DataFrame:
    return anonymize.ConfigurationModelAnonymizer().anonymize(_g(spark, folder), 3).edges


@query
def pygmalion_pseudograph(spark: SparkSession, folder: str) -> DataFrame:
    counts = structure.joint_degrees(_g(spark, folder)).withColumnRenamed("cnt", "noisy")
    return anonymize.PygmalionModelAnonymizer.pseudograph(counts, 4).edges


@query
def pygmalion_counts(spark: SparkSession, folder: str) -> DataFrame:
    return anonymize.PygmalionModelAnonymizer(1.0).noisy_counts(_g(spark, folder), 4)


@query
def pygmalion(spark: SparkSession, folder: str) -> DataFrame:
    return anonymize.PygmalionModelAnonymizer(1.0).anonymize(_g(spark, folder), 4).edges


@query
def edge_blocks(spark: SparkSession, folder: str) -> DataFrame:
    g = _g(spark, folder)
    return rewiring.blocks(rewiring.coloured(g.edges, _by_degree(g)))


@query
def rewire_round(spark: SparkSession, folder: str) -> DataFrame:
    g = _c(spark, folder)
    return rewiring.rewire_rounds(g, _by_degree(g), 1, 9).edges


@query
def configuration_sample(spark: SparkSession, folder: str) -> DataFrame:
    g = _c(spark, folder)
    return rewiring.sample_configuration(g, _by_degree(g), 2)


@query
def nest_rewired_edges(spark: SparkSession, folder: str) -> DataFrame:
    return anonymize.NestModelAnonymizer(2, 1, parallel=True).anonymize(_g(spark, folder), 1).edges


@query
def ccm_rewired_edges(spark: SparkSession, folder: str) -> DataFrame:
    g = _c(spark, folder)
    return rewiring.rewire(g, _by_degree(g), 1, 6, parallel=True).edges


def _changes(before: Graph, after: Graph, colors: DataFrame) -> DataFrame:
    """What an anonymiser is to keep, and that it moved at least an edge in fifty (an edge at least)."""
    after = Graph(after.nodes, materialize(after.edges)).validate(contiguous=False)
    moved = after.edges.join(before.edges, ["src", "dst"], "left_anti").count()
    changed = rewiring.colour_degree_changes(before, after, colors).count()
    wl2 = wl.equal_labellings(before.degrees().withColumnRenamed("deg", "color"), after.degrees().withColumnRenamed("deg", "color"))
    return before.nodes.sparkSession.createDataFrame(
        [(after.count_nodes(), after.count_edges(), wl2, changed, moved >= max(1, before.count_edges() // 50))], "nodes long, edges long, degrees_kept boolean, color_degrees_changed long, moved boolean"
    )


@query
def nest_changes(spark: SparkSession, folder: str) -> DataFrame:
    """The chain of swaps in each block."""
    g = _g(spark, folder)
    return _changes(g, anonymize.NestModelAnonymizer(2, 2).anonymize(g, 1), wl.wl_colors(g, 1))


@query
def ccm_changes(spark: SparkSession, folder: str) -> DataFrame:
    g = _c(spark, folder)
    colors = _by_degree(g)
    return _changes(g, rewiring.rewire(g, colors, (1, 3), 6), colors)


@query
def variant_nest_changes(spark: SparkSession, folder: str) -> DataFrame:
    g, method = _c(spark, folder), anonymize.VariantNestModelAnonymizer(20)
    return _changes(g, method.anonymize(g, 1), materialize(method.colours(g)))


@query
def private_color_changes(spark: SparkSession, folder: str) -> DataFrame:
    g, method = _c(spark, folder), anonymize.PrivateColorAnonymizer(0.001, alpha=0.03)
    colors = materialize(method.colours(g))  # one search serves the rewiring and what is checked of it
    return _changes(g, method.anonymize(g, 1, colors), colors)


@query
def optimal1d_colors(spark: SparkSession, folder: str) -> DataFrame:
    return anonymize.PrivateColorAnonymizer(0.001, alpha=0.03).colours(_c(spark, folder))


@query
def k_degree_sequence(spark: SparkSession, folder: str) -> DataFrame:
    return anonymize.anonymise_degree_sequence(_c(spark, folder), 10)


@query
def k_degree_sequence_additions(spark: SparkSession, folder: str) -> DataFrame:
    return anonymize.anonymise_degree_sequence(_c(spark, folder), 10, deletions=False)


@query
def k_degree_sequence_exact(spark: SparkSession, folder: str) -> DataFrame:
    return anonymize.anonymise_degree_sequence(_c(spark, folder), 10, exact=True)


@query
def k_degree_anonymous(spark: SparkSession, folder: str) -> DataFrame:
    """All nodes share their degree with nine others, and edges changed; the original wasn't so."""
    g = _c(spark, folder)
    out = anonymize.KDegreeAnonymizer(10).anonymize(g, 1).validate(contiguous=False)
    new, old = out.edges.join(g.edges, ["src", "dst"], "left_anti").count(), g.edges.join(out.edges, ["src", "dst"], "left_anti").count()
    before = structure.k_degree_fraction(g, 10).first()[0]
    return structure.k_degree_fraction(out, 10).withColumns({"nodes": F.lit(out.count_nodes()), "changed": F.lit(new + old > 0 or before == 1)})


@query
def local_search_colors(spark: SparkSession, folder: str) -> DataFrame:
    """On the two grids: local search is for small graphs."""
    g = generators.two_grids(spark)
    return anonymize.PrivateColorAnonymizer(0.01, is_eager=True, use_optimal1d=False).colours(g)


@query
def soft_color_changes(spark: SparkSession, folder: str) -> DataFrame:
    """On the two grids; degrees are kept, edges move."""
    g = generators.two_grids(spark)
    return _changes(g, anonymize.SoftColorAnonymizer(6, 0.01, max_epochs=200).anonymize(g, 1), g.nodes.select("id", F.lit(0).alias("color")))


@query
def closeness_color_changes(spark: SparkSession, folder: str) -> DataFrame:
    """On a path of 8 nodes."""
    g = generators.path(spark, 8)
    return _changes(g, anonymize.PrivateClosenessColors(0.5, closeness_samples=2, r=2).anonymize(g, 1), g.nodes.select("id", F.lit(0).alias("color")))


# evaluation and reports


@query
def evaluator_report(spark: SparkSession, folder: str) -> DataFrame:
    g = part_graph(spark, folder).written()
    found = metrics.Evaluator(
        {
            "nodes": metrics.NumberOfNodesMetric(),
            "edges": metrics.NumberOfEdgesMetric(),
            "components": metrics.ConnectedComponentsMetric(),
            "max_degree": metrics.MaxDegreeMetric(),
            "median_degree": metrics.MedianDegreeMetric(),
            "mean_degree": metrics.MeanDegreeMetric(),
            "triangles": metrics.NumberOfTrianglesMetric(),
            "avg_clustering": metrics.AverageClusteringCoefficientMetric(),
            "transitivity": metrics.TransitivityMetric(),
            "degree_w1": metrics.DegreeCentralityMetric(),
            "clustering_w1": metrics.LocalClusteringCoefficientMetric(),
            "eigenvector_w1": metrics.EigenvectorMetric(),
            "katz_w1": metrics.KatzCentralityMetric(),
            "pagerank_w1": metrics.PageRankMetric(),
            "closeness_w1": metrics.ClosenessCentralityMetric(),
            "wl_2": metrics.WLColorMetric(2),
            "jaccard": metrics.EdgeJaccardMetric(),
            "k_degree_20": metrics.PercentageKDegreeAnonMetric(20),
        }
    ).table(g, thinned(g))
    return _rounded(found, "g", "ga", "dist")


def _samples(spark, folder) -> DataFrame:
    return spark.read.parquet(f"{folder}/lineitem.parquet").select((F.col("l_linenumber") % 4).alias("seed"), F.col("l_returnflag").alias("method"), F.col("l_linestatus").alias("metric"), F.col("l_quantity").alias("value"))


@query
def sample_mean_relstd(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(reports.summary(_samples(spark, folder)), "mean", "rel_std")


@query
def metric_pivot(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(reports.wide(_samples(spark, folder), ["F", "O"]), "F", "O")


@query
def metric_unpivot(spark: SparkSession, folder: str) -> DataFrame:
    return reports.long(metric_pivot(spark, folder), ["method"], ["F", "O"])


@query
def average_ranks(spark: SparkSession, folder: str) -> DataFrame:
    parts = spark.read.parquet(f"{folder}/part.parquet").select("p_partkey", "p_brand", "p_size")
    return parts.withColumn("place", reports.average_rank(["p_brand"], "p_size"))


@query
def best_methods(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(reports.best(_samples(spark, folder), 2), "mean")


@query
def relative_values(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(reports.relative(_samples(spark, folder), "N").groupBy("method", "metric").agg(F.sum("ratio").alias("ratio")), "ratio", digits=5)


@query
def outliers_masked(spark: SparkSession, folder: str) -> DataFrame:
    return reports.without_outliers(_samples(spark, folder), 30).groupBy("method").agg(F.count("value").alias("n"), F.count("*").alias("all"))


@query
def weighted_means(spark: SparkSession, folder: str) -> DataFrame:
    lines = spark.read.parquet(f"{folder}/lineitem.parquet")
    return _rounded(reports.weighted_mean(lines, ["l_returnflag"], "l_discount", "l_quantity"), "mean")


@query
def group_means(spark: SparkSession, folder: str) -> DataFrame:
    table = reports.with_group_mean(_samples(spark, folder), ["method", "metric"])
    return _rounded(table.groupBy("method", "metric").agg(F.max("group_mean").alias("group_mean"), F.count("*").alias("n")), "group_mean")


@query
def sample_description(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(reports.describe(_samples(spark, folder)), "mean", "std", "q25", "q50", "q75")


@query
def methods_renamed(spark: SparkSession, folder: str) -> DataFrame:
    return reports.renamed(_samples(spark, folder), {"A": "accepted", "R": "returned"}).groupBy("method").agg(F.count("*").alias("n"))


@query
def metrics_arranged(spark: SparkSession, folder: str) -> DataFrame:
    """Rows by a list of keys, one of which the table doesn't have."""
    return reports.arranged(metric_pivot(spark, folder), "method", ["R", "X", "A"])


@query
def metrics_transposed(spark: SparkSession, folder: str) -> DataFrame:
    return reports.transposed(metric_pivot(spark, folder), "method", ["A", "N", "R"])


@query
def report_latex(spark: SparkSession, folder: str) -> DataFrame:
    regions = spark.read.parquet(f"{folder}/region.parquet").select("r_regionkey", "r_name").orderBy("r_regionkey")
    return spark.createDataFrame([(reports.latex(regions),)], "latex string")

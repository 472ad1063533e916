"""Statistics and losses of node colourings (id, color)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilgraph.graph import Graph
from veilgraph.plans.workspace import hold


def colour_degrees(graph: Graph, colors: DataFrame) -> DataFrame:
    """(id, color, deg): neighbours of each node by their colour."""
    ends = graph.both_ways().join(colors.select(F.col("id").alias("dst"), "color"), "dst")
    return ends.groupBy(F.col("src").alias("id"), "color").agg(F.count("*").alias("deg"))


def colour_pairs(graph: Graph, colors: DataFrame) -> DataFrame:
    """(c1, c2, m): edge ends from colour c1 to colour c2 (an edge within a colour counts twice)."""
    ends = graph.both_ways().join(colors.select(F.col("id").alias("src"), F.col("color").alias("c1")), "src").join(colors.select(F.col("id").alias("dst"), F.col("color").alias("c2")), "dst")
    return ends.groupBy("c1", "c2").agg(F.count("*").alias("m"))


def colour_histogram(graph: Graph, colors: DataFrame, arcs: DataFrame | None = None) -> DataFrame:
    """(id, side, color, deg): neighbours by colour; for directed ``arcs`` by side, out and in."""
    if arcs is None:
        return colour_degrees(graph, colors).select("id", F.lit("both").alias("side"), "color", "deg")
    out = arcs.join(colors.select(F.col("id").alias("dst"), "color"), "dst").select(F.col("src").alias("id"), F.lit("out").alias("side"), "color")
    into = arcs.join(colors.select(F.col("id").alias("src"), "color"), "src").select(F.col("dst").alias("id"), F.lit("in").alias("side"), "color")
    return out.unionByName(into).groupBy("id", "side", "color").agg(F.count("*").alias("deg"))


def coloured_ends(graph: Graph, colors: DataFrame) -> DataFrame:
    """Edges in both directions with colours and colour degrees of both ends: (src, dst, c1, c2, d12, d21, m)."""
    degrees = hold(colour_degrees(graph, colors))
    pairs = degrees.join(colors.select("id", F.col("color").alias("own")), "id").groupBy(F.col("own").alias("c1"), F.col("color").alias("c2")).agg(F.sum("deg").alias("m"))
    ends = graph.both_ways().join(colors.select(F.col("id").alias("src"), F.col("color").alias("c1")), "src").join(colors.select(F.col("id").alias("dst"), F.col("color").alias("c2")), "dst")
    ends = ends.join(degrees.select(F.col("id").alias("src"), F.col("color").alias("c2"), F.col("deg").alias("d12")), ["src", "c2"])
    ends = ends.join(degrees.select(F.col("id").alias("dst"), F.col("color").alias("c1"), F.col("deg").alias("d21")), ["dst", "c1"])
    return ends.join(hold(pairs), ["c1", "c2"])


def privacy_loss(graph: Graph, colors: DataFrame) -> DataFrame:
    """(loss, multi): expected original edges in a random graph with these colour degrees, and expected surplus of multiple edges."""
    p = F.col("d21") / F.col("m")
    each = F.col("d12") * F.col("d21") / F.col("m")
    multi = F.col("d12") * p * (1 - F.pow(1 - p, F.col("d12") - 1))
    sums = coloured_ends(graph, colors).agg(F.sum(each).alias("s"), F.sum(multi).alias("t"))
    return sums.select((F.coalesce("s", F.lit(0.0)) / 2).alias("loss"), F.coalesce("t", F.lit(0.0)).alias("multi"))


def katz_loss(values: DataFrame, colors: DataFrame) -> DataFrame:
    """(loss): squares of ``values`` (id, val) less what colour means explain."""
    per = values.join(colors, "id").groupBy("color").agg(F.count("*").alias("n"), F.sum("val").alias("s"), F.sum(F.col("val") * F.col("val")).alias("q"))
    return per.agg(F.coalesce(F.sum(F.col("q") - F.col("s") * F.col("s") / F.col("n")), F.lit(0.0)).alias("loss"))


def short_term_loss(graph: Graph, colors: DataFrame) -> DataFrame:
    """(loss): squares of colour degrees less what colour means explain."""
    degrees = colour_degrees(graph, colors).join(colors.select("id", F.col("color").alias("own")), "id")
    per = degrees.groupBy("own", "color").agg(F.sum("deg").alias("m"), F.sum(F.col("deg") * F.col("deg")).alias("q"))
    sizes = colors.groupBy(F.col("color").alias("own")).agg(F.count("*").alias("n"))
    return per.join(sizes, "own").agg(F.coalesce(F.sum(F.col("q") - F.col("m") * F.col("m") / F.col("n")), F.lit(0.0)).alias("loss"))


def equivalence_classes(graph: Graph, colors: DataFrame) -> DataFrame:
    """(id, size): nodes with the same colour and the same multiset of neighbours' colours. Multisets are summed, as in a WL round."""
    from veilgraph.operators.wl import refine, start

    labels = start(graph.nodes.select("id").join(colors, "id"), ["id"], "color")
    classes = hold(refine(labels, graph.both_ways(), ["id"]))
    sizes = hold(classes.groupBy("a", "b").agg(F.count("*").alias("size")))
    return classes.join(sizes, ["a", "b"]).select("id", "size")


def equivalence_stats(graph: Graph, colors: DataFrame) -> DataFrame:
    """(mean_guess, mean_guess_without_singletons, median_size, mean_size, singletons) over nodes."""
    return equivalence_classes(graph, colors).agg(
        F.avg(1 / F.col("size")).alias("mean_guess"),
        F.avg(F.when(F.col("size") > 1, 1 / F.col("size"))).alias("mean_guess_without_singletons"),
        F.median("size").alias("median_size"),
        F.avg("size").alias("mean_size"),
        F.count_if(F.col("size") == 1).alias("singletons"),
    )


def evaluate_colouring(graph: Graph, colors: DataFrame, w: float, use_katz_utility: bool = True, alpha: float = 0.1, beta: float = 1.0) -> DataFrame:
    """(utility, privacy, total, gap, clusters) without sampling; gap is the total over w times the privacy loss of one colour."""
    from veilgraph.operators.centrality import katz_vector

    utility = katz_loss(katz_vector(graph, alpha, beta), colors) if use_katz_utility else short_term_loss(graph, colors)
    one = privacy_loss(graph, colors.select("id", F.lit(0).alias("color"))).select(F.col("loss").alias("single"))
    found = utility.withColumnRenamed("loss", "utility").join(privacy_loss(graph, colors).select(F.col("loss").alias("privacy"))).join(one).join(colors.agg(F.count_distinct("color").alias("clusters")))
    total = F.col("utility") + w * F.col("privacy")  # one row each
    return found.select("utility", "privacy", total.alias("total"), (total - w * F.col("single")).alias("gap"), "clusters")

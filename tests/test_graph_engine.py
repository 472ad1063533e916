"""Golden values, invariants and brute force for the graph engine."""

import itertools
import json
import math
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from veilgraph.functions import ordered
from veilgraph.functions.distances import total_variation, wasserstein
from veilgraph.graph import Graph, canonical
from veilgraph.operators import anonymize, centrality, clustering, colours, kdegree, optimisers, rewiring, structure, wl
from veilgraph.operators.components import connected_components
from veilgraph.plans import metrics, reports
from veilgraph.sources import files, generators

EDGES_G = [(0, 1), (0, 2), (0, 5), (1, 2), (1, 6), (2, 3), (2, 4), (2, 7), (3, 4)]
EDGES_GA = [(0, 1), (0, 2), (0, 5), (1, 4), (1, 6), (2, 3), (2, 7), (3, 4)]


def graph(spark, edges, n):
    return Graph(spark.range(n), spark.createDataFrame(edges, "src long, dst long") if edges else spark.createDataFrame([], "src long, dst long"))


@pytest.fixture(scope="module")
def pair(spark):
    return graph(spark, EDGES_G, 8).written(), graph(spark, EDGES_GA, 8).written()


def random_edges(n, p, seed):
    rng = np.random.default_rng(seed)
    return [(u, v) for u in range(n) for v in range(u + 1, n) if rng.random() < p]


def colours_frame(spark, values):
    return spark.createDataFrame([(i, int(c)) for i, c in enumerate(values)], "id long, color long")


def edge_set(g):
    return {tuple(r) for r in g.edges.select("src", "dst").collect()}


def test_goldens_of_the_pair(pair):
    g, ga = pair
    found = metrics.Evaluator(
        {
            "n": metrics.NumberOfNodesMetric(), "m": metrics.NumberOfEdgesMetric(), "t": metrics.NumberOfTrianglesMetric(), "c": metrics.ConnectedComponentsMetric(),
            "tr": metrics.TransitivityMetric(), "ac": metrics.AverageClusteringCoefficientMetric(), "deg": metrics.DegreeCentralityMetric(), "eig": metrics.EigenvectorMetric(),
            "wl1": metrics.WLColorMetric(1), "wl2": metrics.WLColorMetric(2), "wl3": metrics.WLColorMetric(3), "pr": metrics.PageRankMetric(), "lc": metrics.LocalClusteringCoefficientMetric(),
            "ja": metrics.EdgeJaccardMetric(), "k2": metrics.PercentageKDegreeAnonMetric(2), "k3": metrics.PercentageKDegreeAnonMetric(3), "k4": metrics.PercentageKDegreeAnonMetric(4),
            "ka": metrics.KatzCentralityMetric(alpha=0.1), "cl": metrics.ClosenessCentralityMetric(), "mx": metrics.MaxDegreeMetric(), "md": metrics.MedianDegreeMetric(), "me": metrics.MeanDegreeMetric(),
        }
    ).evaluate(g, ga)
    pairs = {"n": (8, 8), "m": (9, 8), "t": (2, 0), "c": (1, 1), "tr": (1 / 3, 0), "ac": (43 / 120, 0), "k2": (0.875, 1), "k3": (0.375, 0.75), "k4": (0, 0), "mx": (5, 3), "md": (2, 2), "me": (2.25, 2)}
    for name, (a, b) in pairs.items():
        assert found[name]["G"] == pytest.approx(a) and found[name]["Ga"] == pytest.approx(b), name
    distances = {"deg": 0.035714285714285705, "eig": 0.04159283405776115, "wl1": 0.125, "wl2": 0.75, "wl3": 1.0, "pr": 0.019091687199899968, "lc": 0.35833333333333334, "ja": 0.7, "ka": 0.014968094437, "cl": 0.043516042781}
    for name, want in distances.items():
        assert found[name] == pytest.approx(want, abs=1e-9), name


def test_a_graph_is_at_distance_zero_from_itself(spark):
    g = graph(spark, random_edges(60, 0.08, 3), 60).written()
    nodes = [metrics.DegreeCentralityMetric(), metrics.EigenvectorMetric(), metrics.LocalClusteringCoefficientMetric(), metrics.KatzCentralityMetric(alpha=0.05), metrics.PageRankMetric(), metrics.ClosenessCentralityMetric(), metrics.WLColorMetric(3)]
    assert all(m.evaluate(g, g) == pytest.approx(0, abs=1e-12) for m in nodes)
    assert metrics.EdgeJaccardMetric().evaluate(g, g) == 1
    table = metrics.Evaluator({"n": metrics.NumberOfNodesMetric(), "j": metrics.EdgeJaccardMetric()}).table(g, g)
    assert [tuple(r) for r in table.collect()] == [("n", 60.0, 60.0, None), ("j", None, None, 1.0)]


def test_edgeless_and_empty_graphs(spark):
    for n in (0, 3):
        g = graph(spark, [], n)
        assert metrics.ConnectedComponentsMetric().compute_scalar(g) == n and structure.triangles(g).count() == 0
        assert metrics.EdgeJaccardMetric().evaluate(g, g) is None
        assert wl.wl_colors(g, 2).count() == n and anonymize.NestModelAnonymizer(1).anonymize(g).edges.count() == 0
        assert anonymize.ConfigurationModelAnonymizer().anonymize(g).edges.count() == 0
    assert metrics.MaxDegreeMetric().compute_scalar(graph(spark, [], 0)) is None


def test_canonical_validate_relabel(spark):
    raw = spark.createDataFrame([(3, 1), (1, 3), (2, 2), (None, 1), (5, 3)], "src long, dst long")
    g = Graph.from_edges(raw)
    assert edge_set(g) == {(1, 3), (3, 5)} and {r[0] for r in g.nodes.collect()} == {1, 2, 3, 5}
    with pytest.raises(ValueError):
        g.validate()
    h, names = g.relabel()
    assert {tuple(r) for r in names.collect()} == {(1, 0), (2, 1), (3, 2), (5, 3)} and edge_set(h.validate()) == {(0, 2), (2, 3)}
    with pytest.raises(ValueError):
        graph(spark, [(0, 9)], 3).validate()
    with pytest.raises(ValueError):
        graph(spark, [(1, 0)], 3).validate()
    rows = spark.createDataFrame([(0, 1, 2), (1, 2, 3), (2, 0, 1)], "at long, src long, dst long")
    assert dict(g.first_appearance_labels(rows, "at").collect()) == {1: 0, 2: 1, 3: 2, 0: 3}


@pytest.mark.parametrize("size", [1 << 18, 2])
def test_distances(spark, monkeypatch, size):
    monkeypatch.setattr(ordered, "SMALL", size)
    rng = np.random.default_rng(0)
    p, q = rng.integers(0, 9, 40) / 3, rng.integers(2, 14, 25) / 3
    frame = lambda x: spark.createDataFrame(pd.DataFrame({"val": x.astype(float)}))
    grid = np.unique(np.concatenate((p, q)))
    cdf = lambda x: (x[:, None] <= grid[:-1]).mean(0)
    assert wasserstein(frame(p), frame(q)).first()[0] == pytest.approx((np.abs(cdf(p) - cdf(q)) * np.diff(grid)).sum())
    assert total_variation(spark.createDataFrame([(1,), (2,), (2,), (3,)], "l int"), spark.createDataFrame([(2,), (3,), (4,)], "l int"), ["l"]).first()[0] == pytest.approx(0.5 * (0.25 + 1 / 6 + 1 / 12 + 1 / 3))


def test_large_forms_equal_small_forms(spark, monkeypatch):
    g = graph(spark, random_edges(40, 0.06, 5), 40).written()
    calls = [(centrality.pagerank, {}), (centrality.closeness, {}), (centrality.katz, {"max_iter": 4, "tol": 0}), (centrality.eigenvector, {"max_iter": 4, "tol": 0}), (centrality.katz_vector, {"alpha": 0.05, "tol": 1e-2})]
    small = [dict(f(g, **options).collect()) for f, options in calls]
    parts = dict(structure.components(g).collect())
    monkeypatch.setattr(centrality, "KERNEL_EDGES", 0)
    large = Graph(g.nodes, g.edges)
    assert centrality.small(large) is None
    for (f, options), want in zip(calls, small, strict=True):
        assert dict(f(large, **options).collect()) == pytest.approx(want)
    assert dict(structure.components(large).collect()) == parts


def test_components_of_stars_paths_and_rings(spark):
    edges = [(0, i) for i in range(1, 30)] + [(i, i + 1) for i in range(100, 140)] + [(200 + i, 200 + (i + 1) % 9) for i in range(9)] + [(5, 5), (None, 3), (29, 0)]
    got = dict(connected_components(spark.createDataFrame(edges, "src long, dst long")).collect())
    assert got == {i: 0 for i in range(30)} | {i: 100 for i in range(100, 141)} | {i: 200 for i in range(200, 209)}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def wl_brute(edges, n, rounds, start=None):
    near = [[] for _ in range(n)]
    for u, v in edges:
        near[u].append(v)
        near[v].append(u)
    color = list(start or [0] * n)
    for _ in range(rounds):
        color = [(color[v], tuple(sorted(map(str, (color[u] for u in near[v]))))) for v in range(n)]
    first = {}
    return {v: first.setdefault(color[v], v) for v in range(n)}


def test_wl(spark):
    for seed in range(3):
        edges = random_edges(30, 0.1, seed)
        g = graph(spark, edges, 30)
        for rounds in (0, 1, 2):
            assert dict(wl.named(wl.colour_rounds(g, rounds + 1)[-1]).collect()) == wl_brute(edges, 30, rounds) or len(wl.colour_rounds(g, rounds + 1)) <= rounds
    line = lambda n: graph(spark, [(i, i + 1) for i in range(n - 1)], n)
    assert len(wl.colour_rounds(line(7))) == 4 and len(wl.colour_rounds(line(8))) == 4
    labels = wl.colour_rounds(line(7), initial=colours_frame(spark, [0, 0, 0, 100, 0, 0, 0]))
    named = [[c for _, c in sorted(wl.canonical_labels(wl.named(x)).collect())] for x in labels]
    assert named == [[0, 0, 0, 1, 0, 0, 0], [0, 1, 2, 3, 2, 1, 0]]
    nine = [(0, 3), (1, 2), (2, 4), (2, 5), (3, 6), (3, 7), (4, 8), (5, 8), (6, 7)]
    assert len(wl.colour_rounds(graph(spark, nine, 9))) == 6
    with pytest.raises(ValueError):
        wl.colour_rounds(line(3), 0)
    arcs = spark.createDataFrame([(0, 1), (1, 2), (0, 2)], "src long, dst long")
    assert len({c for _, c in wl.wl_directed(spark.range(4), arcs, 1).collect()}) == 4


def losses_brute(edges, color, x):
    n, E = len(color), [(u, v) for u, v in edges] + [(v, u) for u, v in edges]
    d = Counter((u, color[v]) for u, v in E)
    m = Counter((color[u], color[v]) for u, v in E)
    p = sum(d[u, color[v]] * d[v, color[u]] / m[color[u], color[v]] for u, v in E) / 2
    short = sum(c * c for c in d.values())
    sizes = Counter(color)
    short -= sum(k * k / sizes[a] for (a, _), k in m.items())
    katz = sum(v * v for v in x) - sum(sum(x[i] for i in range(n) if color[i] == c) ** 2 / sizes[c] for c in sizes)
    return p, katz, short


def test_losses(spark, pair):
    g, _ = pair
    x = centrality.katz_vector(g)
    by_degree = g.degrees().select("id", F.col("deg").alias("color"))
    one, all_ = colours_frame(spark, [0] * 8), colours_frame(spark, range(8))
    want = {"one": (4.111111111, 0.224829774, 13.5), "deg": (7.0, 0.000376742, 1.333333333), "all": (9.0, 0.0, 0.0)}
    for name, c in (("one", one), ("deg", by_degree), ("all", all_)):
        got = (colours.privacy_loss(g, c).first()["loss"], colours.katz_loss(x, c).first()[0], colours.short_term_loss(g, c).first()[0])
        assert got == pytest.approx(want[name], abs=1e-8), name
    stats = colours.equivalence_stats(g, by_degree).first()
    assert tuple(stats) == pytest.approx((0.625, 0.5, 2, 1.75, 2))
    edges, rng = random_edges(34, 0.4, 1), np.random.default_rng(2)
    color, values = rng.integers(0, 9, 34), rng.normal(size=34)
    h = graph(spark, edges, 34)
    got = (colours.privacy_loss(h, colours_frame(spark, color)).first()["loss"], colours.katz_loss(spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "id long, val double"), colours_frame(spark, color)).first()[0], colours.short_term_loss(h, colours_frame(spark, color)).first()[0])
    want = losses_brute(edges, color.tolist(), values.tolist())
    assert got == pytest.approx(want) and want[0] <= len(edges)
    arrays = centrality.small(h)
    assert (optimisers.privacy(arrays, color), optimisers.katz_utility(values, color), optimisers.short_term_utility(arrays, color)) == pytest.approx(want)
    found = colours.evaluate_colouring(g, one, 0.5).first()
    assert found["total"] == pytest.approx(0.224829774 + 0.5 * 4.111111111) and found["clusters"] == 1 and found["gap"] == pytest.approx(0.224829774)


def test_joint_degrees(pair):
    assert {tuple(r) for r in structure.joint_degrees(pair[0]).collect()} == {(1, 3, 2), (1, 5, 1), (2, 2, 1), (2, 5, 2), (3, 3, 1), (3, 5, 2)}


def test_histograms_by_side(spark, pair):
    c = colours_frame(spark, [0, 0, 1, 1, 1, 0, 0, 0])
    assert colours.colour_histogram(pair[0], c).agg(F.sum("deg")).first()[0] == 18
    assert colours.colour_histogram(pair[0], c, pair[0].edges).groupBy("side").agg(F.sum("deg")).count() == 2


@pytest.mark.parametrize("block", [100_000, 3])
def test_rewiring_keeps_colour_degrees(spark, block):
    edges, rng = random_edges(50, 0.12, 6), np.random.default_rng(1)
    for k in (1, 3, 8):
        g, c = graph(spark, edges, 50).written(), colours_frame(spark, rng.integers(0, k, 50))
        out = rewiring.rewire(g, c, 2, 5, block).validate()
        assert out.edges.count() == len(edges) and rewiring.colour_degree_changes(g, out, c).count() == 0
        assert k > 3 or edge_set(out) != set(edges)
        assert edge_set(rewiring.rewire(g, c, 2, 5, block)) == edge_set(out)


def test_dead_blocks(spark):
    g = graph(spark, [(0, 1), (0, 2), (3, 4), (5, 6), (6, 7)], 8)
    c = colours_frame(spark, [0, 1, 1, 2, 3, 4, 4, 4])
    found = {(r.c1, r.c2): (r.m, r.dead) for r in rewiring.blocks(rewiring.coloured(g.edges, c)).collect()}
    assert found == {(0, 1): (2, True), (2, 3): (1, True), (4, 4): (2, False)}
    assert edge_set(rewiring.rewire(g, c, 20)) >= {(0, 1), (0, 2), (3, 4)}


def test_configuration_sample_keeps_colour_degrees(spark):
    g = graph(spark, random_edges(40, 0.15, 2), 40).written()
    c = colours_frame(spark, [i % 3 for i in range(40)])
    out = rewiring.sample_configuration(g, c, 3)
    ends = out.where("src <> dst").select("src", "dst", "weight").unionByName(out.where("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")).unionByName(out.where("src = dst"))
    got = ends.join(c.select(F.col("id").alias("dst"), "color"), "dst").groupBy(F.col("src").alias("id"), "color").agg(F.sum("weight").alias("deg"))
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in colours.colour_degrees(g, c).collect()}


def test_nest(spark):
    g = generators.erdos_renyi(spark, 120, 0.05, 4)
    g = Graph(g.nodes.unionByName(spark.range(120, 121)), g.edges).written()
    for depth in (1, 2):
        out = anonymize.NestModelAnonymizer(depth, 5).anonymize(g, 3)
        assert anonymize.validate_nest(g, out, depth) and out.nodes.count() == 121
    assert edge_set(anonymize.NestModelAnonymizer(1, 5).anonymize(g, 3)) != edge_set(g)
    with pytest.raises(ValueError):
        anonymize.NestModelAnonymizer(0)
    variant = anonymize.VariantNestModelAnonymizer(4).anonymize(g, 1)
    assert {tuple(r) for r in variant.degrees().collect()} == {tuple(r) for r in g.degrees().collect()}


def test_random_add_del(spark):
    ring = graph(spark, [(0, 1), (1, 2), (2, 3), (0, 3)], 4)
    assert anonymize.RandomEdgeAddDelAnonymizer(2).anonymize(ring, 1).validate().edges.count() == 4
    assert edge_set(anonymize.RandomEdgeAddDelAnonymizer(100).anonymize(ring, 1)) == {(u, v) for u in range(4) for v in range(u + 1, 4)}
    assert edge_set(anonymize.RandomEdgeAddDelAnonymizer(0).anonymize(ring)) == edge_set(ring)
    g = generators.erdos_renyi(spark, 300, 0.02, 1).written()
    out = anonymize.RandomEdgeAddDelAnonymizer(50).anonymize(g, 9).validate()
    assert out.edges.count() == g.edges.count() and 0 < len(edge_set(out) ^ edge_set(g)) <= 100


def test_configuration_model(spark):
    g = generators.erdos_renyi(spark, 60, 0.2, 2).written()
    out = anonymize.ConfigurationModelAnonymizer().anonymize(g, 4).validate()
    assert out.nodes.count() == 60 and 0 < out.edges.count() <= g.edges.count()


def test_pygmalion(spark):
    g = generators.erdos_renyi(spark, 80, 0.08, 2).written()
    model = anonymize.PygmalionModelAnonymizer(1000.0)
    counts = model.noisy_counts(g, 3).toPandas().sort_values("cnt", kind="stable")
    assert (counts.noisy.diff().dropna() >= 0).all() and abs(counts.noisy.sum() - counts.cnt.sum()) < 10
    out = model.anonymize(g, 3)
    assert out.degrees().agg(F.max("deg")).first()[0] <= g.degrees().agg(F.max("deg")).first()[0]
    assert anonymize.PygmalionModelAnonymizer(5.0, drop_loops=True).anonymize(g, 3).edges.where("src = dst").count() == 0
    assert clustering.pool_adjacent(np.array([1, 3, 2, 2, 5])).tolist() == pytest.approx([1, 7 / 3, 7 / 3, 7 / 3, 5])


def test_k_degree(spark):
    g = generators.barabasi_albert(spark, 150, 3, 1).written()
    for deletions in (True, False):
        out = anonymize.KDegreeAnonymizer(10, with_deletions=deletions).anonymize(g, 5).validate()
        assert structure.k_degree_fraction(out, 10).first()[0] == 1
    sequence = anonymize.anonymise_degree_sequence(g, 5).toPandas()
    assert sequence.target.value_counts().min() >= 5 and len(sequence) == 150


def test_k_degree_costs_are_the_least():
    rng = np.random.default_rng(0)
    for _ in range(60):
        n, k = int(rng.integers(4, 12)), int(rng.integers(2, 4))
        d = np.sort(rng.integers(0, 9, n))[::-1]
        for deletions in (True, False):
            got = kdegree.anonymise_degrees(d, k, deletions, exact=True)
            assert min(Counter(got.tolist()).values()) >= min(k, n)
            best = math.inf
            for cuts in itertools.product((0, 1), repeat=n - 1):
                at = [0, *(i + 1 for i, c in enumerate(cuts) if c), n]
                parts = [d[a:b] for a, b in itertools.pairwise(at)]
                if min(map(len, parts)) >= k:
                    best = min(best, sum(np.abs(p - (kdegree._median(p) if deletions else p[0])).sum() for p in parts))
            if math.isfinite(best):
                assert np.abs(got - d).sum() == best


def test_k_degree_published_recurrence():
    """Against the plain recursion: a start's first admissible group is costed in full, later members add their distance from the new median."""
    rng = np.random.default_rng(3)
    median = kdegree._median

    def costs(d, k, deletions, exact):
        out = {}
        for i in range(len(d)):
            for j in range(i + k - 1, min(i + 2 * k, len(d))):
                part = d[i : j + 1]
                if not deletions:
                    out[i, j] = sum(part[0] - part)
                elif exact or j == i + k - 1:
                    out[i, j] = sum(abs(median(part) - part))
                else:
                    out[i, j] = out[i, j - 1] + median(part) - d[j]
        return out

    def solve(d, k, deletions, table):
        if len(d) >= 2 * k:
            best = (math.inf, None)
            for t in range(max(k, len(d) + 1 - 2 * k), len(d) - k + 1):
                cost, head = solve(d[:t], k, deletions, table)
                cost += table.get((t, len(d) - 1), math.inf)
                if cost < best[0]:
                    best = (cost, head + [median(d[t:]) if deletions else d[t]] * (len(d) - t))
            if best[0] < table.get((0, len(d) - 1), math.inf):
                return best
        return table.get((0, len(d) - 1), math.inf), [median(d) if deletions else d[0]] * len(d)

    for _ in range(150):
        k = int(rng.integers(2, 5))
        d = np.sort(rng.integers(0, rng.choice([4, 12, 40]), int(rng.integers(k, 6 * k))))[::-1]
        for deletions, exact in itertools.product((True, False), repeat=2):
            assert kdegree.anonymise_degrees(d, k, deletions, exact).tolist() == solve(d, k, deletions, costs(d, k, deletions, exact))[1]
    assert kdegree.group_costs(np.array([5, 3]), np.array([0, 5, 8]), np.zeros(1, int), 2, 1, True, False).tolist() == [[2.0]]


def test_erdos_gallai(spark):
    for n in (1, 2, 3, 4, 5):
        pairs = list(itertools.combinations(range(n), 2))
        real = set()
        for chosen in itertools.product((0, 1), repeat=len(pairs)):
            c = Counter(x for e, k in zip(pairs, chosen, strict=True) if k for x in e)
            real.add(tuple(sorted(c[i] for i in range(n))))
        for d in itertools.combinations_with_replacement(range(n + 1), n):
            assert kdegree.graphical(np.array(d)) == (d in real), d
    table = lambda d: spark.createDataFrame([(x,) for x in d], "deg long")
    for d in ([3, 3, 3, 3], [4, 1, 1, 1], [3, 3, 1, 1], [2, 2, 2], [1], [0], [5, 5, 4, 3, 2, 1]):
        assert structure.erdos_gallai(table(d)) == kdegree.graphical(np.array(d)), d


def test_line_clusters_are_optimal():
    rng = np.random.default_rng(3)
    for _ in range(40):
        x = rng.integers(0, 12, int(rng.integers(1, 9))) / 2
        values = np.unique(x)
        for medians in (False, True):
            for k, labels in clustering.line_clusters(x, 5, medians):
                cost = lambda parts: sum(np.abs(p - np.median(p)).sum() if medians else ((p - p.mean()) ** 2).sum() for p in parts)
                best = min(cost([x[(x >= values[a]) & (x <= values[b - 1])] for a, b in itertools.pairwise((0, *cut, len(values)))]) for cut in itertools.combinations(range(1, len(values)), k - 1))
                assert cost([x[labels == c] for c in range(k)]) == pytest.approx(best)
    labels = clustering.line_cluster(np.array([0, 1, 2, 50, 51, 90.0]), 3, min_size=2)
    assert min(Counter(labels.tolist()).values()) >= 2


def arrays_of(edges, n):
    e = np.array(edges, np.int64).reshape(-1, 2)
    return centrality.Arrays(np.arange(n), e[:, 0], e[:, 1])


def test_incremental_losses_equal_recomputed_ones():
    for seed in range(8):
        rng = np.random.default_rng(seed)
        edges = random_edges(20, 0.3, seed)
        g, x = arrays_of(edges, 20), np.sort(rng.normal(size=20))
        near = [g.dst[g.first[v] : g.first[v] + g.degree[v]].tolist() for v in range(20)]
        state = optimisers.State(near, x, rng.integers(0, 5, 20).tolist(), 0.7)
        for _ in range(60):
            state.recolour(int(rng.integers(20)), int(rng.integers(0, 7)))
        want = losses_brute(edges, state.color, x.tolist())
        assert state.private == pytest.approx(want[0]) and state.square - state.explained == pytest.approx(want[1])
        before, color = state.objective(), list(state.color)
        state.gain({0: 6, 1: 2})
        state.split(state.color[3])
        a, b = sorted(state.colours())[:2]
        state.merge_split(a, b)
        assert state.color == color and state.objective() == pytest.approx(before)


def test_searches_lower_the_loss(spark):
    g = generators.two_grids(spark)
    arrays = centrality.small(g)
    assert arrays.n == 42 and len(arrays.src) == 118
    x = optimisers.katz_array(arrays)
    loss = lambda c: optimisers.katz_utility(x, c) + 0.01 * optimisers.privacy(arrays, c)
    start = loss(np.zeros(42, int))
    line, greedy, eager = optimisers.optimal_line(arrays, 0.01), optimisers.local_search(arrays, 0.01), optimisers.local_search(arrays, 0.01, eager=True, seed=3)
    assert loss(line) < start and loss(greedy) < start and loss(eager) < start
    with pytest.raises(ValueError):
        optimisers.local_search(arrays, 0.01, alpha=0.9)
    assert optimisers.spectral_radius(arrays_of(EDGES_G, 8)) == pytest.approx(2.8194009363)
    assert optimisers.katz_array(arrays_of(EDGES_G, 8)) == pytest.approx([1.422496335, 1.422496335, 1.660217383, 1.295579709, 1.295579709, 1.142249634, 1.142249634, 1.166021738])


@pytest.mark.parametrize("katz", [True, False])
def test_soft_gradient(katz):
    soft = optimisers.SoftColours(arrays_of(random_edges(9, 0.4, 2), 9), 4, 0.3, use_katz_utility=katz, seed=1)
    _, gradient, _, _ = soft.loss(soft.logits, 0.05)
    for i, j in ((0, 0), (3, 2), (8, 3), (5, 1)):
        step = np.zeros_like(soft.logits)
        step[i, j] = 1e-6
        slope = (soft.loss(soft.logits + step, 0.05)[0] - soft.loss(soft.logits - step, 0.05)[0]) / 2e-6
        assert gradient[i, j] == pytest.approx(slope, abs=1e-6)
    hard = soft.fit()
    assert set(hard) == set(range(hard.max() + 1))


def test_private_colours(spark):
    g = generators.two_grids(spark)
    for method in (anonymize.PrivateColorAnonymizer(0.01), anonymize.PrivateColorAnonymizer(0.01, use_optimal1d=False), anonymize.SoftColorAnonymizer(5, 0.01, max_epochs=100)):
        out = method.anonymize(g, 2).validate()
        assert {tuple(r) for r in out.degrees().collect()} == {tuple(r) for r in g.degrees().collect()}
    tiny = generators.path(spark, 6)
    out = anonymize.PrivateClosenessColors(0.05, closeness_samples=2, r=2).anonymize(tiny, 1)
    assert {tuple(r) for r in out.degrees().collect()} == {tuple(r) for r in tiny.degrees().collect()}


def test_generators(spark):
    assert generators.gnm(spark, 20, 60, 3).validate().edges.count() == 60
    assert generators.gnm(spark, 6, 15, 3).edges.count() == 15
    assert generators.barabasi_albert(spark, 50, 2, 1).validate().edges.count() == 2 + 47 * 2
    assert generators.two_grids(spark).validate().edges.count() == 59
    communities = generators.planted_communities(spark, 200, 6, 0.2, seed=3)
    communities.validate()
    assert communities.nodes.select("community").distinct().count() > 3
    many = generators.erdos_renyi(spark, 400, 0.1, 5).edges.count()
    assert abs(many - 7980) < 400
    assert {tuple(r) for r in generators.erdos_renyi(spark, 6, 1.0).edges.collect()} == set(itertools.combinations(range(6), 2))


def test_files(spark, tmp_path):
    import gzip

    with gzip.open(tmp_path / "e.txt.gz", "wt") as f:
        f.write("# a comment\n3 1\n1\t3\n2 2\n\n5 3 # more\n")
    g = files.read_edge_list(spark, str(tmp_path / "e.txt.gz"))
    assert edge_set(g) == {(1, 3), (3, 5)} and g.nodes.count() == 4
    (tmp_path / "n.txt").write_text("b a\na c\n")
    named = files.read_edge_list(spark, str(tmp_path / "n.txt"))
    assert edge_set(named) == {(0, 1), (0, 2)} and {tuple(r) for r in named.nodes.collect()} == {(0, "a"), (1, "b"), (2, "c")}
    (tmp_path / "e.json").write_text(json.dumps([[0, 1], [4, 1]]))
    j = files.read_json_edges(spark, str(tmp_path / "e.json"))
    assert edge_set(j) == {(0, 1), (1, 4)} and j.nodes.count() == 5
    (tmp_path / "g.gml").write_text('graph [\n node [ id 7 label "x" ]\n node [ id 9 label "y" ]\n edge [ source 9 target 7 ]\n]')
    gml = files.read_gml(spark, str(tmp_path / "g.gml"))
    assert edge_set(gml) == {(0, 1)} and {r.label for r in gml.nodes.collect()} == {"x", "y"}
    files.write_graph(g, str(tmp_path / "out"))
    assert edge_set(files.read_graph(spark, str(tmp_path / "out"))) == edge_set(g)
    files.write_edge_list(g, str(tmp_path / "text"))
    assert edge_set(files.read_edge_list(spark, str(tmp_path / "text"))) == edge_set(g)


def test_streaming_degrees(spark, tmp_path):
    from veilgraph.streaming.degrees import streaming_degrees

    spark.createDataFrame([(0, 1), (0, 1), (1, 2), (3, 3)], "src long, dst long").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("src long, dst long").parquet(str(tmp_path / "in"))
    run = streaming_degrees(stream).writeStream.format("memory").queryName("streamed").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination(60)
    assert {tuple(r) for r in spark.table("streamed").collect()} == {(0, 1), (1, 2), (2, 1)}


def test_reports(spark):
    samples = spark.createDataFrame([(s, m, k, float(v)) for s in (1, 2) for m, k, v in (("a", "x", s), ("a", "y", 4), ("b", "x", 3 * s), ("b", "y", 0))], "seed int, method string, metric string, value double")
    found = {(r.method, r.metric): (r.mean, r.rel_std) for r in reports.summary(samples).collect()}
    assert found["a", "x"] == pytest.approx((1.5, 1 / 3)) and found["b", "y"] == (0.0, None)
    text = reports.latex(reports.wide(samples, ["x", "y"]).orderBy("method"), 1)
    assert r"a & 1.5 & 4.0 \\" in text
    ranks = samples.where("metric = 'x'").withColumn("r", reports.average_rank(["metric"], "value")).collect()
    assert sorted((r.value, r.r) for r in ranks) == [(1, 1), (2, 2), (3, 3), (6, 4)]


def test_numbering_over_many_ranges(spark):
    table = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), (F.col("id") % 3).alias("g")).repartition(8)
    assert sorted(tuple(r) for r in ordered.numbered(table, [F.col("k")]).select("k", "position").collect()) == [(i, i) for i in range(1000)]
    got = ordered.numbered(table, [F.col("k")], ["g"]).collect()
    for g in range(3):
        rows = sorted((r.position, r.k) for r in got if r.g == g)
        assert [p for p, _ in rows] == list(range(len(rows))) and [k for _, k in rows] == sorted(k for _, k in rows)
    assert {tuple(r) for r in canonical(spark.createDataFrame([(2, 1), (1, 2), (1, 1)], "a int, b int"), "a", "b").collect()} == {(1, 2)}


def test_closeness_of_all_nodes_follows_from_cores(spark):
    rng = np.random.default_rng(4)
    pairs = [(0, 1), (2, 3), (3, 4), (5, 6), (6, 7), (5, 7), (7, 8), (8, 9)]  # an edge, a path, a triangle with a tail; then random parts with trees, and node 499 alone
    for low, n, m in ((10, 200, 180), (210, 150, 260), (360, 130, 129)):
        pairs += [(int(u), int(v)) for u, v in rng.integers(low, low + n, (m, 2)) if u < v] + [(int(v), int(u)) for u, v in rng.integers(low, low + n, (m, 2)) if u > v]
    ends = np.array(sorted(set(pairs)))
    g = centrality.Arrays(np.arange(500), ends[:, 0], ends[:, 1])
    assert np.array_equal(centrality._whole_closeness(spark, g), centrality.closeness_of(g, np.arange(500)))
    cores = centrality.Cores(g)
    assert len(cores.nodes) < 400 and sum(high - low for _, _, _, low, high in cores.units()) < len(cores.nodes)
    assert not len(centrality._whole_closeness(spark, centrality.Arrays(*[np.zeros(0, np.int64)] * 3)))


def test_k_degree_realisation_grows_with_the_edges():
    import time

    rng = np.random.default_rng(8)
    adjacency = [set() for _ in range(40_000)]
    for u, v in rng.integers(0, 40_000, (80_000, 2)).tolist():
        if u != v:
            adjacency[u].add(v)
            adjacency[v].add(u)
    goal = np.array([len(a) + len(a) % 2 for a in adjacency])
    start = time.process_time()
    edges = kdegree.realise(goal, adjacency, rng)  # some seconds; minutes when all nodes are sorted for each
    assert time.process_time() - start < 30
    assert np.array_equal(np.bincount(np.array(sorted(edges)).ravel(), minlength=40_000), goal)


def test_line_search_by_runs_and_depths():
    rng = np.random.default_rng(9)
    ends = np.array(sorted({(int(min(p)), int(max(p))) for p in rng.integers(0, 120, (300, 2)) if p[0] != p[1]}))
    g = centrality.Arrays(np.arange(120), ends[:, 0], ends[:, 1])
    x = optimisers.katz_array(g, 0.03)
    private = optimisers.LinePrivacy(g, x)
    for k, color in clustering.line_clusters(x, 70):
        assert private(color) == pytest.approx(optimisers.privacy(g, color))
        halved = clustering.line_cluster(x, k, min_size=1)  # range by range
        assert np.array_equal(color, halved) or k > 25


def test_many_values_are_dealt_to_tasks(spark, monkeypatch):
    """More than so many values are not rows of a plan, which the driver alone would read."""
    monkeypatch.setattr(centrality, "ROWS", 3)
    g = generators.path(spark, 8)
    got = centrality.closeness(g)
    assert got.rdd.getNumPartitions() == 3
    assert [(r.id, r.val) for r in got.orderBy("id").collect()] == [(i, 7 / sum(abs(i - j) for j in range(8))) for i in range(8)]


def test_private_colours_are_searched_once(spark, monkeypatch):
    """The query's rewiring and its checks take one search, whose colours are dealt to tasks where they are many."""
    from veilgraph.plans import queries

    search, calls = optimisers.optimal_line, []
    monkeypatch.setattr(optimisers, "optimal_line", lambda *a: calls.append(a) or search(*a))
    monkeypatch.setattr(centrality, "ROWS", 100)
    assert tuple(queries.private_color_changes(spark, "/root/testdata/sf0.001").first())[2:4] == (True, 0)
    assert len(calls) == 1


def test_line_search_takes_the_best_of_all_it_looks_at():
    rng = np.random.default_rng(10)
    ends = np.array(sorted({(int(min(p)), int(max(p))) for p in rng.integers(0, 150, (300, 2)) if p[0] != p[1]}))
    g = centrality.Arrays(np.arange(150), ends[:, 0], ends[:, 1])
    x = optimisers.katz_array(g, 0.05)
    for w in (0.0001, 0.01, 1.0):
        best, best_k, most = (np.inf, None), 0, 2
        for k, color in clustering.line_clusters(x, 150):
            if k > most:
                if best_k < 0.75 * most:
                    break
                most = int(most / 0.75) + 1
            loss = optimisers.katz_utility(x, color) + w * optimisers.privacy(g, color)
            if loss < best[0]:
                best, best_k = (loss, color), k
        assert np.array_equal(optimisers.optimal_line(g, w, True, 0.05), best[1])


def test_differing_rows_count_repeats(spark):
    a = spark.createDataFrame([(1, 1), (1, 1), (2, None), (3, 3)], "id long, color long")
    b = spark.createDataFrame([(1, 1), (2, None), (3, 4)], "id long, color long")
    assert sorted(map(tuple, structure.differing(a, b).collect())) == [(1, 1), (3, 3), (3, 4)]
    assert not wl.equal_labellings(a, b) and wl.equal_labellings(b, b)


def test_searches_work_on_parts_that_stay_in_a_cache(monkeypatch):
    import time

    rng = np.random.default_rng(12)

    def ring_with_chords(n):
        pairs = {(i, i + 1) for i in range(n - 1)} | {(0, n - 1)} | {(int(min(p)), int(max(p))) for p in rng.integers(0, n, (n // 2, 2)) if p[0] != p[1]}
        ends = np.array(sorted(pairs))
        return centrality.Arrays(np.arange(n), ends[:, 0], ends[:, 1])

    def values(g):
        cores = centrality.Cores(g)
        core = np.zeros(len(cores.nodes), np.int64)
        for _, a, b, low, high in cores.units():
            core[a:b] += cores.hops(a, b, low, high)
        size, total = cores.sums(core)
        return (size - 1) / total

    large = ring_with_chords(10_000)
    start = time.process_time()
    values(large)  # under a second; several when each hop gathers all sources' bits at once
    assert time.process_time() - start < 3
    monkeypatch.setattr(centrality, "CACHED", 1)
    g = ring_with_chords(1_500)
    assert np.array_equal(values(g), centrality.closeness_of(g, np.arange(1_500)))


def test_evaluator_runs_metrics_together(spark):
    import threading

    meeting, made = threading.Barrier(2), []

    class Waiting(metrics.AbstractGraphMetric):
        def compute_scalar(self, g):
            g.remember("slow", lambda: made.append(g) or len(made))
            meeting.wait(60)  # breaks where one metric runs after the other
            return g.count_nodes()

    g = generators.path(spark, 5)
    found = metrics.Evaluator({"a": Waiting(), "b": Waiting()}).evaluate(g, g)
    assert found == {name: {"G": 5, "Ga": 5} for name in "ab"} and list(found) == ["a", "b"] and len(made) == 2
    with pytest.raises(ZeroDivisionError):
        metrics.Evaluator({"bad": type("Bad", (Waiting,), {"evaluate": lambda self, g, h: 1 / 0})(), "n": metrics.NumberOfNodesMetric()}).evaluate(g, g)


def test_report_of_small_graphs_is_made_of_arrays(spark, monkeypatch):
    sc = spark.sparkContext
    g = graph(spark, random_edges(150, 0.06, 1), 160)
    h = Graph(spark.range(20, 170), graph(spark, [(a + 20, b + 20) for a, b in random_edges(140, 0.07, 2)] + random_edges(150, 0.06, 1)[::3], 1).edges.where("src >= 20").distinct())
    chosen = {
        "components": metrics.ConnectedComponentsMetric(),
        "max": metrics.MaxDegreeMetric(),
        "median": metrics.MedianDegreeMetric(),
        "mean": metrics.MeanDegreeMetric(),
        "triangles": metrics.NumberOfTrianglesMetric(),
        "clustering": metrics.AverageClusteringCoefficientMetric(),
        "transitivity": metrics.TransitivityMetric(),
        "degree": metrics.DegreeCentralityMetric(),
        "local": metrics.LocalClusteringCoefficientMetric(),
        "eigenvector": metrics.EigenvectorMetric(),
        "katz": metrics.KatzCentralityMetric(),
        "pagerank": metrics.PageRankMetric(),
        "closeness": metrics.ClosenessCentralityMetric(),
        "wl": metrics.WLColorMetric(2),
        "jaccard": metrics.EdgeJaccardMetric(),
        "k_degree": metrics.PercentageKDegreeAnonMetric(9),
    }
    monkeypatch.setattr(structure, "CLOSED", 50)  # wedges are closed in several rounds
    sc.setJobGroup("report", "")
    try:
        found = metrics.Evaluator(chosen).evaluate(g, h)
        jobs = len(sc.statusTracker().getJobIdsForGroup("report"))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert jobs < 45  # several times as many when each metric counts and joins the tables again
    monkeypatch.setattr("veilgraph.functions.distances.at_hand", lambda df, column: None)
    for name, metric in chosen.items():
        assert found[name] == pytest.approx(metric.evaluate(g, h)), name  # of graphs that aren't written: by joins
    monkeypatch.setattr(structure, "WEDGES", 0)
    assert structure.corners(centrality.small(g)) is None

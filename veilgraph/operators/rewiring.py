"""Random graphs with the same degree of every node into every colour, by swapping edge ends.

Edges between the same two colours form a block. Two edges (a, b) and (c, d) of a block, each with its end of the
smaller colour first, become (a, d) and (c, b) unless that makes a loop or a second edge. A block of up to
``BLOCK`` edges runs as a chain of random swaps in one task; a larger one, such as the single block of one colour, in
rounds over all executors: all edges of a block are paired at random, and a pair swaps if its two new edges
neither exist before the round nor are proposed by another pair. Either keeps edge count, simplicity and all colour degrees.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilgraph.functions import hashrand
from veilgraph.functions.ordered import numbered
from veilgraph.graph import Graph, canonical
from veilgraph.plans.workspace import discard, hold, materialize

BLOCK = 100_000


def coloured(edges: DataFrame, colors: DataFrame) -> DataFrame:
    """(a, b, c1, c2): edges with the end of the smaller colour first (within one colour, of the smaller id)."""
    ends = edges.select("src", "dst").join(colors.select(F.col("id").alias("src"), F.col("color").alias("cs")), "src").join(colors.select(F.col("id").alias("dst"), F.col("color").alias("cd")), "dst")
    turn = F.col("cs") > F.col("cd")
    return ends.select(F.when(turn, F.col("dst")).otherwise(F.col("src")).alias("a"), F.when(turn, F.col("src")).otherwise(F.col("dst")).alias("b"), F.least("cs", "cd").alias("c1"), F.greatest("cs", "cd").alias("c2"))


def oriented(edges: DataFrame, labellings: list[DataFrame]) -> DataFrame:
    """(src, dst): each edge from the end with the smaller colour in the first of the labellings (id, color) that tells its ends apart; as it was if none does."""
    out, turn = edges.select("src", "dst"), F.lit(False)
    for i, colors in enumerate(labellings):
        out = out.join(colors.select(F.col("id").alias("src"), F.col("color").alias(f"s{i}")), "src").join(colors.select(F.col("id").alias("dst"), F.col("color").alias(f"d{i}")), "dst")
    for i in reversed(range(len(labellings))):
        s, d = F.col(f"s{i}"), F.col(f"d{i}")
        turn = F.when(s != d, s > d).otherwise(turn)
    return out.select(F.when(turn, F.col("dst")).otherwise(F.col("src")).alias("src"), F.when(turn, F.col("src")).otherwise(F.col("dst")).alias("dst"))


def blocks(edges: DataFrame) -> DataFrame:
    """(c1, c2, m, dead) of coloured edges; a dead block admits no swap: one edge, or one node on a side between two colours."""
    sides = edges.groupBy("c1", "c2").agg(F.count("*").alias("m"), F.min("a").alias("a1"), F.max("a").alias("a2"), F.min("b").alias("b1"), F.max("b").alias("b2"))
    one_sided = (F.col("c1") != F.col("c2")) & ((F.col("a1") == F.col("a2")) | (F.col("b1") == F.col("b2")))
    return sides.select("c1", "c2", "m", ((F.col("m") == 1) | one_sided).alias("dead"))


def swap_round(edges: DataFrame, round_no: int, seed: int) -> DataFrame:
    """One round of swaps over coloured edges (a, b, c1, c2), in any number of tasks."""
    edges = edges.select("a", "b", "c1", "c2")
    mono = F.col("c1") == F.col("c2")
    turned = mono & (hashrand.integer(f"{seed}:{round_no}:turn", F.least("a", "b"), F.greatest("a", "b")) % 2 == 1)
    low, high = F.least("a", "b"), F.greatest("a", "b")
    faced = edges.select(
        F.when(turned, high).when(mono, low).otherwise(F.col("a")).alias("a"), F.when(turned, low).when(mono, high).otherwise(F.col("b")).alias("b"), "c1", "c2",
        hashrand.digest(f"{seed}:{round_no}", low, high).alias("h"),
    )
    placed = hold(numbered(faced, [F.col("h"), F.col("a"), F.col("b")], ["c1", "c2"], "place"))
    first = F.max(F.when(F.col("place") % 2 == 0, F.struct("a", "b")))
    second = F.max(F.when(F.col("place") % 2 == 1, F.struct("a", "b")))
    pairs = placed.groupBy("c1", "c2", F.floor(F.col("place") / 2).alias("pair")).agg(first.alias("e"), second.alias("f")).where("f is not null")
    proper = pairs.where("e.a <> f.a and e.b <> f.b and e.a <> f.b and f.a <> e.b")
    made = hold(
        proper.select("c1", "c2", "pair", F.explode(F.array(F.struct(F.col("e.a").alias("a"), F.col("f.b").alias("b")), F.struct(F.col("f.a").alias("a"), F.col("e.b").alias("b")))).alias("n"))
        .select("c1", "c2", "pair", "n.a", "n.b", F.least("n.a", "n.b").alias("low"), F.greatest("n.a", "n.b").alias("high"))
    )
    present = placed.select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high"))
    clash = made.join(present, ["low", "high"], "left_semi").select("c1", "c2", "pair").unionByName(
        made.join(made.groupBy("low", "high").count().where("count > 1").select("low", "high"), ["low", "high"], "left_semi").select("c1", "c2", "pair")
    )
    key = ["c1", "c2", "pair"]
    swapped = hold(made.join(clash.distinct(), key, "left_anti"))
    kept = placed.withColumn("pair", F.floor(F.col("place") / 2)).join(swapped.select(*key).distinct(), key, "left_anti").select("a", "b", "c1", "c2")
    out = materialize(kept.unionByName(swapped.select("a", "b", "c1", "c2")))
    for table in (placed, made, swapped):
        table.unpersist()
    return out


def swap_block(a: np.ndarray, b: np.ndarray, mono: bool, attempts: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """A chain of random swaps in one block."""
    a, b = a.tolist(), b.tolist()
    present = set(zip(a, b, strict=True))
    if mono:
        present |= set(zip(b, a, strict=True))
    for start in range(0, attempts, 65536):
        n = min(65536, attempts - start)
        first, second, turn = rng.integers(0, len(a), n).tolist(), rng.integers(0, len(a), n).tolist(), rng.integers(0, 2, n).tolist()
        for i, j, t in zip(first, second, turn, strict=True):
            u, v, x, y = a[i], b[i], a[j], b[j]
            if mono and t:
                x, y = y, x
            if i == j or u == x or v == y or u == y or v == x or (u, y) in present or (x, v) in present:
                continue
            present.difference_update(((u, v), (x, y)))
            present.update(((u, y), (x, v)))
            if mono:
                present.difference_update(((v, u), (y, x)))
                present.update(((y, u), (v, x)))
            a[i], b[i], a[j], b[j] = u, y, x, v
    return np.array(a, np.int64), np.array(b, np.int64)


def _attempts(r, m: int, rng: np.random.Generator) -> int:
    """r per edge, or a random number of times per edge between the two of a pair."""
    return int(m * (rng.uniform(*r) if isinstance(r, tuple) else r))


def _chain(r, seed: int):
    def chain(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["a", "b"])
        c1, c2 = int(frame["c1"].iloc[0]), int(frame["c2"].iloc[0])
        rng = np.random.default_rng([seed & 0xFFFFFFFF, c1 & 0xFFFFFFFF, c2 & 0xFFFFFFFF])
        a, b = swap_block(frame["a"].to_numpy(), frame["b"].to_numpy(), c1 == c2, _attempts(r, len(frame), rng), rng)
        return pd.DataFrame({"a": a, "b": b})

    return chain


def rewire(graph: Graph, colors: DataFrame, r: int | float | tuple = 1, seed: int = 0, block: int = BLOCK, parallel: bool = False) -> Graph:
    """The graph after about r swap attempts per edge inside blocks of ``colors`` (id, color); of a pair r, a random number between. ``parallel`` runs every block in rounds."""
    block = 0 if parallel else block
    edges = hold(coloured(graph.edges, colors))
    found = hold(blocks(edges))
    dead = edges.join(found.where("dead"), ["c1", "c2"], "left_semi").select("a", "b")
    small = edges.join(found.where(~F.col("dead") & (F.col("m") <= block)).select("c1", "c2"), ["c1", "c2"])
    parts = [dead, small.groupBy("c1", "c2").applyInPandas(_chain(r, seed), "a long, b long")]
    large = found.where(~F.col("dead") & (F.col("m") > block))
    if large.limit(1).count():
        part = materialize(edges.join(large.select("c1", "c2"), ["c1", "c2"]))
        times = np.random.default_rng(seed & 0xFFFFFFFF).uniform(*r) if isinstance(r, tuple) else r
        for i in range(max(1, round(2 * times))):  # a round tries a swap per two edges
            after = swap_round(part, i, seed)
            discard(part)
            part = after
        parts.append(part.select("a", "b"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return graph.with_edges(materialize(canonical(out, "a", "b")))


def rewire_rounds(graph: Graph, colors: DataFrame, rounds: int, seed: int = 0) -> Graph:
    """The graph after so many rounds of swaps in all blocks."""
    edges = materialize(coloured(graph.edges, colors))
    for i in range(rounds):
        edges = swap_round(edges, i, seed)
    return graph.with_edges(canonical(edges, "a", "b"))


def colour_degree_changes(before: Graph, after: Graph, colors: DataFrame) -> DataFrame:
    """Nodes whose degree into some colour differs between two graphs: none after rewiring."""
    from veilgraph.operators.colours import colour_degrees
    from veilgraph.operators.structure import differing

    return differing(colour_degrees(before, colors), colour_degrees(after, colors)).select("id").distinct()


def sample_configuration(graph: Graph, colors: DataFrame, seed: int = 0) -> DataFrame:
    """(src, dst, weight) of a random multigraph with the same colour degrees: stubs of the two sides of each colour pair matched at random.

    Parallel edges add up; a loop adds two to its node's weight.
    """
    ends = coloured(graph.edges, colors)
    left = ends.select("c1", "c2", F.col("a").alias("id"), F.concat_ws(":", "a", "b").alias("stub"), F.lit(0).alias("side"))
    right = ends.select("c1", "c2", F.col("b").alias("id"), F.concat_ws(":", "a", "b").alias("stub"), F.lit(1).alias("side"))
    mono = F.col("c1") == F.col("c2")
    stubs = left.unionByName(right).select("c1", "c2", "id", F.when(mono, F.lit(2)).otherwise(F.col("side")).alias("side"), hashrand.digest(f"{seed}:stub", "stub", "side").alias("h"))
    placed = hold(numbered(stubs, [F.col("h"), F.col("id")], ["c1", "c2", "side"], "place"))
    slot = placed.withColumn("pair", F.when(F.col("side") == 2, F.floor(F.col("place") / 2)).otherwise(F.col("place")))
    met = slot.groupBy("c1", "c2", "pair").agg(F.min("id").alias("src"), F.max("id").alias("dst"))
    return met.groupBy("src", "dst").agg(F.sum(F.when(F.col("src") == F.col("dst"), 2).otherwise(1)).alias("weight"))

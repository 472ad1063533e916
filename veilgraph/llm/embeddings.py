"""Embedding near-dedup by product quantisation.

Equal vectors are one before anything is compared, with the number of them as its weight. Coarse centroids and the codebooks of the residuals'
subspaces are fitted on a sample bounded in rows and bytes (``SAMPLE`` vectors or ``SAMPLE_BYTES``, those with the least hash). Every vector is stored in the inverted
list of its nearest centroid, as the codes of its residual and the exact error of that code, and is looked up in
its ``PROBES`` nearest lists. In a list, a table of distances from the query's residual to the
codewords gives the distance to every stored code; by the triangle inequality a stored vector whose
distance to the query, less its own code error, exceeds the threshold can't link, and all others
are reranked by exact cosine in double precision. So the codes lose no link within probed lists.

The number of lists grows with the table, one to ``PER_LIST`` vectors: where they are more than ``CENTRES``, a centroid is the sum of one entry from each of
several codebooks, each fitted on what the ones before leave, and the nearest are found by a beam search.

A list with more than ``CELL`` stored vectors is cut into blocks of stored and of querying vectors
by hash; a task gets one pair of blocks, whatever a list holds. It returns per vector a
number of links and one link of the block's own components: links are counted, never listed. A pair is counted once although both ends may look each other up:
the query counts itself, and counts the stored vector only if that one doesn't probe the query's list.

Cases: vectors that are null, zero, of another dimension than most, or hold null or non-finite
components link with nothing; rows with the same id each get a result and count as vectors; an empty table gives an empty
result; extra columns (labels too) are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilgraph.operators.components import connected_components
from veilgraph.plans.workspace import bounded_batches, freeing, hold, materialize

COSINE, PROBES, SAMPLE, SAMPLE_BYTES, CENTRES = 0.9, 4, 16384, 64 << 20, 1024
SUBSPACES, CODEWORDS = 8, 256
#: Vectors to a list that the number of lists aims at, and vectors in a block.
PER_LIST, CELL = 64, 1024


def _nearest(x: np.ndarray, centres: np.ndarray, n: int = 1) -> np.ndarray:
    """Indices of the n nearest centres of each row, nearest first."""
    if len(x) > 4096:
        return np.concatenate([_nearest(x[i : i + 4096], centres, n) for i in range(0, len(x), 4096)])
    far = (centres**2).sum(1) - 2 * (x @ centres.T)
    if n == 1:
        return far.argmin(1)[:, None]
    n = min(n, len(centres))
    part = np.argpartition(far, n - 1, axis=1)[:, :n]
    return np.take_along_axis(part, np.argsort(np.take_along_axis(far, part, 1), axis=1, kind="stable"), 1)


def kmeans(x: np.ndarray, k: int, rounds: int = 10, seed: int = 7) -> np.ndarray:
    """At most k centres of x by Lloyd's rounds from distinct rows."""
    distinct = np.unique(x, axis=0)
    rng = np.random.default_rng(seed)
    centres = distinct[rng.permutation(len(distinct))[:k]].copy()
    for _ in range(rounds):
        own = _nearest(x, centres)[:, 0]
        count = np.bincount(own, minlength=len(centres))
        order = np.argsort(own, kind="stable")
        sums = np.add.reduceat(x[order], np.minimum(np.cumsum(count) - count, len(x) - 1), axis=0)
        full = count > 0
        centres[full] = sums[full] / count[full, None]
    return centres


class Quantiser:
    """Coarse codebooks, whose sums are the lists' centroids, and codebooks of the subspaces of what they leave."""

    def __init__(self, sample: np.ndarray, lists: int, subspaces: int = SUBSPACES, codewords: int = CODEWORDS, centres: int = CENTRES):
        most = max(1, min(centres, len(sample) // 8))
        levels = 1
        while most > 1 and most**levels < lists:
            levels += 1
        size, self.coarse, residual = max(1, min(most, round(lists ** (1 / levels)))), [], sample
        for level in range(levels):
            self.coarse.append(kmeans(residual, size, seed=7 + level))
            residual = residual - self.coarse[-1][_nearest(residual, self.coarse[-1])[:, 0]]
        self.cuts = np.linspace(0, sample.shape[1], min(subspaces, sample.shape[1]) + 1).astype(int)
        self.books = [kmeans(residual[:, a:b], codewords) for a, b in zip(self.cuts[:-1], self.cuts[1:], strict=True)]

    def lists(self, x: np.ndarray, n: int) -> np.ndarray:
        """The numbers of the n lists near each row, nearest first: a beam search over the codebooks."""
        if len(x) > 1024:
            return np.concatenate([self.lists(x[i : i + 1024], n) for i in range(0, len(x), 1024)])
        number = _nearest(x, self.coarse[0], n).astype(np.int64)
        left = x[:, None, :] - self.coarse[0][number]
        for book in self.coarse[1:]:
            rows, beam = number.shape
            far = (left**2).sum(2)[:, :, None] + (book**2).sum(1) - 2 * (left @ book.T)
            flat = far.reshape(rows, -1)
            best = np.argsort(flat, axis=1, kind="stable")[:, : min(n, flat.shape[1])]
            of, entry = np.divmod(best, len(book))
            number = np.take_along_axis(number, of, 1) * len(book) + entry
            left = np.take_along_axis(left, of[:, :, None], 1) - book[entry]
        return number

    def centre(self, number: int) -> np.ndarray:
        """The centroid of a list."""
        out = np.zeros(self.coarse[0].shape[1])
        for book in reversed(self.coarse):
            number, entry = divmod(number, len(book))
            out = out + book[entry]
        return out

    def encode(self, residual: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of residuals, and the distance from each to what its code stands for."""
        codes, error = [], np.zeros(len(residual))
        for book, a, b in zip(self.books, self.cuts[:-1], self.cuts[1:], strict=True):
            code = _nearest(residual[:, a:b], book)[:, 0]
            error += ((residual[:, a:b] - book[code]) ** 2).sum(1)
            codes.append(code.astype(np.uint8))
        return np.stack(codes, 1), np.sqrt(error)

    def distances(self, query: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Asymmetric distances: queries' residuals (rows) to stored codes (columns), by table lookup."""
        far = np.zeros((len(query), len(codes)))
        for m, (book, a, b) in enumerate(zip(self.books, self.cuts[:-1], self.cuts[1:], strict=True)):
            part = query[:, a:b]
            table = (part**2).sum(1)[:, None] - 2 * (part @ book.T) + (book**2).sum(1)
            far += table[:, codes[:, m]]
        return np.sqrt(np.maximum(far, 0))


def unit_rows(column: pa.Array, dimension: int) -> tuple[np.ndarray, np.ndarray]:
    """(usable, unit): which vectors can link, and those as rows of length one in double precision."""
    lists = column.cast(pa.list_(pa.float64()))
    lengths = np.asarray(lists.value_lengths().fill_null(-1))
    usable = lengths == dimension
    kept = lists.filter(pa.array(usable))
    flat = kept.flatten()
    x = np.asarray(flat.fill_null(float("nan"))).reshape(-1, dimension) if dimension else np.empty((0, 0))
    with np.errstate(all="ignore"):
        scale = np.abs(x).max(1, initial=0.0)
        x = x / scale[:, None]
        x = x / np.sqrt((x * x).sum(1))[:, None]
    fine = np.isfinite(x).all(1) & np.isfinite(scale) & (scale > 0)
    usable[np.flatnonzero(usable)[~fine]] = False
    return usable, x[fine]


def _units(dimension: int):
    """The usable vectors at length one, with 128 bits of hash."""

    def units(batches):
        for batch in batches:
            usable, x = unit_rows(batch.column(1), dimension)
            digests = [xxhash.xxh3_128_intdigest(row.tobytes()) for row in x + 0.0]  # no negative zeros
            high, low = (np.array([d >> shift & (1 << 64) - 1 for d in digests], np.uint64).view(np.int64) for shift in (64, 0))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).filter(pa.array(usable)), pa.array(high), pa.array(low), pa.array(list(x), pa.list_(pa.float64()))], names=["key", "high", "low", "unit"]
            )

    return units


def _rows(column: pa.Array, dimension: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, dimension)


def _place(model: Quantiser, probes: int, dimension: int):
    """The lists that each vector probes, its own first."""

    def place(batches):
        for batch in batches:
            near = model.lists(_rows(batch.column(1), dimension), probes) if batch.num_rows else np.empty((0, 1), np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(near), pa.list_(pa.int64()))], names=["key", "unit", "weight", "probed"])

    return place


def linked(x: np.ndarray, y: np.ndarray, near: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (row of x, row of y) among those marked in ``near`` whose cosine is high enough.

    What lies so close to the threshold that the order of a sum could decide is summed in one order, so both ends and every block agree.
    """
    a, b = np.nonzero(near)
    if len(a) < near.size // 8:
        step = max(1, (1 << 22) // x.shape[1])
        value = np.concatenate([np.einsum("ij,ij->i", x[a[i : i + step]], y[b[i : i + step]]) for i in range(0, max(1, len(a)), step)])
    else:
        value = (x @ y.T)[a, b]
    close = np.flatnonzero(np.abs(value - cosine) < 1e-9)
    value[close] = [(x[i] * y[j]).sum() for i, j in zip(a[close].tolist(), b[close].tolist(), strict=True)]
    return a[value >= cosine], b[value >= cosine]


def _forest(hit: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) for the components of a bipartite link matrix; root is the smallest key."""
    mine, other = left.copy(), right.copy()
    top = np.iinfo(np.int64).max
    while True:
        new_other = np.minimum(other, np.where(hit, mine[:, None], top).min(0, initial=top))
        new_mine = np.minimum(mine, np.where(hit, new_other[None, :], top).min(1, initial=top))
        if (new_mine == mine).all() and (new_other == other).all():
            break
        mine, other = new_mine, new_other
    node, root = np.concatenate((left, right)), np.concatenate((mine, other))
    return node[node != root], root[node != root]


def _links(model: Quantiser, dimension: int, cosine: float):
    radius = np.sqrt(2 - 2 * cosine) + 1e-9

    def links(batch):
        row = batch.combine_chunks().to_batches()[0]
        asks, keys, own = np.asarray(row.column("asks").cast(pa.int8())) > 0, np.asarray(row.column("key")), row.column("list")[0].as_py()
        weight = np.asarray(row.column("weight"))
        x, probed = _rows(row.column("unit"), dimension), np.asarray(row.column("probed").flatten()).reshape(row.num_rows, -1)
        q, s = np.flatnonzero(asks), np.flatnonzero(~asks)
        counts: dict[str, list] = {"key": [], "other": [], "links": []}
        if len(q) and len(s):
            centre = model.centre(own)
            codes, error = model.encode(x[s] - centre)
            mine, theirs = keys[q], keys[s]
            total_q, total_s = np.zeros(len(q), np.int64), np.zeros(len(s), np.int64)
            pairs = np.zeros((len(q), len(s)), bool)
            for i in range(0, len(q), 256):
                part = slice(i, i + 256)
                near = model.distances(x[q[part]] - centre, codes) <= radius + error
                near &= mine[part, None] != theirs
                a, b = linked(x[q[part]], x[s], near, cosine)
                pairs[part][a, b] = True
                np.add.at(total_q[part], a, weight[s][b])
                # the stored vector counts the pair itself where it probes the query's own list
                back = (probed[s][b] == probed[q[part]][a][:, :1]).any(1)
                np.add.at(total_s, b[~back], weight[q[part]][a[~back]])
            some_q, some_s = total_q > 0, pairs.any(0)
            node, root = _forest(pairs[some_q][:, some_s], mine[some_q], theirs[some_s])
            for key, other, n in ((mine[total_q > 0], None, total_q[total_q > 0]), (theirs[total_s > 0], None, total_s[total_s > 0]), (node, root, None)):
                counts["key"].append(key)
                counts["other"].append(np.full(len(key), -1) if other is None else other)
                counts["links"].append(np.zeros(len(key), np.int64) if n is None else n)
        columns = [np.concatenate(v) if v else np.empty(0, np.int64) for v in counts.values()]
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=list(counts))

    return links


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE, probes: int = PROBES, sample: int = SAMPLE, per_list: int = PER_LIST, centres: int = CENTRES) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per row of ``vectors``."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    # rows get keys of their own: ids may be null or repeat
    base = materialize(vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).withColumn("key", F.monotonically_increasing_id()))
    found = base.where("v is not null").groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    dimension = found[0]["d"] if found else 0
    marked = materialize(base.select("key", "v").mapInArrow(freeing(_units(dimension)), "key long, high long, low long, unit array<double>")) if dimension else None
    # equal vectors are compared once
    distinct = marked and materialize(marked.groupBy("high", "low").agg(F.min("key").alias("stands"), F.count("*").alias("weight")))
    n = distinct.count() if distinct else 0
    if not n:
        return base.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    rows = max(1024, min(sample, SAMPLE_BYTES // (8 * dimension)))
    least = distinct.orderBy("high", "low").limit(rows).select(F.col("stands").alias("key"))
    chosen = marked.join(least, "key").select("high", "unit").toArrow().sort_by("high")
    model = Quantiser(_rows(chosen.column("unit").combine_chunks(), dimension), max(1, n // per_list), centres=centres)
    shared = spark.sparkContext.broadcast(model)  # a few codebooks of at most CENTRES entries
    units = marked.join(distinct.select(F.col("stands").alias("key"), "weight"), "key").select("key", "unit", "weight")
    placed = materialize(units.mapInArrow(freeing(_late(_place, shared, probes, dimension)), "key long, unit array<double>, weight long, probed array<long>"))
    # lists of many vectors, and the blocks that they are cut into; the others are one block
    held = placed.groupBy(F.col("probed")[0].alias("list")).agg(F.count("*").alias("n"))
    asked = placed.select(F.explode("probed").alias("list")).groupBy("list").agg(F.count("*").alias("n"))
    blocks = held.select("list", F.ceil(F.col("n") / CELL).cast("int").alias("ns")).join(asked.select("list", F.ceil(F.col("n") / (CELL * probes)).cast("int").alias("nq")), "list").where("ns > 1 or nq > 1")
    listed = (
        placed.withColumn("list", F.col("probed")[0]).withColumn("asks", F.lit(False))
        .unionByName(placed.withColumn("list", F.explode("probed")).withColumn("asks", F.lit(True)))
        .join(materialize(blocks), "list", "left").withColumns({c: F.coalesce(c, F.lit(1)) for c in ("ns", "nq")})
    )
    salt = F.abs(F.xxhash64("key") % (1 << 40))
    own, other = salt % F.when(F.col("asks"), F.col("nq")).otherwise(F.col("ns")), F.sequence(F.lit(0), F.when(F.col("asks"), F.col("ns")).otherwise(F.col("nq")) - 1)
    cells = listed.withColumn("own", own.cast("int")).withColumn("other", F.explode(other)).select(
        "list", F.expr("if(asks, own, other)").alias("q"), F.expr("if(asks, other, own)").alias("s"), "key", "unit", "weight", "probed", "asks"
    )
    met = materialize(
        cells.groupBy("list", "q", "s").applyInArrow(_late(_links, shared, dimension, cosine), "key long, other long, links long")
    )
    degrees = met.groupBy(F.col("key").alias("stands")).agg(F.sum("links").alias("links"))
    parts = connected_components(met.where("other >= 0"), "key", "other")
    kinds = distinct.join(degrees, "stands", "left").join(parts.withColumnRenamed("node", "stands"), "stands", "left")
    kinds = materialize(kinds.select("high", "low", F.coalesce("component", "stands").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links")))
    members = marked.select("key", "high", "low").join(kinds, ["high", "low"]).select("key", "component", "n_links")
    groups = hold(base.select("key", "vec_id").join(members, "key", "left").withColumn("component", F.coalesce("component", "key")))
    least = materialize(groups.groupBy("component").agg(F.min("vec_id").alias("component_id")))
    return groups.join(least, "component").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept")
    )


def _late(make, shared, *more):
    """The function that ``make`` returns for a broadcast model, made where it runs."""
    made: list = []

    def call(data):
        if not made:
            made.append(make(shared.value, *more))
        return made[0](data)

    return call

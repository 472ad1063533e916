"""SimHash near-dedup by meet-in-the-middle ball hashing.

A text's fingerprint is the bitwise majority of the XXH64 hashes of its
three-word shingles. Fingerprints within ``radius`` bits of each other share at
least one variant within half the radius of both, so every *distinct*
fingerprint emits its ball of that half radius, the variants are shuffled, and
fingerprints that meet in a variant are verified. Copies of a text are one
fingerprint before the shuffle, however many there are; a variant's group holds
distinct members of one ball only (65 at most for radius 2), whatever the data.

For an even radius all members of a variant's group are within the radius of one another, so a
chain through the sorted group (each member with the one before it) has the same components as all
pairs, and a verified chain loses no component.

``near_copies`` is for word shingles of any length and a Jaccard similarity of their sets; its links are exactly the pairs of that similarity. Texts with one
set of shingles are one. 64 bits and a radius of 2 find copies that are almost equal only, so
it emits the balls of several blocks of ``BLOCK`` bits, of a long fingerprint of two-word shingles: near copies agree in some block to within
the radius though they differ in many bits of the whole. Of the texts with one value of a block, the one with the smallest id stands for all in the ball's variants, so a variant's
group is bounded here too; each meets the one that stands for it, and those that meet in a variant the one before and the
first. What meets and is near in another long fingerprint, of the shingles asked for, is verified by the sets themselves.
Fingerprints leave some pairs out. These are found by prefixes: in one order of all shingles, rare ones first, two sets of a similarity s share one of the first
n - ceil(s n) + 1 of their n, whatever the order (Chaudhuri et al., 2006). Prefixes that share a shingle across components found so far are verified alike, so a large group of near copies,
one component by then, is not compared with itself. The first shingle that two sets share leaves what comes after it to share at most, which has to be enough (Xiao et al., 2008); texts meet by
the shingle and by sizes for which it is, so copies that changed too much, whose own shingles come first, don't meet their group. Before that all meet, for each shingle, the text that has the fewest rarer ones,
so that what belongs to a large group is in its component by then. How rare a shingle is comes from counters of all rows' shingles; it bears on the work only.

Cases: a null text is empty; a text without words has fingerprint zero and links like any other;
fewer words than a shingle give one shingle of the whole sequence; repeated rows each
get a result; a null doc_id is never the smallest of its component unless all are null; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilgraph.llm.rows import plainly, with_keys
from veilgraph.operators.components import connected_components
from veilgraph.plans.workspace import bounded_batches, discard, freeing, hold, materialize, release

SHINGLE, SEED, RADIUS = 3, 42, 2
#: For near copies: shingle and similarity, bits of a block, blocks, and longs of the fingerprint that verifies.
NEAR, SIMILARITY, BLOCK, BLOCKS, LONG = 5, 0.8, 32, 8, 8
#: Words of the shingles behind the blocks: one changed word changes as many shingles, and fewer changed shingles are fewer differing bits.
WIDE = 2
#: Counters of shingles, by the last bits of their hash, and how many of them a row holds.
COUNTERS, COUNTED = 1 << 20, 1 << 14
#: Steps of sizes, between one and the smallest that a set may have to be similar to it.
STEPS = 4
#: Ids that are sent to all executors.
FEW = 1 << 18
#: Shingles whose bits are unpacked at once.
_BLOCK = 1 << 15


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint of a text's UTF-8 bytes."""
    words = text.lower().split()  # of bytes: A-Z only, and the six ASCII white-space bytes
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-shingle] + 1))
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends[shingle - 1 :].tolist(), strict=True)), np.uint64, len(starts))
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), _BLOCK):
        part = hashes[i : i + _BLOCK]
        ones += np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def _fingerprints(batches):
    for batch in batches:
        texts = batch.column(1).to_pylist()
        out = np.fromiter((fingerprint(t or b"") for t in texts), np.uint64, len(texts))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out.view(np.int64))], names=["doc_id", "fp"])


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_ODD = _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def long_fingerprint(words: np.ndarray, shingle: int, longs: int = LONG) -> np.ndarray:
    """The majority bits of ``longs`` hashes of each shingle of a text's words, given by their 64-bit hashes; zero bits without words."""
    if not len(words):
        return np.zeros(64 * longs, bool)
    shingle = min(shingle, len(words))
    n = len(words) - shingle + 1
    ones = np.zeros((longs, 64), np.int64)
    for i in range(0, n, _BLOCK):
        part = words[i : i + _BLOCK + shingle - 1]
        size = len(part) - shingle + 1
        hashes = sum(part[k : k + size] * _ODD[k % 128] for k in range(shingle))
        for k in range(longs):
            bits = _mixed(hashes + _ODD[128 + k]).view(np.uint8).reshape(-1, 8)
            ones[k] += np.unpackbits(bits, axis=1).sum(0, dtype=np.int64)
    return ones.ravel() * 2 > n


def _numbers(bits: np.ndarray, width: int) -> np.ndarray:
    """Rows of bits as signed longs of so many bits each."""
    return (bits.reshape(len(bits), -1, width).astype(np.uint64) << np.arange(width, dtype=np.uint64)).sum(2, dtype=np.uint64).view(np.int64)


def _hashes(text: bytes | None) -> np.ndarray:
    words = (text or b"").lower().split()
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def shingle_set(words: np.ndarray, shingle: int) -> np.ndarray:
    """The hashes of a text's different shingles, ascending; fewer words than a shingle are one, none are none."""
    shingle = min(shingle, len(words))
    if not shingle:
        return np.zeros(0, np.uint64)
    n = len(words) - shingle + 1
    return np.unique(_mixed(sum(words[k : k + n] * _ODD[k % 128] for k in range(shingle))))


MARKS = "id long, key binary, wide array<long>, exact array<long>, part int, counts binary"


def _marks(shingle: int, blocks: int, width: int):
    """A row for each text, with a digest of its set and its fingerprints; at the end of a task rows without id, with counters of the texts' shingles."""

    def marks(batches):
        counts, names = np.zeros(COUNTERS, np.int64), [f.split()[0] for f in MARKS.split(", ")]
        for batch in batches:
            wide, exact = np.zeros((batch.num_rows, blocks * width), bool), np.zeros((batch.num_rows, 64 * LONG), bool)
            keys, sets = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                hashes = _hashes(text)
                wide[i] = long_fingerprint(hashes, WIDE, -(-blocks * width // 64))[: blocks * width]
                exact[i] = long_fingerprint(hashes, shingle)
                sets.append(shingle_set(hashes, shingle))
                keys.append(xxhash.xxh3_128_digest(sets[-1].tobytes()))
            if sets:
                counts += np.bincount((np.concatenate(sets) & np.uint64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS)
            prints = (pa.array(list(_numbers(x, w)), pa.list_(pa.int64())) for x, w in ((wide, width), (exact, 64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), *prints, pa.nulls(batch.num_rows, pa.int32()), pa.nulls(batch.num_rows, pa.binary())], names=names)
        parts = [(i, zlib.compress(part.tobytes(), 1)) for i, part in enumerate(counts.reshape(-1, COUNTED)) if part.any()]
        empty = [pa.nulls(len(parts), t) for t in (pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays([*empty, pa.array([i for i, _ in parts], pa.int32()), pa.array([p for _, p in parts], pa.binary())], names=names)

    return marks


def _counted(marked: DataFrame) -> np.ndarray:
    """All tasks' counters summed, a part of them in a task."""

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(COUNTED, np.int64)
        for part in frame["counts"]:
            total += np.frombuffer(zlib.decompress(part), np.int64)
        return pd.DataFrame({"part": frame["part"].iloc[:1], "counts": [total.tobytes()]})

    counts = np.zeros((COUNTERS // COUNTED, COUNTED), np.int64)
    for row in marked.where("part is not null").select("part", "counts").groupBy("part").applyInPandas(add, "part int, counts binary").collect():
        counts[row.part] = np.frombuffer(row.counts, np.int64)
    return counts.ravel()


def _prefixes(shingle: int, similarity: float, counts):
    """(token, fp, size, label, at) of texts (fp, label, text): the shingles of which a set of that similarity has one among its own, and their places in the order, from 0."""

    def prefixes(batches):
        for batch in batches:
            tokens, sizes, places, at = [], [], [], []
            for i, text in enumerate(batch.column(2).to_pylist()):
                own = shingle_set(_hashes(text), shingle)
                most = len(own) - math.ceil(similarity * len(own) - 1e-9) + 1 if len(own) else 0
                order = np.lexsort((own, counts.value[(own & np.uint64(COUNTERS - 1)).astype(np.int64)]))[:most]
                tokens.append(own[order].view(np.int64))
                sizes.append(np.full(len(order), len(own), np.int32))
                places.append(np.full(len(order), i, np.int64))
                at.append(np.arange(len(order), dtype=np.int32))
            if tokens:
                of = pa.array(np.concatenate(places))
                columns = [pa.array(np.concatenate(tokens)), batch.column(0).take(of), pa.array(np.concatenate(sizes)), batch.column(1).take(of), pa.array(np.concatenate(at))]
                yield pa.RecordBatch.from_arrays(columns, names=["token", "fp", "size", "label", "at"])

    return prefixes


def _sets(shingle: int):
    def sets(batches):
        for batch in batches:
            found = [shingle_set(_hashes(text), shingle).tobytes() for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["fp", "set"])

    return sets


def _similar(similarity: float):
    """(src, dst) of rows (src, dst, a, b) whose sets a and b have that similarity."""

    def similar(batches):
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both > 0 and both / (len(x) + len(y) - both) >= similarity)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["src", "dst"]).filter(pa.array(keep, pa.bool_()))

    return similar


def _verified(pairs: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(src, dst): labels of the rows (x, y, src, dst) of ``pairs`` whose texts x and y have that similarity."""
    ends = materialize(pairs.select(F.explode(F.array("x", "y")).alias("id")).distinct())
    if ends.count() <= FEW:  # no shuffle of all texts for these
        ends = F.broadcast(ends)
    sets = materialize(texts.join(ends, "id", "left_semi").select("id", "text").mapInArrow(freeing(_sets(shingle)), "fp long, set binary"))
    met = pairs.join(sets.withColumnsRenamed({"fp": "x", "set": "a"}), "x").join(sets.withColumnsRenamed({"fp": "y", "set": "b"}), "y")
    out = materialize(met.select("src", "dst", "a", "b").mapInArrow(freeing(_similar(similarity)), "src long, dst long").distinct())
    discard(sets, ends)
    return out


def _shared(rows: DataFrame) -> DataFrame:
    """The rows (token, fp, size, label, at) of tokens that more than one label has."""
    marked = rows.selectExpr("*", "min(label) over (partition by token) as low", "max(label) over (partition by token) as high")
    return materialize(marked.where("low < high").drop("low", "high"))  # one shuffle; few rows stay


def _largest(shared: DataFrame) -> DataFrame:
    """(token, main): each token's largest label."""
    return shared.groupBy("token", "label").count().groupBy("token").agg(F.max_by("label", F.struct("count", "label")).alias("main"))


def _may(similarity: float):
    """Whether x and y, of ``sx`` and ``sy`` tokens, of which ``ax`` and ``ay`` come before one that both have, may have that similarity if it is the first."""
    slack = 1e-6
    both = similarity / (1 + similarity) * (F.col("sx") + F.col("sy")) - slack  # two similar sets share so many at least
    return (F.least("sx", "sy") >= similarity * F.greatest("sx", "sy") - slack) & (F.col("sx") - F.col("ax") >= both) & (F.col("sy") - F.col("ay") >= both)


def _renamed(rows: DataFrame, joined: DataFrame) -> DataFrame:
    """``rows`` with the labels that theirs are joined into (label, after)."""
    return rows.join(joined, "label", "left").withColumn("label", F.coalesce("after", "label")).drop("after")


def _to_centres(shared: DataFrame, similarity: float) -> DataFrame:
    """Some of the pairs of ``_across``, at most one for each row: with the text of the token's largest label that has the fewest tokens before it. It finds most of a group's texts, which need not meet the whole group then."""
    main = materialize(_largest(shared))
    centre = shared.join(main, "token").where("label = main").groupBy("token").agg(F.min(F.struct("at", "size", "fp", "label")).alias("c"))
    centre = materialize(centre.select("token", F.col("c.fp").alias("y"), F.col("c.size").alias("sy"), F.col("c.at").alias("ay"), F.col("c.label").alias("dst")))
    met = shared.withColumnsRenamed({"fp": "x", "size": "sx", "at": "ax", "label": "src"}).join(centre, "token").where("src <> dst").where(_may(similarity))
    pairs = materialize(met.select("x", "y", "src", "dst").distinct())
    discard(main, centre)
    return pairs


def _across(shared: DataFrame, similarity: float) -> DataFrame:
    """(x, y, src, dst): texts that may have that similarity across labels, by the tokens (token, fp, size, label, at) that they share, and their labels.

    One of the two is outside its token's largest label, so a token of one label and few others gives few pairs. A pair is of a shorter text, or one as long, and a longer one; a longer one's
    row is repeated for every step of sizes that the shorter may have, given how many tokens are before the shared one.
    """
    main = _largest(shared)
    part, slack, width = similarity / (1 + similarity), 1e-6, math.log(min(similarity, 0.999)) / -STEPS

    def step(size):
        return F.floor(F.log(size) / width)

    left = F.col("size") - F.col("at")  # the most that can be shared
    least = F.greatest(F.lit(1 - slack), similarity * F.col("size") - slack)
    steps = F.when(F.col("long"), F.sequence(step(least), step(F.least(F.col("size"), left / part - F.col("size")) + slack))).otherwise(F.array(step(F.col("size"))))
    able = shared.where(left >= similarity * F.col("size") - slack).join(main, "token")
    able = able.select("*", F.explode(F.array(F.lit(False), F.lit(True))).alias("long")).where(F.col("long") | (left >= 2 * part * F.col("size") - slack))
    placed = materialize(able.select("*", F.explode(steps).alias("step")))
    few = placed.where("label <> main").select("token", "step", "long", F.col("fp").alias("x"), F.col("size").alias("sx"), F.col("at").alias("ax"), F.col("label").alias("src"))
    many = placed.select("token", "step", (~F.col("long")).alias("long"), "main", F.col("fp").alias("y"), F.col("size").alias("sy"), F.col("at").alias("ay"), F.col("label").alias("dst"))
    met = few.join(many, ["token", "step", "long"])
    met = met.where("src <> dst and (dst = main or not long)").where("if(long, (sy, y) < (sx, x), (sx, x) < (sy, y))")
    pairs = materialize(met.where(_may(similarity)).select("x", "y", "src", "dst").distinct())
    discard(placed)
    return pairs


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long, one row per row of ``docs``."""
    bounded_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(freeing(_fingerprints), "doc_id long, fp long")


def ball(radius: int, width: int = 64) -> list[int]:
    """All masks of ``width`` bits of which at most ``radius`` are set, as signed longs."""
    masks = [sum(1 << b for b in bits) for n in range(radius + 1) for bits in combinations(range(width), n)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def near_fingerprints(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Verified links (src, dst) between distinct fingerprints ``fp``, with the components of all links within ``radius``."""
    if radius % 2:
        raise ValueError("the ball of half the radius needs an even radius")
    masks = F.array(*[F.lit(m) for m in ball(radius // 2)])
    variants = fps.select("fp", F.explode(masks).alias("mask")).select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("variant"))
    met = variants.selectExpr("fp", "lag(fp) over (partition by variant order by fp) as before").where("before is not null")
    return met.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("before"))) <= radius).select(F.col("before").alias("src"), F.col("fp").alias("dst")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row per row of ``docs``; component_id is the smallest doc_id reachable by links."""
    marked = materialize(fingerprints(docs, id_col, text_col))
    distinct = hold(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    links = near_fingerprints(distinct.select("fp"), radius)
    parts = connected_components(links)
    joined = distinct.join(parts.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    joined = hold(joined)
    # written, as a held table would keep its partitioning, and the join no exchange to split
    ids = materialize(joined.groupBy("component").agg(F.min("least").alias("component_id")))
    classes = joined.join(ids, "component").select("fp", "component_id")
    return marked.join(classes, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = NEAR, similarity: float = SIMILARITY, blocks: int = BLOCKS, width: int = BLOCK, radius: int = RADIUS) -> DataFrame:
    """(doc_id, component_id), one row per row of ``docs``, whose ids are unique and not null; component_id is the smallest doc_id reachable by links between texts of that similarity."""
    if radius % 2 or not 0 < width < 64:
        raise ValueError("blocks of up to 63 bits, and an even radius")
    if not 0 < similarity <= 1:
        raise ValueError("a similarity above 0, of 1 at most")
    spark = docs.sparkSession
    bounded_batches(spark)
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    most = int(64 * LONG * share + 2 * math.sqrt(64 * LONG * share * (1 - share)))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    marked = hold(texts.mapInArrow(freeing(_marks(shingle, blocks, width)), MARKS))
    rows = marked.where("id is not null").select("id", "key", "wide", "exact")
    # texts of one set are one row before any variant is made
    distinct = hold(rows.groupBy("key").agg(F.min(F.struct("id", "wide", "exact")).alias("least")).select("key", F.col("least.id").alias("fp"), "least.wide", "least.exact"))
    n = distinct.count()
    masks = F.array(*[F.lit(m) for m in ball(radius // 2, width)])
    met = []
    for block in range(blocks):  # one after the other, so that their shuffles don't add up on disk
        own = distinct.select("fp", F.col("wide")[block].alias("own"))
        # written to few files: a held table would keep its partitioning, and the join no exchange to split
        least = materialize(own.groupBy("own").agg(F.min("fp").alias("least")), n)
        alike = own.join(least, "own").where("fp > least").select(F.col("least").alias("src"), F.col("fp").alias("dst"))
        variants = least.select("least", "own", F.explode(masks).alias("mask")).select("least", F.col("own").bitwiseXOR(F.col("mask")).alias("variant"))
        beside = variants.selectExpr("least", "lag(least) over (partition by variant order by least) as before", "min(least) over (partition by variant order by least) as first").where("before is not null")
        near = beside.select(F.explode(F.array_distinct(F.array("before", "first"))).alias("src"), F.col("least").alias("dst"))
        met.append(materialize(alike.unionByName(near).distinct(), 3 * n))
        discard(least)
        release(spark)
    prints = distinct.select("fp", "exact")
    pairs = reduce(DataFrame.unionByName, met).distinct()
    pairs = pairs.join(prints.withColumnsRenamed({"fp": "src", "exact": "a"}), "src").join(prints.withColumnsRenamed({"fp": "dst", "exact": "b"}), "dst")
    differing = sum(F.bit_count(F.col("a")[i].bitwiseXOR(F.col("b")[i])) for i in range(LONG))
    near = materialize(pairs.where(differing <= most).select(F.col("src").alias("x"), F.col("dst").alias("y"), "src", "dst"), 3 * n)
    discard(*met)
    links = _verified(near, texts, shingle, similarity)
    labels = materialize(distinct.select("fp").join(connected_components(links).withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("component", "fp").alias("label")), n)
    discard(near, links)
    # what the fingerprints left out
    counts = spark.sparkContext.broadcast(_counted(marked))
    first = texts.join(labels, texts["id"] == labels["fp"]).select("fp", "label", "text")
    tokens = first.mapInArrow(freeing(_prefixes(shingle, similarity, counts)), "token long, fp long, size int, label long, at int")
    release(spark)
    shared = _shared(tokens)
    release(spark)
    joined = []
    for meet in (_to_centres, _across):
        met = meet(shared, similarity)
        release(spark)
        links = _verified(met, texts, shingle, similarity)
        joined.append(materialize(connected_components(links).withColumnsRenamed({"node": "label", "component": "after"})))
        discard(met, links)
        if meet is _to_centres:
            left = _shared(_renamed(shared, joined[0]))
            discard(shared)
            shared = left
    parts = _renamed(_renamed(labels, joined[0]), joined[1]).select("fp", F.col("label").alias("component_id"))
    classes = materialize(distinct.select("key", "fp").join(parts, "fp").select("key", "component_id"), n)
    return rows.join(classes, "key").select(F.col("id").alias("doc_id"), "component_id")


def _kept(docs: DataFrame, id_col: str, text_col: str, grouped) -> DataFrame:
    plain, names = plainly(docs)
    keyed = with_keys(plain, names[id_col], [names[text_col]], "key")
    first = grouped(keyed, "key", names[text_col]).where("doc_id = component_id").select(F.col("doc_id").alias("key"))
    return keyed.join(first, "key", "left_semi").select(*plain.columns).toDF(*docs.columns)


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` that stand for their component of fingerprints within ``radius``, exactly one each: the one with its smallest id, null ids last, and of several with that id the one whose text's hash is least."""
    return _kept(docs, id_col, text_col, lambda *of: near_duplicates(*of, radius))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = NEAR, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` that stand for their group of near copies, exactly one each, unchanged: chosen as by ``keep_first``."""
    return _kept(docs, id_col, text_col, lambda *of: near_copies(*of, shingle, similarity))

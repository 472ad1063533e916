"""Sharding by weighted rendezvous hashing of stable record keys.

Every shard scores a key with weight / -ln(u), u being a uniform hash of the key and the shard, and the highest score gets the
record (law ``key``: the id and the shards decide). A shard more wins only the records on which it
scores highest, so those alone move, and only into it; a shard less hands out only its own. A shard's
part of the keys is its part of the weights.

Slots are positions by id in the shard, counted in ranges (``functions.ordered.numbered``): no shard is sorted in one task.

Cases: null ids hash alike; a null text has no bytes and the checksum 0; rows with one id share a
shard and are ordered by checksum and size; equal texts under different ids are separate records; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilgraph.functions.ordered import numbered

SHARDS, OVERHEAD = 24, 8


def uniform(key: Column, shard: int) -> Column:
    """A hash of the key and the shard in (0, 1), of 53 bits."""
    return (F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11).cast("double") + 0.5) / F.lit(float(1 << 53))


def rendezvous(key: Column, weights: list[float]) -> list[Column]:
    """A struct (score, -shard) per shard; the greatest names the key's shard."""
    return [F.struct((F.lit(float(w)) / -F.log(uniform(key, i))).alias("score"), F.lit(-i).alias("minus")) for i, w in enumerate(weights)]


def shard(docs: DataFrame, weights: list[float], grown: list[float] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard); ``grown`` has more weights after those of ``weights``."""
    grown = grown or [*weights, 1.0]
    if list(grown[: len(weights)]) != list(weights) or len(grown) <= len(weights) or min(grown) <= 0:
        raise ValueError("grown begins with weights and has more; all are positive")
    text = F.col(text_col).cast("binary")
    base = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long").alias("size"),
        F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"),
    )
    scored = base.withColumn("_scores", F.array(*rendezvous(F.col("doc_id"), grown)))
    dealt = scored.select(
        "doc_id", "size", "text_crc32",
        F.lit("key").alias("law"),
        (-F.array_max(F.slice("_scores", 1, len(weights)))["minus"]).cast("int").alias("shard"),
        (-F.array_max("_scores")["minus"]).cast("int").alias("grown_shard"),
    )
    order = [F.col("doc_id").asc_nulls_last(), F.col("text_crc32"), F.col("size")]
    return numbered(dealt, order, ["shard"], "slot").select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


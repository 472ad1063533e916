"""One registered query per operator of this package, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veilgraph.llm import embeddings, mixing, packing, quality, repetition, sentences, sharding, simhash, suffixes, urls


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_quality_rda(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    return quality.classify(docs, quality.fit(docs, _table(spark, folder, "labels")))


def op2_pq_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return embeddings.near_duplicates(_table(spark, folder, "embeddings"))


def op3_suffix_array_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffixes.remove_repeats(_table(spark, folder, "documents"))


def op4_repetition_coverage(spark: SparkSession, folder: str) -> DataFrame:
    return repetition.judge(_table(spark, folder, "documents"))


def op5_sentence_span_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return sentences.remove_repeats(_table(spark, folder, "documents"))


def op6_swap_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(_table(spark, folder, "documents"))


def op7_rendezvous_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shard(_table(spark, folder, "documents"), [1.0] * sharding.SHARDS)


def op8_url_trie(spark: SparkSession, folder: str) -> DataFrame:
    return urls.judge(_table(spark, folder, "pages"))


def op9_curriculum_mix(spark: SparkSession, folder: str) -> DataFrame:
    plan = mixing.plan(_table(spark, folder, "documents"))
    return mixing.in_order(plan).select("doc_id", "size", "source_size", "target", "taken", "copies", "position")


def op10_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, folder, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_quality_rda, op2_pq_embedding_dedup, op3_suffix_array_dedup, op4_repetition_coverage, op5_sentence_span_dedup,
    op6_swap_packing, op7_rendezvous_sharding, op8_url_trie, op9_curriculum_mix, op10_simhash_near_dedup,
)}
#: Where DuckDB can give the same rows over whole tables.
SQL = {"op8_url_trie": urls.SQL, "op9_curriculum_mix": mixing.SQL}

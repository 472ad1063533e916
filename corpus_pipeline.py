"""A training corpus from the documents table: five stages, each an operator applied to all that the stage before it kept.

Every stage's result is written as Parquet to the shared folder and read again as the next one's documents. Stages keep extra columns whatever
their names, the last one leaves them out; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veilgraph.llm import mixing, packing, quality, simhash, suffixes
from veilgraph.plans.workspace import discard, materialize


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels, predicts to be good; null texts are judged as empty ones, and each repeated row by itself."""
    return quality.keep_good(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, of five-word shingles and a similarity of 0.8: the smallest id's, null ids last. Null and empty texts are copies of one another."""
    return simhash.keep_one(docs)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes that repeat earlier ones; a character cut in two goes whole, and so does a document of which no word is left.

    Rows with one id follow in the order of their texts' hashes, null ids last; null texts stay null.
    """
    return suffixes.without_repeats(docs)


def curriculum_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, one row per copy that the mix takes; rows with one id or none are planned one by one, null texts have size 0, a null source is a source."""
    return mixing.mix(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every row, with their sequence and place in it; a null text is one end token."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("simhash near-dedup", simhash_near_dedup),
    ("suffix-array dedup", suffix_array_dedup),
    ("curriculum mix", curriculum_mix),
    ("best-fit packing", best_fit_packing),
]

#: The first stage can't be expressed in SQL; tests/llm holds the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        after = materialize(stage(spark, docs, sf_dir))
        if i:  # what the stage before wrote has been read
            discard(docs)
        docs = after
    return docs

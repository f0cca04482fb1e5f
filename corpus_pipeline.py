"""From raw documents to packed training sequences, in five stages.

Every stage takes any table with doc_id, text and source and keeps all its columns, whatever their names (but for packing,
which returns pieces). Null ids, repeated ids and repeated rows are rows of their own; an empty table stays empty; texts are
read whole, however long. What a stage does with null, empty and equal texts is said below.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from storyloom.llm import exact_dedup, minhash, mixing, packing, toxicity
from storyloom.llm.queries import EXACT_TOKENS, FAST_TOKENS


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the pattern grammar, trained on all labels, predicts to be toxic go; null and empty texts are clean,
    equal texts go or stay together."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.clean(docs, model)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts the one with the largest id stays; null counts as empty, so one of these stays too."""
    return exact_dedup.drop_exact_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near duplicates (five-word shingles, similarity 0.8) the one with the smallest id stays; texts without words are
    like no other and stay. Rows with equal sets of shingles are duplicates."""
    return minhash.drop_near_duplicates(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are mixed to their weights; a document that is taken twice is there twice. A null source is one of its own;
    documents of equal size are drawn by a hash of their keys."""
    return mixing.repeat_rows(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens with their places in sequences; null and empty texts are their end token alone, and
    each of repeated rows is packed."""
    return packing.pack(docs, FAST_TOKENS, EXACT_TOKENS).withColumnRenamed("_id", "doc_id")


STAGES = [("toxicity", toxic), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mixed), ("packing", packed)]

#: The learned, drawn and tokenised stages have no SQL form; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written as Parquet in the shared folder and read again by the next."""
    from storyloom.llm.storage import stored

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

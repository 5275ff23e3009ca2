"""A corpus from documents to packed sequences: five stages, each written as Parquet and read by the next.

Each function takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents. Rows may repeat after mixing, as often as the mix takes them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from judgelake.llm import exact_dedup, mixing, ngram_join, packing, toxicity
from judgelake.llm.common import written
from judgelake.shipping import ship


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the string-kernel machine does not predict to be toxic."""
    ship(spark)
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id."""
    ship(spark)
    return exact_dedup.keep_one_of_each(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that n-gram links connect, the one with the smallest doc_id."""
    ship(spark)
    return ngram_join.one_of_each_component(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the balanced mix of sources takes them."""
    ship(spark)
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences."""
    ship(spark)
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources to target weights", mix),
    ("best-fit packing", pack),
]

#: The first and the later stages fit models, draw samples and call a tokenizer, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number + 1 < len(STAGES):
            docs = written(docs, f"stage-{number}")
    return docs

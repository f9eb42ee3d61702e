"""From documents to packed training sequences: each stage takes what the one before kept.

A stage is a function of the session, the documents that are left, and the folder of the given tables.
Its result is written as Parquet and read again as the next stage's documents. All stages but the last
return the columns of the documents.

Defined cases are those of the operators: a text without a word is kept by the quality stage, and one of
all such texts stays after exact dedup; rows without a doc_id stay in near-dedup; empty tables give empty
results.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from hushframe.llm import decontaminate, exact_dedup, kneser_ney, packing, simhash
from hushframe.llm.common import bounded_batches, importable_in_tasks, scratch
from hushframe.llm.queries import trusted_ids


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go whose perplexity is far over that of their language."""
    bounded_batches(spark)
    return kneser_ney.drop(docs, trusted_ids(spark.read.parquet(f"{sf_dir}/labels.parquet")))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group of equal texts stays."""
    return exact_dedup.drop(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    bounded_batches(spark)
    return simhash.drop(docs, words=4, distance=4)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that hold a benchmark item."""
    bounded_batches(spark)
    return decontaminate.drop(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The tokens of the documents, in pieces of sequences."""
    bounded_batches(spark)
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality),
    ("exact dedup", exact),
    ("simhash near-dedup", near),
    ("benchmark decontamination", clean_of_benchmark),
    ("packing", packed),
]

#: SQL cannot express the stages; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to the documents."""
    importable_in_tasks(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        made = stage(spark, docs, sf_dir)
        folder = scratch(spark, f"stage-{name.replace(' ', '-')}")
        made.write.parquet(folder)
        docs = spark.read.schema(made.schema).parquet(folder)
    return docs

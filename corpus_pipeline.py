"""A training-corpus pipeline: stages over ``documents``, each written and read again.

Junk goes, then copies, then near copies; what is left is mixed to source weights (so rows
may come more than once) and packed into training sequences.

Every stage takes null texts (empty), null ids and sources, repeated rows, empty tables and
columns of any name beside those of documents; all but the last return the columns they got.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import exact_dedup, jaccard, mixing, packing, quality
from tidemark.llm.common import free_names
from tidemark.session import stage

QUALITY = 0.3  # scores below are junk


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier, fitted on the labelled rows of these documents: what it rejects goes."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    (score,) = free_names(docs, "_score")
    return quality.with_score(docs, model, score).where(F.col(score) >= QUALITY).drop(score)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exact dedup: of texts that are equal but for white space one stays."""
    return exact_dedup.without_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Jaccard join on five-word shingles at 0.8: of each group one document stays."""
    return jaccard.without_near_copies(docs, n_words=5, num=80, den=100)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Systematic sampling to source weights: each document as often as it is taken."""
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Configuration program: pieces with their place in sequences of 4096 tokens."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", good_documents),
    ("exact dedup", without_copies),
    ("n-gram Jaccard join", without_near_copies),
    ("mixing sources", mixed),
    ("best-fit packing", packed),
]
# A fitted model and a tokenizer are beyond SQL; the tests run the stages by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``; each stage's output is a table in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), f"corpus-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)

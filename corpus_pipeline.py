"""A corpus from ``documents``: quality rules, near copies, benchmark leaks, secrets, and the mix of sources.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the one before kept; its result is written as Parquet and
read again by the next. A stage keeps the rows and columns of the documents it has nothing against.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from repoweave.llm.decontamination import without_leaks
from repoweave.llm.jaccard import one_of_each
from repoweave.llm.mixing import mix
from repoweave.llm.quality import keep_good
from repoweave.llm.secrets import mask_secrets
from repoweave.session import checkpoint_folder


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the learned decision list do not reject."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by shingles of five words at a similarity of 0.8."""
    return one_of_each(docs, words=5, percent=80)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a verified passage of the benchmark."""
    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_masks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in the text replaced by a mark."""
    return mask_secrets(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents repeated as the plan says, with the number of the ``copy``."""
    return mix(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_copies", near_copies),
    ("benchmark_leaks", benchmark_leaks),
    ("secret_masks", secret_masks),
    ("source_mix", source_mix),
]

# The learned rules and the random field cannot be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4()}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs

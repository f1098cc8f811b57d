"""The training-data pipeline: stages over documents, each written as Parquet and reread as the next one's input.

Toxic documents go; of each class of near copies (five-word shingles, Jaccard similarity of 0.8 or more) the smallest
doc_id stays; documents that contain a benchmark item go; personal data is masked; what is left is encoded. Each stage
works on all that the one before kept.

Defined cases: null texts pass as they are and count as empty; nulls elsewhere and further columns, whatever their names,
are kept as they are; rows that repeat a doc_id stay or go together where their texts are equal, and rows without one are
no copies of others; whole texts are used, however long; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from arborquery.llm import bpe, decontamination, ngram_join, pii, toxicity
from arborquery.llm.common import documents, drop, written


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents whose toxicity score is 0.5 or more."""
    return toxicity.accepted(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near copies."""
    return ngram_join.representatives(docs, 5, 4, 5)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that contain a benchmark item."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks personal data in every text; no document goes."""
    return pii.masked(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every text that is left."""
    return bpe.digests(docs)


STAGES = [
    ("toxic documents", toxic_documents),
    ("near duplicates", near_duplicates),
    ("benchmark leaks", benchmark_leaks),
    ("private data", private_data),
    ("token ids", token_ids),
]

#: SQL cannot express these stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents."""
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name.replace(" ", "-"))
            if k:
                drop(before)
    return docs

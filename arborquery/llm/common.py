"""What the operators share: the folder all executors see, written tables, bounded Arrow batches, folds."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import drop, shared_dir, written
from ..shipping import ship

__all__ = ["bounded_batches", "documents", "drop", "fold", "ids_and_texts", "map_arrow", "shared_dir", "written"]

#: Rows and bytes of one Arrow batch: what a Python worker holds at a time (a single row may be longer).
BATCH_ROWS, BATCH_BYTES = 2000, 2 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by rows and bytes, unless the session has tighter bounds already."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(key, None)
        if now is None or not (0 < int(str(now).rstrip("b")) <= most):
            spark.conf.set(key, str(most))


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow under bounded batches, by workers that have this package."""
    ship(df.sparkSession)
    bounded_batches(df.sparkSession)
    return df.mapInArrow(fn, schema)


def fold(column: Column, folds: int) -> Column:
    """crc32 of the value as text, modulo folds."""
    return F.crc32(column.cast("string").cast("binary")) % folds


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def ids_and_texts(docs: DataFrame) -> DataFrame:
    """doc_id and text alone, a null text as empty; other columns, clashing names among them, are not read."""
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))

"""Reading inputs, and joins with tables of ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import new_path, shared_folder, written  # noqa: F401

#: Rows and bytes of text that a Python worker gets at once. Each thread of an executor may
#: keep the native memory of some batches, so large ones add up.
BATCH_ROWS, BATCH_BYTES = 2000, 1 << 20
#: Rows that Spark's Parquet reader holds at once.
READER_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` of an input folder, through Spark's own reader.

    Also bounds the session's Arrow and Parquet batches, which otherwise hold thousands of
    texts in the executor and in the worker.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", READER_ROWS)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A table of ids up to this many rows (16 bytes each) is broadcast, a larger one shuffled.
BROADCAST_ROWS = 500_000


def small_side(ids: DataFrame) -> DataFrame:
    """``ids`` marked for broadcast where its counted rows are few; unchanged beyond that."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids


def columns(df: DataFrame) -> list[Column]:
    """The columns of ``df`` by their whole names, which may hold dots."""
    return [F.col(f"`{c}`") for c in df.columns]


def without(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows of ``df`` whose ``key`` is not among ``ids``; rows with a null key stay."""
    return df.join(small_side(written(ids.where(F.col(key).isNotNull()).distinct(), "ids")), key, "left_anti").select(*columns(df))

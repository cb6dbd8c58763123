"""Shared folders and batch sizes for the operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..shared import remove, shared_dir

_MADE: list[str] = []


def written(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: its lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _MADE.append(path)
    out = df.write.option("compression", "zstd")
    if partition_by:
        out = out.partitionBy(*partition_by)
    out.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def made() -> int:
    """How many tables were written so far; a mark for ``forget``."""
    return len(_MADE)


def forget(spark: SparkSession, since: int) -> None:
    """Delete the tables written since the mark but the last one, which all that went before it has become."""
    for path in _MADE[since:-1]:
        remove(spark, path)
    del _MADE[since:-1]


def compact(df: DataFrame, total: int, each: int = 16 << 20) -> DataFrame:
    """df, of about so many bytes, in partitions of a useful size: never fewer than keep all cores busy twice. No shuffle."""
    return df.coalesce(max(2 * df.sparkSession.sparkContext.defaultParallelism, total // each))


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Batches of few rows, of Arrow and of the Parquet reader: texts may be long, and a batch is held whole."""
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", "512")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

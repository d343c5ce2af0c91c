"""Spreading few but costly rows, and keeping results that must not be worked out twice."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df over at least as many partitions as there are cores: rows whose expressions cost far more than their bytes
    would otherwise be packed into a few tasks."""
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(n, *keys)


def stored(df: DataFrame, name: str = "stored") -> DataFrame:
    """df written as Parquet in the shared folder (spark.checkpoint.dir) and read again: it survives lost executors.
    Only on a local master may the folder be left unset."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    folder = folder or tempfile.mkdtemp(prefix="quire-")
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of the rows that a Python function gets at once.
BATCH_BYTES = 4 << 20


def bounded(spark: SparkSession) -> None:
    """Python functions get batches bounded by their bytes, unless the session has set a bound itself: Spark's bound on
    rows lets through whatever their texts hold. Results don't depend on it."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

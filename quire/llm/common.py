"""Shared by the operators: tables, checkpoints, folds, bounded samples."""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import vectext as V


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); on a local master a temporary one where none is set."""
    held = spark.sparkContext.getCheckpointDir()
    if held is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="quire-"))
        held = spark.sparkContext.getCheckpointDir()
    return held


def cut(df: DataFrame) -> DataFrame:
    """df as a reliable checkpoint: later plans start from files in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stash(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again (smaller than a checkpoint)."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tidy() -> None:
    """Gives memory that a task no longer needs back to the system: Python workers outlive their tasks."""
    V.forget()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


@functools.cache
def settle_in() -> None:
    """Once in a worker: what it has loaded by now stays for good, so that later collections need not look through it."""
    gc.collect()
    gc.freeze()


def tidied(work):
    """work (batches to batches), and tidy() after a task's last batch."""

    def run(batches):
        settle_in()
        yield from work(batches)
        tidy()

    return run


#: Bytes of a batch of rows that a Python function gets at once: it lies in the JVM, in the pipe and in the worker.
BATCH_BYTES = 4 << 20
_BOUND = "spark.sql.execution.arrow.maxBytesPerBatch"


def mapped(df: DataFrame, work, schema: str) -> DataFrame:
    """df.mapInArrow(work, schema), tidied, in batches that are bounded by their bytes, for Spark's bound on rows lets
    through what their texts hold. Results don't depend on it. The session keeps the bound, as plans run later; one that
    it has set itself stays."""
    conf = df.sparkSession.conf
    if conf.get(_BOUND, None) is None:
        conf.set(_BOUND, str(BATCH_BYTES))
    return df.mapInArrow(tidied(work), schema)


def free(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened where df has such columns already."""
    held, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in held:
            name += "_"
        out.append(name)
    return out


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32(doc_id as text) mod modulus; a null doc_id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def bounded_sample(df: DataFrame, key: Column, most: int, salt: str) -> DataFrame:
    """Rows chosen by a hash of the key alone, so that partitions and order do not matter: all where there are at most
    `most`, else a share of them that gives 0.95 * most on average (over `most` only beyond many standard deviations)."""
    n = df.count()
    if n <= most:
        return df
    share = max(1, int(0.95 * most / n * 2**31))
    return df.filter(F.pmod(F.xxhash64(F.lit(salt), key), F.lit(2**31)) < share)

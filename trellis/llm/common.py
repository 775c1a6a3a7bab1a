"""Helpers that several operators share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession

U64 = np.uint64


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which all executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="trellis-")  # one machine, so every task sees it
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: later plans start
    from the written files, so a lost executor costs a reread, not a recomputation."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a batch that goes to a Python worker; texts are far larger than the numbers that the
#: default is made for, and both ends hold a batch in memory.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> SparkSession:
    """The session, with no more than BATCH_ROWS rows in a batch for Python workers."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    return spark


def tidy(run):
    """run, a function of batches, after which its worker gives freed memory back: workers
    outlive their tasks, and what they hold counts against the executor."""

    def tidied(frames):
        yield from run(frames)
        gc.collect()
        import pyarrow as pa

        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass

    return tidied


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash: every input bit reaches every output bit."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(33)
    x *= U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


def batches(texts, most_bytes: int = 4_000_000):
    """Index ranges (i, j) of consecutive texts whose UTF-8 size stays about most_bytes;
    a longer single text is a range of its own."""
    i, size = 0, 0
    for j, t in enumerate(texts):
        n = 0 if t is None else len(t)
        if j > i and size + n > most_bytes:
            yield i, j
            i, size = j, 0
        size += n
    if i < len(texts):
        yield i, len(texts)

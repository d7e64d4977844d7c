"""Shared pieces of the training-data operators."""

from __future__ import annotations

import atexit
import ctypes
import functools
import gc
import shutil
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but space and the ASCII controls tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def bound_batches(spark: SparkSession) -> None:
    """Batches for Python workers hold 2 MB at most (or one row), unless the session says otherwise: rows may be long."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, "2m")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a data folder."""
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    A local session without that setting (tests) gets a temporary folder; on a
    cluster, where no folder of one machine would do, the setting must be there.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        own = tempfile.mkdtemp(prefix="loomspark-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        found = "file://" + own
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Tables that ``stash`` has written in this process.
_WRITTEN: list[str] = []


def release(spark: SparkSession) -> int:
    """Delete the tables that ``stash`` wrote, once the results that read them are stored; how many there were."""
    n = len(_WRITTEN)
    while _WRITTEN:
        path = spark._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n


def stash(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again.

    This cuts the lineage: what follows survives lost executors without going
    back to the source, and branches share the work. The columns keep their types.
    ``release`` deletes what has been written.
    """
    spark = df.sparkSession
    bound_batches(spark)
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def _trim() -> None:
    """Give freed memory back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def slices(batches, rows: int = 500):
    """The batches in pieces of few rows, so that no task holds many long texts as Python objects at once.

    Workers serve many tasks; what the last one has freed goes back to the system first.
    """
    _trim()
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
        del batch


def lean(run):
    """A worker's function of batches that gives back what it held at its end, as the next stage may need no worker."""

    @functools.wraps(run)
    def whole(batches):
        yield from run(batches)  # its frame is gone afterwards
        _trim()

    return whole


def n_words(text: str = "text"):
    """Words of a text column, 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]++")), F.lit(0)).cast("long")


def lower_ascii(col):
    """A-Z to a-z; every other character stays."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

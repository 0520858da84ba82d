"""What the corpus operators share: tables in the cluster's shared folder, and the word rule."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, findable

#: A word, as the contracts of mixing and of the Jaccard join define it.
WORD = r"[^\x20\x09-\x0D]+"


#: Of a table of narrow rows (ids, counts, links) a task writes so many at least.
ROWS_A_PART = 100_000


def in_parts(df: DataFrame, rows: int, each: int = ROWS_A_PART) -> DataFrame:
    """df in as many tasks as so many rows need, two for each core at least, never more than it has: however finely its shuffles are dealt, little is not
    written in hundreds of files. Partitions are only put one after another, so no task holds more at once."""
    return df.coalesce(max(2 * df.sparkSession.sparkContext.defaultParallelism, rows // each + 1))


#: Bytes of a batch of rows on its way to a Python worker, but for its last row. Spark holds a batch several times over outside the heap; narrow rows come in batches of as many as before.
BATCH, BATCH_SETTING = 2 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


@contextlib.contextmanager
def small_batches(spark: SparkSession):
    """For what runs inside; the session's own setting is there again after it."""
    before = spark.conf.get(BATCH_SETTING)
    spark.conf.set(BATCH_SETTING, BATCH)
    try:
        yield
    finally:
        spark.conf.set(BATCH_SETTING, before)


class Workspace:
    """Parquet tables of one call, in the shared folder: they cut lineage, so a lost executor costs one stage.

    Tables that the caller's result still reads go when the JVM ends; drop() removes the others at once.
    """

    def __init__(self, spark: SparkSession, name: str):
        findable(spark)
        self.spark, self.root = spark, f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        self._fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.deleteOnExit(path)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        with small_batches(self.spark):
            df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            self._fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}"), True)


#: What a Python worker keeps from task to task, by what it is for.
_KEPT: dict[str, dict] = {}


def kept(name: str) -> dict:
    return _KEPT.setdefault(name, {})


@functools.cache
def _trim():
    return getattr(ctypes.CDLL(None), "malloc_trim", None)  # the GNU library's alone


def give_back() -> None:
    """Gives the system what this process has freed; allocators hold it otherwise, for as long as the worker lives."""
    pa.default_memory_pool().release_unused()
    if trim := _trim():
        trim(0)


def forget_all_but(name: str | None) -> None:
    for other, memory in _KEPT.items():
        if other != name:
            memory.clear()
    give_back()


def lean(run, keeps: str | None = None):
    """run, a function of an iterator, in a worker that served other jobs before: what was kept for these goes first, but kept(keeps); what the task took goes when it ends."""

    def own(batches):
        forget_all_but(keeps)
        try:
            yield from run(batches)
        finally:
            give_back()

    return own


def text_or_empty(column: Column | str = "text") -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    findable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

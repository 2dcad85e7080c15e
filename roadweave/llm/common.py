"""Staging in the shared folder, files on any file system, and the fold rule of the learned operators."""

from __future__ import annotations

import ctypes
import functools
import os
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where it is unset, one under /tmp that is then set, which a local master alone may use."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = f"file:///tmp/checkpoints/{spark.sparkContext.applicationId}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A folder that no other call gets, in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: the lineage is cut, and a lost executor loses nothing."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    found.staged_path = path
    return found


def discard(*staged: DataFrame) -> None:
    """Deletes what ``stage`` wrote for these frames, which nothing reads any more."""
    for df in staged:
        if path := getattr(df, "staged_path", None):
            jvm = df.sparkSession._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3; rows where it is 1 are held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def store(uri: str) -> tuple[fs.FileSystem, str]:
    """The Arrow file system of a folder given as a URI or plain path."""
    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


class AtomicFile:
    """A file that appears under its name only when it is complete, so a retried or speculative task leaves one whole copy."""

    def __init__(self, folder: str, name: str):
        self.fs, root = store(folder)
        self.fs.create_dir(root, recursive=True)
        self.final, self.part = f"{root}/{name}", f"{root}/.{name}.{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(self.part)
        self.size = 0

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def close(self) -> None:
        self.out.close()
        self.fs.move(self.part, self.final)

    def discard(self) -> None:
        self.out.close()
        self.fs.delete_file(self.part)


def open_file(folder: str, name: str):
    """Random access to one file of a folder."""
    found, root = store(folder)
    return found.open_input_file(f"{root}/{name}")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: What empties the caches that outlive a task in a Python worker.
CACHES: list[Callable[[], None]] = []
PART = 4 << 20


@functools.cache
def _trim() -> Callable[[int], int] | None:
    return getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's alone


def give_back() -> None:
    """Memory that Arrow's pool and the C library keep for later goes back to the system: an idle worker counts as its executor's."""
    pa.default_memory_pool().release_unused()
    if (trim := _trim()) is not None:
        trim(0)


def let_go() -> None:
    """Empties the caches that tasks of another operator left in this worker, which Spark uses again."""
    for clear in CACHES:
        clear()
    give_back()


def parts(batch: pa.RecordBatch, most: int = PART) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about ``most`` bytes, one row at least; an empty batch is passed on."""
    rows = max(1, batch.num_rows * most // max(1, batch.nbytes))
    for at in range(0, max(1, batch.num_rows), rows):
        yield batch.slice(at, rows)


def lean(run: Callable, cached: bool = False) -> Callable:
    """``run`` for mapInArrow, which must not depend on where batches end: it gets parts of them, and gives memory back after each batch.

    Caches of earlier tasks go first, unless the function has its own among them (``cached``).
    """

    def fed(batches):
        for batch in batches:
            yield from parts(batch)
            give_back()

    def task(batches):
        if not cached:
            let_go()
        try:
            yield from run(fed(batches))
        finally:
            give_back()

    return task


def threads_off() -> None:
    """The cluster runs a task per core, so libraries in a task start no threads of their own."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"

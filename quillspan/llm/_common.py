"""What the operators of this subpackage share: the shared folder, spooled tables and Arrow loops."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Code points that count as white space in word and line keys, and nothing else.
ASCII_SPACE = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir, that driver and executors share, else the session's checkpoint folder.

    Where neither is set a local master gets a temporary folder; on a cluster, whose machines don't share one, that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def open_store(path: str):
    """The file system of a path in any store that pyarrow knows, and the path there."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else "file://" + os.path.abspath(path))


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder, deleted when the application ends."""
    path = f"{shared_dir(spark)}/quillspan-{label}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


#: Whether Spark deletes a query's shuffle files when the query has ended, and not only when the driver collects garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def spool(df: DataFrame, label: str, codec: str = "snappy") -> DataFrame:
    """Write a table to the shared folder and read it back: a lost executor costs its running tasks only.

    What the write has shuffled is deleted when the table stands, as nothing reads it again.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path, compression=codec)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete spooled tables that nothing reads any more."""
    for df in tables:
        hadoop = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            target = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            target.getFileSystem(hadoop).delete(target, True)


def broadcast_if_small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """`df`, spooled, and marked for broadcast if it has no more than so many rows, as counted."""
    df = spool(df, "small")
    return F.broadcast(df) if df.count() <= rows else df


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_of(column: str | Column) -> Column:
    """Null texts count as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def runs(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """(start, stop) of runs of consecutive items that are about `limit` large together; an item of any size has a place."""
    ends = np.cumsum(sizes)
    start = 0
    while start < len(sizes):
        before = ends[start - 1] if start else 0
        stop = min(len(sizes), int(np.searchsorted(ends, before + limit)) + 1)
        yield start, stop
        start = stop


def text_slices(column: pa.Array, limit: int = 4_000_000) -> Iterator[tuple[int, list[str]]]:
    """Runs of consecutive texts of about `limit` bytes of an Arrow column: (index of the first, the texts, null as empty).

    Only one run's texts are Python strings at a time.
    """
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    for start, stop in runs(sizes, limit):
        yield start, strings(column.slice(start, stop - start))


_held: dict[str, tuple[object, object]] = {}


def worker_keeps(owner: str, key: object, make: Callable[[], object]) -> object:
    """What a Python worker keeps between the tasks of one operator, made anew for another key; another operator's goes first."""
    if owner not in _held or _held[owner][0] != key:
        give_back(True)
        _held[owner] = (key, make())
    return _held[owner][1]


def give_back(all_kept: bool = False) -> None:
    """Return a worker's free memory to the machine; workers live as long as the application and would keep their largest size.

    `all_kept` also drops what worker_keeps holds.
    """
    if all_kept:
        if not _held:
            return
        _held.clear()
        gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def lean(run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]], keeps: bool = False) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`run` for mapInArrow, giving back memory when a task is done; unless it `keeps` something between tasks, what others kept goes before."""

    def task(batches):
        if not keeps:
            give_back(True)
        yield from run(batches)
        give_back()

    return task


def map_arrow(df: DataFrame, work: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str, keeps: bool = False) -> DataFrame:
    """mapInArrow for a function of one batch; `keeps` as in lean."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield from work(batch)

    return df.mapInArrow(lean(run, keeps), schema)


def strings(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def carried(names: Iterable[str], taken: Iterable[str]) -> Column:
    """Columns to pass through an Arrow function as one struct, without those whose names the result uses itself."""
    kept = [F.col(n) for n in names if n not in set(taken)]
    return (F.struct(*kept) if kept else F.struct(F.lit(True).alias("_none"))).alias("carried")


def uncarried(df: DataFrame, *own: str) -> DataFrame:
    """The columns `own`, then those that were carried."""
    inner = [f.name for f in df.schema["carried"].dataType.fields if f.name != "_none"]
    return df.select(*own, *(F.col("carried")[n].alias(n) for n in inner))


def file_bytes(path: str) -> bytes:
    """A vocabulary file, read on the driver; such files are a few MB whatever the corpus."""
    with open(path, "rb") as file:
        return file.read()

"""Shared plumbing: tables in the cluster's shared folder, partition counts, Arrow batches."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _give_memory_back() -> None:
    """Have large freed arrays go back to the system at once, Arrow's included: Python workers outlive their
    tasks, and what one operator's worker keeps for later is missing beside the executor's JVM."""
    try:
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD: fixed, else it grows to 32 MB by itself
        libc.mallopt(-1, 4 << 20)  # M_TRIM_THRESHOLD
    except OSError:
        pass
    pa.set_memory_pool(pa.system_memory_pool())


_give_memory_back()


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; one of our own only where none is set (tests, local mode)."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="umbra-"))
        root = sc.getCheckpointDir()
    return root


_SCOPES: list[list[str]] = []


@contextmanager
def intermediates(spark: SparkSession) -> Iterator[None]:
    """Tables staged within are removed at the end, but for those staged with keep: these belong to what is around."""
    paths: list[str] = []
    _SCOPES.append(paths)
    try:
        yield
    finally:
        _SCOPES.remove(paths)
        for path in paths:
            remove_path(spark, path)


def _folder(spark: SparkSession, path: str) -> tuple:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).getParent()
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), folder


def remove_path(spark: SparkSession, path: str) -> None:
    fs, folder = _folder(spark, path)
    fs.delete(folder, True)


def stage_path(spark: SparkSession, label: str, keep: bool = False) -> str:
    """A fresh path in the shared folder, removed with its intermediates() or else when the session's JVM ends."""
    path = f"{shared_dir(spark)}/umbra-{uuid.uuid4().hex}/{label}"
    fs, folder = _folder(spark, path)
    fs.deleteOnExit(folder)
    if len(_SCOPES) > keep:
        _SCOPES[-1 - keep].append(path)
    return path


def stage_table(df: DataFrame, label: str, keep: bool = False) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = stage_path(spark, label, keep)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession, limit: int) -> Iterator[None]:
    """What is planned within sends Python batches of about limit bytes: by default 10,000 rows of any width, which JVM and
    worker both hold, are bounded by 64 MB only."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    was = spark.conf.get(name, None)
    spark.conf.set(name, str(limit))
    try:
        yield
    finally:
        spark.conf.unset(name) if was is None else spark.conf.set(name, was)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def source_bytes(df: DataFrame, column: str) -> int:
    """Bytes of the files that df reads; where a source doesn't tell its size, the counted bytes of a column."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size())]
    if max(sizes, default=0) < 1 << 60:
        return sum(sizes)
    return df.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0))).first()[0]


def block_count(df: DataFrame, column: str, block_bytes: int = 12 << 20) -> int:
    """Blocks of about block_bytes each, and never fewer than the session's shuffle partitions."""
    return max(shuffle_partitions(df.sparkSession), source_bytes(df, column) // block_bytes, 1)


def slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = 6 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the strings of one column take about limit bytes; a longer single row stays whole."""
    for batch in batches:
        col = batch.column(column)
        if batch.num_rows < 2 or col.nbytes <= limit:
            yield batch
            continue
        ends = np.frombuffer(col.buffers()[1], np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, ends[start] + limit, "right")) - 1)
            yield batch.slice(start, stop - start)
            start = stop


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (int64, from 0) of a string array without nulls."""
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    offsets = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start+1, ... of every run, one after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(starts.astype(np.int64) - (ends - lengths), lengths)


_SLOT: list = [None, None]


def give_back() -> None:
    """Have what lies freed between live blocks go back to the system."""
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def worker_slot(key: object, make):
    """The one large object that a Python worker keeps between tasks; another key's object is let go first."""
    if _SLOT[0] != key:
        _SLOT[0] = _SLOT[1] = None
        gc.collect()
        give_back()
        _SLOT[1] = make()
        _SLOT[0] = key
        gc.collect()  # what making it took, a parsed vocabulary for one
        give_back()
    return _SLOT[1]


def release_slot() -> None:
    """Let go what another operator's tasks left in this worker."""
    _SLOT[0] = _SLOT[1] = None

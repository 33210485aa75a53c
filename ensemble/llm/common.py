"""Shared pieces of the corpus operators: table access, batches, hashing in SQL."""

from __future__ import annotations

import ctypes
import os
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir

#: Arrow batches to Python workers hold at most so many rows / bytes, so that
#: very long texts do not meet in one batch of ten thousand rows.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20


_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Session setting that gives the Python stages of a phase smaller batches; see batches_of.
_PHASE = "ensemble.llm.batchBytes"


@contextmanager
def batches_of(spark: SparkSession, size: int) -> Iterator[None]:
    """Arrow batches of at most ``size`` bytes for the Python stages that run inside."""
    spark.conf.set(_PHASE, str(size))
    try:
        yield
    finally:
        spark.conf.unset(_PHASE)


def bounded_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session's Python stages."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    try:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", spark.conf.get(_PHASE, str(BATCH_BYTES)))
    except Exception:  # an older Spark without this setting has the row bound alone
        pass


def give_back() -> None:
    """Return the memory that this Python worker holds but does not use: workers outlive their task, and
    each that waits for its next one would otherwise keep the most that any task took."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # a C library without it
        pass


def lean(fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``fn`` with unused memory given back at the end of each task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(batches)
        finally:
            give_back()
    return run


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
              schema: str) -> DataFrame:
    bounded_batches(df.sparkSession)
    # workers import this package by name: name its place to those that share this file system
    # (on a cluster it is installed or shipped with the job, as any library)
    df.sparkSession.sparkContext.environment.setdefault("PYTHONPATH", _ROOT)
    return df.mapInArrow(lean(fn), schema)


def crc_mod(col: Column, n: int) -> Column:
    """crc32 of a value's text modulo n; a null value counts as the empty text."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % n


def saved(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder (cuts lineage, survives lost executors)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let Spark's context cleaner drop the shuffle files of finished jobs now.

    The cleaner acts on the driver's garbage collection; a hint to collect is
    given between the phases of a multi-pass job, whose earlier shuffles would
    otherwise stay on the executors' disks to the end.
    """
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def size_in_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate (file sizes for a plain scan)."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().longValue())


def blocks(rows: Iterator[pa.RecordBatch], limit: int, size: Callable[[pa.RecordBatch], int]) -> Iterator[pa.Table]:
    """Join consecutive batches into tables of about ``limit`` (as ``size`` counts)."""
    held, total = [], 0
    for b in rows:
        if not b.num_rows:
            continue
        held.append(b)
        total += size(b)
        if total >= limit:
            yield pa.Table.from_batches(held)
            held, total = [], 0
    if held:
        yield pa.Table.from_batches(held)


def written_at(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def discard(spark: SparkSession, path: str) -> None:
    """Remove an intermediate table that this job wrote and needs no more."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def written(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write a table of large rows to the shared folder (zstd Parquet) and read it back."""
    path = path or written_at(df.sparkSession, name)
    df.write.option("compression", "zstd").option("parquet.block.size", 16 << 20).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of 8-byte keys that may be broadcast to filter a large table (counted first; beyond it, a shuffle join).
BROADCAST_ROWS = 2_000_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it is counted to have few rows, else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


#: Bits of a table that says which of many 64-bit keys may be present; its size is fixed (4 MB).
TABLE_BITS = 25


def bit_table(keys: DataFrame, col: str, n: int = TABLE_BITS) -> np.ndarray:
    """Bits of the low ``n`` of a long column, as bytes; see may_hold."""
    place = F.col(col).bitwiseAND(F.lit((1 << n) - 1))
    rows = keys.select(F.shiftright(place, 15).alias("k"), (place % 32768).alias("p")) \
        .groupBy("k").agg(F.bitmap_construct_agg("p").alias("bits")).collect()
    out = np.zeros(1 << n - 3, np.uint8)
    for r in rows:
        out[r.k * 4096 : (r.k + 1) * 4096] = np.frombuffer(r.bits, np.uint8)
    return out


def may_hold(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each key's bit is set: false for certain where the key is not in the table's column."""
    at = (keys & np.uint64(8 * len(table) - 1)).astype(np.int64)
    return (table[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def order_of(keys: np.ndarray) -> np.ndarray:
    """The stable order of 64-bit hashes, by one sort of numbers: a key's high bits with its place below them."""
    n = np.uint64(max(1, len(keys).bit_length()))
    mark = keys >> n << n | np.arange(len(keys), dtype=np.uint64)
    mark.sort()
    order = (mark & ((np.uint64(1) << n) - np.uint64(1))).astype(np.int64)
    in_order = keys[order]
    down = np.flatnonzero(in_order[1:] < in_order[:-1])
    if len(down) > 1000:  # not hashes
        return np.argsort(keys, kind="stable")
    if len(down):  # keys that differ in the low bits alone
        high = mark >> n
        for h in np.unique(high[down]):
            a, z = np.searchsorted(high, h), np.searchsorted(high, h, side="right")
            order[a:z] = order[a:z][np.argsort(in_order[a:z], kind="stable")]
    return order


def grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, cuts): order_of(keys), and where each run of equal keys begins in it."""
    order = order_of(keys)
    in_order = keys[order]
    return order, np.flatnonzero(np.append(np.ones(min(1, len(keys)), dtype=bool), in_order[1:] != in_order[:-1]))


class Places:
    """Places of hashes in a sorted array of distinct ones: the first by its high bits, then steps."""

    def __init__(self, keys: np.ndarray):
        bits = min(24, len(keys).bit_length() + 1)
        self.keys, self.shift = keys, np.uint64(64 - bits)
        self.first = np.searchsorted(keys >> self.shift, np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int32)

    def of(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key, -1 where it is not in the array."""
        out = np.full(len(keys), -1, np.int64)
        cell = (keys >> self.shift).astype(np.int64)
        at, end = self.first[cell], self.first[cell + 1]
        live = np.flatnonzero(at < end)
        at, end, keys = at[live], end[live], keys[live]
        while len(live):
            hit = self.keys[at] == keys
            out[live[hit]] = at[hit]
            at = at + 1
            go = np.flatnonzero(~hit & (at < end))
            live, at, end, keys = live[go], at[go], end[go], keys[go]
        return out

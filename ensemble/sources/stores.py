"""Stored datasets: in global order with a manifest of key ranges, and in batches that can be run again.

An ordered store is range-partitioned and sorted inside each file; its manifest has
a row a file: the first and last key, the rows, and the rows before it. A reader
gives every row its place in the order from the manifest and the row's index in its
file, without a sort or a shuffle, reads the files a key range needs, or the first
files for the first rows.

A batch store is partitioned by reservoir and batch. Each batch has a manifest row
with the fingerprint of the sources it was derived from: a batch is written again
only if they changed, and replaces its own partitions alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

MANIFEST, BATCHES = "_manifest", "_batches"


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def fingerprint(spark: SparkSession, *paths: str) -> str:
    """What the files under some paths are: a hash of their names, sizes and times of change."""
    entries = []
    for path in paths:
        fs, p = _fs(spark, path)
        if not fs.exists(p):
            continue
        files = fs.listFiles(p, True)
        while files.hasNext():
            f = files.next()
            entries.append(f"{f.getPath()}|{f.getLen()}|{f.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(entries)).encode()).hexdigest()


# ---------------------------------------------------------------- global order

def write_ordered(df: DataFrame, path: str, keys: Sequence[str], files: int) -> DataFrame:
    """Write ``df`` in ascending (keys) order over at most ``files`` files; returns the manifest. Rows of
    equal keys lie in one file; an empty table has an empty manifest."""
    spark = df.sparkSession
    df.repartitionByRange(max(1, files), *keys).sortWithinPartitions(*keys).write.mode("overwrite").parquet(path)
    key = F.struct(*[F.col(k) for k in keys])
    ranges = spark.read.schema(df.schema).parquet(path).groupBy(F.col("_metadata.file_name").alias("file")).agg(
        F.min(key).alias("first"), F.max(key).alias("last"), F.count(F.lit(1)).alias("rows"))
    order = Window.orderBy("first", "file")  # a row a file
    ranges = ranges.withColumn("file_no", F.row_number().over(order) - 1) \
        .withColumn("offset", F.coalesce(F.sum("rows").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))) \
        .withColumn("rising", F.coalesce(F.lag("last").over(order) < F.col("first"), F.lit(True)))
    ranges.coalesce(1).write.mode("overwrite").parquet(f"{path}/{MANIFEST}")
    return manifest(spark, path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(file, first, last, rows, file_no, offset, rising) of an ordered store."""
    return spark.read.parquet(f"{path}/{MANIFEST}")


def read_ordered(spark: SparkSession, path: str, position: str = "position") -> DataFrame:
    """The rows with their place (from 0) in the store's order; no sort, no shuffle of rows."""
    rows = spark.read.parquet(path).select("*", F.col("_metadata.file_name").alias("__file"), F.col("_metadata.row_index").alias("__at"))
    places = manifest(spark, path).select(F.col("file").alias("__file"), "offset")
    return rows.join(F.broadcast(places), "__file").withColumn(position, F.col("offset") + F.col("__at")).drop("__file", "__at", "offset")  # a row a file


def read_key_range(spark: SparkSession, path: str, keys: Sequence[str], low: tuple, high: tuple) -> DataFrame:
    """Rows with low <= keys <= high, from the files whose range meets it alone."""
    def literal(values: tuple) -> Column:
        return F.struct(*[F.lit(v).alias(k) for k, v in zip(keys, values)])
    hit = manifest(spark, path).where((F.col("last") >= literal(low)) & (F.col("first") <= literal(high))).orderBy("file_no")
    names = [f"{path}/{r.file}" for r in hit.select("file").collect()]
    rows = spark.read.schema(spark.read.parquet(path).schema)
    key = F.struct(*[F.col(k) for k in keys])
    return (rows.parquet(*names) if names else spark.read.parquet(path).limit(0)).where((key >= literal(low)) & (key <= literal(high)))


def head(spark: SparkSession, path: str, keys: Sequence[str], n: int = 5) -> list[Row]:
    """The first ``n`` rows in order, from the first files that hold so many."""
    first = manifest(spark, path).where(F.col("offset") < n).select("file").collect()
    rows = spark.read.schema(spark.read.parquet(path).schema).parquet(*[f"{path}/{r.file}" for r in first]) if first else spark.read.parquet(path)
    return rows.orderBy(*keys).limit(n).collect()


def iterate(spark: SparkSession, path: str, keys: Sequence[str]) -> Iterator[Row]:
    """All rows in order, one file after another (the driver holds a file at a time)."""
    schema = spark.read.parquet(path).schema
    for f in manifest(spark, path).orderBy("file_no").select("file").collect():
        yield from spark.read.schema(schema).parquet(f"{path}/{f.file}").sortWithinPartitions(*keys).coalesce(1).toLocalIterator()


# ---------------------------------------------------------------- batches

def batches(spark: SparkSession, path: str) -> dict[str, str]:
    """Fingerprint of each batch that was written to its end."""
    if not exists(spark, f"{path}/{BATCHES}"):
        return {}
    return {r.batch: r.fingerprint for r in spark.read.schema("fingerprint string, batch string").json(f"{path}/{BATCHES}").collect()}


def write_batch(spark: SparkSession, path: str, batch: str, source: str, build: Callable[[], DataFrame]) -> bool:
    """Write a batch's rows (with ``reservoir_id``) unless it was written from the same ``source`` fingerprint.

    Only the batch's own partitions are replaced, those that it no longer has are
    removed; the manifest row comes last, so a batch broken off is written again.
    Returns whether it was written.
    """
    if batches(spark, path).get(batch) == source:
        return False
    mark = f"{path}/{BATCHES}/name={hashlib.sha256(batch.encode()).hexdigest()[:16]}"
    fs, p = _fs(spark, mark)
    fs.delete(p, True)
    df = build().withColumn("batch", F.lit(batch))
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("reservoir_id", "batch").parquet(path)
    have = {r.reservoir_id for r in df.select("reservoir_id").distinct().collect()}  # a few reservoirs
    for old in fs.globStatus(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/reservoir_id=*/batch={batch}")) or []:
        if old.getPath().getParent().getName().split("=", 1)[1] not in have:
            fs.delete(old.getPath(), True)
    spark.createDataFrame([(source, batch)], "fingerprint string, batch string").coalesce(1).write.mode("overwrite").json(mark)
    return True


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    """All rows of the batches written to their end, with ``reservoir_id`` and ``batch``."""
    done = list(batches(spark, path))
    return spark.read.parquet(path).where(F.col("batch").cast("string").isin(done) if done else F.lit(False))

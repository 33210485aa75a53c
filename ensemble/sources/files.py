"""File sources and sinks for ensemble datasets, run logs and keyword text.

Datasets are stored as Parquet partitioned by ``reservoir_id`` (filters on the
reservoir prune whole folders; other predicates and column selections reach
the Parquet reader). CSV is supported with explicit schemas — never inferred.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import RUN_LOG, TRAJECTORY


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN marks a missing value in the source files; Spark aggregates treat NaN
    as a value (max/avg return NaN), so it becomes NULL at ingest."""
    cols = [F.nanvl(F.col(f.name), F.lit(None).cast(f.dataType)).alias(f.name)
            if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)
            for f in df.schema.fields]
    return df.select(*cols)


def read_trajectory(spark: SparkSession, path: str, fmt: str = "parquet",
                    schema: T.StructType = TRAJECTORY) -> DataFrame:
    reader = spark.read.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True).option("mode", "FAILFAST")
        return nan_to_null(reader.csv(path))
    return nan_to_null(reader.parquet(path))


def read_run_log(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A run log with the full run-log schema (Parquet, or CSV whose header
    carries every run-log column)."""
    reader = spark.read.schema(RUN_LOG)
    if fmt == "csv":
        return nan_to_null(reader.option("header", True).option("enforceSchema", False).csv(path))
    return nan_to_null(reader.parquet(path))


def read_run_logs_csv(spark: SparkSession, logs: dict[str, str]) -> DataFrame:
    """Per-reservoir CSV run logs ``{reservoir_id: path}`` whose headers differ
    (each reservoir has its own levers) as one table in the run-log schema:
    columns are matched by name, cast to their type, and a column a file lacks
    is NULL. Values are read as text first, so nothing is inferred."""
    parts = []
    for reservoir, path in logs.items():
        raw = spark.read.option("header", True).option("inferSchema", False).csv(path)
        have = set(raw.columns)
        cols = []
        for f in RUN_LOG.fields:
            if f.name == "reservoir_id":
                cols.append(F.lit(reservoir).alias(f.name))
            elif f.name in have:
                src = F.col(f.name)
                if isinstance(f.dataType, T.BooleanType):
                    cols.append(F.lower(src).isin("true", "1").alias(f.name))
                elif isinstance(f.dataType, T.StringType):
                    cols.append(F.coalesce(src, F.lit("")).alias(f.name))
                else:
                    cols.append(src.try_cast(f.dataType).alias(f.name))
            else:
                cols.append(F.lit(None).cast(f.dataType).alias(f.name))
        parts.append(raw.select(*cols))
    return nan_to_null(union_datasets(parts))


def read_csv_checked(spark: SparkSession, path: str, schema: T.StructType, keys: Sequence[str] = (), header: bool = True) -> tuple[DataFrame, DataFrame]:
    """CSV rows with an explicit schema as (accepted, rejected).

    Rejected are lines with a value that is not of its column's type, with too few or
    too many values, or without a value in one of ``keys``; they are given back as they
    stand, (file, record), to be counted or mended. Nothing is dropped silently and
    nothing ends the job.
    """
    whole = T.StructType([*schema.fields, T.StructField("__bad", T.StringType())])
    rows = spark.read.schema(whole).option("header", header).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "__bad") \
        .csv(path).withColumn("__file", F.col("_metadata.file_path"))
    missing = F.lit(False)
    for k in keys:
        missing = missing | F.col(k).isNull()
    good = F.col("__bad").isNull() & ~missing
    # a whole record without its key is written out again from its columns
    record = F.coalesce("__bad", F.concat_ws(",", *[F.coalesce(F.col(f.name).cast("string"), F.lit("")) for f in schema.fields]))
    return nan_to_null(rows.where(good).drop("__bad", "__file")), rows.where(~good).select(F.col("__file").alias("file"), record.alias("record"))


def write_dataset(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> bool:
    """Write a trajectory dataset partitioned by reservoir; an empty one is skipped.

    Returns whether anything was written.
    """
    if df.isEmpty():
        return False
    w = df.write.mode(mode).option("maxRecordsPerFile", 5_000_000).partitionBy("reservoir_id")
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.parquet(path)
    return True


def write_run_log(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    w = df.write.mode(mode)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.parquet(path)


def union_datasets(parts: list[DataFrame]) -> DataFrame:
    """Concatenate datasets by column name (an empty list gives no DataFrame)."""
    if not parts:
        raise ValueError("no datasets to combine")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=False), parts)


def read_keyword_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Keyword text files as (file, text), one row per file (``wholetext``), so
    that line order within a file is kept; files are spread over tasks."""
    df = spark.read.text(paths, wholetext=True)
    return df.select(F.input_file_name().alias("file"), F.col("value").alias("text"))


def read_keyword_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Lines of keyword text files as (file, block, place, line), read split by split: ``block`` is
    the byte at which the line's split starts, ``place`` rises inside a split. See
    :func:`ensemble.operators.text.numbered_lines` for line numbers."""
    return spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("place"), F.col("value").alias("line"))

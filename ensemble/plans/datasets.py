"""The ensemble's logical tables, derived from the test tables of one scale factor.

Each function is lazy and returns a DataFrame; callers share nothing through
the driver. ``trajectory`` is the converged feature table every analysis reads.
"""

from __future__ import annotations

import hashlib
import os
import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import features, runlog, sampling, summaries
from ..schemas import ALL_LEVERS, TARGET, TRAJECTORY_COLUMNS
from ..session import checkpoint_dir
from ..sources import decks, files, stores, testdata

SEED = testdata.SEED
_LOCKS: dict[str, threading.Lock] = {}
_LOCKS_GUARD = threading.Lock()
#: Bump when the derivation of a materialized table changes.
DATASET_VERSION = "v2"
MAX_RECORDS_PER_FILE = 5_000_000
#: The tables that materialized ones are derived from.
SOURCE_TABLES = ("events", "conversations")


def materialize(spark: SparkSession, sf_dir: str, name: str, build, partition_by: str | None = None,
                sort_by: tuple[str, ...] = ()) -> str:
    """Write a derived table once to the shared checkpoint folder; return its path.

    This is the dataset sink of the batch: later analyses read Parquet (pruned
    columns, pushed filters, reservoir partitions) instead of re-running the
    derivation, and lineage is cut so a lost executor recomputes from files.
    Reuse requires the ``_SUCCESS`` marker of a completed write. ``sort_by``
    sorts rows within each task before writing (no shuffle), so Parquet row
    groups cover narrow key ranges and equality filters on those keys skip
    most of them; files are capped at a fixed number of rows.
    """
    def write(path: str) -> None:
        df = build()
        if sort_by:
            df = df.sortWithinPartitions(*sort_by)
        w = df.write.mode("overwrite").option("maxRecordsPerFile", MAX_RECORDS_PER_FILE)
        if partition_by:
            w = w.partitionBy(partition_by)
        w.parquet(path)
    return materialize_with(spark, sf_dir, name, write)


def materialize_with(spark: SparkSession, sf_dir: str, name: str, write) -> str:
    """``write(path)`` once for the source files as they are now (new data at the same path give a new table); the path."""
    source = stores.fingerprint(spark, *[f"{sf_dir}/{t}.parquet" for t in SOURCE_TABLES])
    key = hashlib.sha1(f"{os.path.abspath(sf_dir)}|{DATASET_VERSION}|{source}".encode()).hexdigest()[:16]
    path = f"{checkpoint_dir(spark).rstrip('/')}/ensemble-tables/{name}-{key}"
    with _LOCKS_GUARD:
        lock = _LOCKS.setdefault(path, threading.Lock())
    with lock:  # one writer per table and process
        if not stores.exists(spark, f"{path}/_SUCCESS"):
            write(path)
    return path


def materialized(spark: SparkSession, sf_dir: str, name: str, build, partition_by: str | None = None,
                 sort_by: tuple[str, ...] = ()) -> DataFrame:
    return spark.read.parquet(materialize(spark, sf_dir, name, build, partition_by, sort_by))


def scenarios_plan(spark: SparkSession, sf_dir: str, seed: int = SEED) -> DataFrame:
    """Levers of every run: LHS per reservoir, then validator redraws."""
    return sampling.lhs_rejection(sampling.lhs_sample(testdata.runs(spark, sf_dir), seed), seed)


def scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialized(spark, sf_dir, "scenarios", lambda: scenarios_plan(spark, sf_dir)) \
        .select("reservoir_id", "sim_id", "attempt", *ALL_LEVERS)


def classified_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runlog.classify_outcome(testdata.run_outcomes(spark, sf_dir))


def feature_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature rows of all runs (before dropping failed ones)."""
    return features.feature_table(testdata.summary_vectors(spark, sf_dir), scenarios(spark, sf_dir))


def trajectory_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Converged runs' rows: 19 schema columns + step (failed runs are dropped
    on the run table, before it meets the step rows)."""
    ok = classified_runs(spark, sf_dir).where("ok")
    return features.feature_table(testdata.summary_vectors(spark, sf_dir), scenarios(spark, sf_dir), ok)


def trajectory_path(spark: SparkSession, sf_dir: str) -> str:
    return materialize(spark, sf_dir, "trajectory", lambda: trajectory_plan(spark, sf_dir), "reservoir_id",
                       sort_by=("reservoir_id", "sim_id", "step"))


def trajectory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The written dataset (Parquet partitioned by reservoir), in schema order."""
    return spark.read.parquet(trajectory_path(spark, sf_dir)).select(*TRAJECTORY_COLUMNS, "step")


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runlog.run_log(classified_runs(spark, sf_dir), scenarios(spark, sf_dir),
                          trajectory(spark, sf_dir))


def run_log_path(spark: SparkSession, sf_dir: str) -> str:
    """The run log written next to the dataset (the batch's second sink)."""
    return materialize_with(spark, sf_dir, "run_log", lambda path: files.write_run_log(run_log(spark, sf_dir), path))


def keyword_files_path(spark: SparkSession, sf_dir: str) -> str:
    """The conversations as keyword text: files of a thousand conversations, a header line with the
    role in capitals before each turn's lines."""
    def write(path: str) -> None:
        lines = testdata.section_lines(spark, sf_dir, with_role=True)
        bucket = F.floor(F.col("file") / 1000).alias("bucket")
        head = lines.where("pos = 0").select(bucket, "file", "turn", F.lit(-1).cast("long").alias("pos"), F.upper("role").alias("value"))
        body = lines.select(bucket, "file", "turn", "pos", F.col("line").alias("value"))
        head.union(body).repartition("bucket").sortWithinPartitions("bucket", "file", "turn", "pos") \
            .select("bucket", "value").write.mode("overwrite").partitionBy("bucket").text(path)
    return materialize_with(spark, sf_dir, "keyword_files", write)


def control_files_path(spark: SparkSession, sf_dir: str) -> str:
    """The fixed control records as keyword files, one a reservoir."""
    return materialize_with(spark, sf_dir, "control_files", lambda path: decks.write_control_files(spark, path))


def ordered_trajectory_path(spark: SparkSession, sf_dir: str, rows_per_file: int = 1_000_000) -> str:
    """The dataset in the order of its runs and steps, with a manifest of the files' key ranges."""
    def write(path: str) -> None:
        tr = trajectory(spark, sf_dir)
        stores.write_ordered(tr, path, ("reservoir_id", "sim_id", "step"), max(4, -(-tr.count() // rows_per_file)))
    return materialize_with(spark, sf_dir, "ordered_trajectory", write)


def batched_trajectory_path(spark: SparkSession, sf_dir: str) -> str:
    """The dataset written in two batches of runs (odd and even ids), the first one offered again after the second."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/ensemble-batches/{hashlib.sha1(os.path.abspath(sf_dir).encode()).hexdigest()[:16]}"
    source = stores.fingerprint(spark, *[f"{sf_dir}/{t}.parquet" for t in SOURCE_TABLES])
    for batch in ("even", "odd", "even"):
        rest = 0 if batch == "even" else 1
        stores.write_batch(spark, path, batch, source, lambda: trajectory(spark, sf_dir).where(F.pmod("sim_id", F.lit(2)) == rest))
    return path


def damaged_csv_path(spark: SparkSession, sf_dir: str) -> str:
    """Run, step and pressure of the dataset as CSV, in which every 97th line by a fixed rule is broken:
    a word for a number, a value too few, or one too many."""
    def write(path: str) -> None:
        run, step = F.col("sim_id").cast("string"), F.col("step").cast("string")
        rest = F.pmod(F.col("sim_id") * 31 + F.col("step"), F.lit(97))
        line = (F.when(rest == 0, F.concat_ws(",", run, step, F.lit("high"))).when(rest == 1, F.concat_ws(",", run, step))
                .when(rest == 2, F.concat_ws(",", run, step, F.lit("1.5"), F.lit("2"))).when(rest == 3, F.concat_ws(",", F.lit(""), step, F.lit("1.5")))
                .otherwise(F.concat_ws(",", run, step, F.col("Presion_Reservorio_psi").cast("string"))))
        trajectory(spark, sf_dir).select(line.alias("value")).write.mode("overwrite").text(path)
    return materialize_with(spark, sf_dir, "damaged_csv", write)


def step_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored summary table of the batches: sketches of the pressure by (batch, reservoir, step)."""
    def build() -> DataFrame:
        rows = stores.read_batches(spark, batched_trajectory_path(spark, sf_dir))
        return summaries.summarize(rows, TARGET, ["batch", "reservoir_id", "step"])
    return materialized(spark, sf_dir, "step_summaries", build)

"""Binding of the ensemble's logical tables to the shared test tables.

The source datasets of ensembles are not shipped, so every logical table is
derived from the parquet test tables by Spark, and grows with them:

* a simulation is a ``user_id`` of ``events``; its reservoir is
  ``pmod(sim_id, 3)`` in registration order (spe9, norne, volve);
* a report step is one event, ordered by (ts, event_id); time is days since
  2024-01-01; pressure is ``6000 - 12.5 * value`` psi (stored in the deck's
  unit); rates are the event value routed by type (view: oil, click: gas,
  purchase: water injection, signup: water production) and cumulatives are
  their running sums, except that an ``error`` event books a correction of
  -1 % of its value on cumulative water injected (so that cumulative can fall);
* a run fails by exit code when ``pmod(sim_id, 11) = 0``, by time-out when
  ``pmod(sim_id, 23) = 5`` and by an exception when ``pmod(sim_id, 29) = 7``;
* scenario levers come from :func:`lhs_sample` + :func:`lhs_rejection`.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import BAR_TO_PSI, RESERVOIR_ORDER, SUMMARY_KEYS
from ..operators.ranking import ordered_scan
from ..operators.text import normalized_lines
from .dimensions import reservoir_dim

SEED = 42
TIME_ORIGIN = "2024-01-01 00:00:00"
#: Event type -> rate vector it feeds.
RATE_OF_EVENT = {"view": "FOPR", "click": "FGPR", "purchase": "FWIR", "signup": "WATER_PROD"}
#: An ``error`` event books a reporting correction of -1 % of its value on the
#: cumulative water injected (so cumulatives can fall, as simulator output can).
CORRECTION_EVENT, CORRECTION_SHARE = "error", -0.01


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reservoir_of(sim_id: Column) -> Column:
    names = F.array(*[F.lit(n) for n in RESERVOIR_ORDER])
    return F.element_at(names, (F.pmod(sim_id, F.lit(len(RESERVOIR_ORDER))) + 1).cast("int"))


def micros_since(df: DataFrame, col: str, origin: str) -> Column:
    """Microseconds from ``origin`` (a wall-clock time) to ``col``, independent of
    the session time zone: a TIMESTAMP_NTZ column is compared as wall-clock
    time, a TIMESTAMP column by its epoch microseconds (files that store
    wall-clock times are read with the epoch counted as UTC)."""
    if isinstance(df.schema[col].dataType, T.TimestampNTZType):
        return F.timestamp_diff("MICROSECOND", F.lit(origin).cast("timestamp_ntz"), F.col(col))
    origin_us = int((datetime.fromisoformat(origin).replace(tzinfo=timezone.utc)
                     - datetime(1970, 1, 1, tzinfo=timezone.utc)).total_seconds()) * 1_000_000
    return F.unix_micros(F.col(col)) - F.lit(origin_us)


def days_since_origin(df: DataFrame, col: str, origin: str = TIME_ORIGIN) -> Column:
    return micros_since(df, col, origin) / F.lit(86_400e6)


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return ev.select(
        reservoir_of(F.col("user_id")).alias("reservoir_id"),
        F.col("user_id").alias("sim_id"),
        F.col("event_id"),
        F.col("event_type"),
        F.col("value"),
        days_since_origin(ev, "ts").alias("tiempo_dias"),
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct simulations (reservoir_id, sim_id)."""
    ev = table(spark, sf_dir, "events").select(F.col("user_id").alias("sim_id")).distinct()
    return ev.select(reservoir_of(F.col("sim_id")).alias("reservoir_id"), "sim_id")


def run_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw outcome of each run (before classification)."""
    ev = event_rows(spark, sf_dir)
    per_run = ev.groupBy("reservoir_id", "sim_id").agg(F.count(F.lit(1)).alias("n_steps"))
    dim = reservoir_dim(spark).select("reservoir_id", "flow_timeout_s")
    sim = F.col("sim_id")
    timed_out = F.pmod(sim, F.lit(23)) == 5
    return per_run.join(dim, "reservoir_id").select(
        "reservoir_id", "sim_id",
        F.when(timed_out, F.lit(None).cast("int"))
         .when(F.pmod(sim, F.lit(11)) == 0, F.lit(1)).otherwise(F.lit(0)).alias("exit_code"),
        timed_out.alias("timed_out"),
        F.when(F.pmod(sim, F.lit(29)) == 7, F.lit("ValueError: summary vector FPR is empty"))
         .alias("exception"),
        F.when(timed_out, F.col("flow_timeout_s"))
         .otherwise(F.col("n_steps") * F.lit(0.25)).alias("elapsed_s"),
        F.col("flow_timeout_s").alias("limit_s"),
    )


def run_streams(spark: SparkSession, sf_dir: str, classified: DataFrame) -> DataFrame:
    """(reservoir_id, sim_id, ok, stdout, stderr) of each run: it printed the text of the document
    with its number (NULL, if there is none), and its error stream names its last event, by
    (ts, event_id), and its error."""
    last = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("sim_id")) \
        .agg(F.max(F.struct("ts", "event_id", "event_type")).alias("last"))
    printed = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("sim_id"), F.col("text").alias("stdout"))
    return classified.join(last, "sim_id").join(printed, "sim_id", "left").select(
        "reservoir_id", "sim_id", "ok", "stdout",
        F.format_string("last event %d: %s\n%s\n", "last.event_id", "last.event_type", "error").alias("stderr"))


def summary_vectors(spark: SparkSession, sf_dir: str, rows_per_chunk: int = 1_000_000) -> DataFrame:
    """Long summary vectors (reservoir_id, sim_id, step, key, value) in deck units."""
    ev = event_rows(spark, sf_dir)
    for etype, vec in RATE_OF_EVENT.items():
        ev = ev.withColumn(vec, F.when(F.col("event_type") == etype, F.col("value")).otherwise(F.lit(0.0)))
    ev = ev.withColumn("WATER_INJ_BOOKED", F.when(F.col("event_type") == "purchase", F.col("value"))
                       .when(F.col("event_type") == CORRECTION_EVENT, F.col("value") * F.lit(CORRECTION_SHARE))
                       .otherwise(F.lit(0.0)))
    ev = ordered_scan(
        ev, ["reservoir_id", "sim_id"], ["tiempo_dias", "event_id"], index_col="step",
        running_sums={"FOPT": "FOPR", "FGPT": "FGPR", "FWIT": "WATER_INJ_BOOKED", "FWPT": "WATER_PROD"},
        rows_per_chunk=rows_per_chunk,
    )
    dim = reservoir_dim(spark).select("reservoir_id", "unit_system")
    p_psi = F.lit(6000.0) - F.lit(12.5) * F.col("value")
    ev = ev.join(dim, "reservoir_id").withColumn(
        "FPR", F.when(F.col("unit_system") == "METRIC", p_psi / F.lit(BAR_TO_PSI)).otherwise(p_psi)
    ).withColumn("TIME", F.col("tiempo_dias"))
    entries = F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).cast("double").alias("value"))
                        for k in SUMMARY_KEYS])
    return ev.select("reservoir_id", "sim_id", "step", F.inline(entries))


#: Well vector names routed from the part key (pmod(l_partkey, 5)).
WELL_VECTORS = ["WBHP", "WBHPH", "WOPR", "WGPR", "WWPR"]
SHIP_ORIGIN = "1992-01-01 00:00:00"


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prediction rows: a dataset per return flag, a run per supplier,
    y = extended price, y_pred = 2000 * quantity."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_returnflag").alias("reservoir_id"),
        F.col("l_suppkey").alias("sim_id"),
        F.col("l_orderkey"), F.col("l_linenumber"),
        F.col("l_extendedprice").alias("y"),
        (F.lit(2000.0) * F.col("l_quantity")).alias("y_pred"),
    )


def well_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long well vectors (run, key_well, days, date, value): a run per line
    status, a well per supplier, a vector per part key."""
    li = table(spark, sf_dir, "lineitem")
    vec = F.element_at(F.array(*[F.lit(v) for v in WELL_VECTORS]),
                       (F.pmod(F.col("l_partkey"), F.lit(len(WELL_VECTORS))) + 1).cast("int"))
    well = F.format_string("W-%d", F.col("l_suppkey"))
    days = F.floor(micros_since(li, "l_shipdate", SHIP_ORIGIN) / F.lit(86_400_000_000))
    date = F.date_add(F.lit(SHIP_ORIGIN[:10]).cast("date"), days.cast("int")).cast("string")  # ISO yyyy-MM-dd
    return li.select(
        F.concat(F.lit("run_"), F.col("l_linestatus")).alias("run"),
        F.concat_ws(":", vec, well).alias("key_well"),
        days.cast("double").alias("days"),
        date.alias("date"),
        F.col("l_extendedprice").alias("value"),
    )


def section_lines(spark: SparkSession, sf_dir: str, with_role: bool = False) -> DataFrame:
    """Lines of keyword text: a file per conversation; every line of a turn in
    turn order; a ``user`` turn opens a section named after its turn."""
    cv = table(spark, sf_dir, "conversations")
    lines = cv.select("conv_id", "turn", "role",
                      F.posexplode(F.split(normalized_lines(F.col("text")), "\n")).alias("pos", "line"))
    return lines.select(
        F.col("conv_id").alias("file"),
        "turn", F.col("pos").cast("long").alias("pos"),
        "line",
        F.when((F.col("role") == "user") & (F.col("pos") == 0),
               F.format_string("TURN%d", F.col("turn"))).alias("header"),
        *(["role"] if with_role else []),
    )

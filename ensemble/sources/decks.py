"""The fixed control records as keyword files (the form in which users have them)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .dimensions import EQUIL_RECORDS, GROUP_INJECTION_RECORDS, INJECTOR_RECORDS, PRODUCER_RECORDS, PVTO_RECORDS


def _num(x: float) -> str:
    return f"{x:g}" if float(f"{x:g}") == x else repr(x)


def control_lines(reservoir: str) -> list[str]:
    """Control sections of a reservoir: records over lines, comments, defaults."""
    out = [f"-- control records of {reservoir}", ""]
    if reservoir == "spe9":
        out += ["PVTO", "-- rs  p  bo  viscosity"]
        out += ["  ".join(map(_num, nums)) + (" /" if end else "") for _, nums, end in PVTO_RECORDS] + ["/", ""]
    out.append("EQUIL")
    for r in (r[2:] for r in EQUIL_RECORDS if r[0] == reservoir):
        out += ["  ".join(map(_num, r[:4])) + "  -- the rest on the next line", "   " + "  ".join(map(_num, r[4:])) + " /  region"]
    for _, _, well, fluid, status, mode, rate in (r for r in INJECTOR_RECORDS if r[0] == reservoir):
        out += ["", "WCONINJE", f"  '{well}' '{fluid}' '{status}' '{mode}' {_num(rate)} 1* 4000 /", "/"]
    for _, _, pattern, status, mode, rate in (r for r in PRODUCER_RECORDS if r[0] == reservoir):
        out += ["", "WCONPROD", f"  '{pattern}' '{status}' '{mode}'", f"     {_num(rate)} 4* 1000 /", "/", "", "TSTEP", "30*10 /"]
    groups = [r[2:] for r in GROUP_INJECTION_RECORDS if r[0] == reservoir]
    if groups:
        out += ["", "GCONINJE", *[f"  '{g}' '{phase}' '{mode}' {_num(rate)} /" for g, phase, mode, rate in groups], "/"]
    return out


def write_control_files(spark: SparkSession, path: str) -> None:
    """One folder with one file for each reservoir (a fixed number of lines)."""
    rows = [(r, i, x) for r in ("spe9", "norne", "volve") for i, x in enumerate(control_lines(r))]
    df: DataFrame = spark.createDataFrame(rows, "reservoir string, no int, value string")
    df.coalesce(1).sortWithinPartitions("reservoir", "no").select(F.col("reservoir").alias("deck"), "value") \
        .write.mode("overwrite").partitionBy("deck").text(path)

"""Dataset validation on hand-made frames (one broken dataset per check)."""
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ensemble.operators import quality
from ensemble.schemas import SCHEMA_COLUMNS, TRAJECTORY


def make(spark, sims=3, steps=4, p_span=500.0, null=False, nan=False):
    rows = []
    for s in range(1, sims + 1):
        for k in range(steps):
            vals = {c: 1.0 for c in SCHEMA_COLUMNS[1:]}
            vals["Prod_Acumulada_Petroleo"] = 10.0 * k
            vals["Presion_Reservorio_psi"] = 3000.0 + p_span * (s - 1) / max(sims - 1, 1)
            if null and s == 1 and k == 0:
                vals["Bo_rb_stb"] = None
            if nan and s == 1 and k == 0:
                vals["Bo_rb_stb"] = float("nan")
            rows.append((s, "spe9", *[vals[c] for c in SCHEMA_COLUMNS[1:]], k))
    schema = T.StructType(TRAJECTORY.fields + [T.StructField("step", T.LongType())])
    return spark.createDataFrame(rows, schema)


def findings(df, n):
    return {(r.check, r.column): r for r in quality.validate_dataset(df, n).collect()}


def test_clean_dataset_passes(spark):
    f = findings(make(spark), 3)
    assert all(r.passed for r in f.values())
    assert quality.exit_status(quality.validate_dataset(make(spark), 3)) == 0
    assert quality.exit_status(quality.validate_dataset(make(spark, p_span=10.0), 3)) == 2


def test_empty_short_circuits(spark):
    f = findings(make(spark).where("false"), 3)
    assert list(f) == [("empty", None)] and not f[("empty", None)].passed


@pytest.mark.parametrize("fall,ok", [(0.5, True), (1.0, True), (1.5, False)])
def test_cumulative_tolerance(spark, fall, ok):
    # the last step falls by `fall` relative to the previous one
    df = make(spark).withColumn(
        "Prod_Acumulada_Petroleo",
        F.when(F.col("step") == 3, F.lit(20.0) - F.lit(fall)).otherwise(F.col("step") * 10.0))
    f = findings(df, 3)
    assert f[("monotonic", "Prod_Acumulada_Petroleo")].passed is ok
    v = quality.monotonic_violations(df).collect()
    assert (len(v) == 0) is ok


@pytest.mark.parametrize("sims,requested,ok", [(79, 100, False), (80, 100, True), (7, 10, False),
                                               (8, 10, True), (1, 1, True)])
def test_converged_floor(spark, sims, requested, ok):
    f = findings(make(spark, sims=sims, steps=1), requested)
    assert f[("converged", None)].passed is ok


@pytest.mark.parametrize("span,ok", [(99.9, False), (100.0, True)])
def test_pressure_range(spark, span, ok):
    assert findings(make(spark, p_span=span), 3)[("pressure_range", "Presion_Reservorio_psi")].passed is ok


@pytest.mark.parametrize("kind", ["null", "nan"])
def test_missing_values(spark, kind):
    f = findings(make(spark, **{kind: True}), 3)
    assert not f[("null_values", None)].passed and f[("null_values", None)].observed == 1.0


def test_missing_column_reported_and_skipped(spark):
    f = findings(make(spark).drop("Area"), 3)
    assert not f[("missing_column", "Area")].passed
    assert f[("null_values", None)].passed


def test_variance_audit_zero_variance(spark):
    out = {r.column: r for r in quality.variance_audit(make(spark)).collect()}
    assert out["Area"].zero_variance and out["Area"].variance == 0.0
    assert out["Bo_rb_stb"].reason.startswith("leakage")


def test_drift_report(spark):
    a = spark.createDataFrame([(0.0,), (10.0,)], "x double")
    b = spark.createDataFrame([(5.0,), (11.0,), (12.0,), (1.0,)], "x double")
    r = quality.drift_report(a, b, ["x"]).first()
    assert r.out_of_range and r.share_out == 0.5 and r.max_b == 12.0


@pytest.mark.parametrize("gone", [["step"], ["step", "reservoir_id"], ["step", "sim_id"], ["step", "tiempo_dias"],
                                  ["step", "Presion_Reservorio_psi"], ["step", "Prod_Acumulada_Gas", "Bo_rb_stb"]])
def test_missing_columns_skip_their_checks(spark, gone):
    f = findings(make(spark).drop(*gone), 3)
    assert {c for k, c in f if k == "missing_column"} == set(gone) & set(SCHEMA_COLUMNS)
    monotonic = {c for k, c in f if k == "monotonic"}
    whole = {"sim_id", "tiempo_dias"}.isdisjoint(gone)
    assert monotonic == ({c for c in quality.CUMULATIVE_COLUMNS if c not in gone} if whole else set())
    assert (("converged", None) in f) == ("sim_id" not in gone)
    assert ("pressure_range", "Presion_Reservorio_psi") in f or "Presion_Reservorio_psi" in gone
    assert all(r.passed for (k, _), r in f.items() if k != "missing_column")


def test_falls_are_found_without_a_step(spark):
    df = make(spark).withColumn("tiempo_dias", F.col("step") * 30.0).withColumn(
        "Prod_Acumulada_Gas", F.when(F.col("step") == 2, 5.0).otherwise(F.col("step") * 10.0)).drop("step")
    assert not findings(df, 3)[("monotonic", "Prod_Acumulada_Gas")].passed

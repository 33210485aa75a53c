from pyspark.sql import functions as F

from ensemble.operators import runlog
from ensemble.schemas import ALL_LEVERS, RUN_OUTCOME


def test_classification_order_and_failed_runs_keep_rows(spark):
    out = spark.createDataFrame([
        ("spe9", 1, 0, False, None, 10.0, 600.0),
        ("spe9", 2, 3, False, None, 11.0, 600.0),
        ("spe9", 3, None, True, None, 600.0, 600.0),
        ("spe9", 4, 0, False, "ValueError: bad", 12.0, 600.0),
    ], RUN_OUTCOME)
    c = {r.sim_id: r for r in runlog.classify_outcome(out).collect()}
    assert c[1].ok and c[1].error == ""
    assert c[2].error == "exit 3" and c[3].error == "timeout after 600s" and c[4].error == "ValueError: bad"
    levers = spark.createDataFrame([("spe9", i, *[1.0] * len(ALL_LEVERS)) for i in range(1, 5)],
                                   "reservoir_id string, sim_id long, " + ", ".join(f"{x} double" for x in ALL_LEVERS))
    traj = spark.createDataFrame([("spe9", 1, 3000.0), ("spe9", 1, 3500.5)],
                                 "reservoir_id string, sim_id long, Presion_Reservorio_psi double")
    log = {r.sim_id: r for r in runlog.run_log(runlog.classify_outcome(out), levers, traj).collect()}
    assert len(log) == 4
    assert log[1].fpr_range_psi == 500.5 and log[1].fpr_range_psi == log[1].fpr_max_psi - log[1].fpr_min_psi
    assert log[2].fpr_min_psi is None and log[2].fpr_range_psi is None and not log[2].ok
    b = runlog.batch_summary(runlog.run_log(runlog.classify_outcome(out), levers, traj)).first()
    assert b.n_requested == 4 and b.n_converged == 1 and b.converged_ratio == 0.25


def test_converged_is_a_semi_join(spark):
    c = spark.createDataFrame([("spe9", 1, True), ("spe9", 2, False)], "reservoir_id string, sim_id long, ok boolean")
    rows = spark.range(6).select(F.lit("spe9").alias("reservoir_id"), (F.col("id") % 3).alias("sim_id"))
    assert runlog.converged(rows, c).count() == 2

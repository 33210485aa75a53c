import math
import tempfile

from ensemble.schemas import TRAJECTORY
from ensemble.sources import files


def test_csv_round_trip_with_schema_and_nan(spark):
    row = tuple([7, "spe9"] + [1.5] * (len(TRAJECTORY.fields) - 3) + [float("nan")])
    df = spark.createDataFrame([row], TRAJECTORY)
    out = tempfile.mkdtemp(prefix="ensemble-test-")
    assert files.write_dataset(df, out + "/ds", fmt="csv")
    back = files.read_trajectory(spark, out + "/ds", fmt="csv").first()
    assert back.sim_id == 7 and back.reservoir_id == "spe9" and back.Presion_Reservorio_psi is None
    assert not files.write_dataset(df.where("false"), out + "/empty")
    assert not math.isnan(back.Porosidad)


def test_run_logs_with_different_levers_read_together(spark, tmp_path):
    a = tmp_path / "runs_log_a.csv"
    a.write_text("sim_id,ok,error,runtime_s,qwinj_rate,k_mult,fpr_min_psi,fpr_max_psi,fpr_range_psi\n"
                 "1,True,,24.5,4000.0,1.1,1550.2,3000.0,1449.8\n2,False,docker exit 1,3.0,5000.0,0.9,,,\n")
    b = tmp_path / "runs_log_b.csv"
    b.write_text("sim_id,ok,error,runtime_s,k_mult,p_init_shift_bar,fpr_min_psi,fpr_max_psi,fpr_range_psi\n"
                 "1,True,,265.9,1.2,-3.5,3346.5,4345.7,999.2\n")
    log = files.read_run_logs_csv(spark, {"spe9": str(a), "norne": str(b)})
    rows = {(r.reservoir_id, r.sim_id): r for r in log.collect()}
    assert len(rows) == 3
    assert rows[("spe9", 1)].qwinj_rate == 4000.0 and rows[("spe9", 1)].p_init_shift_bar is None
    assert rows[("norne", 1)].p_init_shift_bar == -3.5 and rows[("norne", 1)].qwinj_rate is None
    assert rows[("spe9", 2)].ok is False and rows[("spe9", 2)].fpr_min_psi is None
    assert rows[("spe9", 2)].error == "docker exit 1" and rows[("spe9", 1)].error == ""


def test_csv_rows_are_accepted_or_rejected_as_they_stand(spark, tmp_path):
    from pyspark.sql import types as T

    from ensemble.sources import files
    (tmp_path / "a.csv").write_text("sim_id,p,ok\n1,2.5,true\n2,high,true\n3,1.5\n4,1.5,true,9\n,7.0,false\n5,NaN,false\n6,,true\n")
    schema = T.StructType([T.StructField("sim_id", T.LongType()), T.StructField("p", T.DoubleType()), T.StructField("ok", T.BooleanType())])
    good, bad = files.read_csv_checked(spark, str(tmp_path), schema, keys=["sim_id"])
    assert sorted(map(tuple, good.collect()), key=str) == [(1, 2.5, True), (5, None, False), (6, None, True)]
    assert sorted(r.record for r in bad.collect()) == [",7.0,false", "2,high,true", "3,1.5", "4,1.5,true,9"]
    assert all(r.file.endswith("a.csv") for r in bad.collect())


def test_csv_sinks_are_read_back(spark, tmp_path):
    from pyspark.sql import functions as F

    from ensemble.schemas import RUN_LOG, TRAJECTORY
    from ensemble.sources import files

    def rows(schema, n):
        kinds = {"string": F.lit("spe9"), "boolean": F.lit(True), "double": F.col("id") / 4, "bigint": F.col("id"), "int": F.col("id").cast("int")}
        return spark.range(n).select(*[kinds[f.dataType.simpleString()].cast(f.dataType).alias(f.name) for f in schema.fields])
    log = rows(RUN_LOG, 5)
    for fmt in ("csv", "parquet"):
        files.write_run_log(log, str(tmp_path / f"log-{fmt}"), fmt)
        assert sorted(map(str, files.read_run_log(spark, str(tmp_path / f"log-{fmt}"), fmt).collect())) == sorted(map(str, log.collect()))
        tr = rows(TRAJECTORY, 5)
        assert files.write_dataset(tr, str(tmp_path / f"tr-{fmt}"), fmt) and not files.write_dataset(tr.limit(0), str(tmp_path / "no"), fmt)
    assert not (tmp_path / "no").exists()
    back = files.read_trajectory(spark, str(tmp_path / "tr-parquet")).select(*[f.name for f in TRAJECTORY.fields])
    assert sorted(map(str, back.collect())) == sorted(map(str, tr.collect()))

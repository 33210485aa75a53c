"""Plan properties that matter at scale, checked on the small tables."""
from pyspark.sql import functions as F

from conftest import SF_SMALL
from ensemble.plans import datasets as D
from ensemble.operators import features
from ensemble.sources import testdata


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_dataset_scan_prunes_partitions_columns_and_runs(spark):
    df = D.trajectory(spark, SF_SMALL).where((F.col("reservoir_id") == "spe9") & (F.col("sim_id") == 3)) \
        .select("step", "Presion_Reservorio_psi")
    plan = _plan(df)
    assert "PartitionFilters: [isnotnull(reservoir_id" in plan and "= spe9" in plan
    assert "EqualTo(sim_id,3)" in plan
    assert "ReadSchema: struct<sim_id:bigint,Presion_Reservorio_psi:double,step:bigint>" in plan


def test_dataset_written_once(spark):
    p1 = D.trajectory_path(spark, SF_SMALL)
    marker = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p1 + "/_SUCCESS")
    fs = marker.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    t1 = fs.getFileStatus(marker).getModificationTime()
    assert D.trajectory_path(spark, SF_SMALL) == p1
    assert fs.getFileStatus(marker).getModificationTime() == t1


def test_vector_pivot_is_one_aggregation_round(spark):
    plan = features.pivot_summary_vectors(testdata.summary_vectors(spark, SF_SMALL))._jdf \
        .queryExecution().optimizedPlan().toString()
    assert sum("Aggregate [reservoir_id" in x and "max(CASE" in x for x in plan.splitlines()) == 1


def test_no_python_udf_in_headline_plans(spark):
    import __spark_entry__ as E
    for name in ("feature_table", "lhs_rejection", "validate_dataset", "section_scan"):
        plan = _plan(E.queries()[name](spark, SF_SMALL))
        assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan, name

from pyspark.sql import functions as F

from ensemble.functions import units
from ensemble.schemas import BAR_TO_PSI, SM3_TO_MSCF, SM3_TO_SCF, SM3_TO_STB, SUMMARY_KEYS


def test_unit_factors_metric_and_field(spark):
    df = spark.createDataFrame([("METRIC",), ("FIELD",)], "u string")
    out = df.select("u", *[units.to_field(F.lit(1.0), F.col("u"), k).alias(k) for k in SUMMARY_KEYS])
    rows = {r.u: r for r in out.collect()}
    m, f = rows["METRIC"], rows["FIELD"]
    assert m.FPR == BAR_TO_PSI and m.FOPR == SM3_TO_STB and m.FGPR == SM3_TO_MSCF and m.FGPT == SM3_TO_SCF
    assert m.FWPT == SM3_TO_STB and m.FWIT == SM3_TO_STB and m.FWIR == SM3_TO_STB and m.TIME == 1.0
    assert f.FGPT == 1000.0
    assert all(f[k] == 1.0 for k in SUMMARY_KEYS if k != "FGPT")


def test_bubble_point_missing_lever_is_zero(spark):
    df = spark.createDataFrame([("METRIC", 250.0, None, None), ("FIELD", 3600.0, None, None),
                                ("METRIC", 250.0, None, 10.0), ("FIELD", 3600.0, -100.0, None)],
                               "u string, pb double, s double, m double")
    got = [r[0] for r in df.select(units.bubble_point_psi(F.col("u"), F.col("pb"), F.col("s"), F.col("m"))).collect()]
    assert got == [250.0 * BAR_TO_PSI, 3600.0, 260.0 * BAR_TO_PSI, 3500.0]
    shifts = [r[0] for r in df.select(units.pvt_shift(F.col("u"), F.col("s"))).collect()]
    assert shifts == [0.0, 0.0, 0.0, -100.0]

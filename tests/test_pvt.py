"""PVT lookups against a NumPy brute force of the same rules."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from ensemble.functions import pvt
from ensemble.functions.interp import interp
from ensemble.schemas import PVDG, PVTO_SATURATED

PRESSURES = [-125.0, 0.0, 14.7, 100.0, 400.0, 2000.0, 3999.9, 4000.0, 4100.0, 4200.0, 5000.0, 6000.0]
SHIFTS = [-300.0, 0.0, 400.0]
GRID = np.array([r[1] for r in PVTO_SATURATED])
RS = np.array([r[0] for r in PVTO_SATURATED])
BO = np.array([r[2] for r in PVTO_SATURATED])


def np_grid(shift):
    g = GRID.copy()
    g[g > 14.7] += shift
    return g


def np_rs(p, s):
    g = np_grid(s)
    return np.interp(np.minimum(p, g[-1]), g, RS) * 1000.0


def np_bo(p, s):
    g = np_grid(s)
    sat = np.interp(np.minimum(p, g[-1]), g, BO)
    if p > g[-1] and 5000.0 > g[-1]:
        return BO[-1] + (1.1189 - BO[-1]) / (5000.0 - g[-1]) * (p - g[-1])
    return sat


def np_bg(p):
    return np.interp(p, [r[0] for r in PVDG], [r[1] for r in PVDG]) / 1000.0


@pytest.fixture(scope="module")
def frame(spark):
    rows = [(p, s) for p in PRESSURES for s in SHIFTS]
    df = spark.createDataFrame(rows, "p double, s double")
    return df.select("p", "s", pvt.rs_from_pressure(F.col("p"), F.col("s")).alias("rs"),
                     pvt.bo_from_pressure(F.col("p"), F.col("s")).alias("bo"),
                     pvt.bg_from_pressure(F.col("p")).alias("bg")).collect()


def test_rs_bo_bg_match_numpy(frame):
    for r in frame:
        assert r.rs == pytest.approx(np_rs(r.p, r.s), rel=0, abs=1e-9)
        assert r.bo == pytest.approx(np_bo(r.p, r.s), rel=0, abs=1e-12)
        assert r.bg == pytest.approx(np_bg(r.p), rel=0, abs=1e-15)


def test_interp_is_bit_exact_with_numpy(spark):
    xs = np.linspace(-200, 6500, 2001)
    df = spark.createDataFrame([(float(x),) for x in xs], "x double")
    got = [r[0] for r in df.select(interp(F.col("x"), list(GRID), list(BO))).collect()]
    assert got == list(np.interp(xs, GRID, BO))


def test_grid_nodes_return_table_values(spark):
    df = spark.createDataFrame([(float(x),) for x in GRID], "p double")
    got = [r[0] for r in df.select(pvt.rs_from_pressure(F.col("p"), 0.0)).collect()]
    assert got == pytest.approx(list(RS * 1000.0))


def test_bo_continues_past_undersaturated_point(frame):
    # shift 0: pb_max 4000 < 5000 -> line through (5000, 1.1189), not clamped at 6000
    r = [x for x in frame if x.p == 6000.0 and x.s == 0.0][0]
    assert r.bo == pytest.approx(1.12 + (1.1189 - 1.12) / 1000.0 * 2000.0)
    # shift 400 at p=4200: below shifted pb_max (4400): saturated curve
    r = [x for x in frame if x.p == 4200.0 and x.s == 400.0][0]
    assert r.bo == pytest.approx(np.interp(4200.0, np_grid(400.0), BO))


def test_null_pressure_gives_null(spark):
    df = spark.createDataFrame([(None,)], "p double")
    assert df.select(pvt.bg_from_pressure(F.col("p"))).first()[0] is None


def test_shifted_grid_keeps_anchor(spark):
    g = spark.range(1).select(pvt.shifted_grid_array(F.lit(-300.0))).first()[0]
    assert g[0] == 14.7 and g[1] == 100.0 and g[-1] == 3700.0


def test_run_features_rejects_shift_crossing_anchor(spark):
    from ensemble.operators.features import run_features
    from ensemble.schemas import ALL_LEVERS
    row = {k: None for k in ALL_LEVERS}
    row.update(k_mult=1.0, phi_mult=1.0, pb_shift=-390.0)
    df = spark.createDataFrame([("spe9", 1, *[row[k] for k in ALL_LEVERS])],
                               "reservoir_id string, sim_id long, " + ", ".join(f"{k} double" for k in ALL_LEVERS))
    with pytest.raises(Exception, match="reorder the PVT grid"):
        run_features(df).collect()
    row.update(pb_shift=-300.0)
    ok = spark.createDataFrame([("spe9", 1, *[row[k] for k in ALL_LEVERS])], df.schema)
    assert run_features(ok).first().pvt_shift == -300.0

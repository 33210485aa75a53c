import pytest
from pyspark.sql import functions as F

from ensemble.operators import scenarios as rules
from ensemble.schemas import ALL_LEVERS

BASE = {lv: None for lv in ALL_LEVERS}


def scen(spark, rows):
    data = []
    for res, sim, lv in rows:
        d = dict(BASE)
        d.update(lv)
        data.append((res, sim, 0, *[d[k] for k in ALL_LEVERS]))
    schema = "reservoir_id string, sim_id long, attempt int, " + ", ".join(f"{k} double" for k in ALL_LEVERS)
    return spark.createDataFrame(data, schema)


SPE9 = {"qwinj_rate": 4321.456, "qo_rate_high": 1800.0, "k_mult": 1.234567, "phi_mult": 0.912345,
        "p_init": 4000.126, "pb_shift": 150.0}


def test_injector_producer_equil(spark):
    s = scen(spark, [("spe9", 1, SPE9)])
    inj = rules.apply_injector_rate(s).collect()
    assert len(inj) == 1 and inj[0].rate == 4321.46 and inj[0].hits == 1
    prod = sorted(rules.apply_producer_cap(s).collect(), key=lambda r: r.record_no)
    assert [r.rate for r in prod] == [1800.0, 120.0, 1800.0] and prod[0].hits == 3
    eq = rules.apply_equil(s).collect()
    assert len(eq) == 1 and eq[0].pressure == 4000.13


def test_metric_equil_shift_and_zero_shift(spark):
    s = scen(spark, [("norne", 1, {"k_mult": 1.0, "phi_mult": 1.0, "p_init_shift_bar": 1.23456}),
                     ("norne", 2, {"k_mult": 1.0, "phi_mult": 1.0, "p_init_shift_bar": 0.0}),
                     ("volve", 3, {"k_mult": 1.0, "phi_mult": 1.0, "p_init_shift_bar": -2.0,
                                   "qwinj_group_mult": 1.0})])
    eq = rules.apply_equil(s).collect()
    n1 = sorted((r.record_no, r.pressure, r.base_pressure) for r in eq if r.sim_id == 1)
    assert len(n1) == 5 and n1[0][1] == pytest.approx(round(268.56 + 1.23456, 4))
    assert all(r.pressure == r.base_pressure for r in eq if r.sim_id == 2)
    assert sum(1 for r in eq if r.sim_id == 3) == 12
    gr = sorted(rules.apply_group_rate(s).collect(), key=lambda r: r.record_no)
    assert [r.rate for r in gr] == [r.base_rate for r in gr]  # mult 1: unchanged


def test_group_rate_first_record_only(spark):
    s = scen(spark, [("volve", 3, {"k_mult": 1.0, "phi_mult": 1.0, "p_init_shift_bar": 0.0,
                                   "qwinj_group_mult": 1.25})])
    gr = sorted(rules.apply_group_rate(s).collect(), key=lambda r: r.record_no)
    assert [r.rate for r in gr] == [11250.0, 7000.0, 1000.0] and gr[0].hits == 1


def test_pvto_shift_rules(spark):
    s = scen(spark, [("spe9", 1, SPE9), ("spe9", 2, dict(SPE9, pb_shift=0.0))])
    out = rules.apply_pvto_shift(s).collect()
    one = {r.record_no: r for r in out if r.sim_id == 1}
    assert one[1].nums[1] == 14.7 and not one[1].shifted            # anchor untouched
    assert one[2].nums[1] == 550.0 and one[2].shifted
    assert one[11].nums[1] == 4150.0                                 # 4 numbers, no terminator
    assert one[12].nums == [5000.0, 1.1189, 0.94] and not one[12].shifted
    assert not any(r.shifted for r in out if r.sim_id == 2)


def test_multipliers_rounded(spark):
    s = scen(spark, [("spe9", 1, SPE9)])
    m = {r.prop: r.multiplier for r in rules.apply_multipliers(s).collect()}
    assert m == {"PORO": float("%.5f" % 0.912345), "PERMX": 1.23457, "PERMY": 1.23457, "PERMZ": 1.23457}


def test_hit_count_assertion_fails_job(spark, monkeypatch):
    import ensemble.operators.scenarios as mod
    from ensemble.sources import dimensions as reference
    monkeypatch.setattr(reference, "PRODUCER_RECORDS", reference.PRODUCER_RECORDS[:2])
    monkeypatch.setattr(mod, "control_table", reference.control_table)
    with pytest.raises(Exception, match="producer caps"):
        rules.apply_producer_cap(scen(spark, [("spe9", 1, SPE9)])).collect()


def all_levers(spark):
    return scen(spark, [("spe9", 1, SPE9), ("norne", 2, {"k_mult": 1.0, "phi_mult": 1.0, "p_init_shift_bar": 1.0}),
                        ("volve", 3, {"k_mult": 1.0, "phi_mult": 1.0, "p_init_shift_bar": 1.0, "qwinj_group_mult": 1.25})])


@pytest.mark.parametrize("action", ["collect", "count"])
@pytest.mark.parametrize("table,broken", [
    ("injector", "fluid = 'GAS'"), ("injector", "false"), ("producer", "record_no < 3"), ("producer", "false"),
    ("equil", "reservoir_id <> 'volve' or record_no < 12"), ("equil", "reservoir_id <> 'norne'"),
    ("group_injection", "phase = 'GAS'"), ("group_injection", "false")])
def test_missed_rules_fail(spark, monkeypatch, table, broken, action):
    whole = rules.control_table
    monkeypatch.setattr(rules, "control_table", lambda s, n: whole(s, n).where(broken) if n == table else whole(s, n))
    with pytest.raises(Exception, match="records matched"):
        getattr(rules.apply_scenario(all_levers(spark)), action)()


def test_all_rules_hold_on_the_given_records(spark):
    assert rules.apply_scenario(all_levers(spark)).count() == 1 + 3 + 18 + 12 + 10 + 3


def test_decimals_as_formatted(spark):
    import random
    rnd = random.Random(1)
    xs = [2.675, 0.125, 0.375, 1.005, 2.5, -2.675, -0.125, 0.0, 1e9 + 0.005, 0.145, 1.115, 8.345]
    xs += [rnd.uniform(-1e4, 1e4) for _ in range(3000)] + [round(rnd.uniform(0, 100), 3) for _ in range(3000)]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for digits in (2, 3, 4, 5):
        got = [r[0] for r in df.select(rules._round(F.col("x"), digits)).collect()]
        assert got == [float(f"%.{digits}f" % x) for x in xs]

"""LHS invariants: one point per stratum per lever, validator, dependent lever."""
import math

import pytest
from pyspark.sql import functions as F

from ensemble.operators import sampling
from ensemble.schemas import RESERVOIRS, THROTTLE_RATIO


@pytest.fixture(scope="module")
def runs(spark):
    rows = [(name, i) for name, n in (("spe9", 100), ("norne", 30), ("volve", 10)) for i in range(1, n + 1)]
    return spark.createDataFrame(rows, "reservoir_id string, sim_id long")


@pytest.fixture(scope="module")
def lhs(runs):
    return sampling.lhs_sample(runs, seed=42).collect()


def test_every_stratum_hit_once(lhs):
    for name, cfg in RESERVOIRS.items():
        rows = [r for r in lhs if r.reservoir_id == name]
        n = len(rows)
        for lever, (lo, hi) in cfg["levers"].items():
            strata = sorted(math.floor((r[lever] - lo) / (hi - lo) * n) for r in rows)
            assert strata == list(range(n)), (name, lever)
        for lever in set(sum([list(c["levers"]) for c in RESERVOIRS.values()], [])) - set(cfg["levers"]):
            assert all(r[lever] is None for r in rows)


def test_rejection_satisfies_validator(runs):
    out = sampling.lhs_rejection(sampling.lhs_sample(runs, 42), 42).collect()
    spe9 = [r for r in out if r.reservoir_id == "spe9"]
    assert len(spe9) == 100
    for r in spe9:
        assert r.attempt == 50 or r.p_init >= 3600 + r.pb_shift + 200
        lo, hi = RESERVOIRS["spe9"]["levers"]["p_init"]
        assert lo <= r.p_init <= hi
    assert all(r.attempt == 0 for r in out if r.reservoir_id != "spe9")


def test_validator_never_true_keeps_last_draw(runs, monkeypatch):
    monkeypatch.setitem(sampling.VALIDATORS, "norne", lambda get: F.lit(False))
    out = sampling.lhs_rejection(sampling.lhs_sample(runs.where("reservoir_id = 'norne'"), 42), 42).collect()
    assert {r.attempt for r in out} == {sampling.MAX_REDRAWS}


def test_dependent_lever(runs):
    lv = sampling.with_dependent_levers(sampling.lhs_sample(runs, 42)).where("reservoir_id = 'spe9'").collect()
    for r in lv:
        assert r.qo_rate_low == pytest.approx(r.qo_rate_high * THROTTLE_RATIO)
        assert r.qo_rate_low == pytest.approx(r.qo_rate_high / 15, rel=1e-12)

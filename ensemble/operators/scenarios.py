"""Scenario rules: baseline control records x scenario levers -> per-run records.

Each rule joins the scenario table with a small fixed control table of the
same reservoir (a broadcast join on ``reservoir_id``) and rewrites the targeted
values with column expressions. How many records a rule hits depends on the
control table alone, so hits are counted there, once per reservoir; a count
other than the rule expects fails the job in a filter that no later projection
or count can prune, as a rewrite that misses its target must not go unnoticed.
A reservoir without any control record has no hits, and fails too.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import PVT_ANCHOR_PSI
from ..sources.dimensions import GRID_PROPERTIES, control_table
from .sampling import with_dependent_levers

RUN_KEY = ["reservoir_id", "sim_id"]


def _two_product(x: Column, y: float) -> tuple[Column, Column]:
    """x * y as (rounded product, exact error), both doubles (splitting by 2**27 + 1)."""
    c = F.lit(134217729.0)
    p = x * F.lit(y)
    xh = c * x - (c * x - x)
    xl = x - xh
    t = 134217729.0 * y
    yh = t - (t - y)
    yl = y - yh
    return p, ((xh * F.lit(yh) - p) + xh * F.lit(yl) + xl * F.lit(yh)) + xl * F.lit(yl)


def _round(c: Column, digits: int) -> Column:
    """Value as ``%.<digits>f`` writes it: the exact binary value to the nearest, ties to even."""
    x = F.abs(c.cast("double"))
    p, err = _two_product(x, 10.0**digits)
    n = F.floor(p).cast("double")
    beyond = (p - (n + 0.5)) + err  # sign: on which side of the middle the exact product lies
    up = (beyond > 0) | ((beyond == 0) & (F.pmod(n, F.lit(2.0)) == 1))
    # the product may be rounded up to a whole number that the exact one does not reach
    low = (p == n) & (err < 0) & (err < -0.5)
    whole = F.when(low, n - 1).when(up, n + 1).otherwise(n)
    return F.when(c < 0, -whole / F.lit(10.0**digits)).otherwise(whole / F.lit(10.0**digits))


def _with_controls(scenarios: DataFrame, ctl: DataFrame, hit: Column, ok: Column, rule: str) -> DataFrame:
    """Scenarios x control records of their reservoir, with ``hits``: the records that the rule
    matches. Fails where ``ok`` (an expression on reservoir_id and hits) does not hold."""
    hits = ctl.groupBy("reservoir_id").agg(F.count_if(hit).alias("hits"))  # a fixed table: a row per reservoir
    j = scenarios.join(ctl, "reservoir_id", "left").join(F.broadcast(hits), "reservoir_id", "left") \
        .withColumn("hits", F.coalesce("hits", F.lit(0)))
    # one condition: a filter of its own on the records would turn the join into an inner one before the check
    return j.where(F.when(ok, F.col("record_no").isNotNull()).otherwise(
        F.raise_error(F.format_string(f"{rule} of %s: %d records matched", F.col("reservoir_id"), F.col("hits"))).cast("boolean")))


def _scen(scenarios: DataFrame, reservoir: str) -> DataFrame:
    return scenarios.where(F.col("reservoir_id") == reservoir)


def apply_injector_rate(scenarios: DataFrame, ctl: DataFrame | None = None) -> DataFrame:
    """Water injector INJE1 (WATER/OPEN/RATE): rate := qwinj_rate (2 dp); exactly 1 hit."""
    ctl = control_table(scenarios.sparkSession, "injector") if ctl is None else ctl
    match = ((F.col("well") == "INJE1") & (F.col("fluid") == "WATER") & (F.col("status") == "OPEN")
             & (F.col("mode") == "RATE"))
    j = _with_controls(_scen(scenarios, "spe9"), ctl, match, F.col("hits") == 1, "injector rate")
    return j.select(*RUN_KEY, "record_no", "well", F.col("rate").alias("base_rate"),
                    F.when(match, _round(F.col("qwinj_rate"), 2)).otherwise(F.col("rate")).alias("rate"), "hits")


def apply_producer_cap(scenarios: DataFrame, ctl: DataFrame | None = None) -> DataFrame:
    """Producer ORAT caps: 1500 -> qo_rate_high, 100 -> qo_rate_low (2 dp), others
    kept; exactly 3 matching records."""
    ctl = control_table(scenarios.sparkSession, "producer") if ctl is None else ctl
    match = (F.col("well_pattern") == "PRODU*") & (F.col("status") == "OPEN") & (F.col("mode") == "ORAT")
    j = _with_controls(with_dependent_levers(_scen(scenarios, "spe9")), ctl, match, F.col("hits") == 3, "producer caps")
    base = F.col("rate")
    new = (F.when(match & (base == 1500.0), _round(F.col("qo_rate_high"), 2))
           .when(match & (base == 100.0), _round(F.col("qo_rate_low"), 2)).otherwise(base))
    return j.select(*RUN_KEY, "record_no", base.alias("base_rate"), new.alias("rate"), "hits")


def apply_equil(scenarios: DataFrame, ctl: DataFrame | None = None) -> DataFrame:
    """Equilibration pressure: FIELD deck sets it to p_init (2 dp, exactly 1
    record); METRIC decks shift every record by p_init_shift_bar (4 dp; shift 0
    leaves the record as is, whatever the number of records; norne needs at
    least 1 record, volve exactly 12). The twelve records of the third field
    are illustrative: its main deck is not public."""
    ctl = control_table(scenarios.sparkSession, "equil") if ctl is None else ctl
    shift = F.coalesce(F.col("p_init_shift_bar"), F.lit(0.0))
    res, hits = F.col("reservoir_id"), F.col("hits")
    ok = F.when(res == "spe9", hits == 1).when(shift == 0, F.lit(True)).when(res == "volve", hits == 12).otherwise(hits >= 1)
    j = _with_controls(scenarios, ctl, F.lit(True), ok, "equilibration")
    new = (F.when(res == "spe9", _round(F.col("p_init"), 2))
           .when(shift == 0, F.col("pressure"))
           .otherwise(_round(F.col("pressure") + shift, 4)))
    return j.select(
        *RUN_KEY, "record_no", F.col("pressure").alias("base_pressure"), new.alias("pressure"), "hits")


def apply_multipliers(scenarios: DataFrame) -> DataFrame:
    """MULTIPLY records per scenario: PORO x phi_mult, PERMX/Y/Z x k_mult (5 dp)."""
    props = F.array(*[F.lit(p) for p in GRID_PROPERTIES])
    s = scenarios.select(*RUN_KEY, "k_mult", "phi_mult", F.explode(props).alias("prop"))
    mult = F.when(F.col("prop") == "PORO", F.col("phi_mult")).otherwise(F.col("k_mult"))
    return s.select(*RUN_KEY, "prop", _round(mult, 5).alias("multiplier"))


def apply_pvto_shift(scenarios: DataFrame, ctl: DataFrame | None = None) -> DataFrame:
    """PVTO records: bubble point + pb_shift on records of 4 numbers whose
    pressure is above the 14.7 psia anchor (written 3/2/4/4 dp); the anchor and
    the 3-number undersaturated record are untouched; shift 0 changes nothing."""
    ctl = control_table(scenarios.sparkSession, "pvto") if ctl is None else ctl
    j = _scen(scenarios, "spe9").join(ctl, "reservoir_id")
    shift = F.coalesce(F.col("pb_shift"), F.lit(0.0))
    nums = F.col("nums")
    n = [F.get(nums, i) for i in range(4)]
    target = (F.size(nums) == 4) & (n[1] > F.lit(PVT_ANCHOR_PSI)) & (shift != 0)
    shifted = F.array(_round(n[0], 3), _round(n[1] + shift, 2), _round(n[2], 4), _round(n[3], 4))
    return j.select(*RUN_KEY, "record_no", n[1].alias("base_pressure"),
                    F.when(target, shifted).otherwise(nums).alias("nums"),
                    "terminated", target.alias("shifted"))


def apply_group_rate(scenarios: DataFrame, ctl: DataFrame | None = None) -> DataFrame:
    """Group injection: the first FIELD/WAT/RATE record's rate x qwinj_group_mult
    (2 dp); there must be one; mult 1 changes nothing. The records of the third
    field are illustrative: its main deck is not public."""
    ctl = control_table(scenarios.sparkSession, "group_injection") if ctl is None else ctl
    match = (F.col("grp") == "FIELD") & (F.col("phase") == "WAT") & (F.col("mode") == "RATE")
    first = ctl.where(match).groupBy("reservoir_id").agg(F.min("record_no").alias("__first"))  # a row per reservoir
    ctl = ctl.join(F.broadcast(first), "reservoir_id", "left")
    target = F.coalesce(F.col("record_no") == F.col("__first"), F.lit(False))
    mult = F.col("qwinj_group_mult")
    j = _with_controls(_scen(scenarios, "volve"), F.broadcast(ctl), target, (F.col("hits") == 1) | (mult == 1.0), "group injection")
    new = F.when(target & (mult != 1.0), _round(F.col("rate") * mult, 2)).otherwise(F.col("rate"))
    return j.select(
        *RUN_KEY, "record_no", F.col("rate").alias("base_rate"), new.alias("rate"), "hits")


def apply_scenario(scenarios: DataFrame, controls: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """All rules of each run's reservoir, as one long table of changed values:
    (reservoir_id, sim_id, rule, record, base, value). ``controls``: control tables by name
    (see :mod:`records`), else the fixed ones."""
    controls = controls or {}
    def norm(df, rule, record, base, value):
        return df.select(*RUN_KEY, F.lit(rule).alias("rule"), F.col(record).cast("string").alias("record"),
                         F.col(base).cast("double").alias("base"), F.col(value).cast("double").alias("value"))
    parts = [
        norm(apply_injector_rate(scenarios, controls.get("injector")), "injector_rate", "record_no", "base_rate", "rate"),
        norm(apply_producer_cap(scenarios, controls.get("producer")), "producer_cap", "record_no", "base_rate", "rate"),
        norm(apply_equil(scenarios, controls.get("equil")), "equil_pressure", "record_no", "base_pressure", "pressure"),
        norm(apply_multipliers(scenarios).withColumn("one", F.lit(1.0)), "multiply", "prop", "one", "multiplier"),
        norm(apply_pvto_shift(scenarios, controls.get("pvto")).where(F.col("shifted")).withColumn("v", F.get(F.col("nums"), 1)),
             "pvto_bubble_point", "record_no", "base_pressure", "v"),
        norm(apply_group_rate(scenarios, controls.get("group_injection")), "group_rate", "record_no", "base_rate", "rate"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out

"""DuckDB SQL for the logical tables (used only by the correctness oracles).

Written independently of the Spark operators with plain SQL windows, so the
two engines check each other. Constants come from :mod:`ensemble.schemas`.
"""

from __future__ import annotations

from ..functions.units import UNIT_FACTORS, VECTOR_COLUMNS
from ..schemas import (ALL_LEVERS, BAR_TO_PSI, PVDG, PVT_ANCHOR_PSI, PVTO_SATURATED,
                       PVTO_UNDERSAT, RESERVOIR_ORDER, RESERVOIRS, SPE9_PB_MARGIN_PSI,
                       SUMMARY_KEYS, TRAJECTORY_COLUMNS)

SEED = 42
TWO_52 = float(2 ** 52)


def d(x: float) -> str:
    """A DOUBLE literal (bare decimals are DECIMAL in DuckDB)."""
    return f"CAST({float(x)!r} AS DOUBLE)"


def hu(seed: int, *exprs: str) -> str:
    parts = ", ".join([f"'{seed}'"] + [f"CAST({e} AS VARCHAR)" for e in exprs])
    return (f"(CAST(CAST(('0x' || substr(md5(concat_ws('|', {parts})), 1, 13)) AS BIGINT) AS DOUBLE)"
            f" / {d(TWO_52)})")


def reservoir_sql(sim: str) -> str:
    cases = " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(RESERVOIR_ORDER))
    return f"(CASE ((({sim}) % 3) + 3) % 3 {cases} END)"


def dim_values() -> str:
    rows = []
    for name in sorted(RESERVOIRS):
        c = RESERVOIRS[name]
        vals = [f"'{name}'", f"'{c['unit_system']}'", d(c["baseline_pb"]), d(c["baseline_porosity"]),
                d(c["baseline_perm_md"]), d(c["espesor_neto_m"]), d(c["area_m2"]), d(c["flow_timeout_s"])]
        for lv in ALL_LEVERS:
            r = c["levers"].get(lv)
            vals += [d(r[0]), d(r[1])] if r else ["CAST(NULL AS DOUBLE)", "CAST(NULL AS DOUBLE)"]
        rows.append("(" + ", ".join(vals) + ")")
    cols = ["reservoir_id", "unit_system", "baseline_pb", "baseline_porosity", "baseline_perm_md",
            "espesor_neto_m", "area_m2", "flow_timeout_s"] + [f"{lv}_{e}" for lv in ALL_LEVERS for e in ("lo", "hi")]
    return f"(SELECT * FROM (VALUES {', '.join(rows)}) t({', '.join(cols)}))"


def ranges_values() -> str:
    rows = [f"('{n}', '{lv}', {d(lo)}, {d(hi)})"
            for n, c in sorted(RESERVOIRS.items()) for lv, (lo, hi) in c["levers"].items()]
    return f"(SELECT * FROM (VALUES {', '.join(rows)}) t(reservoir_id, lever, lo, hi))"


def interp_sql(x: str, xs: list[str], ys: list[str]) -> str:
    parts = [f"WHEN {x} IS NULL THEN CAST(NULL AS DOUBLE)", f"WHEN {x} <= {xs[0]} THEN {ys[0]}"]
    for j in range(len(xs) - 1):
        slope = f"(({ys[j + 1]}) - ({ys[j]})) / (({xs[j + 1]}) - ({xs[j]}))"
        parts.append(f"WHEN {x} < {xs[j + 1]} THEN {slope} * ({x} - ({xs[j]})) + ({ys[j]})")
    return f"(CASE {' '.join(parts)} ELSE {ys[-1]} END)"


def grid_sql(shift: str) -> list[str]:
    return [d(r[1]) if not r[1] > PVT_ANCHOR_PSI else f"({d(r[1])} + {shift})" for r in PVTO_SATURATED]


def rs_sql(p: str, shift: str) -> str:
    top = f"({d(PVTO_SATURATED[-1][1])} + {shift})"
    return f"({interp_sql(f'least({p}, {top})', grid_sql(shift), [d(r[0]) for r in PVTO_SATURATED])} * {d(1000.0)})"


def bo_sql(p: str, shift: str) -> str:
    top = f"({d(PVTO_SATURATED[-1][1])} + {shift})"
    sat = interp_sql(f"least({p}, {top})", grid_sql(shift), [d(r[2]) for r in PVTO_SATURATED])
    pu, bu = PVTO_UNDERSAT
    last = d(PVTO_SATURATED[-1][2])
    slope = f"(({d(bu)} - {last}) / ({d(pu)} - {top}))"
    return f"(CASE WHEN ({p} > {top}) AND ({d(pu)} > {top}) THEN {last} + {slope} * ({p} - {top}) ELSE {sat} END)"


def bg_sql(p: str) -> str:
    return f"({interp_sql(p, [d(r[0]) for r in PVDG], [d(r[1]) for r in PVDG])} / {d(1000.0)})"


def to_field_sql(v: str, unit: str, key: str) -> str:
    m = UNIT_FACTORS["METRIC"].get(key, 1.0)
    f = UNIT_FACTORS["FIELD"].get(key, 1.0)
    out = v
    if m != 1.0:
        out = f"(CASE WHEN {unit} = 'METRIC' THEN {v} * {d(m)} ELSE {out} END)"
    if f != 1.0:
        out = f"(CASE WHEN {unit} = 'FIELD' THEN {v} * {d(f)} ELSE {out} END)"
    return out


def spe9_valid_sql(p_init: str, pb_shift: str) -> str:
    return f"({p_init} >= ({d(RESERVOIRS['spe9']['baseline_pb'])} + {pb_shift}) + {d(SPE9_PB_MARGIN_PSI)})"


def base_ctes(seed: int = SEED) -> str:
    """CTEs: dim, ranges, ev, runs, lhs_w (LHS levers), scen (after redraws),
    outcome, runs_c (classified), vec (raw vectors per step), feat (all rows),
    traj (converged rows)."""
    lv_pivot = ", ".join(f"max(CASE WHEN lever = '{lv}' THEN value END) AS {lv}" for lv in ALL_LEVERS)
    redraw = ", ".join(
        f"CASE WHEN dm.{lv}_lo IS NOT NULL THEN dm.{lv}_lo + "
        f"{hu(seed, 'l.reservoir_id', repr(lv), repr('redraw'), 'a.attempt', 'l.sim_id')} * (dm.{lv}_hi - dm.{lv}_lo) END AS {lv}"
        for lv in ALL_LEVERS)
    pick = ", ".join(f"CASE WHEN c.attempt = 0 THEN l.{lv} ELSE r.{lv} END AS {lv}" for lv in ALL_LEVERS)
    p = f"({d(6000.0)} - {d(12.5)} * value)"
    fpr_raw = f"(CASE WHEN unit_system = 'METRIC' THEN {p} / {d(BAR_TO_PSI)} ELSE {p} END)"
    raw = {"TIME": "tiempo_dias", "FPR": fpr_raw, "FOPR": "FOPR", "FGPR": "FGPR", "FWIR": "FWIR",
           "FOPT": "FOPT", "FGPT": "FGPT", "FWPT": "FWPT", "FWIT": "FWIT"}
    vec_cols = ", ".join(f"{to_field_sql(raw[k], 'unit_system', k)} AS {VECTOR_COLUMNS[k]}" for k in SUMMARY_KEYS)
    w = "PARTITION BY reservoir_id, sim_id ORDER BY tiempo_dias, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    pb = (f"CASE WHEN dm.unit_system = 'METRIC' THEN (dm.baseline_pb + coalesce(s.p_init_shift_bar, {d(0)})) * {d(BAR_TO_PSI)}"
          f" ELSE dm.baseline_pb + coalesce(s.pb_shift, {d(0)}) END")
    shift = f"CASE WHEN dm.unit_system = 'METRIC' THEN {d(0)} ELSE coalesce(s.pb_shift, {d(0)}) END"
    return f"""
dim AS {dim_values()},
ranges AS {ranges_values()},
ev AS (
  SELECT {reservoir_sql('user_id')} AS reservoir_id, user_id AS sim_id, event_id, event_type, value,
         date_diff('microsecond', TIMESTAMP '2024-01-01 00:00:00', CAST(ts AS TIMESTAMP)) / {d(86400e6)} AS tiempo_dias
  FROM events),
runs AS (SELECT DISTINCT reservoir_id, sim_id FROM ev),
nruns AS (SELECT reservoir_id, count(*) AS n FROM runs GROUP BY reservoir_id),
cells AS (
  SELECT r.reservoir_id, r.sim_id, g.lever, g.lo, g.hi,
         {hu(seed, 'r.reservoir_id', 'g.lever', repr('perm'), 'r.sim_id')} AS h,
         {hu(seed, 'r.reservoir_id', 'g.lever', repr('jitter'), 'r.sim_id')} AS jit
  FROM runs r JOIN ranges g ON r.reservoir_id = g.reservoir_id),
lhs_l AS (
  SELECT c.reservoir_id, c.sim_id, c.lever,
         c.lo + ((row_number() OVER (PARTITION BY c.reservoir_id, c.lever ORDER BY c.h, c.sim_id) - 1) + c.jit) / n.n * (c.hi - c.lo) AS value
  FROM cells c JOIN nruns n ON c.reservoir_id = n.reservoir_id),
lhs_w AS (SELECT reservoir_id, sim_id, {lv_pivot} FROM lhs_l GROUP BY reservoir_id, sim_id),
redraws AS (
  SELECT l.reservoir_id, l.sim_id, a.attempt, {redraw}
  FROM lhs_w l JOIN dim dm ON l.reservoir_id = dm.reservoir_id
  CROSS JOIN (SELECT CAST(range AS INTEGER) AS attempt FROM range(1, 51)) a
  WHERE l.reservoir_id = 'spe9' AND NOT {spe9_valid_sql('l.p_init', 'l.pb_shift')}),
chosen AS (
  SELECT l.reservoir_id, l.sim_id,
         CASE WHEN l.reservoir_id <> 'spe9' OR {spe9_valid_sql('l.p_init', 'l.pb_shift')} THEN 0
              ELSE coalesce((SELECT min(r.attempt) FROM redraws r WHERE r.reservoir_id = l.reservoir_id
                             AND r.sim_id = l.sim_id AND {spe9_valid_sql('r.p_init', 'r.pb_shift')}), 50) END AS attempt
  FROM lhs_w l),
scen AS (
  SELECT l.reservoir_id, l.sim_id, c.attempt, {pick}
  FROM lhs_w l JOIN chosen c ON l.reservoir_id = c.reservoir_id AND l.sim_id = c.sim_id
  LEFT JOIN redraws r ON r.reservoir_id = l.reservoir_id AND r.sim_id = l.sim_id AND r.attempt = c.attempt),
outcome AS (
  SELECT e.reservoir_id, e.sim_id,
         CASE WHEN (e.sim_id % 23) = 5 THEN CAST(NULL AS INTEGER) WHEN (e.sim_id % 11) = 0 THEN 1 ELSE 0 END AS exit_code,
         ((e.sim_id % 23) = 5) AS timed_out,
         CASE WHEN (e.sim_id % 29) = 7 THEN 'ValueError: summary vector FPR is empty' END AS exception,
         CASE WHEN (e.sim_id % 23) = 5 THEN dm.flow_timeout_s ELSE count(*) * {d(0.25)} END AS elapsed_s,
         dm.flow_timeout_s AS limit_s
  FROM ev e JOIN dim dm ON e.reservoir_id = dm.reservoir_id
  GROUP BY e.reservoir_id, e.sim_id, dm.flow_timeout_s),
runs_c AS (
  SELECT reservoir_id, sim_id, (err = '') AS ok, err AS error, elapsed_s AS runtime_s FROM (
    SELECT *, CASE WHEN timed_out THEN printf('timeout after %.0fs', limit_s)
                   WHEN coalesce(exit_code, 0) <> 0 THEN printf('exit %d', exit_code)
                   WHEN exception IS NOT NULL THEN exception ELSE '' END AS err
    FROM outcome) o),
stp AS (
  SELECT e.*, dm.unit_system,
         row_number() OVER (PARTITION BY e.reservoir_id, e.sim_id ORDER BY e.tiempo_dias, e.event_id) - 1 AS step,
         CASE WHEN event_type = 'view' THEN value ELSE {d(0)} END AS FOPR,
         CASE WHEN event_type = 'click' THEN value ELSE {d(0)} END AS FGPR,
         CASE WHEN event_type = 'purchase' THEN value ELSE {d(0)} END AS FWIR,
         CASE WHEN event_type = 'signup' THEN value ELSE {d(0)} END AS WPROD,
         CASE WHEN event_type = 'purchase' THEN value WHEN event_type = 'error' THEN value * {d(-0.01)}
              ELSE {d(0)} END AS WINJ
  FROM ev e JOIN dim dm ON e.reservoir_id = dm.reservoir_id),
cum AS (
  SELECT *, sum(FOPR) OVER ({w}) AS FOPT, sum(FGPR) OVER ({w}) AS FGPT,
         sum(WPROD) OVER ({w}) AS FWPT, sum(WINJ) OVER ({w}) AS FWIT
  FROM stp),
vec AS (SELECT reservoir_id, sim_id, step, unit_system, {vec_cols} FROM cum),
runf AS (
  SELECT s.reservoir_id, s.sim_id, dm.baseline_porosity * s.phi_mult AS Porosidad,
         dm.baseline_perm_md * s.k_mult AS Permeabilidad_mD, dm.espesor_neto_m AS Espesor_Neto_m,
         dm.area_m2 AS Area, {pb} AS Presion_Burbuja_psi, {shift} AS pvt_shift
  FROM scen s JOIN dim dm ON s.reservoir_id = dm.reservoir_id),
feat AS (
  SELECT v.sim_id, v.reservoir_id, v.tiempo_dias, f.Porosidad, f.Permeabilidad_mD, f.Espesor_Neto_m, f.Area,
         f.Presion_Burbuja_psi,
         {bo_sql('v.Presion_Reservorio_psi', 'f.pvt_shift')} AS Bo_rb_stb,
         {bg_sql('v.Presion_Reservorio_psi')} AS Bg_rb_scf,
         {rs_sql('v.Presion_Reservorio_psi', 'f.pvt_shift')} AS Rs_scf_stb,
         v.Caudal_Prod_Petroleo_bbl, v.Caudal_Prod_Gas_Mpc, v.Caudal_Iny_Agua_bbl, v.Prod_Acumulada_Petroleo,
         v.Prod_Acumulada_Gas, v.Prod_Acumulada_Agua, v.Iny_Acumulada_Agua, v.Presion_Reservorio_psi, v.step
  FROM vec v JOIN runf f ON v.reservoir_id = f.reservoir_id AND v.sim_id = f.sim_id),
traj AS (
  SELECT * FROM feat t WHERE EXISTS (
    SELECT 1 FROM runs_c r WHERE r.ok AND r.reservoir_id = t.reservoir_id AND r.sim_id = t.sim_id))
"""


TRAJ_COLS = TRAJECTORY_COLUMNS + ["step"]

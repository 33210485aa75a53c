"""DuckDB oracle SQL for each registered query (same column names and types)."""

from __future__ import annotations

from ..functions.units import VECTOR_COLUMNS
from ..schemas import (ALL_LEVERS, CORRELATION_COLUMNS, CUMULATIVE_COLUMNS, FEATURES, LEAKAGE_COLUMNS,
                       PVDG, PVT_ANCHOR_PSI, PVTO_SATURATED, SUMMARY_KEYS, TARGET, TRAJECTORY_COLUMNS,
                       ZERO_VARIANCE_COLUMNS)
from ..sources.dimensions import EQUIL_RECORDS, GRID_PROPERTIES, GROUP_INJECTION_RECORDS, PVTO_RECORDS
from .common import round_sql
from .oracle_base import base_ctes, bg_sql, bo_sql, d, hu, interp_sql, rs_sql

ORACLE: dict[str, str] = {}
LEVERS = " ".join(ALL_LEVERS)
TRAJ_DOUBLES = " ".join(TRAJECTORY_COLUMNS[2:])


def sql(name: str, body: str, doubles: str = "", ctes: str = "") -> None:
    """Register ``WITH <base ctes>[, ctes] <body>`` rounded on ``doubles``."""
    extra = f",\n{ctes}" if ctes else ""
    ORACLE[name] = round_sql(f"WITH {base_ctes()}{extra}\n{body}", doubles)


RUNLOG_CTE = f"""
env AS (SELECT reservoir_id, sim_id, min(Presion_Reservorio_psi) AS mn, max(Presion_Reservorio_psi) AS mx
        FROM traj GROUP BY reservoir_id, sim_id),
rlog AS (
  SELECT c.reservoir_id, c.sim_id, c.ok, coalesce(c.error, '') AS error, c.runtime_s,
         {", ".join(f"s.{lv}" for lv in ALL_LEVERS)},
         CASE WHEN c.ok THEN e.mn END AS fpr_min_psi, CASE WHEN c.ok THEN e.mx END AS fpr_max_psi,
         CASE WHEN c.ok THEN e.mx - e.mn END AS fpr_range_psi
  FROM runs_c c LEFT JOIN scen s ON c.reservoir_id = s.reservoir_id AND c.sim_id = s.sim_id
  LEFT JOIN env e ON c.reservoir_id = e.reservoir_id AND c.sim_id = e.sim_id)"""
RUNLOG_DOUBLES = f"runtime_s {LEVERS} fpr_min_psi fpr_max_psi fpr_range_psi"

sql("scan_trajectory", f"SELECT {', '.join(TRAJECTORY_COLUMNS)} FROM traj", TRAJ_DOUBLES)
sql("scan_run_log", "SELECT * FROM rlog", RUNLOG_DOUBLES, RUNLOG_CTE)
sql("run_log", "SELECT * FROM rlog", RUNLOG_DOUBLES, RUNLOG_CTE)

_raw = {"TIME": "tiempo_dias",
        "FPR": f"CASE WHEN unit_system = 'METRIC' THEN ({d(6000.0)} - {d(12.5)} * value) / {d(14.5037738)}"
               f" ELSE ({d(6000.0)} - {d(12.5)} * value) END",
        "FOPR": "FOPR", "FGPR": "FGPR", "FWIR": "FWIR", "FOPT": "FOPT", "FGPT": "FGPT",
        "FWPT": "FWPT", "FWIT": "FWIT"}
sql("pivot_summary_vectors",
    f"SELECT reservoir_id, sim_id, step, {', '.join(f'{_raw[k]} AS {k}' for k in SUMMARY_KEYS)} FROM cum",
    " ".join(SUMMARY_KEYS))

sql("reservoir_dim",
    "SELECT r.reservoir_id, r.sim_id, dm.unit_system, dm.baseline_pb, dm.baseline_porosity, dm.baseline_perm_md,"
    " dm.espesor_neto_m, dm.area_m2, dm.flow_timeout_s,"
    " CAST((SELECT count(*) FROM ranges g WHERE g.reservoir_id = r.reservoir_id) AS BIGINT) AS n_levers"
    " FROM runs r JOIN dim dm ON r.reservoir_id = dm.reservoir_id",
    "baseline_pb baseline_porosity baseline_perm_md espesor_neto_m area_m2 flow_timeout_s")

sql("normalize_units",
    f"SELECT reservoir_id, sim_id, step, {', '.join(VECTOR_COLUMNS[k] for k in SUMMARY_KEYS)} FROM vec",
    " ".join(VECTOR_COLUMNS[k] for k in SUMMARY_KEYS))

sql("bubble_point",
    "SELECT f.reservoir_id, f.sim_id, dm.unit_system, f.Presion_Burbuja_psi, f.pvt_shift"
    " FROM runf f JOIN dim dm ON f.reservoir_id = dm.reservoir_id",
    "Presion_Burbuja_psi pvt_shift")

sql("static_features",
    "SELECT reservoir_id, sim_id, Porosidad, Permeabilidad_mD, Espesor_Neto_m, Area FROM runf",
    "Porosidad Permeabilidad_mD Espesor_Neto_m Area")

sql("dependent_lever",
    f"SELECT reservoir_id, sim_id, qo_rate_high, qo_rate_high * {d(100.0 / 1500.0)} AS qo_rate_low"
    " FROM scen WHERE qo_rate_high IS NOT NULL",
    "qo_rate_high qo_rate_low")

sql("run_label",
    "SELECT reservoir_id, sim_id, printf('%s_sim_%04d', reservoir_id, sim_id) AS run_name,"
    " printf('sim_%04d', sim_id) AS title FROM runs")

sql("classify_outcome", "SELECT * FROM runs_c", "runtime_s")

sql("lhs_sample", f"SELECT reservoir_id, sim_id, {', '.join(ALL_LEVERS)} FROM lhs_w", LEVERS)
sql("lhs_rejection", "SELECT reservoir_id, sim_id, CAST(attempt AS BIGINT) AS attempt, "
    + ", ".join(ALL_LEVERS) + " FROM scen", LEVERS)

sql("feature_table", f"SELECT {', '.join(TRAJECTORY_COLUMNS)}, step FROM feat", TRAJ_DOUBLES)
sql("step_index", "SELECT reservoir_id, sim_id, tiempo_dias, step FROM traj", "tiempo_dias")

sql("pressure_envelope",
    "SELECT reservoir_id, sim_id, min(Presion_Reservorio_psi) AS fpr_min_psi,"
    " max(Presion_Reservorio_psi) AS fpr_max_psi,"
    " max(Presion_Reservorio_psi) - min(Presion_Reservorio_psi) AS fpr_range_psi"
    " FROM traj GROUP BY reservoir_id, sim_id",
    "fpr_min_psi fpr_max_psi fpr_range_psi")

sql("batch_summary",
    "SELECT reservoir_id, count(*) AS n_requested, CAST(count_if(ok) AS BIGINT) AS n_converged,"
    " count_if(ok) / count(*) AS converged_ratio, sum(runtime_s) AS total_runtime_s,"
    " avg(runtime_s) AS mean_runtime_s FROM rlog GROUP BY reservoir_id",
    "converged_ratio total_runtime_s mean_runtime_s", RUNLOG_CTE)

sql("union_runs",
    "SELECT reservoir_id, sim_id, step, tiempo_dias, Presion_Reservorio_psi FROM traj",
    "tiempo_dias Presion_Reservorio_psi")

sql("union_reservoirs", f"SELECT {', '.join(TRAJECTORY_COLUMNS)}, step FROM traj", TRAJ_DOUBLES)


# --- PVT and lookups -------------------------------------------------------------

TP = "tp AS (SELECT reservoir_id, sim_id, step, Presion_Reservorio_psi AS p FROM traj)"
TPS = TP + ",\ntps AS (SELECT t.*, f.pvt_shift FROM tp t JOIN runf f ON t.reservoir_id = f.reservoir_id AND t.sim_id = f.sim_id)"

_seg = " ".join(f"WHEN p < {d(r[0])} THEN {i - 1}" for i, r in enumerate(PVDG))
sql("pvt_segments",
    f"SELECT CAST(CASE WHEN p IS NULL THEN NULL {_seg} ELSE {len(PVDG) - 1} END AS BIGINT) AS seg,"
    " count(*) AS n_rows FROM tp GROUP BY 1", "", TP)

sql("interp_lookup",
    f"SELECT reservoir_id, sim_id, step, p, {interp_sql('p', [d(r[1]) for r in PVTO_SATURATED], [d(r[0]) for r in PVTO_SATURATED])} AS rs_mscf FROM tp",
    "p rs_mscf", TP)

_nodes = ", ".join(f"({i}, {d(r[1])})" for i, r in enumerate(PVTO_SATURATED))
sql("shifted_grid",
    f"SELECT f.reservoir_id, f.sim_id, CAST(g.node AS BIGINT) AS node,"
    f" CASE WHEN g.x > {d(PVT_ANCHOR_PSI)} THEN g.x + f.pvt_shift ELSE g.x END AS pressure"
    f" FROM runf f CROSS JOIN (VALUES {_nodes}) g(node, x)", "pressure")

sql("pvt_rs", f"SELECT reservoir_id, sim_id, step, p, {rs_sql('p', 'pvt_shift')} AS rs FROM tps", "p rs", TPS)
sql("pvt_bo", f"SELECT reservoir_id, sim_id, step, p, {bo_sql('p', 'pvt_shift')} AS bo FROM tps", "p bo", TPS)
sql("pvt_bg", f"SELECT reservoir_id, sim_id, step, p, {bg_sql('p')} AS bg FROM tp", "p bg", TP)

def _clamped(points: list[tuple[float, float]]) -> tuple[str, str]:
    """(value, segment) CASE chains of a clamped table lookup."""
    value, seg = f"CASE WHEN p <= {d(points[0][0])} THEN {d(points[0][1])}", "CASE"
    for j, ((x0, y0), (x1, y1)) in enumerate(zip(points, points[1:])):
        value += f" WHEN p < {d(x1)} THEN ({d(y1)} - {d(y0)}) / ({d(x1)} - {d(x0)}) * (p - {d(x0)}) + {d(y0)}"
        seg += f" WHEN p < {d(x1)} THEN {j}"
    return (f"{value} WHEN p >= {d(points[-1][0])} THEN {d(points[-1][1])} END",
            f"CAST({seg} WHEN p IS NOT NULL THEN {len(points) - 2} END AS BIGINT)")


_lookup = []
for _name, _points in (("pvdg_bg", [(r[0], r[1] / 1000.0) for r in PVDG]), ("pvto_bo", [(r[1], r[2]) for r in PVTO_SATURATED]),
                       ("pvto_rs", [(r[1], r[0] * 1000.0) for r in PVTO_SATURATED])):
    _v, _s = _clamped(_points)
    _lookup.append(f"SELECT reservoir_id, sim_id, step, '{_name}' AS table_id, p, {_s} AS seg, {_v} AS value FROM tp WHERE p IS NOT NULL")
sql("interp_join", " UNION ALL ".join(_lookup), "p value", TP)

sql("weighted_statics",
    "SELECT p_brand AS grp, sum(CAST(p_size AS DOUBLE) * p_retailprice) / sum(CAST(p_size AS DOUBLE)) AS weighted_mean,"
    " sum(CAST(p_size AS DOUBLE)) AS total_weight FROM part GROUP BY p_brand", "weighted_mean total_weight")

# --- scenario rules ----------------------------------------------------------------
INJ = ("inj AS (SELECT s.reservoir_id, s.sim_id, CAST(1 AS BIGINT) AS record_no, 'INJE1' AS well,"
       f" {d(5000.0)} AS base_rate, CAST(printf('%.2f', s.qwinj_rate) AS DOUBLE) AS rate, CAST(1 AS BIGINT) AS hits"
       " FROM scen s WHERE s.reservoir_id = 'spe9')")
sql("apply_injector_rate", "SELECT * FROM inj", "base_rate rate", INJ)

_prod = ", ".join(f"({n}, {d(r)})" for n, r in [(1, 1500.0), (2, 100.0), (3, 1500.0)])
PROD = ("prod AS (SELECT s.reservoir_id, s.sim_id, CAST(c.record_no AS BIGINT) AS record_no, c.rate AS base_rate,"
        f" CASE WHEN c.rate = {d(1500.0)} THEN CAST(printf('%.2f', s.qo_rate_high) AS DOUBLE)"
        f" WHEN c.rate = {d(100.0)} THEN CAST(printf('%.2f', s.qo_rate_high * {d(100.0 / 1500.0)}) AS DOUBLE) ELSE c.rate END AS rate,"
        " CAST(3 AS BIGINT) AS hits"
        f" FROM scen s CROSS JOIN (VALUES {_prod}) c(record_no, rate) WHERE s.reservoir_id = 'spe9')")
sql("apply_producer_cap", "SELECT * FROM prod", "base_rate rate", PROD)

_eq = ", ".join(f"('{r[0]}', {r[1]}, {d(r[3])})" for r in EQUIL_RECORDS)
EQ = ("eq AS (SELECT s.reservoir_id, s.sim_id, CAST(c.record_no AS BIGINT) AS record_no, c.pressure AS base_pressure,"
      " CASE WHEN s.reservoir_id = 'spe9' THEN CAST(printf('%.2f', s.p_init) AS DOUBLE)"
      f" WHEN coalesce(s.p_init_shift_bar, {d(0)}) = {d(0)} THEN c.pressure"
      f" ELSE CAST(printf('%.4f', c.pressure + coalesce(s.p_init_shift_bar, {d(0)})) AS DOUBLE) END AS pressure,"
      " count(*) OVER (PARTITION BY s.reservoir_id, s.sim_id) AS hits"
      f" FROM scen s JOIN (VALUES {_eq}) c(reservoir_id, record_no, pressure) ON s.reservoir_id = c.reservoir_id)")
sql("apply_equil", "SELECT * FROM eq", "base_pressure pressure", EQ)

_props = ", ".join(f"('{p}')" for p in GRID_PROPERTIES)
MUL = ("mul AS (SELECT s.reservoir_id, s.sim_id, g.prop,"
       " CAST(printf('%.5f', CASE WHEN g.prop = 'PORO' THEN s.phi_mult ELSE s.k_mult END) AS DOUBLE) AS multiplier"
       f" FROM scen s CROSS JOIN (VALUES {_props}) g(prop))")
sql("apply_multipliers", "SELECT * FROM mul", "multiplier", MUL)


def _num(v):
    return d(v) if v is not None else "CAST(NULL AS DOUBLE)"


_pv = ", ".join(
    f"({n}, {_num(nums[0])}, {_num(nums[1])}, {_num(nums[2])}, {_num(nums[3] if len(nums) > 3 else None)}, {len(nums)}, {str(t).upper()})"
    for n, nums, t in PVTO_RECORDS)
PV = ("pv0 AS (SELECT s.reservoir_id, s.sim_id, CAST(c.record_no AS BIGINT) AS record_no, c.n0, c.n1, c.n2, c.n3,"
      " CAST(c.n_nums AS BIGINT) AS n_nums, c.terminated, coalesce(s.pb_shift, CAST(0 AS DOUBLE)) AS sh,"
      f" (c.n_nums = 4 AND c.n1 > {d(PVT_ANCHOR_PSI)} AND coalesce(s.pb_shift, CAST(0 AS DOUBLE)) <> 0) AS shifted"
      f" FROM scen s CROSS JOIN (VALUES {_pv}) c(record_no, n0, n1, n2, n3, n_nums, terminated)"
      " WHERE s.reservoir_id = 'spe9'),\n"
      "pv AS (SELECT reservoir_id, sim_id, record_no, n1 AS base_pressure,"
      " CASE WHEN shifted THEN CAST(printf('%.3f', n0) AS DOUBLE) ELSE n0 END AS n0, CASE WHEN shifted THEN CAST(printf('%.2f', n1 + sh) AS DOUBLE) ELSE n1 END AS n1,"
      " CASE WHEN shifted THEN CAST(printf('%.4f', n2) AS DOUBLE) ELSE n2 END AS n2, CASE WHEN shifted THEN CAST(printf('%.4f', n3) AS DOUBLE) ELSE n3 END AS n3,"
      " n_nums, terminated, shifted FROM pv0)")
sql("apply_pvto_shift", "SELECT * FROM pv", "base_pressure n0 n1 n2 n3", PV)

_gi = ", ".join(f"({r[1]}, '{r[2]}', '{r[3]}', '{r[4]}', {d(r[5])})" for r in GROUP_INJECTION_RECORDS)
GI = ("gi AS (SELECT s.reservoir_id, s.sim_id, CAST(c.record_no AS BIGINT) AS record_no, c.rate AS base_rate,"
      f" CASE WHEN c.record_no = 1 AND s.qwinj_group_mult <> {d(1.0)} THEN CAST(printf('%.2f', c.rate * s.qwinj_group_mult) AS DOUBLE)"
      " ELSE c.rate END AS rate, CAST(1 AS BIGINT) AS hits"
      f" FROM scen s CROSS JOIN (VALUES {_gi}) c(record_no, grp, phase, mode, rate) WHERE s.reservoir_id = 'volve')")
sql("apply_group_rate", "SELECT * FROM gi", "base_rate rate", GI)

sql("apply_scenario",
    "SELECT reservoir_id, sim_id, 'injector_rate' AS rule, CAST(record_no AS VARCHAR) AS record, base_rate AS base, rate AS value FROM inj"
    " UNION ALL SELECT reservoir_id, sim_id, 'producer_cap', CAST(record_no AS VARCHAR), base_rate, rate FROM prod"
    " UNION ALL SELECT reservoir_id, sim_id, 'equil_pressure', CAST(record_no AS VARCHAR), base_pressure, pressure FROM eq"
    f" UNION ALL SELECT reservoir_id, sim_id, 'multiply', prop, {d(1.0)}, multiplier FROM mul"
    " UNION ALL SELECT reservoir_id, sim_id, 'pvto_bubble_point', CAST(record_no AS VARCHAR), base_pressure, n1 FROM pv WHERE shifted"
    " UNION ALL SELECT reservoir_id, sim_id, 'group_rate', CAST(record_no AS VARCHAR), base_rate, rate FROM gi",
    "base value", ",\n".join([INJ, PROD, EQ, MUL, PV, GI]))
ORACLE["apply_scenario_files"] = ORACLE["apply_scenario"]

sql("scan_csv_checked",
    "SELECT r > 3 AS accepted, CASE WHEN r > 3 THEN sim_id || ',' || step WHEN r = 0 THEN sim_id || ',' || step || ',high' WHEN r = 1 THEN sim_id || ',' || step"
    " WHEN r = 2 THEN sim_id || ',' || step || ',1.5,2' ELSE ',' || step || ',1.5' END AS record,"
    f" CASE WHEN r > 3 THEN Presion_Reservorio_psi ELSE {d(0)} END AS pressure"
    " FROM (SELECT *, (((sim_id * 31 + step) % 97) + 97) % 97 AS r FROM traj)", "pressure")
sql("summary_by_step",
    "SELECT reservoir_id, step, count(*) AS n, min(Presion_Reservorio_psi) AS lo, max(Presion_Reservorio_psi) AS hi,"
    " true AS median_within, true AS runs_within FROM traj GROUP BY reservoir_id, step", "lo hi")
# the as-of joins give what the plain lookups give
ORACLE["interp_asof"] = ORACLE["interp_join"]
ORACLE["interp_asof_runs"] = ORACLE["pvt_rs"]

# --- stores ------------------------------------------------------------------------
sql("ordered_store",
    "SELECT reservoir_id, sim_id, step, row_number() OVER (ORDER BY reservoir_id, sim_id, step) - 1 AS position, true AS rising FROM traj", "")
sql("batch_store",
    "SELECT reservoir_id, sim_id, step, Presion_Reservorio_psi, CASE WHEN sim_id % 2 = 0 THEN 'even' ELSE 'odd' END AS batch FROM traj",
    "Presion_Reservorio_psi")

# --- text --------------------------------------------------------------------------
SEC = rf"""
cl AS (
  SELECT conv_id, turn, role, string_split_regex(regexp_replace(text, '(\r\n|\r|\n)\z', ''), '\r\n|\r|\n') AS parts
  FROM conversations),
cl2 AS (SELECT conv_id, turn, role, unnest(parts) AS line, unnest(range(len(parts))) AS pos FROM cl),
ln AS (
  SELECT conv_id AS file, turn, CAST(pos AS BIGINT) AS pos, line,
         CASE WHEN role = 'user' AND pos = 0 THEN printf('TURN%d', turn) END AS header
  FROM cl2),
ln2 AS (
  SELECT *, sum(CASE WHEN header IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY turn, pos
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sec_no,
         regexp_replace(line, '^\s+|\s+$', '', 'g') AS stripped
  FROM ln),
hd AS (SELECT file, sec_no, header AS section FROM ln2 WHERE header IS NOT NULL),
ct AS (
  SELECT l.file, l.turn, l.pos, h.section, l.stripped,
         regexp_replace(regexp_replace(l.stripped, '/+$', ''), '^\s+|\s+$', '', 'g') AS body
  FROM ln2 l LEFT JOIN hd h ON l.file = h.file AND l.sec_no = h.sec_no
  WHERE l.header IS NULL AND l.stripped <> '' AND NOT starts_with(l.stripped, '--')),
tk AS (
  SELECT *, CASE WHEN body = '' THEN CAST([] AS VARCHAR[]) ELSE string_split_regex(body, '\s+') END AS tokens FROM ct)"""
sql("section_scan",
    "SELECT file, turn, pos, section, CAST(len(tokens) AS BIGINT) AS n_tokens,"
    " CAST(len(list_filter(tokens, lambda t: TRY_CAST(t AS DOUBLE) IS NOT NULL)) AS BIGINT) AS n_numbers,"
    " ends_with(stripped, '/') AS terminated, array_to_string(tokens, ' ') AS tokens FROM tk", "", SEC)

KEYFILES = SEC.split("ln2 AS", 1)[0].rstrip().rstrip(",") + r""",
kl AS (SELECT file // 1000 AS bucket, file, turn, pos, line FROM ln
  UNION ALL SELECT conv_id // 1000, conv_id, turn, -1, upper(role) FROM conversations WHERE text IS NOT NULL),
kn AS (SELECT bucket, row_number() OVER (PARTITION BY bucket ORDER BY file, turn, pos) - 1 AS lineno,
         regexp_replace(line, '^\s+|\s+$', '', 'g') AS stripped FROM kl),
kh AS (SELECT *, CASE WHEN regexp_full_match(stripped, '[A-Z][A-Z0-9]*') THEN stripped END AS hdr FROM kn),
ks AS (SELECT *, last_value(hdr IGNORE NULLS) OVER (PARTITION BY bucket ORDER BY lineno ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM kh),
kb AS (SELECT *, regexp_replace(regexp_replace(stripped, '/+$', ''), '^\s+|\s+$', '', 'g') AS body FROM ks
  WHERE hdr IS NULL AND stripped <> '' AND NOT starts_with(stripped, '--')),
kt AS (SELECT *, CASE WHEN body = '' THEN CAST([] AS VARCHAR[]) ELSE string_split_regex(body, '\s+') END AS tokens FROM kb)"""
sql("section_scan_files",
    "SELECT bucket AS file, lineno, section, CAST(len(tokens) AS BIGINT) AS n_tokens,"
    " CAST(len(list_filter(tokens, lambda t: TRY_CAST(t AS DOUBLE) IS NOT NULL)) AS BIGINT) AS n_numbers,"
    " ends_with(stripped, '/') AS terminated, array_to_string(tokens, ' ') AS tokens FROM kt", "", KEYFILES)

TAIL = r"""
dl AS (SELECT doc_id, text, string_split_regex(regexp_replace(text, '(\r\n|\r|\n)\z', ''), '\r\n|\r|\n') AS parts
       FROM documents)"""
sql("tail_lines",
    "SELECT doc_id, CAST(CASE WHEN text = '' THEN 0 ELSE len(parts) END AS BIGINT) AS n_lines,"
    " CASE WHEN text = '' THEN '' ELSE array_to_string(list_slice(parts, greatest(len(parts) - 299, 1), len(parts)), chr(10)) END AS tail"
    " FROM dl", "", TAIL)

_tail = ("CASE WHEN coalesce(text, '') = '' THEN '' ELSE array_to_string(list_slice(parts, greatest(len(parts) - 299, 1), len(parts)), chr(10)) END")
sql("failure_logs",
    f"SELECT c.reservoir_id, c.sim_id, '=== STDOUT (tail) ===' || chr(10) || {_tail} || chr(10) || chr(10)"
    " || '=== STDERR (tail) ===' || chr(10) || 'last event ' || last.event_id || ': ' || last.event_type || chr(10) || c.error || chr(10) AS log"
    " FROM runs_c c JOIN (SELECT user_id, max(struct_pack(ts := ts, event_id := event_id, event_type := event_type)) AS last"
    " FROM events GROUP BY user_id) e ON e.user_id = c.sim_id LEFT JOIN dl ON dl.doc_id = c.sim_id WHERE NOT c.ok", "", TAIL)

# --- quality -------------------------------------------------------------------------
_cum_w = ", ".join(f"{c} - lag({c}) OVER (PARTITION BY reservoir_id, sim_id ORDER BY step) AS d_{c}"
                   for c in CUMULATIVE_COLUMNS)
_nulls = " + ".join(["count_if(reservoir_id IS NULL)"] +
                    [f"count_if({c} IS NULL OR isnan({c}))" for c in TRAJECTORY_COLUMNS[2:]])
VAL = f"""
dl1 AS (SELECT reservoir_id, sim_id, step, {_cum_w} FROM traj),
wst AS (SELECT {", ".join(f"min(d_{c}) AS w_{c}" for c in CUMULATIVE_COLUMNS)} FROM dl1),
st AS (SELECT count(*) AS n_rows, {_nulls} AS null_cells,
              count(DISTINCT (reservoir_id, sim_id)) AS n_sims,
              max(Presion_Reservorio_psi) - min(Presion_Reservorio_psi) AS p_range FROM traj),
rq AS (SELECT count(*) AS n_requested FROM runs),
one AS (SELECT * FROM st, wst, rq),
fi AS (
  SELECT 'empty' AS "check", CAST(NULL AS VARCHAR) AS "column", n_rows > 0 AS passed, CAST(n_rows AS DOUBLE) AS observed,
         CAST(NULL AS DOUBLE) AS threshold, CASE WHEN n_rows = 0 THEN 'no rows: not one run was kept' ELSE '' END AS message, n_rows FROM one
  UNION ALL SELECT 'null_values', NULL, null_cells = 0, CAST(null_cells AS DOUBLE), {d(0)},
         CASE WHEN null_cells > 0 THEN printf('%d cells without a value', null_cells) ELSE '' END, n_rows FROM one
  UNION ALL SELECT 'converged', NULL, n_sims >= floor(n_requested * {d(0.8)}), CAST(n_sims AS DOUBLE), NULL,
         printf('runs kept: %d of %d', n_sims, n_requested), n_rows FROM one
  {" ".join(f"UNION ALL SELECT 'monotonic', '{c}', (w_{c} IS NULL OR w_{c} >= {d(-1.0)}), w_{c}, {d(-1.0)}, CASE WHEN (w_{c} IS NULL OR w_{c} >= {d(-1.0)}) THEN '' ELSE 'a run''s {c} goes down' END, n_rows FROM one" for c in CUMULATIVE_COLUMNS)}
  UNION ALL SELECT 'pressure_range', '{TARGET}', coalesce(p_range >= {d(100.0)}, false), p_range, {d(100.0)},
         printf('all pressures lie within %.0f psi', CAST(floor(p_range + 0.5) AS DOUBLE)), n_rows FROM one)"""
sql("validate_dataset",
    "SELECT \"check\", \"column\", passed, observed, threshold, message FROM fi WHERE n_rows > 0 OR \"check\" = 'empty'",
    "observed threshold", VAL)

# a stored dataset has no step: its rows are ordered by time, rows of equal time by their cumulatives
_stored_order = "tiempo_dias NULLS FIRST, " + ", ".join(f"{c} NULLS FIRST" for c in CUMULATIVE_COLUMNS)
sql("validate_stored",
    "SELECT \"check\", \"column\", passed, observed, threshold, message FROM fi WHERE n_rows > 0 OR \"check\" = 'empty'",
    "observed threshold", VAL.replace("ORDER BY step", f"ORDER BY {_stored_order}").replace("sim_id, step, ", "sim_id, "))

MONO = (f"dl1 AS (SELECT reservoir_id, sim_id, step, {_cum_w} FROM traj)")
sql("monotonic_violations",
    "SELECT * FROM (" + " UNION ALL ".join(
        f"SELECT reservoir_id, sim_id, step, '{c}' AS \"column\", d_{c} AS delta FROM dl1" for c in CUMULATIVE_COLUMNS)
    + f") v WHERE delta < {d(-1.0)}", "delta", MONO)

sql("variance_audit",
    "SELECT reservoir_id, \"column\", variance, CASE WHEN \"column\" IN ("
    + ", ".join(f"'{c}'" for c in LEAKAGE_COLUMNS)
    + ") THEN 'leakage: computed from the target pressure' ELSE 'no variance inside a reservoir' END AS reason,"
    " coalesce(variance = 0, false) AS zero_variance FROM (" + " UNION ALL ".join(
        f"SELECT reservoir_id, '{c}' AS \"column\", CASE WHEN min({c}) = max({c}) AND var_samp({c}) IS NOT NULL"
        f" THEN CAST(0 AS DOUBLE) ELSE var_samp({c}) END AS variance FROM traj GROUP BY reservoir_id"
        for c in LEAKAGE_COLUMNS + ZERO_VARIANCE_COLUMNS) + ") v", "variance")


def _long(src: str, cols, ids: str = "", name: str = "feature", value: str = "x") -> str:
    pre = f"{ids}, " if ids else ""
    return " UNION ALL ".join(f"SELECT {pre}'{c}' AS \"{name}\", CAST({c} AS DOUBLE) AS {value} FROM {src}" for c in cols)


DRIFT = f"""
la AS ({_long("traj WHERE reservoir_id = 'spe9'", FEATURES)}),
lb AS ({_long("traj WHERE reservoir_id = 'norne'", FEATURES)}),
ra AS (SELECT feature, min(x) AS min_a, max(x) AS max_a FROM la GROUP BY feature)"""
sql("drift_report",
    "SELECT b.feature, min(a.min_a) AS min_a, min(a.max_a) AS max_a, min(b.x) AS min_b, max(b.x) AS max_b,"
    " (min(b.x) < min(a.min_a) OR max(b.x) > min(a.max_a)) AS out_of_range,"
    " avg(CAST((b.x < a.min_a OR b.x > a.max_a) AS DOUBLE)) AS share_out"
    " FROM lb b JOIN ra a ON a.feature = b.feature GROUP BY b.feature",
    "min_a max_a min_b max_b share_out", DRIFT)

# --- exploration ---------------------------------------------------------------------
_med_cols = [TARGET] + CUMULATIVE_COLUMNS
sql("median_by_step",
    "SELECT reservoir_id, step, " + ", ".join(f"quantile_cont({c}, 0.5) AS {c}" for c in _med_cols)
    + " FROM traj GROUP BY reservoir_id, step", " ".join(_med_cols))

_desc_cols = [c for c in TRAJECTORY_COLUMNS if c != "reservoir_id"]
DESC = f"dsl AS ({_long('traj', _desc_cols, name='column', value='value')})"
sql("describe_columns",
    "SELECT \"column\", count(value) AS count, avg(value) AS mean, CASE WHEN min(value) = max(value) AND stddev_samp(value) IS NOT NULL THEN CAST(0 AS DOUBLE)"
    " ELSE stddev_samp(value) END AS std, min(value) AS min,"
    " quantile_cont(value, 0.25) AS p25, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.75) AS p75,"
    " max(value) AS max FROM dsl WHERE value IS NOT NULL GROUP BY \"column\"",
    "mean std min p25 p50 p75 max", DESC)


def hist_sql(src: str, group: list[str], x: str, bins: int, density: bool = False) -> tuple[str, str]:
    g = ", ".join(group)
    gsel = ", ".join(f"r.{c}" for c in group)
    on = " AND ".join(f"v.{c} = r.{c}" for c in group)
    on2 = " AND ".join(f"f.{c} = b.{c}" for c in group)
    ctes = f"""
hv AS (SELECT * FROM ({src}) s WHERE {x} IS NOT NULL AND NOT isnan({x})),
hr0 AS (SELECT {g}, min({x}) AS mn, max({x}) AS mx, count(*) AS n FROM hv GROUP BY {g}),
hr AS (SELECT {g}, n, CASE WHEN mn = mx THEN mn - {d(0.5)} ELSE mn END AS lo,
              CASE WHEN mn = mx THEN mx + {d(0.5)} ELSE mx END AS hi FROM hr0),
hi0 AS (SELECT v.{x} AS x, {gsel}, r.lo, r.hi, (r.hi - r.lo) / {d(bins)} AS w,
               CAST(least(floor((v.{x} - r.lo) * ({d(bins)} / (r.hi - r.lo))), {bins - 1}) AS BIGINT) AS i0
        FROM hv v JOIN hr r ON {on}),
hi1 AS (SELECT *, CASE WHEN x < (CASE WHEN i0 >= {bins} THEN hi ELSE i0 * w + lo END) THEN i0 - 1 ELSE i0 END AS i1
        FROM hi0),
hb AS (SELECT {g}, CASE WHEN x >= (CASE WHEN i1 + 1 >= {bins} THEN hi ELSE (i1 + 1) * w + lo END)
                             AND i1 <> {bins - 1} THEN i1 + 1 ELSE i1 END AS bin,
              count(*) AS cnt FROM hi1 GROUP BY ALL),
hf AS (SELECT r.*, CAST(b.range AS BIGINT) AS bin, (r.hi - r.lo) / {d(bins)} AS w FROM hr r CROSS JOIN range({bins}) b)"""
    dens = ", CAST(coalesce(b.cnt, 0) AS DOUBLE) / (f.n * f.w) AS density" if density else ""
    body = (f"SELECT {', '.join('f.' + c for c in group)}, f.bin, f.lo + f.bin * f.w AS lo,"
            f" CASE WHEN f.bin = {bins - 1} THEN f.hi ELSE f.lo + (f.bin + 1) * f.w END AS hi,"
            f" CAST(coalesce(b.cnt, 0) AS BIGINT) AS count{dens}"
            f" FROM hf f LEFT JOIN hb b ON {on2} AND f.bin = b.bin")
    return ctes, body


_c, _b = hist_sql(f"SELECT reservoir_id, {TARGET} FROM traj", ["reservoir_id"], TARGET, 40)
sql("histogram", _b, "lo hi", _c.strip())

_c, _b = hist_sql(_long("traj WHERE reservoir_id IN ('spe9', 'norne')", FEATURES, ids="reservoir_id"),
                  ["reservoir_id", "feature"], "x", 40, density=True)
sql("drift_histogram", _b, "lo hi density", _c.strip())

_cc = CORRELATION_COLUMNS
_means = ", ".join(f"avg({c}) AS m_{c}, min({c}) < max({c}) AS v_{c}" for c in _cc)
_cen = ", ".join(f"t.{c} - m.m_{c} AS {c}" for c in _cc) + ", " + ", ".join(f"m.v_{c}" for c in _cc)
_aggs, _pairs = [], []
for _i, _a in enumerate(_cc):
    for _j in range(_i, len(_cc)):
        _bb = _cc[_j]
        both = f"({_a} IS NOT NULL AND {_bb} IS NOT NULL)"
        k = f"{_i}_{_j}"
        _aggs += [f"sum(CASE WHEN {both} THEN {_a} * {_bb} END) AS sab_{k}",
                  f"sum(CASE WHEN {both} THEN {_a} * {_a} END) AS saa_{k}",
                  f"sum(CASE WHEN {both} THEN {_bb} * {_bb} END) AS sbb_{k}",
                  f"sum(CASE WHEN {both} THEN {_a} END) AS sa_{k}",
                  f"sum(CASE WHEN {both} THEN {_bb} END) AS sb_{k}",
                  f"count_if({both}) AS n_{k}"]
        _pairs.append((_a, _bb, k, _i, _j))
_aggs += [f"bool_and(v_{c}) AS var_{i}" for i, c in enumerate(_cc)]
CORR = (f"cm AS (SELECT {_means} FROM traj),\n"
        f"cc AS (SELECT {_cen} FROM traj t CROSS JOIN cm m),\n"
        f"cs AS (SELECT {', '.join(_aggs)} FROM cc)")
_rows = []
for _a, _bb, k, _i, _j in _pairs:
    cab = f"(sab_{k} - sa_{k} * sb_{k} / n_{k})"
    caa = f"(saa_{k} - sa_{k} * sa_{k} / n_{k})"
    cbb = f"(sbb_{k} - sb_{k} * sb_{k} / n_{k})"
    r = f"CASE WHEN n_{k} > 1 AND var_{_i} AND var_{_j} AND {caa} > 0 AND {cbb} > 0 THEN {cab} / sqrt({caa} * {cbb}) END"
    _rows.append(f"SELECT '{_a}' AS col_a, '{_bb}' AS col_b, {r} AS corr FROM cs")
    if _a != _bb:
        _rows.append(f"SELECT '{_bb}', '{_a}', {r} FROM cs")
sql("correlation_matrix", " UNION ALL ".join(_rows), "corr", CORR)

PRM = """
pm AS (SELECT reservoir_id, sim_id, min(Presion_Reservorio_psi) AS fpr_min FROM traj GROUP BY reservoir_id, sim_id),
pr AS (SELECT *, row_number() OVER (PARTITION BY reservoir_id ORDER BY fpr_min, sim_id) - 1 AS rk,
              count(*) OVER (PARTITION BY reservoir_id) AS n FROM pm),
pk AS (SELECT reservoir_id, sim_id, 'first' AS pick FROM pr WHERE rk = 0
       UNION ALL SELECT reservoir_id, sim_id, 'half' FROM pr WHERE rk = n // 2
       UNION ALL SELECT reservoir_id, sim_id, 'last' FROM pr WHERE rk = n - 1)"""
sql("rank_picks",
    "SELECT t.reservoir_id, t.sim_id, k.pick, t.step, t.Presion_Reservorio_psi, t.Caudal_Prod_Petroleo_bbl,"
    " t.Caudal_Iny_Agua_bbl, t.Prod_Acumulada_Petroleo, t.Iny_Acumulada_Agua"
    " FROM traj t JOIN pk k ON t.reservoir_id = k.reservoir_id AND t.sim_id = k.sim_id",
    f"{TARGET} Caudal_Prod_Petroleo_bbl Caudal_Iny_Agua_bbl Prod_Acumulada_Petroleo Iny_Acumulada_Agua", PRM)

SAMP = f"""
sd AS (SELECT DISTINCT reservoir_id, sim_id FROM traj),
sr AS (SELECT reservoir_id, sim_id, row_number() OVER (PARTITION BY reservoir_id
              ORDER BY {hu(0, 'reservoir_id', 'sim_id')}, sim_id) - 1 AS sample_rank FROM sd),
ss AS (SELECT * FROM sr WHERE sample_rank < 8)"""
sql("sample_sims", "SELECT * FROM ss", "", SAMP)
sql("pvt_curve",
    "SELECT t.reservoir_id, t.sim_id, t.step, t.Presion_Reservorio_psi, t.Bo_rb_stb, t.Bg_rb_scf, t.Rs_scf_stb,"
    " row_number() OVER (PARTITION BY t.reservoir_id, t.sim_id ORDER BY t.Presion_Reservorio_psi, t.step) - 1 AS curve_pos"
    " FROM traj t WHERE EXISTS (SELECT 1 FROM ss s WHERE s.reservoir_id = t.reservoir_id AND s.sim_id = t.sim_id)",
    f"{TARGET} Bo_rb_stb Bg_rb_scf Rs_scf_stb", SAMP)

LEVL = (RUNLOG_CTE + ",\nlvl AS (" + " UNION ALL ".join(
    f"SELECT reservoir_id, sim_id, '{lv}' AS lever, {lv} AS x, fpr_min_psi, fpr_max_psi FROM rlog WHERE ok AND {lv} IS NOT NULL"
    for lv in ALL_LEVERS) + ")")
sql("lever_sensitivity", "SELECT * FROM lvl", "x fpr_min_psi fpr_max_psi", LEVL)
_c, _b = hist_sql("SELECT * FROM lvl", ["reservoir_id", "lever"], "x", 20)
sql("lever_histogram", _b, "lo hi", LEVL.replace("WHERE ok AND ", "WHERE ") + "," + _c)

THIRDS = PRM[: PRM.index("pk AS")] + """pk AS (SELECT reservoir_id, sim_id, 'first' AS pick FROM pr WHERE rk = 0
       UNION ALL SELECT reservoir_id, sim_id, 'third' FROM pr WHERE rk = n // 3
       UNION ALL SELECT reservoir_id, sim_id, 'two_thirds' FROM pr WHERE rk = 2 * n // 3
       UNION ALL SELECT reservoir_id, sim_id, 'last' FROM pr WHERE rk = n - 1),
lagged AS (SELECT reservoir_id, sim_id, step, Presion_Reservorio_psi AS y,
                  lag(Presion_Reservorio_psi) OVER (PARTITION BY reservoir_id, sim_id ORDER BY step) AS y_pred FROM traj)"""
sql("rank_picks_thirds", "SELECT t.reservoir_id, t.sim_id, t.step, k.pick, t.y, t.y_pred"
    " FROM lagged t JOIN pk k ON t.reservoir_id = k.reservoir_id AND t.sim_id = k.sim_id", "y y_pred", THIRDS)
sql("trajectory_band", "SELECT reservoir_id, step, quantile_cont(Presion_Reservorio_psi, 0.05) AS p05,"
    " quantile_cont(Presion_Reservorio_psi, 0.5) AS p50, quantile_cont(Presion_Reservorio_psi, 0.95) AS p95"
    " FROM traj GROUP BY reservoir_id, step", "p05 p50 p95")

# --- splits ------------------------------------------------------------------------
GS = f"""
gd AS (SELECT DISTINCT reservoir_id, sim_id FROM traj),
gs AS (SELECT reservoir_id, sim_id, row_number() OVER (PARTITION BY reservoir_id
              ORDER BY {hu(42, 'reservoir_id', 'sim_id')}, sim_id) - 1 AS shuffle_rank FROM gd),
gsp AS (SELECT *, CASE WHEN shuffle_rank < 20 THEN 'test' WHEN shuffle_rank < 36 THEN 'val' ELSE 'train' END AS split FROM gs)"""
sql("group_split", "SELECT * FROM gsp", "", GS)
sql("rows_not_held_out", "SELECT t.reservoir_id, t.sim_id, t.step, t.Presion_Reservorio_psi FROM traj t"
    " WHERE NOT EXISTS (SELECT 1 FROM gsp g WHERE g.reservoir_id = t.reservoir_id AND g.sim_id = t.sim_id AND g.split = 'test')",
    TARGET, GS)
sql("split_sizes",
    "SELECT t.reservoir_id, g.split, count(*) AS n_rows, count(DISTINCT (t.reservoir_id, t.sim_id)) AS n_runs"
    " FROM traj t JOIN gsp g ON t.reservoir_id = g.reservoir_id AND t.sim_id = g.sim_id GROUP BY t.reservoir_id, g.split",
    "", GS)
sql("group_kfold",
    "SELECT reservoir_id, sim_id, n_rows, CAST(CASE WHEN r < 5 THEN r ELSE 9 - r END AS BIGINT) AS fold FROM ("
    " SELECT *, (row_number() OVER (PARTITION BY reservoir_id ORDER BY -n_rows, sim_id) - 1) % 10 AS r FROM ("
    " SELECT reservoir_id, sim_id, count(*) AS n_rows FROM traj GROUP BY reservoir_id, sim_id) a) b")

# --- prediction metrics ------------------------------------------------------------------
PRED = ("pred AS (SELECT l_returnflag AS reservoir_id, l_suppkey AS sim_id, l_orderkey, l_linenumber,"
        f" l_extendedprice AS y, {d(2000.0)} * l_quantity AS y_pred FROM lineitem)")


def _metrics_sql(src: str) -> str:
    return ("SELECT reservoir_id, count(*) AS n, avg(abs(y - y_pred)) AS mae, sqrt(avg((y - y_pred) * (y - y_pred))) AS rmse,"
            " CASE WHEN count(*) < 2 THEN NULL WHEN min(y) = max(y) OR var_pop(y) * count(*) = 0 THEN"
            " (CASE WHEN sum((y - y_pred) * (y - y_pred)) = 0 THEN 1.0 ELSE 0.0 END)"
            " ELSE 1.0 - sum((y - y_pred) * (y - y_pred)) / (var_pop(y) * count(*)) END AS r2,"
            f" CASE WHEN avg(y) = 0 THEN NULL ELSE avg(abs(y - y_pred)) / avg(y) END AS mae_over_mean FROM {src} GROUP BY reservoir_id")


sql("regression_metrics", _metrics_sql("pred"), "mae rmse r2 mae_over_mean", PRED)
BASE = PRED + f""",
pa AS (SELECT DISTINCT reservoir_id, sim_id FROM pred),
pas AS (SELECT *, CASE WHEN {hu(42, 'reservoir_id', 'sim_id')} < {d(0.2)} THEN 'test' ELSE 'train' END AS split FROM pa),
ptr AS (SELECT p.* FROM pred p JOIN pas s ON p.reservoir_id = s.reservoir_id AND p.sim_id = s.sim_id WHERE s.split = 'train'),
pte AS (SELECT p.* FROM pred p JOIN pas s ON p.reservoir_id = s.reservoir_id AND p.sim_id = s.sim_id WHERE s.split = 'test'),
pmed AS (SELECT reservoir_id, quantile_cont(y, 0.5) AS median_y FROM ptr GROUP BY reservoir_id),
pbl AS (SELECT t.reservoir_id, min(m.median_y) AS median_y, avg(abs(t.y - m.median_y)) AS baseline_mae
        FROM pte t JOIN pmed m ON t.reservoir_id = m.reservoir_id GROUP BY t.reservoir_id)"""
sql("median_baseline", "SELECT * FROM pbl", "median_y baseline_mae", BASE)


def _r(x: str, digits: int) -> str:
    s = d(float(10 ** digits))
    return f"(floor({x} * {s} + {d(0.5)}) / {s})"


sql("metrics_report",
    "SELECT m.reservoir_id, v.metric, v.value FROM tm m JOIN pbl b ON m.reservoir_id = b.reservoir_id,"
    " LATERAL (VALUES "
    f"('MAE', printf('%.2f psi', {_r('m.mae', 2)})), ('RMSE', printf('%.2f psi', {_r('m.rmse', 2)})),"
    f" ('R^2', printf('%.4f', {_r('m.r2', 4)})), ('MAE / mean(y)', printf('%.3f%%', {_r('m.mae_over_mean', 5)} * {d(100.0)})),"
    f" ('Baseline MAE (median)', printf('%.2f psi', {_r('b.baseline_mae', 2)}))) v(metric, value)",
    "", BASE + f",\ntm AS ({_metrics_sql('pte')})")

PSM = PRED + ",\npsm AS (SELECT reservoir_id, sim_id, count(*) AS n, avg(abs(y - y_pred)) AS mae," \
    " CASE WHEN count(*) < 2 THEN NULL WHEN min(y) = max(y) OR var_pop(y) * count(*) = 0 THEN" \
    " (CASE WHEN sum((y - y_pred) * (y - y_pred)) = 0 THEN 1.0 ELSE 0.0 END)" \
    " ELSE 1.0 - sum((y - y_pred) * (y - y_pred)) / (var_pop(y) * count(*)) END AS r2," \
    " min(y) AS y_min, max(y) AS y_max FROM pred GROUP BY reservoir_id, sim_id)"
sql("per_sim_metrics", "SELECT * FROM psm", "mae r2 y_min y_max", PSM)
sql("residual_stats",
    "SELECT reservoir_id, avg(y - y_pred) AS residual_mean, stddev_pop(y - y_pred) AS residual_std FROM pred GROUP BY reservoir_id",
    "residual_mean residual_std", PRED)
sql("best_worst_sims",
    "SELECT reservoir_id, CASE WHEN rank < 3 THEN 'best' ELSE 'worst' END AS kind, rank, sim_id, mae, r2 FROM ("
    " SELECT *, row_number() OVER (PARTITION BY reservoir_id ORDER BY mae, sim_id) - 1 AS rank,"
    " count(*) OVER (PARTITION BY reservoir_id) AS nn FROM psm) q WHERE rank < 3 OR rank >= nn - 3",
    "mae r2", PSM)
sql("pred_actual_bins",
    "SELECT p.reservoir_id,"
    f" CAST(CASE WHEN r.hi - r.lo > 0 THEN least(floor((p.y - r.lo) / (r.hi - r.lo) * {d(20)}), 19) ELSE 0 END AS BIGINT) AS bx,"
    f" CAST(CASE WHEN r.hi - r.lo > 0 THEN least(floor((p.y_pred - r.lo) / (r.hi - r.lo) * {d(20)}), 19) ELSE 0 END AS BIGINT) AS \"by\","
    " count(*) AS count FROM pred p JOIN (SELECT reservoir_id, least(min(y), min(y_pred)) AS lo,"
    " greatest(max(y), max(y_pred)) AS hi FROM pred GROUP BY reservoir_id) r ON p.reservoir_id = r.reservoir_id GROUP BY ALL",
    "", PRED)

# --- wells -----------------------------------------------------------------------------
WV = ("wv AS (SELECT 'run_' || l_linestatus AS run,"
      " concat_ws(':', ['WBHP', 'WBHPH', 'WOPR', 'WGPR', 'WWPR'][CAST(((l_partkey % 5) + 5) % 5 AS INTEGER) + 1],"
      " printf('W-%d', l_suppkey)) AS key_well,"
      " CAST(date_diff('day', TIMESTAMP '1992-01-01 00:00:00', CAST(l_shipdate AS TIMESTAMP)) AS DOUBLE) AS days,"
      " strftime(l_shipdate, '%Y-%m-%d') AS date, l_extendedprice AS value FROM lineitem),\n"
      "wk AS (SELECT *, split_part(key_well, ':', 1) AS vector, split_part(key_well, ':', 2) AS well FROM wv)")
sql("well_catalog",
    "SELECT well, count(DISTINCT run) AS n_runs FROM wk WHERE contains(key_well, 'WBHP') AND NOT contains(key_well, 'WBHPH')"
    " GROUP BY well", "", WV)
sql("key_catalog", "SELECT vector, count(DISTINCT well) AS n_wells FROM wk GROUP BY vector", "", WV)
_wvec = ["WBHP", "WOPR", "WGPR", "WWPR"]
sql("well_wide",
    "SELECT run, well, days, date, " + ", ".join(f"avg(CASE WHEN vector = '{v}' THEN value END) AS {v}" for v in _wvec)
    + f" FROM wk WHERE vector IN ({', '.join(repr(v) for v in _wvec)}) GROUP BY run, well, days, date",
    "days " + " ".join(_wvec), WV)
sql("run_comparison",
    "SELECT well, vector, days, avg(CASE WHEN run = 'run_O' THEN value END) AS \"run-O\","
    " avg(CASE WHEN run = 'run_F' THEN value END) AS \"run-F\""
    f" FROM wk WHERE vector IN ({', '.join(repr(v) for v in _wvec)}) GROUP BY well, vector, days",
    'days "run-O" "run-F"', WV)

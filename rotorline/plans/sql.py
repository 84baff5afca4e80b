"""SQL twins: common table expressions with their dependencies, assembled per query."""

from __future__ import annotations

from collections.abc import Sequence

CH = ["speed", "flow", "outlet_pressure", "motor_current", "de_bearing_temp"]
OUT = ["flow", "outlet_pressure", "de_bearing_temp"]
FIL = ["flow", "outlet_pressure", "motor_current", "de_bearing_temp"]
SEGW = "PARTITION BY pump_id, date ORDER BY ts"

CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, deps: Sequence[str], body: str) -> None:
    CTES[name] = (tuple(deps), body)


def with_(deps: Sequence[str], select: str, recursive: bool = False) -> str:
    """``select`` preceded by every CTE it needs, in dependency order."""
    order: list[str] = []

    def visit(name: str) -> None:
        for d in CTES[name][0]:
            visit(d)
        if name not in order:
            order.append(name)

    for d in deps:
        visit(d)
    head = "WITH RECURSIVE " if recursive else "WITH "
    body = ",\n".join(f"{n} AS ({CTES[n][1]})" for n in order)
    return f"{head}{body}\n{select}"


def r(expr: str, alias: str | None = None, digits: int = 6) -> str:
    """Rounded double without a negative zero."""
    x = f"round(CAST({expr} AS DOUBLE) * 1.0000000000001::DOUBLE, {digits})"
    return f"CASE WHEN {x} = 0 THEN CAST(0 AS DOUBLE) ELSE {x} END AS {alias or expr}"


def rs(names: Sequence[str], digits: int = 6) -> str:
    return ", ".join(r(n, n, digits) for n in names)


def i(expr: str, alias: str | None = None) -> str:
    return f"CAST({expr} AS BIGINT) AS {alias or expr}"


def ins(names: Sequence[str]) -> str:
    return ", ".join(i(n) for n in names)


def d(expr: str = "date", alias: str = "date") -> str:
    return f"strftime({expr}, '%Y-%m-%d') AS {alias}"


def t(expr: str = "ts", alias: str = "ts") -> str:
    return f"strftime({expr}, '%Y-%m-%d %H:%M:%S') AS {alias}"


def hash_order(columns: Sequence[str], seed: int = 42) -> str:
    parts = ", ".join(f"coalesce(CAST({c} AS VARCHAR), '')" for c in columns)
    return f"CAST('0x' || substr(md5(concat_ws('|', {parts}, '{seed}')), 1, 15) AS BIGINT)"


SEGS = f"{i('pump_id')}, {d()}"
STEPS = f"{SEGS}, {t()}"

# --- views -------------------------------------------------------------------
cte("raw", (), """
  SELECT event_id, CAST(user_id // 40 + 1 AS INTEGER) AS pump_id, user_id, CAST(ts AS DATE) AS date, ts,
         event_type AS sensor, value FROM events""")
cte("readings", ("raw",), """
  SELECT pump_id, CAST(b AS DATE) AS date, b AS ts,
         CASE WHEN s < 20 THEN 0.0 ELSE s * 20 END AS speed, flow, outlet_pressure, motor_current, de_bearing_temp
  FROM (SELECT pump_id, time_bucket(INTERVAL 3 HOUR, ts) AS b,
          round(avg(value) FILTER (WHERE sensor = 'click'), 6) AS s, round(avg(value) FILTER (WHERE sensor = 'view'), 6) AS flow,
          round(avg(value) FILTER (WHERE sensor = 'purchase'), 6) AS outlet_pressure,
          round(avg(value) FILTER (WHERE sensor = 'error'), 6) AS motor_current,
          round(avg(value) FILTER (WHERE sensor = 'signup'), 6) AS de_bearing_temp
        FROM raw GROUP BY 1, 2)""")
cte("machine", ("readings",), """
  SELECT *, motor_current * 0.5::DOUBLE AS inlet_pressure, de_bearing_temp / 10.0::DOUBLE AS filter_diff_pressure,
         flow AS total_fw_flow, outlet_pressure AS npsh_pressure, speed / 20.0::DOUBLE AS frequency,
         motor_current * 2.0::DOUBLE AS motor_u_winding_temp_1, de_bearing_temp * 2.0::DOUBLE AS motor_u_winding_temp_2,
         flow * 2.0::DOUBLE AS motor_u_winding_temp_3, flow / 100.0::DOUBLE AS de_vibration, outlet_pressure / 100.0::DOUBLE AS nde_vibration
  FROM readings""")
SEASON = """CASE WHEN month({0}) IN (12, 1, 2) THEN 'winter' WHEN month({0}) IN (3, 4, 5) THEN 'spring'
  WHEN month({0}) IN (6, 7, 8) THEN 'summer' ELSE 'autumn' END"""
LABEL = "CASE WHEN (day(date) + pump_id) % 3 = 0 THEN 'abnormal' ELSE 'normal' END"
cte("tagged", ("readings",), f"""
  SELECT *, {LABEL} AS label, {SEASON.format('date + to_months(CAST((pump_id % 4) * 3 AS INTEGER))')} AS season FROM readings""")

# --- quality -----------------------------------------------------------------
RULES = {
    "speed": (0, 4000, True, True), "outlet_pressure": (0, 60, True, True), "flow": (0, 120, False, True),
    "motor_current": (0, 100, False, True), "de_bearing_temp": (5, 100, True, False),
}
CONST = [c for c, x in RULES.items() if x[2]]
cte("sparse", ("readings",), "SELECT * FROM readings WHERE speed IS NOT NULL")
cte("filled_grid", ("sparse",), """
  SELECT g.pump_id, g.date, g.ts, x.pump_id IS NULL AS inserted, x.speed, x.flow, x.outlet_pressure, x.motor_current, x.de_bearing_temp
  FROM (SELECT pump_id, date, unnest(generate_series(a, b, INTERVAL 3 HOUR)) AS ts
        FROM (SELECT pump_id, date, min(ts) AS a, max(ts) AS b FROM sparse GROUP BY 1, 2)) g
  LEFT JOIN sparse x ON x.pump_id = g.pump_id AND x.ts = g.ts""")
cte("still", ("filled_grid",), "SELECT *, " + ", ".join(
    f"coalesce(abs({c} - lag({c}) OVER w) < 8.0, false) AS st_{c}" for c in CONST
) + f" FROM filled_grid WINDOW w AS ({SEGW})")
cte("breaks", ("still",), "SELECT *, " + ", ".join(
    f"sum(CASE WHEN st_{c} THEN 0 ELSE 1 END) OVER (w ROWS UNBOUNDED PRECEDING) AS br_{c}" for c in CONST
) + f" FROM still WINDOW w AS ({SEGW})")


def code_sql(frame: str, missing_all: bool = False) -> str:
    cols = []
    for n, (c, (lo, hi, const, fall)) in enumerate(RULES.items()):
        gap = 1 if n == 0 or missing_all else 2
        base = f"CASE WHEN inserted THEN {gap} WHEN {c} IS NULL THEN 2 ELSE 0 END"
        parts = [base, f"CASE WHEN {c} < {lo} OR {c} > {hi} THEN 3 ELSE 0 END"]
        if fall:
            parts.append(f"CASE WHEN count({c}) OVER ({frame}) >= 2 AND stddev_samp({c}) OVER ({frame}) / {float(hi - lo)} > 0.15 THEN 4 ELSE 0 END")
        if const:
            parts.append(f"CASE WHEN st_{c} AND count(*) FILTER (WHERE st_{c}) OVER (PARTITION BY pump_id, date, br_{c}) >= 2 THEN 5 ELSE 0 END")
        cols.append(f"CASE WHEN count({c}) OVER (PARTITION BY pump_id, date) > 0 THEN greatest({', '.join(parts)}) ELSE {base} END AS {c}_quality")
    return f"SELECT pump_id, date, ts, inserted, {', '.join(CH)}, {', '.join(cols)} FROM breaks"


cte("labelled", ("breaks",), code_sql(f"{SEGW} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW"))
cte("cleaned", ("labelled",), "SELECT pump_id, date, ts, inserted, " + ", ".join(
    f"CASE WHEN {c}_quality IN (3, 4, 5) THEN NULL ELSE {c} END AS {c}" for c in CH) + " FROM labelled")
cte("runs_on", ("cleaned",), f"""
  SELECT *, sum(CASE WHEN on_ THEN 0 ELSE 1 END) OVER ({SEGW} ROWS UNBOUNDED PRECEDING) AS br
  FROM (SELECT *, coalesce(speed >= 500, false) AS on_ FROM cleaned)""")
cte("operated", ("runs_on",), """
  SELECT * FROM (SELECT *, count(*) FILTER (WHERE on_) OVER (PARTITION BY pump_id, date, br) AS len FROM runs_on) WHERE on_ AND len >= 2""")
cte("seg_interval", ("readings",), f"""
  SELECT pump_id, date, CASE WHEN median(gap) > 0 THEN median(gap) ELSE 5.0 END AS interval_s
  FROM (SELECT pump_id, date, epoch(ts) - epoch(lag(ts) OVER ({SEGW})) AS gap FROM readings) GROUP BY 1, 2""")

# --- periods -----------------------------------------------------------------
cte("on_rows", ("machine",), f"""
  SELECT *, sum(CASE WHEN on_ THEN 0 ELSE 1 END) OVER ({SEGW} ROWS UNBOUNDED PRECEDING) AS br
  FROM (SELECT pump_id, date, ts, coalesce(speed > 500, false) AS on_, row_number() OVER ({SEGW}) AS rn FROM machine)""")
cte("blocks", ("on_rows", "seg_interval"), """
  SELECT b.*, interval_s FROM (SELECT pump_id, date, br, min(ts) AS s, max(ts) AS e, min(rn) AS a, max(rn) AS z
    FROM on_rows WHERE on_ GROUP BY 1, 2, 3) b JOIN seg_interval USING (pump_id, date)""")
cte("merged", ("blocks",), """
  SELECT *, sum(op) OVER (PARTITION BY pump_id, date ORDER BY s ROWS UNBOUNDED PRECEDING) AS m FROM (
    SELECT *, CASE WHEN epoch(s) - epoch(lag(e) OVER (PARTITION BY pump_id, date ORDER BY s)) - interval_s <= 10800 THEN 0 ELSE 1 END AS op FROM blocks)""")
cte("periods", ("merged",), """
  SELECT *, row_number() OVER (PARTITION BY pump_id, date ORDER BY s) AS period_id FROM (
    SELECT pump_id, date, m, min(s) AS s, max(e) AS e, max(z) - min(a) + 1 AS n_rows, max(interval_s) AS interval_s,
           epoch(max(e)) - epoch(min(s)) + max(interval_s) AS duration FROM merged GROUP BY 1, 2, 3)
  WHERE duration >= CASE WHEN interval_s >= 240 THEN greatest(900.0, interval_s * 3) ELSE 900.0 END""")
PER = "PARTITION BY pump_id, date, period_id"
cte("prow1", ("periods", "machine"), """
  SELECT x.*, p.period_id, p.s, p.e, p.duration, p.n_rows, p.interval_s,
    x.ts BETWEEN p.s AND p.e AS in_,
    x.ts BETWEEN p.s + INTERVAL 5400 SECOND AND p.e - INTERVAL 5400 SECOND AS cand,
    (epoch(p.e) - 5400) - (epoch(p.s) + 5400) >= 120 AS wide,
    coalesce(x.speed = 0, false) AS stopped, coalesce(x.speed, 0) = 0 AS quiet,
    CASE WHEN x.ts < p.s AND coalesce(x.speed, 0) > 500 THEN x.ts END AS was_on
  FROM machine x JOIN periods p ON x.pump_id = p.pump_id AND x.date = p.date AND x.ts <= p.e + INTERVAL 21600 SECOND""")
cte("prow2", ("prow1",), f"""
  SELECT *, sum(in_::INT) OVER ({PER} ORDER BY ts ROWS UNBOUNDED PRECEDING) - 1 AS pos, sum(in_::INT) OVER ({PER}) AS nin,
    max((in_ AND cand)::INT) OVER ({PER}) = 1 AS has_cand, max(was_on) OVER ({PER}) AS last_on FROM prow1""")
cte("prow", ("prow2",), """
  SELECT *, CASE WHEN wide AND has_cand THEN in_ AND cand
      ELSE in_ AND pos >= floor(nin * 0.25) AND pos < greatest(ceil(nin * 0.75), least(nin, floor(nin * 0.25) + 1)) END AS steady,
    stopped AND ts >= s - INTERVAL 21600 SECOND AND ts < s AS ob, stopped AND ts > e AS oa,
    quiet AND ts < s AND (last_on IS NULL OR ts >= last_on + INTERVAL 300 SECOND) AS ox, quiet AND ts > e AS oax FROM prow2""")
FCH = ["speed", "motor_current", "outlet_pressure", "de_bearing_temp", "motor_u_winding_temp_1", "motor_u_winding_temp_2",
       "motor_u_winding_temp_3", "flow", "filter_diff_pressure", "frequency", "total_fw_flow", "de_vibration", "nde_vibration",
       "npsh_pressure"]
WIND = ["motor_u_winding_temp_1", "motor_u_winding_temp_2", "motor_u_winding_temp_3"]
cte("feat", ("prow",), "SELECT pump_id, date, period_id, s, e, duration, n_rows, interval_s, sum(steady::INT) AS n_steady, " + ", ".join(
    f"avg({c}) FILTER (WHERE steady) AS mean_{c}, stddev_pop({c}) FILTER (WHERE steady) AS std_{c}, max({c}) FILTER (WHERE steady) AS max_{c}, count({c}) FILTER (WHERE steady) AS cnt_{c}"
    for c in FCH) + """,
    avg(motor_current / speed) FILTER (WHERE steady AND abs(speed) > 1e-6) AS mean_ratio,
    count(motor_current / speed) FILTER (WHERE steady AND abs(speed) > 1e-6) AS cnt_ratio,
    avg(flow / speed) FILTER (WHERE steady AND speed > 100) AS mean_fps, count(flow / speed) FILTER (WHERE steady AND speed > 100) AS cnt_fps,
    stddev_pop(outlet_pressure - inlet_pressure) FILTER (WHERE steady) AS std_head,
    count(outlet_pressure - inlet_pressure) FILTER (WHERE steady) AS cnt_head, """ + ", ".join(
    f"avg({c}) FILTER (WHERE steady AND {c} <= 200) AS wmean_{c}, count({c}) FILTER (WHERE steady AND {c} <= 200) AS wcnt_{c}" for c in WIND) + """,
    count(*) FILTER (WHERE ob) AS n_ob, count(*) FILTER (WHERE oa) AS n_oa, count(*) FILTER (WHERE ob OR oa) AS n_off,
    median(motor_current) FILTER (WHERE ob OR oa) AS med_off_cur, avg(outlet_pressure) FILTER (WHERE ob) AS ob_mean,
    avg(outlet_pressure) FILTER (WHERE oa) AS oa_mean, stddev_pop(outlet_pressure) FILTER (WHERE ob OR oa) AS off_std,
    count(*) FILTER (WHERE ox) AS n_ox, avg(outlet_pressure) FILTER (WHERE ox) AS ox_mean,
    count(*) FILTER (WHERE oax) AS n_oax, avg(outlet_pressure) FILTER (WHERE oax) AS oax_mean
  FROM prow GROUP BY ALL""")
cte("offs", ("machine", "periods"), """
  SELECT pump_id, date, avg(outlet_pressure) AS pressure_off, avg(motor_current) AS current_off FROM machine x
  WHERE speed = 0 AND EXISTS (SELECT 1 FROM periods p WHERE p.pump_id = x.pump_id AND p.date = x.date)
    AND NOT EXISTS (SELECT 1 FROM periods p WHERE p.pump_id = x.pump_id AND p.date = x.date
      AND x.ts BETWEEN p.s - INTERVAL 300 SECOND AND p.e + INTERVAL 300 SECOND) GROUP BY 1, 2""")
BCH = ["de_bearing_temp", "motor_current", *WIND, "flow", "outlet_pressure", "filter_diff_pressure", "frequency", "total_fw_flow"]
_obs = [
    ("speed", "mean_speed"), ("current", "mean_motor_current"),
    ("ratio", "CASE WHEN abs(mean_speed) > 1e-6 THEN mean_motor_current / mean_speed END"), ("pressure_on", "mean_outlet_pressure"),
    ("pressure_off_var", "CASE WHEN n_off >= 2 THEN off_std END"),
    ("response_fast", "CASE WHEN interval_s <= 30 AND n_ob >= 2 THEN mean_outlet_pressure - ob_mean END"),
    ("response_slow", "CASE WHEN interval_s > 30 AND n_ob >= 2 THEN mean_outlet_pressure - ob_mean END"),
]
for _c in BCH:
    _obs += [(f"mean:{_c}", f"mean_{_c}"), (f"var:{_c}", f"std_{_c}")]
for _c in ("de_vibration", "nde_vibration"):
    _obs += [(f"vib:{_c}", f"mean_{_c}"), (f"vib_max:{_c}", f"max_{_c}")]
cte("obs", ("feat", "offs"), " UNION ALL ".join(
    [f"SELECT pump_id, '{k}' AS k, CAST({x} AS DOUBLE) AS v FROM feat" for k, x in _obs]
    + [f"SELECT pump_id, '{k}' AS k, {k} AS v FROM offs" for k in ("pressure_off", "current_off")]))
cte("base", ("obs",), """
  SELECT pump_id, k, max(med) AS median, greatest(1.4826 * median(abs(v - med)), CASE WHEN k LIKE 'response%' THEN 0.5
      WHEN k LIKE 'mean:%' OR k LIKE 'var:%' THEN 0.01 WHEN k LIKE 'vib:%' THEN 0.005 ELSE 0.0 END) AS robust_std,
    quantile_cont(v, 0.25) AS q25, quantile_cont(v, 0.95) AS q95, count(*) AS n_obs
  FROM (SELECT *, median(v) OVER (PARTITION BY pump_id, k) AS med FROM obs WHERE v IS NOT NULL) GROUP BY 1, 2""")
BASE_KEYS = [k for k, _ in _obs] + ["pressure_off", "current_off"]


def bn(key: str) -> str:
    return key.replace(":", "_")


cte("base_wide", ("base",), "SELECT pump_id, " + ", ".join(
    f"max(median) FILTER (WHERE k = '{k}') AS m_{bn(k)}, max(robust_std) FILTER (WHERE k = '{k}') AS s_{bn(k)}, max(q95) FILTER (WHERE k = '{k}') AS q_{bn(k)}"
    for k in BASE_KEYS) + " FROM base GROUP BY 1")
cte("fb", ("feat", "base_wide"), "SELECT * FROM feat JOIN base_wide USING (pump_id)")

# --- level 1 -----------------------------------------------------------------
cte("lines", ("tagged",), "SELECT pump_id, " + ", ".join(
    f"regr_slope({c}, speed) AS k_{c}, regr_intercept({c}, speed) AS b_{c}" for c in OUT) + " FROM tagged GROUP BY 1")
cte("pred", ("tagged", "lines"), "SELECT t.*, " + ", ".join(f"k_{c} * speed + b_{c} AS pred_{c}" for c in OUT) + " FROM tagged t LEFT JOIN lines USING (pump_id)")
cte("res", ("pred",), "SELECT * FROM (SELECT *, " + ", ".join(f"{c} - pred_{c} AS res_{c}" for c in OUT)
    + " FROM pred) WHERE " + " AND ".join(f"res_{c} IS NOT NULL" for c in OUT))
cte("norm_res", ("res",), "SELECT * FROM res WHERE label = 'normal'")
cte("scoped", ("norm_res",), """
  SELECT 'all' AS scope_season, -1 AS scope_pump, * FROM norm_res UNION ALL SELECT 'all', pump_id, * FROM norm_res""")
cte("scoped4", ("norm_res", "scoped"), """
  SELECT * FROM scoped UNION ALL SELECT season, -1, * FROM norm_res UNION ALL SELECT season, pump_id, * FROM norm_res""")


def cov_sql(source: str) -> str:
    pairs = [(a, b) for n, a in enumerate(OUT) for b in OUT[n:]]
    covs = ", ".join(f"covar_samp(res_{a}, res_{b}) AS cov_{a}__{b}" for a, b in pairs)
    ms = ", ".join(f"avg(res_{c}) AS m_{c}, stddev_pop(res_{c}) AS s_{c}" for c in OUT)
    return f"SELECT scope_season, scope_pump, count(*) AS n, {ms}, {covs} FROM {source} GROUP BY 1, 2"


cte("cov", ("scoped",), cov_sql("scoped"))
cte("cov4", ("scoped4",), cov_sql("scoped4"))


def inverse_sql(source: str, ridge: str = "1e-6") -> str:
    """Closed-form inverse of the ridge-regularised 3x3 matrix."""
    x, y, z = OUT
    g = {}
    for n, p in enumerate(OUT):
        for q in OUT[n:]:
            g[p, q] = g[q, p] = f"(cov_{p}__{q}{' + ' + ridge if p == q else ''})"
    a, b, c, dd, e, f = g[x, x], g[x, y], g[x, z], g[y, y], g[y, z], g[z, z]
    det = f"({a}*({dd}*{f}-{e}*{e}) - {b}*({b}*{f}-{c}*{e}) + {c}*({b}*{e}-{c}*{dd}))"
    cells = {
        (x, x): f"({dd}*{f}-{e}*{e})/{det}", (x, y): f"({c}*{e}-{b}*{f})/{det}", (x, z): f"({b}*{e}-{c}*{dd})/{det}",
        (y, y): f"({a}*{f}-{c}*{c})/{det}", (y, z): f"({b}*{c}-{a}*{e})/{det}", (z, z): f"({a}*{dd}-{b}*{b})/{det}",
    }
    return "SELECT *, " + ", ".join(f"{v} AS i_{p}__{q}" for (p, q), v in cells.items()) + f" FROM {source}"


cte("inv", ("cov",), inverse_sql("cov"))
cte("inv4", ("cov4",), inverse_sql("cov4"))


def full_d2(prefix: str = "") -> str:
    terms = []
    for n, p in enumerate(OUT):
        for q in OUT[n:]:
            k = "" if p == q else "2*"
            terms.append(f"{k}(res_{p}-{prefix}m_{p})*{prefix}i_{p}__{q}*(res_{q}-{prefix}m_{q})")
    return " + ".join(terms)


def diag_d2(prefix: str = "") -> str:
    return " + ".join(f"(res_{c}-{prefix}m_{c})*(res_{c}-{prefix}m_{c})/greatest({prefix}s_{c}*{prefix}s_{c}, 1e-12)" for c in OUT)


def thr_sql(scoped: str, inv: str) -> str:
    return f"""SELECT scope_season, scope_pump, count(*) AS n, avg(dist) AS mean, stddev_pop(dist) AS std,
      quantile_cont(dist, 0.95) AS warning, quantile_cont(dist, 0.99) AS alarm FROM (
        SELECT scope_season, scope_pump, sqrt(greatest(0.0, {full_d2()})) AS dist
        FROM {scoped} JOIN {inv} USING (scope_season, scope_pump)) GROUP BY 1, 2"""


cte("own_thr", ("scoped", "inv"), thr_sql("scoped", "inv"))
cte("own_thr4", ("scoped4", "inv4"), thr_sql("scoped4", "inv4"))


def block_sql(thr: str, inv: str) -> str:
    """Blocks after fallback: g_ columns of the season's global block replace weak pump blocks."""
    own = ["mean", "std", "warning", "alarm"]
    vec = [f"{p}_{c}" for c in OUT for p in ("m", "s")]
    mats = [f"i_{p}__{q}" for n, p in enumerate(OUT) for q in OUT[n:]]
    cols = ", ".join(f"CASE WHEN weak THEN g.{c} ELSE o.{c} END AS {c}" for c in own + vec)
    return f"""SELECT o.scope_season, o.scope_pump, o.n, o.weak AS fallback, (o.scope_pump <> -1 AND NOT o.weak) AS diag, {cols},
      {', '.join(f'g.{m} AS {m}' for m in mats)}
      FROM (SELECT t.*, {', '.join(vec)}, (scope_pump <> -1 AND t.n < 30) AS weak FROM {thr} t JOIN {inv} v USING (scope_season, scope_pump)) o
      JOIN (SELECT t.*, {', '.join(vec + mats)} FROM {thr} t JOIN {inv} v USING (scope_season, scope_pump) WHERE scope_pump = -1) g
      ON o.scope_season = g.scope_season"""


cte("blocks1", ("own_thr", "inv"), block_sql("own_thr", "inv"))
cte("blocks4", ("own_thr4", "inv4"), block_sql("own_thr4", "inv4"))
DIST = f"sqrt(greatest(0.0, CASE WHEN diag THEN {diag_d2()} ELSE {full_d2()} END))"
# Per-pump blocks (no season): own block, global when the pump is missing or weak.
cte("l1_steps", ("res", "blocks1"), f"""
  SELECT *, CASE WHEN dist >= alarm THEN 'ALARM' WHEN dist >= warning THEN 'WARNING' ELSE 'NORMAL' END AS status
  FROM (SELECT x.*, b.mean, b.warning, greatest(b.alarm, b.warning) AS alarm, {', '.join(f'b.m_{c}, b.s_{c}' for c in OUT)}, {DIST} AS dist
    FROM res x JOIN (SELECT p.pump_id, k.* FROM (SELECT DISTINCT pump_id FROM res) p JOIN blocks1 k
      ON k.scope_pump = CASE WHEN EXISTS (SELECT 1 FROM blocks1 q WHERE q.scope_pump = p.pump_id AND NOT q.fallback) THEN p.pump_id ELSE -1 END) b
    ON x.pump_id = b.pump_id)""")
RANK = "CASE status WHEN 'ALARM' THEN 2 WHEN 'WARNING' THEN 1 ELSE 0 END"
cte("l1_days", ("l1_steps",), f"""
  SELECT *, CASE WHEN day_max >= alarm AND share_alarm >= 0.02 THEN 'ALARM' WHEN day_max >= warning THEN 'WARNING' ELSE 'NORMAL' END AS status,
    CASE WHEN alarm <= 0 THEN 0.0 ELSE least(2.0, greatest(0.0, day_max / alarm)) END AS severity
  FROM (SELECT pump_id, date, max(label) AS label, avg(dist) AS day_mean, max(dist) AS day_max, avg(({RANK} >= 1)::INT) AS share_warning,
    avg((status = 'ALARM')::INT) AS share_alarm, count(*) AS n_steps, max(warning) AS warning, max(alarm) AS alarm, max(mean) AS mean
    FROM l1_steps GROUP BY 1, 2)""")

# --- level 2 -----------------------------------------------------------------
cte("l2_means", ("tagged",), "SELECT " + ", ".join(f"avg({c}) AS a_{c}" for c in FIL) + " FROM tagged WHERE label = 'normal'")
cte("l2_ahead", ("tagged",), "SELECT pump_id, date, ts, label, season, speed, " + ", ".join(
    f"coalesce({c}, lag({c}) OVER w) AS {c}" for c in FIL) + f" FROM tagged WINDOW w AS ({SEGW})")
cte("l2_filled", ("l2_ahead", "l2_means"), "SELECT pump_id, date, ts, label, season, speed, " + ", ".join(
    f"coalesce({c}, lead({c}) OVER w, (SELECT a_{c} FROM l2_means)) AS {c}" for c in FIL) + f" FROM l2_ahead WINDOW w AS ({SEGW})")


def _sg(c: str) -> str:
    def term(weights: Sequence[int], offs: Sequence[int]) -> str:
        return "(" + " + ".join(
            f"{k}.0::DOUBLE*" + (c if o == 0 else (f"lead({c},{o}) OVER w" if o > 0 else f"lag({c},{-o}) OVER w")) for k, o in zip(weights, offs)
        ) + ")/35.0::DOUBLE"

    return (f"CASE WHEN rn = 1 THEN {term((31, 9, -3, -5, 3), (0, 1, 2, 3, 4))} WHEN rn = 2 THEN {term((9, 13, 12, 6, -5), (-1, 0, 1, 2, 3))} "
            f"WHEN rn = n - 1 THEN {term((9, 13, 12, 6, -5), (1, 0, -1, -2, -3))} WHEN rn = n THEN {term((31, 9, -3, -5, 3), (0, -1, -2, -3, -4))} "
            f"ELSE {term((-3, 12, 17, 12, -3), (-2, -1, 0, 1, 2))} END AS {c}")


cte("l2_placed", ("l2_filled",), f"SELECT *, row_number() OVER ({SEGW}) AS rn, count(*) OVER (PARTITION BY pump_id, date) AS n FROM l2_filled")
cte("l2_smooth", ("l2_placed",), "SELECT pump_id, date, ts, label, season, speed, rn, " + ", ".join(_sg(c) for c in FIL) + f" FROM (SELECT * FROM l2_placed WHERE n >= 5) WINDOW w AS ({SEGW})")
cte("l2_params", ("l2_smooth",), "SELECT " + ", ".join(
    f"avg({c}) AS p_m_{c}, stddev_pop({c}) AS p_s_{c}, min({c}) AS p_lo_{c}, max({c}) AS p_hi_{c}" for c in FIL) + " FROM l2_smooth WHERE label = 'normal'")
cte("l2_scaled", ("l2_smooth", "l2_params"), "SELECT pump_id, date, ts, label, season, speed, rn, " + ", ".join(
    f"CASE WHEN p_s_{c} = 0 THEN 0.0 ELSE ({c} - p_m_{c}) / p_s_{c} END AS {c}" for c in FIL) + " FROM l2_smooth, l2_params")
cte("l2_windows", ("l2_scaled",), f"""
  SELECT * FROM (SELECT pump_id, date, ts, label, season, rn, avg(({' + '.join(f'{c}*{c}' for c in FIL)}) / {len(FIL)}) OVER ({SEGW} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS error
  FROM l2_scaled) WHERE rn > 3""")
# EMA by folding the time-ordered list of the segment.
cte("l2_soft", ("l2_windows",), """
  SELECT pump_id, date, label, season, ts, error, list_reduce([e * 1.0::DOUBLE FOR e IN errs[1:k]], lambda a, x: 0.7::DOUBLE * a + 0.3::DOUBLE * x) AS smoothed
  FROM (SELECT *, row_number() OVER (PARTITION BY pump_id, date ORDER BY ts) AS k,
    list(error) OVER (PARTITION BY pump_id, date ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS errs FROM l2_windows)""")
cte("l2_norm", ("l2_soft",), "SELECT * FROM l2_soft WHERE label = 'normal'")
cte("l2_scoped", ("l2_norm",), "SELECT -1 AS scope_pump, * FROM l2_norm UNION ALL SELECT pump_id, * FROM l2_norm")
cte("l2_thr_all", ("l2_scoped",), """
  SELECT a.*, day_warning, day_alarm, n_days FROM (SELECT scope_pump, count(*) AS n, avg(error) AS mean, stddev_pop(error) AS std, quantile_cont(error, 0.95) AS warning,
    quantile_cont(error, 0.99) AS alarm, quantile_cont(smoothed, 0.95) AS window_warning, quantile_cont(smoothed, 0.99) AS window_alarm
    FROM l2_scoped GROUP BY 1) a JOIN (SELECT scope_pump, quantile_cont(day_error, 0.95) AS day_warning, quantile_cont(day_error, 0.99) AS day_alarm, count(*) AS n_days
    FROM (SELECT scope_pump, pump_id, date, avg(error) AS day_error FROM l2_scoped GROUP BY 1, 2, 3) GROUP BY 1) b USING (scope_pump)""")
cte("l2_thr", ("l2_thr_all",), """
  SELECT scope_pump, n, mean, std, warning, alarm, window_warning, window_alarm, mean + 2 * std AS mean_plus_2sigma, mean + 3 * std AS mean_plus_3sigma,
    CASE WHEN scope_pump = -1 OR n_days >= 3 THEN day_warning END AS day_warning, CASE WHEN scope_pump = -1 OR n_days >= 3 THEN day_alarm END AS day_alarm, n_days
  FROM l2_thr_all WHERE scope_pump = -1 OR n >= 10""")
cte("l2_steps", ("l2_soft", "l2_thr"), """
  SELECT x.*, b.mean, b.warning, b.alarm, b.window_warning, b.window_alarm,
    CASE WHEN smoothed >= b.window_alarm THEN 'ALARM' WHEN smoothed >= b.window_warning THEN 'WARNING' ELSE 'NORMAL' END AS window_status
  FROM l2_soft x JOIN (SELECT p.pump_id, k.* FROM (SELECT DISTINCT pump_id FROM l2_soft) p JOIN l2_thr k
    ON k.scope_pump = CASE WHEN EXISTS (SELECT 1 FROM l2_thr q WHERE q.scope_pump = p.pump_id) THEN p.pump_id ELSE -1 END) b USING (pump_id)""")
cte("l2_days", ("l2_steps",), """
  SELECT *, CASE WHEN day_error >= alarm THEN 'ALARM' WHEN day_error >= warning THEN 'WARNING' ELSE 'NORMAL' END AS status,
    CASE WHEN alarm <= 0 THEN 0.0 ELSE least(2.0, greatest(0.0, day_error / alarm)) END AS severity
  FROM (SELECT pump_id, date, max(label) AS label, max(season) AS season, avg(error) AS day_error, avg(smoothed) AS day_smoothed, count(*) AS n_windows,
    avg((window_status <> 'NORMAL')::INT) AS share_warning, avg((window_status = 'ALARM')::INT) AS share_alarm,
    max(warning) AS warning, max(alarm) AS alarm, max(mean) AS mean FROM l2_steps GROUP BY 1, 2)""")

"""Registered queries: features, scoring, fusion, alarms, joins, calibration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rotorline.functions import formulas as X
from rotorline.functions.asof import asof_join
from rotorline.functions.ordered import exact_quantiles
from rotorline.operators import calibration as K
from rotorline.operators import features as FE
from rotorline.operators import fusion as U
from rotorline.operators import scoring as C
from rotorline.plans import sql as S
from rotorline.plans import views as V
from rotorline.plans.registry import query, shape
from rotorline.session import materialize

Spark = SparkSession
KEY = ["pump_id", "date", "ts"]

# --- features ----------------------------------------------------------------


@query("cln_20_forward_fill_clean", S.with_(("readings",), f"""SELECT {S.STEPS}, {S.rs(S.FIL)} FROM (SELECT *, count(*) OVER (PARTITION BY pump_id, date) AS n FROM (SELECT pump_id, date, ts, {', '.join(
    f'coalesce({c}, lag({c}) OVER w) AS {c}' for c in S.FIL)} FROM readings WINDOW w AS ({S.SEGW})) WHERE {' AND '.join(f'{c} IS NOT NULL' for c in S.FIL)}) WHERE n >= 5"""))
def forward_fill_clean(spark: Spark, sf: str) -> DataFrame:
    return shape(FE.forward_fill_clean(V.readings(spark, sf), V.FILLED), [*KEY, *V.FILLED])


@query("cln_21_fill_with_mean", S.with_(("l2_filled",), f"SELECT {S.STEPS}, {S.rs(S.FIL)} FROM l2_filled"))
def fill_with_mean(spark: Spark, sf: str) -> DataFrame:
    r = V.grid(spark, sf)
    means = FE.params_struct(FE.norm_params(r.where(F.col("label") == "normal"), V.FILLED), V.FILLED).scalar()
    held = r.withColumn("_m", means)
    return shape(FE.fill_with_mean(held, V.FILLED, {c: F.col("_m")[c]["mean"] for c in V.FILLED}), [*KEY, *V.FILLED])


@query("cln_22_column_upgrade", S.with_(("readings",), f"SELECT {S.STEPS}, {S.r('flow', 'winding_1')}, {S.r('flow', 'winding_2')}, {S.r('speed')} FROM readings"))
def column_upgrade(spark: Spark, sf: str) -> DataFrame:
    """A legacy model lists one winding column and the pump id among its outputs."""
    _, outputs = FE.upgrade_columns(["speed"], ["winding", "speed", "pump_id"], {"winding": ("winding_1", "winding_2")}, ["pump_id"])
    r = V.readings(spark, sf).withColumns({"winding_1": F.col("flow"), "winding_2": F.col("flow")})
    return shape(r, [*KEY, *outputs])


@query("fea_01_one_hot", S.with_(("readings",), f"SELECT {S.STEPS}, " + ", ".join(S.i(f"(pump_id % 4 + 1 = {k})::INT", f"pump_{k}") for k in (1, 2, 3, 4)) + f", {S.i('pump_id % 4 + 1', 'back')} FROM readings"))
def one_hot(spark: Spark, sf: str) -> DataFrame:
    r = V.readings(spark, sf).withColumn("slot", F.col("pump_id") % 4 + 1)
    hot = r.withColumns(FE.one_hot("slot", (1, 2, 3, 4), "pump_")).withColumn("back", FE.from_one_hot((1, 2, 3, 4), "pump_"))
    return shape(hot, [*KEY, "pump_1", "pump_2", "pump_3", "pump_4", "back"])


@query("fea_02_smoothing", S.with_(("l2_smooth",), f"SELECT {S.STEPS}, {S.rs(S.FIL)} FROM l2_smooth"))
def smoothing(spark: Spark, sf: str) -> DataFrame:
    return shape(V.smoothed_rows(spark, sf), [*KEY, *V.FILLED])


S.cte("l2_params_long", ("l2_params",), " UNION ALL ".join(f"SELECT '{c}' AS channel, p_m_{c} AS mean, p_s_{c} AS std, p_lo_{c} AS min, p_hi_{c} AS max FROM l2_params" for c in S.FIL))


@query("fea_03_norm_params", S.with_(("l2_params_long",), f"SELECT channel, {S.rs(['mean', 'std', 'min', 'max'])} FROM l2_params_long"))
def norm_params(spark: Spark, sf: str) -> DataFrame:
    s = V.smoothed_rows(spark, sf)
    return shape(FE.norm_params(s.where(F.col("label") == "normal"), V.FILLED))


@query("fea_04_normalize", S.with_(("l2_smooth", "l2_params"), f"SELECT {S.STEPS}, " + ", ".join(
    S.r(f"CASE WHEN p_hi_{c} = p_lo_{c} THEN 0.0 ELSE ({c} - p_lo_{c}) / (p_hi_{c} - p_lo_{c}) END", c) for c in S.FIL) + " FROM l2_smooth, l2_params"))
def normalize(spark: Spark, sf: str) -> DataFrame:
    s = materialize(V.smoothed_rows(spark, sf))
    params = FE.norm_params(s.where(F.col("label") == "normal"), V.FILLED)
    return shape(FE.normalize(s, params, V.FILLED, "min-max"), [*KEY, *V.FILLED])


@query("fea_05_denormalize", S.with_(("l2_smooth",), f"SELECT {S.STEPS}, {S.rs(S.FIL)} FROM l2_smooth"))
def denormalize(spark: Spark, sf: str) -> DataFrame:
    """There and back again gives the smoothed values."""
    s = materialize(V.smoothed_rows(spark, sf))
    params = materialize(FE.norm_params(s.where(F.col("label") == "normal"), V.FILLED))
    there = FE.normalize(s, params, V.FILLED, "z-score")
    return shape(FE.denormalize(there, params, V.FILLED, "z-score"), [*KEY, *V.FILLED])


_HIST = [(k, c) for k in (2, 1, 0) for c in ("speed", "flow")]


@query("fea_06_padded_history", S.with_(("l2_filled",), f"SELECT {S.STEPS}, " + ", ".join(
    S.r(f"coalesce(lag({c}, {k}) OVER w, first({c}) OVER w)" if k else c, f"w{n}") for n, (k, c) in enumerate(_HIST))
    + f" FROM (SELECT pump_id, date, ts, coalesce(speed, 0.0) AS speed, flow FROM l2_filled) WINDOW w AS ({S.SEGW})"))
def padded_history(spark: Spark, sf: str) -> DataFrame:
    r = V.grid(spark, sf)
    means = FE.params_struct(FE.norm_params(r.where(F.col("label") == "normal"), V.FILLED), V.FILLED).scalar()
    f = FE.fill_with_mean(r.withColumn("_m", means), V.FILLED, {c: F.col("_m")[c]["mean"] for c in V.FILLED})
    f = f.withColumn("speed", F.coalesce("speed", F.lit(0.0)))
    out = FE.padded_history(f, ["speed", "flow"], 3)
    return shape(out.select(*KEY, *[F.col("window")[n].alias(f"w{n}") for n in range(6)]))


@query("fea_07_full_history", S.with_(("l2_scaled",), f"SELECT {S.STEPS}, {S.i('size')}, {S.r('total')}, {S.r('oldest')} FROM (SELECT pump_id, date, ts, rn, 12 AS size, " +
    f"sum({' + '.join(S.FIL)}) OVER x AS total, first(flow) OVER x AS oldest FROM l2_scaled WINDOW x AS ({S.SEGW} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)) WHERE rn > 3"))
def full_history(spark: Spark, sf: str) -> DataFrame:
    out = FE.full_history(V.scaled_rows(spark, sf), V.FILLED, V.HISTORY)
    total = F.aggregate("window", F.lit(0.0), lambda a, v: a + v)
    return shape(out.select(*KEY, F.size("window").alias("size"), total.alias("total"), F.col("window")[0].alias("oldest")))


def _cut_sql(strata: str, days: str, parts: dict[str, float]) -> str:
    """Days per part: the k-th of n days (from 0) goes to the first part whose end lies above k/n."""
    edge, cases = 0.0, []
    for name, share in list(parts.items())[:-1]:
        edge += share
        cases.append(f"WHEN k / n < {edge!r}::DOUBLE - 1e-12 THEN '{name}'")
    part = f"CASE {' '.join(cases)} ELSE '{list(parts)[-1]}' END"
    return f"""SELECT {strata}, {part} AS part, count(*) AS n_days FROM (SELECT *, row_number() OVER (PARTITION BY {strata} ORDER BY pump_id, date) - 1 AS k, count(*) OVER (PARTITION BY {strata}) AS n
      FROM (SELECT DISTINCT pump_id, date, label FROM {days})) GROUP BY ALL"""


S.cte("good_days", ("tagged",), "SELECT * FROM tagged WHERE label = 'normal'")
S.cte("bad_days", ("tagged",), "SELECT * FROM tagged WHERE label = 'abnormal'")


@query("fea_08_split_days", S.with_(("good_days", "bad_days"), f"SELECT label, part, {S.i('n_days')} FROM (" +
    _cut_sql("label", "good_days", {"train": 0.8, "validation": 0.1, "test": 0.1}) + " UNION ALL " + _cut_sql("label", "bad_days", {"validation": 0.5, "test": 0.5}) + ")"))
def split_days(spark: Spark, sf: str) -> DataFrame:
    days = V.days(V.tagged(V.readings(spark, sf)))
    normal = FE.split_days(days.where(F.col("label") == "normal"), {"train": 0.8, "validation": 0.1, "test": 0.1}, ["label"])
    abnormal = FE.split_days(days.where(F.col("label") == "abnormal"), {"validation": 0.5, "test": 0.5}, ["label"])
    return shape(normal.unionByName(abnormal).groupBy("label", "part").agg(F.count(F.lit(1)).alias("n_days")))


@query("fea_09_stratified_split", S.with_(("tagged",), f"SELECT {S.i('pump_id')}, label, part, {S.i('n_days')} FROM (" + _cut_sql("pump_id, label", "tagged", {"optimise": 0.7, "holdout": 0.3}) + ")"))
def stratified_split(spark: Spark, sf: str) -> DataFrame:
    days = V.days(V.tagged(V.readings(spark, sf)))
    out = FE.split_days(days, {"optimise": 0.7, "holdout": 0.3}, ["pump_id", "label"])
    return shape(out.groupBy("pump_id", "label", "part").agg(F.count(F.lit(1)).alias("n_days")))


@query("fea_10_shuffle_split", S.with_(("tagged",), f"""SELECT {S.SEGS}, label, part FROM (
  SELECT *, CASE WHEN (row_number() OVER (PARTITION BY label ORDER BY h) - 1) / count(*) OVER (PARTITION BY label) < 0.8 - 1e-12 THEN 'optimise' ELSE 'validation' END AS part
  FROM (SELECT DISTINCT pump_id, date, label, {S.hash_order(['pump_id', 'date'])} AS h FROM tagged WHERE label = 'abnormal')) ORDER BY h, pump_id, date LIMIT 60"""))
def shuffle_split(spark: Spark, sf: str) -> DataFrame:
    days = V.days(V.tagged(V.readings(spark, sf))).where(F.col("label") == "abnormal")
    parts = FE.split_days(days, {"optimise": 0.8, "validation": 0.2}, ["label"])
    return shape(FE.sample_rows(parts, 60, ["pump_id", "date"]), ["pump_id", "date", "label", "part"])


@query("fea_11_balance_weights", S.with_(("readings",), f"SELECT {S.i('pump_id')}, {S.i('n')}, {S.r('n * (1.0 / n)', 'total_weight')} FROM (SELECT pump_id, count(*) AS n FROM readings GROUP BY 1)"))
def balance_weights(spark: Spark, sf: str) -> DataFrame:
    w = FE.balance_weights(V.readings(spark, sf))
    return shape(w.groupBy("pump_id").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("total_weight")))


@query("fea_12_season", S.with_(("tagged",), f"SELECT {S.i('pump_id')}, season, {S.i('n')} FROM (SELECT pump_id, season, count(*) AS n FROM tagged GROUP BY 1, 2)"))
def season(spark: Spark, sf: str) -> DataFrame:
    return shape(V.tagged(V.readings(spark, sf)).groupBy("pump_id", "season").agg(F.count(F.lit(1)).alias("n")))


def _hist_sql(h: int) -> str:
    return (f"SELECT {h} AS history, pump_id, (day(date) <= 20) AS is_train, sum(x) OVER ({S.SEGW} ROWS BETWEEN {h - 1} PRECEDING AND CURRENT ROW) AS total, rn FROM hx")


S.cte("hp", ("l2_smooth",), "SELECT min(flow) AS a, max(flow) AS b FROM l2_smooth WHERE day(date) <= 20")
S.cte("hx", ("l2_smooth", "hp"), "SELECT pump_id, date, ts, rn, (flow - a) / (b - a) AS x FROM l2_smooth, hp")


@query("fea_13_history_datasets", S.with_(("hx",), f"""SELECT {S.i('history')}, {S.i('pump_id')}, {S.i('is_train::INT', 'is_train')}, {S.i('n')}, {S.r('total')}, {S.r('n * (1.0 / n)', 'weight')} FROM (
  SELECT history, pump_id, is_train, count(*) AS n, sum(total) AS total FROM ({_hist_sql(2)} UNION ALL {_hist_sql(4)}) WHERE rn > history GROUP BY 1, 2, 3)"""))
def history_datasets(spark: Spark, sf: str) -> DataFrame:
    s = materialize(V.smoothed_rows(spark, sf))
    out = FE.history_datasets(s, ["flow"], [2, 4], F.dayofmonth("date") <= 20)
    total = F.aggregate("window", F.lit(0.0), lambda a, v: a + v)
    return shape(out.groupBy("history", "pump_id", "is_train").agg(
        F.count(F.lit(1)).alias("n"), F.sum(total).alias("total"), F.sum("weight").alias("weight")))


# --- level 1 -----------------------------------------------------------------


def l1_blocks(res: DataFrame, seasonal: bool = False, features: bool = False) -> DataFrame:
    return materialize(K.calibrate(res.where(F.col("label") == "normal"), V.OUTPUTS, seasonal, features=features))


def l1_steps(spark: Spark, sf: str, g: DataFrame | None = None, features: bool = False) -> DataFrame:
    """Level 1 scores under the all-year blocks."""
    res = V.residual_rows(spark, sf, g)
    columns = ["mean_vec", "std_vec", "cov_inv", "warning", "alarm", "mean", *(["per_feature"] if features else [])]
    blocks = K.resolve_blocks(res, l1_blocks(res, features=features), columns)
    return C.score_steps(res.join(blocks, ["pump_id", "season"]), V.OUTPUTS)


def l1_days(spark: Spark, sf: str, g: DataFrame | None = None) -> DataFrame:
    return C.level1_days(l1_steps(spark, sf, g))


@query("sco_01_ml_predictor")
def ml_predictor(spark: Spark, sf: str) -> DataFrame:
    """Spark ML regression on the padded history of the conditions."""
    r = V.grid(spark, sf).where("speed IS NOT NULL AND motor_current IS NOT NULL")
    model = C.LinearConditions(["speed", "motor_current"], ["flow", "de_bearing_temp"]).fit(r)
    return shape(model.transform(r), [*KEY, "pred_flow", "pred_de_bearing_temp"])


@query("sco_02_residuals", S.with_(("pred",), f"SELECT {S.i('pump_id')}, {S.i('n_scored')}, {S.i('n_dropped')} FROM (SELECT pump_id, count(*) FILTER (ok) AS n_scored, count(*) FILTER (NOT ok) AS n_dropped FROM (SELECT pump_id, " +
    " AND ".join(f"({c} - pred_{c}) IS NOT NULL" for c in S.OUT) + " AS ok FROM pred) GROUP BY 1)"))
def residual_counts(spark: Spark, sf: str) -> DataFrame:
    return shape(C.dropped_rows(V.predicted(spark, sf), V.OUTPUTS))


@query("sco_03_pump_from_name", f"""SELECT {S.i('pump')}, {S.i('n')} FROM (SELECT CASE WHEN user_id % 3 <> 0 THEN user_id % 5 ELSE try_cast(regexp_extract('Pump-' || (user_id % 11) || '_day', '[Pp]ump[_-]?(\\d+)', 1) AS INTEGER) END AS pump, count(*) AS n FROM events GROUP BY 1)""")
def pump_from_name(spark: Spark, sf: str) -> DataFrame:
    e = V.raw(spark, sf)
    name = F.concat(F.lit("Pump-"), (F.col("user_id") % 11).cast("string"), F.lit("_day"))
    col = F.when(F.col("user_id") % 3 != 0, (F.col("user_id") % 5).cast("int"))
    return shape(e.groupBy(C.pump_from_name(col, name).alias("pump")).agg(F.count(F.lit(1)).alias("n")))


@query("sco_04_distance", S.with_(("l1_steps",), f"SELECT {S.STEPS}, {S.r('dist', 'distance')} FROM l1_steps"))
def distances(spark: Spark, sf: str) -> DataFrame:
    return shape(l1_steps(spark, sf), [*KEY, "distance"])


@query("sco_05_feature_scores", S.with_(("l1_steps",), f"SELECT feature, {S.i('n')}, {S.i('n_anomalous')}, {S.r('max_z')} FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, count(*) AS n, count(*) FILTER (abs((res_{c} - m_{c}) / greatest(s_{c}, 1e-12)) > 3) AS n_anomalous, max(abs((res_{c} - m_{c}) / greatest(s_{c}, 1e-12))) AS max_z FROM l1_steps" for c in S.OUT) + ")"))
def feature_scores(spark: Spark, sf: str) -> DataFrame:
    long = l1_steps(spark, sf).select(F.explode("feature_scores").alias("f")).select("f.*")
    return shape(long.groupBy("feature").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("is_anomalous"), 1)).alias("n_anomalous"), F.max(F.abs("z")).alias("max_z")))


@query("sco_06_status", S.with_(("l1_steps",), f"SELECT {S.STEPS}, status FROM l1_steps"))
def statuses(spark: Spark, sf: str) -> DataFrame:
    return shape(l1_steps(spark, sf), [*KEY, "status"])


@query("sco_07_level1_days", S.with_(("l1_days",), f"SELECT {S.SEGS}, status, {S.rs(['day_mean', 'day_max', 'share_warning', 'share_alarm', 'severity'])}, {S.i('n_steps')} FROM l1_days"))
def level1_days(spark: Spark, sf: str) -> DataFrame:
    return shape(l1_days(spark, sf), ["pump_id", "date", "status", "day_mean", "day_max", "share_warning", "share_alarm", "severity", "n_steps"])


@query("sco_07_top_steps", S.with_(("l1_steps",), f"SELECT {S.STEPS}, {S.i('place')}, {S.r('dist', 'distance')} FROM (SELECT *, row_number() OVER (PARTITION BY pump_id, date ORDER BY dist DESC, ts) AS place FROM l1_steps) WHERE place <= 3"))
def top_steps(spark: Spark, sf: str) -> DataFrame:
    return shape(C.top_steps(l1_steps(spark, sf), 3), [*KEY, "place", "distance"])


def _stats_sql(scoped: str, keys: str) -> str:
    parts = []
    for c in S.OUT:
        parts.append(f"""SELECT {keys}, '{c}' AS channel, max(mu) AS mean_residual, max(sd) AS std_residual, count(*) AS n, quantile_cont(abs(v), 0.95) AS p95_abs, quantile_cont(abs(v), 0.99) AS p99_abs,
          quantile_cont(CASE WHEN sd < 1e-12 THEN 0.0 ELSE abs((v - mu) / sd) END, 0.95) AS z_warning, quantile_cont(CASE WHEN sd < 1e-12 THEN 0.0 ELSE abs((v - mu) / sd) END, 0.99) AS z_alarm
          FROM (SELECT {keys}, res_{c} AS v, avg(res_{c}) OVER (PARTITION BY {keys}) AS mu, stddev_pop(res_{c}) OVER (PARTITION BY {keys}) AS sd FROM {scoped}) GROUP BY {keys}""")
    return " UNION ALL ".join(parts)


S.cte("fstats", ("scoped",), _stats_sql("scoped", "scope_season, scope_pump"))
S.cte("fstats4", ("scoped4",), _stats_sql("scoped4", "scope_season, scope_pump"))
S.cte("fblock", ("fstats", "blocks1"), "SELECT b.scope_pump, f.channel, f.mean_residual, f.std_residual, f.p99_abs FROM blocks1 b JOIN fstats f ON f.scope_pump = CASE WHEN b.fallback THEN -1 ELSE b.scope_pump END")
S.cte("healths", ("l1_steps", "fblock", "blocks1"), """SELECT pump_id, date, ts, channel, z, CASE WHEN band <= 0 THEN (CASE WHEN z <= 0 THEN 100.0 ELSE 0.0 END) ELSE 100.0 / (1.0 + exp(greatest(-20.0, least(20.0, 6.0 * (z / band - 0.5))))) END AS health FROM (
  SELECT l.pump_id, l.date, l.ts, l.channel, abs(v - mean_residual) / greatest(abs(std_residual), 1e-9) AS z, 2.0 * (greatest(abs(p99_abs), 1e-9) / greatest(abs(std_residual), 1e-9)) AS band
  FROM (""" + " UNION ALL ".join(f"SELECT pump_id, date, ts, '{c}' AS channel, res_{c} AS v FROM l1_steps" for c in S.OUT) + """) l
  JOIN fblock f ON f.channel = l.channel AND f.scope_pump = CASE WHEN EXISTS (SELECT 1 FROM blocks1 q WHERE q.scope_pump = l.pump_id AND NOT q.fallback) THEN l.pump_id ELSE -1 END)""")


def _healths(spark: Spark, sf: str) -> DataFrame:
    return C.channel_healths(l1_steps(spark, sf, features=True), V.OUTPUTS)


@query("sco_08_channel_health", S.with_(("healths",), f"SELECT {S.STEPS}, channel, {S.rs(['health', 'z'])} FROM healths"))
def channel_health(spark: Spark, sf: str) -> DataFrame:
    return shape(_healths(spark, sf), [*KEY, "channel", "health", "z"])


def health_sql(score: str, mean: str, alarm: str) -> str:
    return f"CASE WHEN {alarm} <= {mean} THEN (CASE WHEN {score} <= {mean} THEN 100.0 ELSE 0.0 END) ELSE 100.0 / (1.0 + exp(greatest(-20.0, least(20.0, 6.0 * (({score} - {mean}) / ({alarm} - {mean}) - 0.5))))) END"


@query("sco_09_health", S.with_(("l1_steps",), f"SELECT {S.STEPS}, {S.r(health_sql('dist', 'mean', 'alarm'), 'health')} FROM l1_steps"))
def health(spark: Spark, sf: str) -> DataFrame:
    s = l1_steps(spark, sf)
    return shape(s.withColumn("health", X.health(F.col("distance"), F.col("mean"), F.col("alarm"))), [*KEY, "health"])


@query("sco_10_channel_health_days", S.with_(("healths",), f"""SELECT {S.SEGS}, channel, {S.rs(['mean_health', 'min_health', 'mean_z', 'max_z'])}, {S.i('n_low')} FROM (
  SELECT pump_id, date, channel, avg(health) AS mean_health, min(health) AS min_health, avg(z) AS mean_z, max(z) AS max_z, count(*) FILTER (health < 50) AS n_low FROM healths GROUP BY 1, 2, 3)"""))
def channel_health_days(spark: Spark, sf: str) -> DataFrame:
    return shape(C.channel_health_days(_healths(spark, sf)))


# --- level 2 -----------------------------------------------------------------


@query("sco_11_window_error", S.with_(("l2_windows",), f"SELECT {S.STEPS}, {S.r('error')} FROM l2_windows"))
def window_error(spark: Spark, sf: str) -> DataFrame:
    return shape(V.windows(spark, sf), [*KEY, "error"])


def l2_windows(spark: Spark, sf: str, g: DataFrame | None = None) -> DataFrame:
    return C.smooth_errors(materialize(V.windows(spark, sf, g)))


@query("sco_12_smoothed_error", S.with_(("l2_soft",), f"SELECT {S.STEPS}, {S.rs(['error', 'smoothed'])} FROM l2_soft"))
def smoothed_error(spark: Spark, sf: str) -> DataFrame:
    return shape(l2_windows(spark, sf), [*KEY, "error", "smoothed"])


S.cte("whole_pump", ("l2_windows",), """SELECT pump_id, date, ts, list_reduce([e * 1.0::DOUBLE FOR e IN errs[1:k]], lambda a, x: 0.7::DOUBLE * a + 0.3::DOUBLE * x) AS smoothed FROM (
  SELECT *, row_number() OVER (PARTITION BY pump_id ORDER BY ts) AS k, list(error) OVER (PARTITION BY pump_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS errs FROM l2_windows)""")


@query("sco_12_smoothed_whole_pump", S.with_(("whole_pump",), f"SELECT {S.STEPS}, {S.r('smoothed')} FROM whole_pump"))
def smoothed_whole_pump(spark: Spark, sf: str) -> DataFrame:
    """The calibration series of a whole machine, chained over its days."""
    from rotorline.functions.series import ema

    out = ema(materialize(V.windows(spark, sf)), "error", "smoothed", ["pump_id"], long_series=True)
    return shape(out, [*KEY, "smoothed"])


def l2_thresholds(windows: DataFrame) -> DataFrame:
    return K.window_thresholds(windows.where(F.col("label") == "normal"))


def l2_steps(spark: Spark, sf: str, g: DataFrame | None = None) -> DataFrame:
    """Windows with their threshold block: the pump's own, else the global one."""
    w = materialize(l2_windows(spark, sf, g))
    th = materialize(l2_thresholds(w))
    cols = ["mean", "warning", "alarm", "window_warning", "window_alarm"]
    own = th.where(F.col("scope_pump") != K.GLOBAL).select(F.col("scope_pump").alias("pump_id"), F.struct(*cols).alias("_o"))
    base = th.where(F.col("scope_pump") == K.GLOBAL).select(F.struct(*cols).alias("_g")).scalar()
    out = w.join(own, "pump_id", "left").withColumn("_t", F.coalesce("_o", base))
    return out.select(*w.columns, "_t.*")


def l2_days(spark: Spark, sf: str, g: DataFrame | None = None) -> DataFrame:
    steps = materialize(l2_steps(spark, sf, g))
    extra = steps.groupBy("pump_id", "date").agg(F.avg("smoothed").alias("day_smoothed"), F.max("mean").alias("mean"), F.max("season").alias("season"), F.max("label").alias("label"))
    return C.level2_days(steps).join(extra, ["pump_id", "date"])


@query("sco_13_level2_days", S.with_(("l2_days",), f"SELECT {S.SEGS}, status, {S.rs(['day_error', 'share_warning', 'share_alarm', 'severity'])}, {S.i('n_windows')} FROM l2_days"))
def level2_days(spark: Spark, sf: str) -> DataFrame:
    return shape(l2_days(spark, sf), ["pump_id", "date", "status", "day_error", "share_warning", "share_alarm", "severity", "n_windows"])


S.cte("l2_seasonal", ("l2_norm",), """SELECT season, pump_id, quantile_cont(error, 0.95) AS s_warning, quantile_cont(error, 0.99) AS s_alarm, count(*) < 80 AS s_fallback FROM l2_norm GROUP BY 1, 2""")
S.cte("l2_over", ("l2_days", "l2_seasonal"), """SELECT *, CASE WHEN day_error >= a THEN 'ALARM' WHEN day_error >= w THEN 'WARNING' ELSE 'NORMAL' END AS st FROM (
  SELECT d.pump_id, d.date, d.day_error, CASE WHEN coalesce(NOT s_fallback, false) THEN s_warning ELSE warning END AS w, CASE WHEN coalesce(NOT s_fallback, false) THEN s_alarm ELSE alarm END AS a
  FROM l2_days d LEFT JOIN l2_seasonal USING (season, pump_id))""")


@query("sco_14_seasonal_override", S.with_(("l2_over",), f"SELECT {S.SEGS}, st AS status, {S.r('w', 'warning')}, {S.r('a', 'alarm')} FROM l2_over"))
def seasonal_override(spark: Spark, sf: str) -> DataFrame:
    w = materialize(l2_windows(spark, sf).where(F.col("label") == "normal"))
    q = exact_quantiles(w, ["season", "pump_id"], "error", {"s_warning": 0.95, "s_alarm": 0.99})
    n = w.groupBy("season", "pump_id").agg((F.count(F.lit(1)) < 80).alias("s_fallback"))
    return shape(C.apply_seasonal_days(l2_days(spark, sf), q.join(n, ["season", "pump_id"])), ["pump_id", "date", "status", "warning", "alarm"])


@query("sco_15_evidence_score",
    f"""SELECT {S.i('vec_id')}, {S.r('rec + 0.01::DOUBLE * (-0.5::DOUBLE) * kl', 'score', 5)} FROM (SELECT vec_id,
  list_sum([(a - 0.1::DOUBLE) * (a - 0.1::DOUBLE) FOR a IN y]) / 8 AS rec,
  list_sum([1.0::DOUBLE + greatest(-30.0::DOUBLE, least(20.0::DOUBLE, z[k] * 10)) - m[k] * m[k] - exp(greatest(-30.0::DOUBLE, least(20.0::DOUBLE, z[k] * 10))) FOR k IN range(1, 9)]) AS kl
  FROM (SELECT vec_id, CAST(embedding[1:8] AS DOUBLE[]) AS y, CAST(embedding[9:16] AS DOUBLE[]) AS m, CAST(embedding[17:24] AS DOUBLE[]) AS z FROM embeddings))""")
def evidence_score(spark: Spark, sf: str) -> DataFrame:
    """The embedding holds the target, the latent means and (scaled) the log variances of a scorer."""
    e = V.table(spark, sf, "embeddings").withColumn("e", F.col("embedding").cast("array<double>"))
    y, mu = F.slice("e", 1, 8), F.slice("e", 9, 8)
    logvar = F.transform(F.slice("e", 17, 8), lambda v: v * 10)
    recon = F.array_repeat(F.lit(0.1), 8)
    return shape(e.select("vec_id", X.evidence_score(y, recon, mu, logvar, 0.01).alias("score")), digits=5)


@query("sco_17_step_table", S.with_(("l1_steps", "l2_soft"), f"""SELECT {S.STEPS}, label, {S.i('step')}, {S.r('dist', 'l1')}, {S.r('smoothed', 'l2')} FROM (
  SELECT a.*, b.smoothed, row_number() OVER (PARTITION BY a.pump_id, a.date ORDER BY a.ts) - 1 AS step, count(*) OVER (PARTITION BY a.pump_id, a.date) AS n
  FROM l1_steps a LEFT JOIN l2_soft b ON a.pump_id = b.pump_id AND a.ts = b.ts) WHERE n >= 5"""))
def step_table(spark: Spark, sf: str) -> DataFrame:
    return shape(steps_both(spark, sf), [*KEY, "label", "step", "l1", "l2"])


def steps_both(spark: Spark, sf: str) -> DataFrame:
    g = V.grid(spark, sf)
    return C.step_table(l1_steps(spark, sf, g), l2_windows(spark, sf, g), V.days(g))


# --- fusion and alarms -------------------------------------------------------

S.cte("fused", ("l1_days", "l2_days"), """SELECT *, CASE WHEN s2 IS NULL THEN s1 WHEN s1 = 'ALARM' OR s2 = 'ALARM' THEN 'ALARM' WHEN s1 = 'WARNING' OR s2 = 'WARNING' THEN 'WARNING' ELSE 'NORMAL' END AS status,
  least(2.0, greatest(0.0, CASE WHEN v2 IS NULL THEN v1 ELSE greatest(v1, v2) + 0.3::DOUBLE * least(v1, v2) END)) AS severity FROM (
  SELECT pump_id, date, coalesce(a.status, 'NORMAL') AS s1, b.status AS s2, coalesce(a.severity, 0.0) AS v1, b.severity AS v2 FROM l1_days a FULL JOIN l2_days b USING (pump_id, date))""")


def fused(spark: Spark, sf: str) -> DataFrame:
    # Days of level 1 and of level 2 overlap only partly, so both outer sides occur.
    g = V.grid(spark, sf)
    return U.fuse_days(l1_days(spark, sf, g), l2_days(spark, sf, g))


@query("joi_03_full_outer_days", S.with_(("fused",), f"SELECT {S.SEGS}, s1 AS status_1, s2 AS status_2, {S.r('v1', 'severity_1')}, {S.r('v2', 'severity_2')} FROM fused"))
def full_outer_days(spark: Spark, sf: str) -> DataFrame:
    return shape(fused(spark, sf), ["pump_id", "date", "status_1", "status_2", "severity_1", "severity_2"])


@query("fus_01_status_matrix", S.with_(("fused",), f"SELECT {S.SEGS}, status FROM fused"))
def status_matrix(spark: Spark, sf: str) -> DataFrame:
    return shape(fused(spark, sf), ["pump_id", "date", "status"])


@query("fus_02_severity", S.with_(("l1_steps",), f"SELECT {S.STEPS}, {S.r('CASE WHEN alarm <= 0 THEN 0.0 ELSE least(2.0, greatest(0.0, dist / alarm)) END', 'severity')} FROM l1_steps"))
def step_severity(spark: Spark, sf: str) -> DataFrame:
    s = l1_steps(spark, sf)
    return shape(s.withColumn("severity", X.severity(F.col("distance"), F.col("alarm"))), [*KEY, "severity"])


@query("fus_03_combined_severity", S.with_(("fused",), f"SELECT {S.SEGS}, {S.r('severity')} FROM fused"))
def combined_severity(spark: Spark, sf: str) -> DataFrame:
    return shape(fused(spark, sf), ["pump_id", "date", "severity"])


S.cte("day_inputs", ("l1_days", "l2_days"), f"""SELECT a.pump_id, a.date, a.label, CASE WHEN a.alarm <= 0 THEN 0.0 ELSE least(2.0, greatest(0.0, a.day_mean / a.alarm)) END AS s1, {health_sql('a.day_mean', 'a.mean', 'a.alarm')} AS h1,
  CASE WHEN b.alarm <= 0 THEN 0.0 ELSE CASE WHEN b.alarm IS NULL THEN NULL ELSE least(2.0, greatest(0.0, b.day_error / b.alarm)) END END AS s2, CASE WHEN b.alarm IS NOT NULL THEN {health_sql('b.day_error', 'b.mean', 'b.alarm')} END AS h2
  FROM l1_days a LEFT JOIN l2_days b USING (pump_id, date)""")


def day_inputs(spark: Spark, sf: str) -> DataFrame:
    from rotorline.operators.evaluation import day_inputs as build

    g = V.grid(spark, sf)
    s = materialize(l1_steps(spark, sf, g).select("pump_id", "date", "distance", "status", "warning", "alarm", "mean", "label"))
    means = s.groupBy("pump_id", "date").agg(F.max("mean").alias("mean"), F.max("label").alias("label"))
    one = C.level1_days(s).join(means, ["pump_id", "date"]).withColumnRenamed("day_mean", "value")
    two = l2_days(spark, sf, g).withColumnRenamed("day_error", "value")
    return build(one, two, means.select("pump_id", "date", "label"))


@query("eva_23_day_inputs", S.with_(("day_inputs",), f"SELECT {S.SEGS}, label, {S.rs(['s1', 'h1', 's2', 'h2'])} FROM day_inputs"))
def day_inputs_query(spark: Spark, sf: str) -> DataFrame:
    return shape(day_inputs(spark, sf), ["pump_id", "date", "label", "s1", "h1", "s2", "h2"])


@query("fus_04_ensemble_health", S.with_(("day_inputs",), f"SELECT {S.SEGS}, {S.r('CASE WHEN h2 IS NULL THEN h1 ELSE 0.6::DOUBLE * least(h1, h2) + 0.4::DOUBLE * greatest(h1, h2) END', 'health')} FROM day_inputs"))
def ensemble_health(spark: Spark, sf: str) -> DataFrame:
    d = day_inputs(spark, sf)
    return shape(d.withColumn("health", X.combined_health(F.col("h1"), F.col("h2"))), ["pump_id", "date", "health"])


# Windows and steps rarely share a time here, so the as-of match is a real one.
S.cte("aligned", ("l2_steps", "l1_steps"), """SELECT w.pump_id, w.date, w.ts, w.smoothed, w.window_status, w.alarm, coalesce(CASE WHEN w.ts - s.ts <= INTERVAL 6 HOUR THEN s.dist END, 0.0) AS l1_distance,
  coalesce(CASE WHEN w.ts - s.ts <= INTERVAL 6 HOUR THEN s.status END, 'NORMAL') AS l1_status
  FROM l2_steps w ASOF LEFT JOIN (SELECT * FROM l1_steps WHERE hour(ts) % 2 = 0) s ON w.pump_id = s.pump_id AND w.date = s.date AND w.ts >= s.ts""")


def aligned(spark: Spark, sf: str) -> tuple[DataFrame, DataFrame]:
    g = V.grid(spark, sf)
    steps = materialize(l1_steps(spark, sf, g).select("pump_id", "date", "ts", "distance", "status", "warning", "alarm"))
    w = l2_steps(spark, sf, g).withColumn(
        "window_status", X.status_of(F.col("smoothed"), F.col("window_warning"), F.col("window_alarm"), strict=False))
    w = w.select(*KEY, "smoothed", "window_status", "alarm")
    return U.align_windows(w, steps.where(F.hour("ts") % 2 == 0), 6 * 3600.0), steps


@query("joi_04_align_windows", S.with_(("aligned",), f"SELECT {S.STEPS}, {S.r('l1_distance')}, l1_status, window_status FROM aligned"))
def align_windows(spark: Spark, sf: str) -> DataFrame:
    return shape(aligned(spark, sf)[0], [*KEY, "l1_distance", "l1_status", "window_status"])


@query("fus_05_window_ensemble", S.with_(("aligned", "l1_days"), f"""SELECT {S.STEPS}, ensemble_status, {S.r('ensemble_severity')} FROM (
  SELECT pump_id, date, ts, CASE WHEN l1_status = 'ALARM' OR window_status = 'ALARM' THEN 'ALARM' WHEN l1_status = 'WARNING' OR window_status = 'WARNING' THEN 'WARNING' ELSE 'NORMAL' END AS ensemble_status,
    least(2.0, greatest(a, b) + 0.3::DOUBLE * least(a, b)) AS ensemble_severity FROM (
    SELECT x.*, CASE WHEN day_max > 0 THEN severity * l1_distance / day_max ELSE 0.0 END AS a, CASE WHEN x.alarm <= 0 THEN 0.0 ELSE least(2.0, greatest(0.0, smoothed / x.alarm)) END AS b
    FROM aligned x LEFT JOIN l1_days USING (pump_id, date)))"""))
def window_ensemble(spark: Spark, sf: str) -> DataFrame:
    a, steps = aligned(spark, sf)
    return shape(U.window_ensemble(a, C.level1_days(steps)), [*KEY, "ensemble_status", "ensemble_severity"])


@query("fus_06_overall", S.with_(("fused",), f"""SELECT CASE max(CASE status WHEN 'ALARM' THEN 2 WHEN 'WARNING' THEN 1 ELSE 0 END) WHEN 2 THEN 'ALARM' WHEN 1 THEN 'WARNING' ELSE 'NORMAL' END AS overall_status,
  {S.r('max(severity)', 'overall_severity')}, {S.i('count(*)', 'n_days')} FROM fused"""))
def overall(spark: Spark, sf: str) -> DataFrame:
    return shape(U.overall(fused(spark, sf)))


# Step statuses straight from the readings (dense alarms exercise runs and limits).
S.cte("hot", ("readings",), f"""SELECT *, sum(CASE WHEN h THEN 0 ELSE 1 END) OVER ({S.SEGW} ROWS UNBOUNDED PRECEDING) AS br FROM (
  SELECT *, status <> 'NORMAL' AS h FROM (SELECT pump_id, date, ts, CASE WHEN flow >= 45 THEN 'ALARM' WHEN flow >= 30 THEN 'WARNING' ELSE 'NORMAL' END AS status FROM readings))""")
S.cte("spiked", ("hot",), f"""SELECT *, CASE WHEN NOT h OR pos >= 2 THEN status ELSE 'NORMAL' END AS filtered_status FROM (
  SELECT *, count(*) FILTER (WHERE h) OVER (PARTITION BY pump_id, date, br ORDER BY ts ROWS UNBOUNDED PRECEDING) AS pos FROM hot)""")


def alarm_steps(spark: Spark, sf: str) -> DataFrame:
    flow = F.coalesce("flow", F.lit(0.0))
    return V.readings(spark, sf).select(*KEY, X.status_of(flow, F.lit(30.0), F.lit(45.0)).alias("status"))


@query("fus_07_spike_filter", S.with_(("spiked",), f"SELECT {S.STEPS}, status, filtered_status FROM spiked"))
def spike_filter(spark: Spark, sf: str) -> DataFrame:
    return shape(U.spike_filter(alarm_steps(spark, sf)), [*KEY, "status", "filtered_status"])


S.cte("eligible", ("spiked",), "SELECT pump_id, date, br, ts FROM spiked WHERE h AND pos >= 2 AND status = 'ALARM'")
S.cte("fired", ("eligible",), """SELECT pump_id, date, br, min(ts) AS ts FROM eligible GROUP BY 1, 2, 3
  UNION ALL SELECT * FROM (SELECT f.pump_id, f.date, f.br, (SELECT min(e.ts) FROM eligible e WHERE e.pump_id = f.pump_id AND e.date = f.date AND e.br = f.br AND e.ts >= f.ts + INTERVAL 6 HOUR) AS ts FROM fired f) WHERE ts IS NOT NULL""")


@query("fus_08_rate_limit", S.with_(("fired", "spiked"), f"SELECT {S.STEPS}, filtered_status, {S.i('CASE WHEN (pump_id, ts) IN (SELECT (pump_id, ts) FROM fired) THEN 1 ELSE 0 END', 'alert_fired')} FROM spiked", recursive=True))
def rate_limit(spark: Spark, sf: str) -> DataFrame:
    out = U.rate_limit(U.spike_filter(alarm_steps(spark, sf)), 6 * 3600)
    return shape(out, [*KEY, "filtered_status", "alert_fired"])


@query("fus_09_session_counter", S.with_(("spiked",), f"""SELECT {S.STEPS}, {S.i('n', 'session_alert_steps')}, {S.i('(n >= 3)::INT', 'session_flagged')} FROM (
  SELECT *, sum((filtered_status <> 'NORMAL')::INT) OVER ({S.SEGW} ROWS UNBOUNDED PRECEDING) AS n FROM spiked)"""))
def session_counter(spark: Spark, sf: str) -> DataFrame:
    return shape(U.session_counter(U.spike_filter(alarm_steps(spark, sf))), [*KEY, "session_alert_steps", "session_flagged"])


@query("fus_10_day_flags", S.with_(("spiked",), f"SELECT {S.SEGS}, {S.ins(['n_steps', 'n_alert_steps'])}, {S.i('(n_alert_steps >= 3)::INT', 'flagged')} FROM (SELECT pump_id, date, count(*) AS n_steps, count(*) FILTER (filtered_status <> 'NORMAL') AS n_alert_steps FROM spiked GROUP BY 1, 2)"))
def day_flags(spark: Spark, sf: str) -> DataFrame:
    return shape(U.day_flags(U.spike_filter(alarm_steps(spark, sf))))


# --- joins -------------------------------------------------------------------

S.cte("clicks", ("raw",), "SELECT pump_id, date_trunc('minute', ts) AS ts, min(event_id) AS event_id FROM raw WHERE sensor = 'click' GROUP BY 1, 2")
S.cte("errors", ("raw",), "SELECT pump_id, date_trunc('minute', ts) AS ts, min(value) AS value FROM raw WHERE sensor = 'error' GROUP BY 1, 2")


def _nearest_sql(minutes: int) -> str:
    return f"""SELECT l.pump_id, l.ts, l.event_id, CASE WHEN l.ts - b.ts <= INTERVAL {minutes} MINUTE AND (a.ts IS NULL OR l.ts - b.ts <= a.ts - l.ts) THEN b.value WHEN a.ts - l.ts <= INTERVAL {minutes} MINUTE THEN a.value END AS value
      FROM clicks l ASOF LEFT JOIN errors b ON l.pump_id = b.pump_id AND l.ts >= b.ts ASOF LEFT JOIN errors a ON l.pump_id = a.pump_id AND l.ts <= a.ts"""


def _sides(spark: Spark, sf: str) -> tuple[DataFrame, DataFrame]:
    r = V.raw(spark, sf).withColumn("ts", F.date_trunc("minute", "ts"))
    left = r.where(F.col("sensor") == "click").groupBy("pump_id", "ts").agg(F.min("event_id").alias("event_id"))
    return left, r.where(F.col("sensor") == "error").select("pump_id", "ts", "value")


@query("joi_01_nearest_join", S.with_(("clicks", "errors"), f"SELECT {S.i('pump_id')}, {S.t()}, {S.i('event_id')}, {S.r('value')} FROM ({_nearest_sql(45)})"))
def nearest_join(spark: Spark, sf: str) -> DataFrame:
    left, right = _sides(spark, sf)
    return shape(asof_join(left, right, ["pump_id"], ["value"], 45 * 60.0))


@query("joi_05_nearest_within", S.with_(("clicks", "errors"), f"SELECT {S.i('pump_id')}, {S.i('n')}, {S.i('n_matched')} FROM (SELECT pump_id, count(*) AS n, count(value) AS n_matched FROM ({_nearest_sql(3)}) GROUP BY 1)"))
def nearest_within(spark: Spark, sf: str) -> DataFrame:
    left, right = _sides(spark, sf)
    near = asof_join(left, right, ["pump_id"], ["value"], 180.0)
    return shape(near.groupBy("pump_id").agg(F.count(F.lit(1)).alias("n"), F.count("value").alias("n_matched")))


# Every machine is asked for every season, so all steps of the fallback chain are taken.
S.cte("asked", ("tagged",), "SELECT DISTINCT pump_id, s AS season FROM tagged, (SELECT unnest(['winter', 'spring', 'summer', 'autumn', 'none']) AS s)")
S.cte("chain", ("asked", "blocks4"), """SELECT a.pump_id, a.season, coalesce(b1.warning, b2.warning, b3.warning, b4.warning) AS warning, coalesce(b1.alarm, b2.alarm, b3.alarm, b4.alarm) AS alarm,
  CASE WHEN b1.warning IS NOT NULL THEN 'season_pump' WHEN b2.warning IS NOT NULL THEN 'season' WHEN b3.warning IS NOT NULL THEN 'pump' ELSE 'global' END AS block_source
  FROM asked a LEFT JOIN blocks4 b1 ON b1.scope_season = a.season AND b1.scope_pump = a.pump_id AND NOT b1.fallback LEFT JOIN blocks4 b2 ON b2.scope_season = a.season AND b2.scope_pump = -1
  LEFT JOIN blocks4 b3 ON b3.scope_season = 'all' AND b3.scope_pump = a.pump_id AND NOT b3.fallback LEFT JOIN blocks4 b4 ON b4.scope_season = 'all' AND b4.scope_pump = -1""")


def _asked(res: DataFrame) -> DataFrame:
    names = F.explode(F.array(*[F.lit(s) for s in ("winter", "spring", "summer", "autumn", "none")]))
    return res.select("pump_id").distinct().select("pump_id", names.alias("season"))


@query("joi_08_threshold_chain", S.with_(("chain",), f"SELECT {S.i('pump_id')}, season, block_source, {S.rs(['warning', 'alarm'])} FROM chain"))
def threshold_chain(spark: Spark, sf: str) -> DataFrame:
    res = V.residual_rows(spark, sf)
    return shape(K.resolve_blocks(_asked(res), l1_blocks(res, True), ["warning", "alarm"]), ["pump_id", "season", "block_source", "warning", "alarm"])


@query("joi_09_stream_thresholds", S.with_(("asked", "blocks4"), f"""SELECT {S.i('pump_id')}, season, {S.i('level')}, {S.r('warning')}, {S.r('greatest(alarm, warning)', 'alarm')}, {S.r('mean')} FROM (
  SELECT a.pump_id, a.season, 1 AS level, coalesce(p.warning, g.warning) AS warning, coalesce(p.alarm, g.alarm) AS alarm, coalesce(p.mean, g.mean) AS mean
  FROM asked a LEFT JOIN blocks4 p ON p.scope_season = 'all' AND p.scope_pump = a.pump_id AND NOT p.fallback LEFT JOIN blocks4 g ON g.scope_season = 'all' AND g.scope_pump = -1
  UNION ALL SELECT a.pump_id, a.season, 2, coalesce(s.warning, p.warning, g.warning), coalesce(s.alarm, p.alarm, g.alarm), coalesce(p.mean, g.mean)
  FROM asked a LEFT JOIN blocks4 p ON p.scope_season = 'all' AND p.scope_pump = a.pump_id AND NOT p.fallback LEFT JOIN blocks4 g ON g.scope_season = 'all' AND g.scope_pump = -1
  LEFT JOIN blocks4 s ON s.scope_season = a.season AND s.scope_season <> 'all' AND s.scope_pump = a.pump_id AND NOT s.fallback)"""))
def stream_thresholds(spark: Spark, sf: str) -> DataFrame:
    res = V.residual_rows(spark, sf)
    blocks, asked = l1_blocks(res, True), _asked(res)
    parts = [K.resolve_stream_blocks(asked, blocks, level).withColumn("level", F.lit(level)) for level in (1, 2)]
    return shape(parts[0].unionByName(parts[1]), ["pump_id", "season", "level", "warning", "alarm", "mean"])


# --- calibration -------------------------------------------------------------


def _normal(spark: Spark, sf: str) -> DataFrame:
    return V.residual_rows(spark, sf).where(F.col("label") == "normal")


STAT = ["mean_residual", "std_residual", "p95_abs", "p99_abs", "z_warning", "z_alarm"]


@query("cal_01_feature_statistics", S.with_(("fstats",), f"SELECT scope_season, {S.i('scope_pump')}, channel, {S.i('n')}, {S.rs(STAT)} FROM fstats"))
def feature_statistics(spark: Spark, sf: str) -> DataFrame:
    return shape(K.feature_statistics(_normal(spark, sf), V.OUTPUTS), ["scope_season", "scope_pump", "channel", "n", *STAT])


PAIRS = [f"cov_{a}__{b}" for n, a in enumerate(S.OUT) for b in S.OUT[n:]]


@query("cal_02_covariance", S.with_(("inv",), f"SELECT {S.i('scope_pump')}, {S.i('n')}, {S.rs(PAIRS)}, {S.r('i_flow__flow', 'inv_00', 9)}, {S.r('i_flow__outlet_pressure', 'inv_01', 9)} FROM inv"))
def covariance(spark: Spark, sf: str) -> DataFrame:
    out = K.invert(K.scope_moments(_normal(spark, sf), V.OUTPUTS), V.OUTPUTS)
    inv = out.withColumns({"inv_00": F.round("cov_inv.flow.flow", 9), "inv_01": F.round("cov_inv.flow.outlet_pressure", 9)})
    return shape(inv, ["scope_pump", "n", *PAIRS]).join(inv.select(F.col("scope_pump").cast("bigint").alias("scope_pump"), "inv_00", "inv_01"), "scope_pump")


def _own_distances(spark: Spark, sf: str) -> DataFrame:
    rows = _normal(spark, sf)
    blocks = materialize(K.invert(K.scope_moments(rows, V.OUTPUTS), V.OUTPUTS).select(*K.SCOPE, "mean_vec", "cov_inv"))
    each = K.with_blocks(rows, blocks, ["mean_vec", "cov_inv"]).select("*", F.explode("_scopes").alias("_s")).select(*rows.columns, *[f"_s.{c}" for c in K.SCOPE], "_s.block.*")
    return each.withColumn("distance", C.distance(V.OUTPUTS, F.col("mean_vec"), F.col("cov_inv")))


@query("cal_03_distance_thresholds", S.with_(("own_thr",), f"SELECT {S.i('scope_pump')}, {S.i('n')}, {S.rs(['mean', 'std', 'warning', 'alarm'])} FROM own_thr"))
def distance_thresholds(spark: Spark, sf: str) -> DataFrame:
    own = materialize(_own_distances(spark, sf).select(*K.SCOPE, "distance"))
    return shape(K.distance_thresholds(own), ["scope_pump", "n", "mean", "std", "warning", "alarm"])


def _part(a: str) -> str:
    terms = []
    for b in S.OUT:
        p, q = (a, b) if S.OUT.index(a) <= S.OUT.index(b) else (b, a)
        terms.append(f"i_{p}__{q} * (res_{b} - m_{b})")
    return f"(res_{a} - m_{a}) * ({' + '.join(terms)})"


@query("cal_04_contributions", S.with_(("scoped", "inv"), "SELECT channel, " + S.rs(["contribution_mean", "contribution_p95"]) + " FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS channel, avg({_part(c)}) AS contribution_mean, quantile_cont({_part(c)}, 0.95) AS contribution_p95 FROM (SELECT * FROM scoped WHERE scope_pump = -1) JOIN inv USING (scope_season, scope_pump)" for c in S.OUT) + ")"))
def contributions(spark: Spark, sf: str) -> DataFrame:
    own = materialize(_own_distances(spark, sf).where(F.col("scope_pump") == K.GLOBAL))
    return shape(K.contributions(own, V.OUTPUTS, ["scope_pump"]), ["channel", "contribution_mean", "contribution_p95"])


@query("cal_04_most_correlated", S.with_(("cov",), f"SELECT {S.i('scope_pump')}, channel, string_agg(other, ',' ORDER BY x DESC, o) AS top_correlated FROM (" + " UNION ALL ".join(
    f"SELECT scope_pump, '{a}' AS channel, '{b}' AS other, abs({'cov_' + a + '__' + b if S.OUT.index(a) < S.OUT.index(b) else 'cov_' + b + '__' + a}) / (sqrt(cov_{a}__{a}) * sqrt(cov_{b}__{b})) AS x, {-S.OUT.index(b)} AS o FROM cov"
    for a in S.OUT for b in S.OUT if a != b) + ") GROUP BY 1, 2"))
def most_correlated(spark: Spark, sf: str) -> DataFrame:
    cov = K.scope_moments(_normal(spark, sf), V.OUTPUTS)
    return shape(K.most_correlated(cov, V.OUTPUTS, ["scope_pump"]), ["scope_pump", "channel", "top_correlated"])


BLOCK = ["warning", "alarm", "mean", "std"]


@query("cal_05_pump_blocks", S.with_(("blocks1",), f"SELECT {S.i('scope_pump')}, {S.i('n')}, {S.i('fallback')}, {S.rs(BLOCK)} FROM blocks1"))
def pump_blocks(spark: Spark, sf: str) -> DataFrame:
    return shape(K.calibrate(_normal(spark, sf), V.OUTPUTS, features=False), ["scope_pump", "n", "fallback", *BLOCK])


@query("cal_06_seasonal_blocks", S.with_(("blocks4",), f"SELECT scope_season, {S.i('scope_pump')}, {S.i('n')}, {S.i('fallback')}, {S.rs(BLOCK)} FROM blocks4"))
def seasonal_blocks(spark: Spark, sf: str) -> DataFrame:
    return shape(K.calibrate(_normal(spark, sf), V.OUTPUTS, seasonal=True, features=False), ["scope_season", "scope_pump", "n", "fallback", *BLOCK])


WT = ["warning", "alarm", "mean", "std", "window_warning", "window_alarm", "mean_plus_2sigma", "mean_plus_3sigma", "day_warning", "day_alarm"]


@query("cal_07_window_thresholds", S.with_(("l2_thr",), f"SELECT {S.i('scope_pump')}, {S.i('n')}, {S.rs(WT)} FROM l2_thr"))
def window_thresholds(spark: Spark, sf: str) -> DataFrame:
    return shape(l2_thresholds(materialize(l2_windows(spark, sf))), ["scope_pump", "n", *WT])


@query("cal_08_calibration_check", S.with_(("l2_thr",), f"""SELECT {S.i('scope_pump')}, {S.r('alarm')}, CASE WHEN alarm / (mean * 3 + 1e-12) > 0.3 AND alarm / (mean * 3 + 1e-12) < 3.0 THEN 'GOOD' ELSE 'CHECK' END AS verdict FROM l2_thr"""))
def calibration_check(spark: Spark, sf: str) -> DataFrame:
    th = l2_thresholds(materialize(l2_windows(spark, sf)))
    return shape(th.withColumn("verdict", K.calibration_check(F.col("alarm"), F.col("mean") * 3)), ["scope_pump", "alarm", "verdict"])


@query("cal_09_recalibrate", S.with_(("l2_thr",), f"SELECT {S.i('scope_pump')}, {S.rs(['warning', 'alarm'])}, {S.r('CASE WHEN scope_pump = -1 THEN 0.5 END', 'youden')} FROM l2_thr"))
def recalibrate(spark: Spark, sf: str) -> DataFrame:
    stored = materialize(l2_windows(spark, sf).where(F.col("label") == "normal"))
    previous = K.window_thresholds(stored).where(F.col("scope_pump") == K.GLOBAL).withColumn("youden", F.lit(0.5))
    return shape(K.recalibrate(stored, previous), ["scope_pump", "warning", "alarm", "youden"])


S.cte("gdist", ("scoped", "inv"), f"""SELECT s.scope_pump, s.dist FROM (SELECT x.scope_pump, sqrt(greatest(0.0, {S.full_d2()})) AS dist FROM scoped x JOIN (SELECT * EXCLUDE (scope_season, scope_pump, n) FROM inv WHERE scope_pump = -1) g ON true) s""")
S.cte("conf", ("gdist",), """SELECT scope_pump, n, max(dist) FILTER (k = rank) AS q, max(ceil(round(0.95::DOUBLE * (n + 1), 9)) / (n + 1)) AS cov FROM (
  SELECT *, least(ceil(round(0.95::DOUBLE * (n + 1), 9)), n) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY scope_pump ORDER BY dist) AS k, count(*) OVER (PARTITION BY scope_pump) AS n FROM gdist)) GROUP BY 1, 2""")


def _global_distances(spark: Spark, sf: str) -> DataFrame:
    normal = _normal(spark, sf)
    everyone = normal.withColumns({"scope_season": F.lit(K.ALL_YEAR), "scope_pump": F.lit(K.GLOBAL)})
    block = K.invert(K.covariance(everyone, V.OUTPUTS), V.OUTPUTS).select(F.struct("mean_vec", "cov_inv")).scalar()
    held = normal.withColumn("_b", block)
    return held.select("pump_id", "season", C.distance(V.OUTPUTS, F.col("_b.mean_vec"), F.col("_b.cov_inv")).alias("distance"))


@query("cal_10_conformal_quantile", S.with_(("conf",), f"SELECT {S.i('scope_pump')}, {S.i('n')}, {S.r('q', 'conformal')} FROM conf"))
def conformal_quantile(spark: Spark, sf: str) -> DataFrame:
    d = K.with_scopes(materialize(_global_distances(spark, sf)))
    return shape(K.conformal_quantile(d, ["scope_pump"], "distance", 0.05), ["scope_pump", "n", "conformal"])


@query("cal_11_coverage", S.with_(("readings",), f"SELECT {S.i('pump_id')}, {S.i('n')}, {S.r('ceil(round(0.9::DOUBLE * (n + 1), 9)) / (n + 1)', 'coverage')} FROM (SELECT pump_id, count(*) AS n FROM readings GROUP BY 1)"))
def coverage(spark: Spark, sf: str) -> DataFrame:
    n = V.readings(spark, sf).groupBy("pump_id").agg(F.count(F.lit(1)).alias("n"))
    return shape(n.withColumn("coverage", K.conformal_coverage(F.col("n"), 0.1)))


S.cte("confb", ("conf",), """SELECT c.scope_pump, c.n, (c.scope_pump <> -1 AND c.n < 95) AS fallback, CASE WHEN c.scope_pump <> -1 AND c.n < 95 THEN g.q ELSE c.q END AS conformal,
  CASE WHEN c.scope_pump <> -1 AND c.n < 95 THEN g.cov ELSE c.cov END AS coverage FROM conf c, (SELECT * FROM conf WHERE scope_pump = -1) g""")


@query("cal_12_conformal_blocks", S.with_(("confb",), f"SELECT {S.i('scope_pump')}, {S.i('n')}, {S.i('fallback')}, {S.rs(['conformal', 'coverage'])} FROM confb"))
def conformal_blocks(spark: Spark, sf: str) -> DataFrame:
    return shape(K.conformal_blocks(materialize(_global_distances(spark, sf)), 0.05, 95), ["scope_pump", "n", "fallback", "conformal", "coverage"])


@query("cal_13_merge_conformal", S.with_(("confb", "blocks1"), f"SELECT {S.i('b.scope_pump', 'scope_pump')}, {S.r('warning')}, {S.r('c.conformal', 'conformal')} FROM blocks1 b LEFT JOIN (SELECT * FROM confb WHERE scope_pump % 2 <> 0) c ON b.scope_pump = c.scope_pump"))
def merge_conformal(spark: Spark, sf: str) -> DataFrame:
    """Only odd machines get conformal fields; the other blocks stay as they are."""
    blocks = l1_blocks(V.residual_rows(spark, sf))
    conf = K.conformal_blocks(materialize(_global_distances(spark, sf)), 0.05, 95).where(F.col("scope_pump") % 2 != 0)
    merged = K.merge_conformal(blocks, conf)
    return shape(merged.withColumn("conformal", F.col("conformal_quantile.conformal")), ["scope_pump", "warning", "conformal"])


@query("cal_14_scale_thresholds", S.with_(("blocks1",), f"SELECT {S.i('scope_pump')}, {S.r('warning * 1.1::DOUBLE', 'warning')}, {S.r('alarm * 0.95::DOUBLE', 'alarm')} FROM blocks1"))
def scale_thresholds(spark: Spark, sf: str) -> DataFrame:
    return shape(K.scale_thresholds(K.calibrate(_normal(spark, sf), V.OUTPUTS, features=False), 1.1, 0.95), ["scope_pump", "warning", "alarm"])


def _z(c: str) -> str:
    return f"abs((res_{c} - m_{c}) / greatest(s_{c}, 1e-12))"


S.cte("zsteps", ("l1_steps",), f"SELECT *, greatest({', '.join(_z(c) for c in S.OUT)}) AS max_z, greatest({_z('flow')}, {_z('outlet_pressure')}) AS subset_z FROM l1_steps")
S.cte("zlimits", ("zsteps",), """SELECT 'all' AS kind, pump_id, quantile_cont(max_z, 0.95) AS threshold FROM zsteps WHERE label = 'normal' GROUP BY pump_id
  UNION ALL SELECT 'subset', pump_id, quantile_cont(subset_z, 0.95) FROM zsteps WHERE label = 'normal' AND pump_id = 3 GROUP BY pump_id""")


def z_steps(spark: Spark, sf: str) -> DataFrame:
    s = l1_steps(spark, sf)
    mean, std = F.col("mean_vec"), F.col("std_vec")
    return s.withColumns({"max_z": K.max_z(V.OUTPUTS, mean, std), "subset_z": K.max_z(["flow", "outlet_pressure"], mean, std)})


@query("cal_15_max_z_thresholds", S.with_(("zlimits",), f"SELECT kind, {S.i('pump_id')}, {S.r('threshold')} FROM zlimits"))
def max_z_thresholds(spark: Spark, sf: str) -> DataFrame:
    s = materialize(z_steps(spark, sf).where(F.col("label") == "normal").select("pump_id", "max_z", "subset_z"))
    return shape(K.max_z_thresholds(s, 3))


@query("cal_16_refit")
def refit(spark: Spark, sf: str) -> DataFrame:
    """Global refit with ridge; the new matrix and mean replace those of the global block."""
    normal = _normal(spark, sf)
    fitted = K.refit(normal, V.OUTPUTS, 1e-3)
    blocks = K.replace_global(l1_blocks(V.residual_rows(spark, sf)), fitted)
    out = blocks.join(fitted.select("scope_pump", "condition_number"), "scope_pump", "left")
    flat = {f"inv_{c}": F.col(f"cov_inv.{c}.{c}") for c in V.OUTPUTS}
    return shape(out.withColumns(flat), ["scope_pump", "warning", "alarm", "condition_number", *flat])


S.cte("refit_inv", ("cov",), S.inverse_sql("cov", "1e-3"))


@query("cal_16_refit_matrix", S.with_(("refit_inv", "blocks1"), f"SELECT {S.i('b.scope_pump', 'scope_pump')}, {S.r('b.warning', 'warning')}, " + ", ".join(
    S.r(f"CASE WHEN b.scope_pump = -1 THEN f.i_{c}__{c} ELSE 1.0::DOUBLE / greatest(b.s_{c} * b.s_{c}, 1e-12) END", f"inv_{c}") for c in S.OUT) +
    " FROM blocks1 b, (SELECT * FROM refit_inv WHERE scope_pump = -1) f WHERE NOT b.fallback"))
def refit_matrix(spark: Spark, sf: str) -> DataFrame:
    """The replaced global matrix; pump blocks keep theirs."""
    res = V.residual_rows(spark, sf)
    fitted = K.refit(res.where(F.col("label") == "normal"), V.OUTPUTS, 1e-3)
    blocks = K.replace_global(l1_blocks(res), fitted).where(~F.col("fallback"))
    flat = {f"inv_{c}": F.col(f"cov_inv.{c}.{c}") for c in V.OUTPUTS}
    return shape(blocks.withColumns(flat), ["scope_pump", "warning", *flat])

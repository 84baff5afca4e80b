"""Registered queries: evaluation, monitoring, exploratory statistics, outlier models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rotorline.functions import formulas as X
from rotorline.operators import calibration as K
from rotorline.operators import eda as D
from rotorline.operators import evaluation as E
from rotorline.operators import monitoring as M
from rotorline.operators import outliers as O
from rotorline.plans import catalog_scoring as CS
from rotorline.plans import sql as S
from rotorline.plans import views as V
from rotorline.plans.catalog_sources import day_log
from rotorline.plans.registry import query, shape
from rotorline.session import materialize

Spark = SparkSession
ONE = "(SELECT 1 AS one)"

# Row-level score with many ties: the flow reading in whole units.
S.cte("marks", ("tagged",), "SELECT pump_id, date, ts, label, floor(flow / 4) AS score, flow FROM tagged WHERE flow IS NOT NULL")
S.cte("roc", ("marks",), """SELECT score, sum(p) OVER (ORDER BY score DESC) AS tp, sum(q) OVER (ORDER BY score DESC) AS fp, sum(q) OVER () - sum(q) OVER (ORDER BY score DESC) AS neg_below, p, q, sum(p) OVER () AS np, sum(q) OVER () AS nq
  FROM (SELECT score, count(*) FILTER (label = 'abnormal') AS p, count(*) FILTER (label = 'normal') AS q FROM marks GROUP BY 1)""")


def marks(spark: Spark, sf: str) -> DataFrame:
    r = V.tagged(V.readings(spark, sf)).where("flow IS NOT NULL")
    return r.select("pump_id", "date", "ts", "label", F.floor(F.col("flow") / 4).cast("double").alias("score"), "flow")


@query("eva_01_auc", S.with_(("roc",), f"SELECT {S.r('sum(p * (neg_below + q * 0.5)) / (max(np) * max(nq))', 'auc_roc')}, {S.i('max(np)', 'n_pos')}, {S.i('max(nq)', 'n_neg')} FROM roc"))
def auc(spark: Spark, sf: str) -> DataFrame:
    return shape(E.auc(marks(spark, sf)))


_PRF = f"{S.r('CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END', 'precision')}, {S.r('tp / np', 'recall')}, {S.r('2 * tp / (tp + fp + np)', 'f1')}"


@query("eva_02_youden", S.with_(("roc",), f"SELECT {S.r('score', 'threshold')}, {S.r('tp / np - fp / nq', 'youden_j')}, {_PRF} FROM roc ORDER BY round(tp / np - fp / nq, 12) DESC, score DESC LIMIT 1"))
def youden(spark: Spark, sf: str) -> DataFrame:
    return shape(E.youden_threshold(marks(spark, sf)))


@query("eva_03_best_f1", S.with_(("roc",), f"SELECT {S.r('score', 'threshold')}, {_PRF} FROM roc ORDER BY round(2 * tp / (tp + fp + np), 12) DESC, score LIMIT 1"))
def best_f1(spark: Spark, sf: str) -> DataFrame:
    return shape(E.f1_threshold(marks(spark, sf)))


S.cte("conf_at", ("marks",), """SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1, coalesce(ma, 0) / greatest(coalesce(mn, 1e-8), 1e-12) AS score_ratio FROM (
  SELECT pump_id, count(*) FILTER (score >= 10 AND label = 'abnormal') AS tp, count(*) FILTER (score >= 10 AND label <> 'abnormal') AS fp, count(*) FILTER (score < 10 AND label = 'abnormal') AS fn, count(*) FILTER (score < 10 AND label <> 'abnormal') AS tn,
    avg(score) FILTER (label = 'abnormal') AS ma, avg(score) FILTER (label <> 'abnormal') AS mn FROM marks GROUP BY 1)""")


@query("eva_04_at_threshold", S.with_(("conf_at",), f"SELECT {S.ins(['pump_id', 'tp', 'fp', 'fn', 'tn'])}, {S.rs(['precision', 'recall', 'f1', 'score_ratio'])} FROM conf_at"))
def at_threshold(spark: Spark, sf: str) -> DataFrame:
    out = E.at_threshold(marks(spark, sf), F.lit(10.0), by=["pump_id"])
    return shape(out, ["pump_id", "tp", "fp", "fn", "tn", "precision", "recall", "f1", "score_ratio"])


@query("eva_05_day_means", S.with_(("marks",), f"SELECT {S.SEGS}, label, {S.r('score')} FROM (SELECT pump_id, date, label, avg(flow) AS score FROM marks GROUP BY 1, 2, 3)"))
def day_means(spark: Spark, sf: str) -> DataFrame:
    return shape(E.day_means(marks(spark, sf), "flow", ["label"]), ["pump_id", "date", "label", "score"])


@query("eva_06_step_mse", S.with_(("res",), f"SELECT {S.STEPS}, {S.r('mse')} FROM (SELECT *, (" + " + ".join(f"res_{c} * res_{c}" for c in S.OUT) + ") / 3 AS mse FROM res)"))
def step_mse(spark: Spark, sf: str) -> DataFrame:
    r = V.residual_rows(spark, sf)
    return shape(r.withColumn("mse", X.mean_square([F.col(f"res_{c}") for c in V.OUTPUTS])), ["pump_id", "date", "ts", "mse"])


@query("eva_07_verdicts", S.with_(("tagged",), f"""SELECT {S.SEGS}, CASE WHEN a > 0.002 AND b > 0.1 THEN 'IMPROVEMENT' WHEN a < -0.002 AND b < -0.1 THEN 'REGRESSION' ELSE 'NEUTRAL' END AS calibration,
  CASE WHEN a > 0.005 THEN 'IMPROVEMENT' WHEN a < -0.002 THEN 'NO_CHANGE' WHEN abs(a) <= 0.005 THEN 'MARGINAL' ELSE 'NO_CHANGE' END AS weights FROM (
  SELECT pump_id, date, (avg(flow) - 45) / 2000 AS a, (avg(outlet_pressure) - 45) / 100 AS b FROM tagged GROUP BY 1, 2)"""))
def verdicts(spark: Spark, sf: str) -> DataFrame:
    d = V.tagged(V.readings(spark, sf)).groupBy("pump_id", "date").agg(
        ((F.avg("flow") - 45) / 2000).alias("a"), ((F.avg("outlet_pressure") - 45) / 100).alias("b"))
    return shape(d.select("pump_id", "date", E.verdict_calibration(F.col("a"), F.col("b")).alias("calibration"), E.verdict_weights(F.col("a")).alias("weights")))


# Two day errors per day: the basis of the grid experiments.
S.cte("pair_days", ("tagged",), "SELECT pump_id, date, label, avg(flow) / 100 AS e1, avg(de_bearing_temp) / 100 AS e2 FROM tagged GROUP BY 1, 2, 3 HAVING avg(flow) IS NOT NULL AND avg(de_bearing_temp) IS NOT NULL")


def pair_days(spark: Spark, sf: str) -> DataFrame:
    d = V.tagged(V.readings(spark, sf)).groupBy("pump_id", "date", "label").agg((F.avg("flow") / 100).alias("e1"), (F.avg("de_bearing_temp") / 100).alias("e2"))
    return d.dropna(subset=["e1", "e2"])


def _grid_ctes(name: str, values: list[float], score: str) -> None:
    S.cte(f"g_{name}", ("pair_days",), f"SELECT *, {score} AS score FROM pair_days, (SELECT unnest({values}::DOUBLE[]) AS g)")
    S.cte(f"groc_{name}", (f"g_{name}",), f"""SELECT *, sum(p) OVER (PARTITION BY g ORDER BY score DESC) AS tp, sum(q) OVER (PARTITION BY g ORDER BY score DESC) AS fp, sum(q) OVER (PARTITION BY g) - sum(q) OVER (PARTITION BY g ORDER BY score DESC) AS neg_below,
      sum(p) OVER (PARTITION BY g) AS np, sum(q) OVER (PARTITION BY g) AS nq FROM (SELECT g, score, count(*) FILTER (label = 'abnormal') AS p, count(*) FILTER (label = 'normal') AS q FROM g_{name} GROUP BY 1, 2)""")
    S.cte(f"gauc_{name}", (f"groc_{name}",), f"SELECT g, sum(p * (neg_below + q * 0.5)) / (max(np) * max(nq)) AS auc FROM groc_{name} GROUP BY 1")
    S.cte(f"gbest_{name}", (f"groc_{name}",), f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY round(2 * tp / (tp + fp + np), 12) DESC, score) AS k FROM groc_{name}) WHERE k = 1")


LAMBDAS = [0.0, 0.01, 0.1, 0.5, 1.0]
_grid_ctes("elbo", LAMBDAS, "e1 + g * e2")
_grid_ctes("pair", [0.0, 0.25, 0.5, 0.75, 1.0], "g * e1 + (1.0 - g) * e2")


def _grid_sql(name: str) -> str:
    return S.with_((f"gauc_{name}", f"gbest_{name}"), f"""SELECT {S.r('a.g', 'grid')}, {S.r('auc', 'auc_roc')}, {S.r('score', 'threshold')}, {_PRF}, {S.i('(row_number() OVER (ORDER BY round(auc, 9) DESC, a.g) = 1)::INT', 'is_best')}
      FROM gauc_{name} a JOIN gbest_{name} b ON a.g = b.g""")


GRID_OUT = ["grid", "auc_roc", "threshold", "precision", "recall", "f1", "is_best"]


@query("eva_08_lambda_grid", _grid_sql("elbo"))
def lambda_grid(spark: Spark, sf: str) -> DataFrame:
    return shape(E.grid_metrics(pair_days(spark, sf), "grid", LAMBDAS, F.col("e1") + F.col("grid") * F.col("e2")), GRID_OUT)


@query("eva_08_newly_caught", S.with_(("g_elbo", "gbest_elbo"), f"""SELECT {S.SEGS}, {S.r('g', 'grid')} FROM (SELECT d.pump_id, d.date, d.g FROM g_elbo d JOIN gbest_elbo b ON b.g = d.g
  WHERE d.label = 'abnormal' AND d.g >= 0.01 AND d.score >= b.score AND EXISTS (SELECT 1 FROM g_elbo z JOIN gbest_elbo y ON y.g = z.g WHERE z.g = 0 AND z.pump_id = d.pump_id AND z.date = d.date AND z.score < y.score))"""))
def newly_caught(spark: Spark, sf: str) -> DataFrame:
    return shape(E.newly_caught(pair_days(spark, sf), "grid", LAMBDAS, F.col("e1") + F.col("grid") * F.col("e2")))


@query("sco_16_pair_weight", _grid_sql("pair"))
def pair_weight(spark: Spark, sf: str) -> DataFrame:
    grid = [0.0, 0.25, 0.5, 0.75, 1.0]
    return shape(E.grid_metrics(pair_days(spark, sf), "grid", grid, E.pair_score(F.col("grid"), F.col("e1"), F.col("e2"))), GRID_OUT)


MODES = {"flow": "hydraulic", "outlet_pressure": "hydraulic", "de_bearing_temp": "mechanical_wear"}
S.cte("res_long", ("res",), " UNION ALL ".join(f"SELECT pump_id, date, label, '{c}' AS channel, res_{c} AS v FROM res" for c in S.OUT))
S.cte("zdays", ("res_long",), """SELECT d.pump_id, d.date, d.channel, (day_mean - mu) / greatest(sigma, 1e-12) AS z FROM (SELECT pump_id, date, channel, avg(v) AS day_mean FROM res_long WHERE label = 'abnormal' GROUP BY 1, 2, 3) d
  JOIN (SELECT pump_id, channel, avg(v) AS mu, stddev_samp(v) AS sigma FROM res_long WHERE label = 'normal' GROUP BY 1, 2) s USING (pump_id, channel)""")
S.cte("ztop", ("zdays",), "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pump_id, date ORDER BY abs(round(z, 9)) DESC, channel) AS place FROM zdays) WHERE place <= 2")


def z_days(spark: Spark, sf: str) -> DataFrame:
    r = V.residual_rows(spark, sf)
    return E.channel_z_days(r.where(F.col("label") == "normal"), r.where(F.col("label") == "abnormal"), V.OUTPUTS)


@query("eva_09_fault_isolation", S.with_(("ztop",), f"SELECT {S.SEGS}, channel, {S.i('place')}, {S.r('z')} FROM ztop"))
def fault_isolation(spark: Spark, sf: str) -> DataFrame:
    return shape(E.top_channels(z_days(spark, sf), 2), ["pump_id", "date", "channel", "place", "z"])


_MODE = "CASE WHEN channel IN ('flow', 'outlet_pressure') THEN 'hydraulic' ELSE 'mechanical_wear' END"
S.cte("ranking", ("ztop",), f"""SELECT *, row_number() OVER (ORDER BY n_days DESC, channel) AS rank FROM (SELECT c.channel, count(z.date) AS n_days, round(100.0 * count(z.date) / (SELECT count(*) FROM (SELECT DISTINCT pump_id, date FROM ztop)), 1) AS pct,
  {_MODE.replace('channel', 'c.channel')} AS failure_mode FROM (SELECT unnest(['flow', 'outlet_pressure', 'de_bearing_temp']) AS channel) c LEFT JOIN ztop z USING (channel) GROUP BY 1)""")


@query("eva_10_fault_ranking", S.with_(("ranking",), f"SELECT {S.i('rank')}, channel, {S.i('n_days')}, {S.r('pct')}, failure_mode FROM ranking"))
def fault_ranking(spark: Spark, sf: str) -> DataFrame:
    return shape(E.fault_ranking(materialize(E.top_channels(z_days(spark, sf), 2)), MODES), ["rank", "channel", "n_days", "pct", "failure_mode"])


@query("eva_10_pump_ranking", S.with_(("ztop",), f"""SELECT {S.i('pump_id')}, {S.i('rank')}, channel, {S.i('n_days')}, {S.r('pct')} FROM (SELECT *, row_number() OVER (PARTITION BY pump_id ORDER BY n_days DESC, channel) AS rank FROM (
  SELECT pump_id, channel, count(*) AS n_days, round(100.0 * count(*) / max(nd), 1) AS pct FROM ztop JOIN (SELECT pump_id, count(DISTINCT date) AS nd FROM ztop GROUP BY 1) USING (pump_id) GROUP BY 1, 2))"""))
def pump_ranking(spark: Spark, sf: str) -> DataFrame:
    return shape(E.fault_ranking(materialize(E.top_channels(z_days(spark, sf), 2)), MODES, per_pump=True), ["pump_id", "rank", "channel", "n_days", "pct"])


@query("eva_11_dominant_mode", S.with_(("ranking",), f"SELECT failure_mode, {S.i('n_channels')} FROM (SELECT failure_mode, count(*) AS n_channels, min(rank) AS f FROM ranking WHERE rank <= 5 GROUP BY 1) ORDER BY n_channels DESC, f LIMIT 1"))
def dominant_mode(spark: Spark, sf: str) -> DataFrame:
    return shape(E.dominant_mode(E.fault_ranking(materialize(E.top_channels(z_days(spark, sf), 2)), MODES)))


ALPHAS = list(E.ALPHA_GRID)
S.cte("sweep", ("day_inputs",), f"SELECT *, greatest(s1, coalesce(s2, s1)) + g * least(s1, coalesce(s2, s1)) AS score FROM day_inputs, (SELECT unnest({ALPHAS}::DOUBLE[]) AS g)")
S.cte("sweep_auc", ("sweep",), """SELECT g, round(sum(p * (neg_below + q * 0.5)) / (sum(p) * sum(q)), 4) AS auc FROM (SELECT *, sum(q) OVER (PARTITION BY g) - sum(q) OVER (PARTITION BY g ORDER BY score DESC) AS neg_below FROM (
  SELECT g, score, count(*) FILTER (label = 'abnormal') AS p, count(*) FILTER (label = 'normal') AS q FROM sweep GROUP BY 1, 2)) GROUP BY 1""")


@query("eva_12_fusion_sweep", S.with_(("sweep_auc",), f"""SELECT {S.r('g', 'alpha')}, {S.r('w', 'health_weight')}, {S.r('auc', 'auc_roc')}, {S.i('(k = 1)::INT', 'is_best')} FROM (SELECT *, row_number() OVER (ORDER BY auc DESC, g) AS k FROM sweep_auc),
  (SELECT unnest({list(E.HEALTH_WEIGHTS)}::DOUBLE[]) AS w)"""))
def fusion_sweep(spark: Spark, sf: str) -> DataFrame:
    return shape(E.fusion_sweep(CS.day_inputs(spark, sf)), ["alpha", "health_weight", "auc_roc", "is_best"])


# Both step scores of labelled days from the readings, thresholds per machine.
S.cte("two", ("tagged",), "SELECT pump_id, date, ts, label, coalesce(flow, 0.0) AS l1, outlet_pressure AS l2 FROM tagged")
S.cte("limits", ("two",), "SELECT pump_id, quantile_cont(l1, 0.6) AS l1_warning, quantile_cont(l1, 0.9) AS l1_alarm, quantile_cont(l2, 0.7) AS l2_warning, quantile_cont(l2, 0.95) AS l2_alarm FROM two WHERE label = 'normal' GROUP BY 1")


def two_levels(spark: Spark, sf: str) -> DataFrame:
    r = V.grid(spark, sf)
    return r.select("pump_id", "date", "ts", "label", F.coalesce("flow", F.lit(0.0)).alias("l1"), F.col("outlet_pressure").alias("l2"))


def limits(steps: DataFrame) -> DataFrame:
    from rotorline.functions.ordered import exact_quantiles

    n = steps.where(F.col("label") == "normal")
    one = exact_quantiles(n, ["pump_id"], "l1", {"l1_warning": 0.6, "l1_alarm": 0.9})
    return materialize(one.join(exact_quantiles(n, ["pump_id"], "l2", {"l2_warning": 0.7, "l2_alarm": 0.95}), "pump_id"))


def _flag_sql(m1: str = "1.0", m2: str = "1.0", extra: str = "") -> str:
    return f"""SELECT pump_id, date, label{extra}, (count(*) FILTER (l1 >= l1_warning * {m1} OR coalesce(l2 >= l2_warning * {m2}, false)) >= 4)::INT AS flagged"""


RATE = ["n_normal", "n_abnormal", "n_false", "n_detected"]
_RATE_SQL = """count(*) FILTER (label = 'normal') AS n_normal, count(*) FILTER (label = 'abnormal') AS n_abnormal, coalesce(sum(flagged) FILTER (label = 'normal'), 0) AS n_false, coalesce(sum(flagged) FILTER (label = 'abnormal'), 0) AS n_detected"""
S.cte("flags", ("two", "limits"), _flag_sql() + " FROM two JOIN limits USING (pump_id) GROUP BY 1, 2, 3")
S.cte("rates", ("flags",), f"SELECT *, coalesce(n_false / nullif(n_normal, 0), 0) AS fa_rate, coalesce(n_detected / nullif(n_abnormal, 0), 0) AS detection_rate FROM (SELECT pump_id, {_RATE_SQL} FROM flags GROUP BY GROUPING SETS ((pump_id), ()))")


@query("eva_13_threshold_evaluation", S.with_(("rates",), f"SELECT {S.i('pump_id')}, {S.ins(RATE)}, {S.rs(['fa_rate', 'detection_rate'])} FROM rates"))
def threshold_evaluation(spark: Spark, sf: str) -> DataFrame:
    s = two_levels(spark, sf)
    return shape(E.evaluate_thresholds(s, limits(s), 4), ["pump_id", *RATE, "fa_rate", "detection_rate"])


MULTS = E.multiplier_grid(5)
S.cte("mgrid", (), f"SELECT unnest({MULTS}::DOUBLE[]) AS m")
S.cte("gflags", ("two", "limits", "mgrid"), _flag_sql("a.m", "b.m", ", a.m AS m1, b.m AS m2") + " FROM two JOIN limits USING (pump_id), mgrid a, mgrid b GROUP BY pump_id, date, label, a.m, b.m")
S.cte("grates", ("gflags",), f"SELECT *, coalesce(n_false / nullif(n_normal, 0), 0) AS fa_rate, coalesce(n_detected / nullif(n_abnormal, 0), 0) AS det FROM (SELECT m1, m2, pump_id, {_RATE_SQL} FROM gflags GROUP BY GROUPING SETS ((m1, m2, pump_id), (m1, m2)))")


@query("eva_14_multiplier_search", S.with_(("grates", "rates", "limits", "mgrid"), f"""SELECT {S.r('m1', 'l1_mult')}, {S.r('a1.m', 'l1_alarm_mult')}, {S.r('m2', 'l2_mult')}, {S.r('a2.m', 'l2_alarm_mult')}, {S.r('g.fa_rate', 'fa_rate')}, {S.i('g.n_false', 'n_false')}, {S.r('g.det', 'detection_rate')}
  FROM grates g, mgrid a1, mgrid a2 WHERE g.pump_id IS NULL AND NOT EXISTS (SELECT 1 FROM grates x JOIN rates y ON x.pump_id = y.pump_id WHERE x.m1 = g.m1 AND x.m2 = g.m2 AND x.det < y.detection_rate)
  AND NOT EXISTS (SELECT 1 FROM limits WHERE l1_warning / l1_alarm * g.m1 >= a1.m) AND NOT EXISTS (SELECT 1 FROM limits WHERE l2_warning / l2_alarm * g.m2 >= a2.m)"""))
def multiplier_search(spark: Spark, sf: str) -> DataFrame:
    s = two_levels(spark, sf)
    return shape(E.multiplier_search(s, limits(s), 5, 4))


def _total_sql(alias: str, where: str, m1: str, m2: str) -> str:
    return f"""(SELECT coalesce(sum(flagged) FILTER (label = 'normal') / nullif(count(*) FILTER (label = 'normal'), 0), 0) AS fa, coalesce(sum(flagged) FILTER (label = 'abnormal') / nullif(count(*) FILTER (label = 'abnormal'), 0), 0) AS det FROM (
      {_flag_sql(m1, m2)} FROM two JOIN limits USING (pump_id) WHERE {where} GROUP BY 1, 2, 3)) {alias}"""


def _pumps_sql(m1: str, m2: str) -> str:
    return f"SELECT pump_id, coalesce(sum(flagged) FILTER (label = 'abnormal') / nullif(count(*) FILTER (label = 'abnormal'), 0), 0) AS det FROM ({_flag_sql(m1, m2)} FROM two JOIN limits USING (pump_id) WHERE day(date) > 20 GROUP BY 1, 2, 3) GROUP BY 1"


@query("eva_15_holdout_check", S.with_(("two", "limits"), f"""SELECT {S.r('fa_rate')}, {S.r('baseline_fa_rate')}, {S.r('cut', 'fa_cut_pp')}, {S.r('detection_rate')}, {S.i('pumps_worse')}, {S.r('abs(ocut - cut)', 'overfit_gap_pp')}, {S.i('(cut >= 5 AND pumps_worse = 0 AND abs(ocut - cut) < 3)::INT', 'accepted')} FROM (
  SELECT n.fa AS fa_rate, b.fa AS baseline_fa_rate, (b.fa - n.fa) * 100 AS cut, n.det AS detection_rate, (ob.fa - og.fa) * 100 AS ocut, (SELECT count(*) FROM ({_pumps_sql('1.15', '1.3')}) x JOIN ({_pumps_sql('1.0', '1.0')}) y USING (pump_id) WHERE x.det < y.det) AS pumps_worse
  FROM {_total_sql('n', 'day(date) > 20', '1.15', '1.3')}, {_total_sql('b', 'day(date) > 20', '1.0', '1.0')}, {_total_sql('og', 'day(date) <= 20', '1.15', '1.3')}, {_total_sql('ob', 'day(date) <= 20', '1.0', '1.0')})"""))
def holdout_check(spark: Spark, sf: str) -> DataFrame:
    s = two_levels(spark, sf)
    late = F.dayofmonth("date") > 20
    return shape(E.holdout_check(s.where(~late), s.where(late), limits(s), (1.15, 1.3), 4))


@query("eva_16_seasonal_evaluation", S.with_(("flags",), f"""SELECT {S.i('pump_id')}, {S.rs(['fa_rate', 'detection_rate'])}, {S.i('CASE WHEN pump_id IS NULL THEN (fa_rate <= 0.5 + 0.05)::INT ELSE coalesce((0.8 - detection_rate <= 0.02)::INT, 1) END', 'gate_ok')} FROM (
  SELECT *, coalesce(n_false / nullif(n_normal, 0), 0) AS fa_rate, coalesce(n_detected / nullif(n_abnormal, 0), 0) AS detection_rate FROM (SELECT pump_id, {_RATE_SQL} FROM flags GROUP BY GROUPING SETS ((pump_id), ())))"""))
def seasonal_evaluation(spark: Spark, sf: str) -> DataFrame:
    s = two_levels(spark, sf)
    th = limits(s)
    flags = materialize(E.day_alerts(E.step_histogram(s, th, [1.0]), [1.0], 4).drop("l1_mult", "l2_mult"))
    pumps = flags.select("pump_id").distinct().unionByName(flags.agg(F.lit(None).cast("int").alias("pump_id")))
    baseline = pumps.withColumns({"base_fa": F.lit(0.5), "base_det": F.lit(0.8)})
    return shape(E.against_baseline(flags, baseline, 0.05, 0.02), ["pump_id", "fa_rate", "detection_rate", "gate_ok"])


S.cte("policies", ("zsteps", "zlimits"), """SELECT pump_id, date, label, (count(*) FILTER (far) >= 2)::INT AS baseline, (count(*) FILTER (far OR sub) >= 2)::INT AS policy1, (count(*) FILTER (far OR high) >= 2)::INT AS policy2, (count(*) FILTER (high) >= 2)::INT AS policy3 FROM (
  SELECT z.pump_id, z.date, z.label, z.dist >= z.warning AS far, coalesce(z.max_z >= l.threshold, false) AS high, z.pump_id = 3 AND z.subset_z >= (SELECT threshold FROM zlimits WHERE kind = 'subset') AS sub
  FROM zsteps z LEFT JOIN (SELECT * FROM zlimits WHERE kind = 'all') l USING (pump_id)) GROUP BY 1, 2, 3""")


def policy_flags(spark: Spark, sf: str) -> DataFrame:
    s = materialize(CS.z_steps(spark, sf).select("pump_id", "date", "label", "distance", "warning", "max_z", "subset_z"))
    th = materialize(K.max_z_thresholds(s.where(F.col("label") == "normal"), 3))
    per_pump = th.where(F.col("kind") == "all").select("pump_id", F.col("threshold").alias("z_limit"))
    subset = th.where(F.col("kind") == "subset").select("threshold").scalar()
    return E.policy_flags(s, 3, per_pump, subset, k=2)


POL = ["baseline", "policy1", "policy2", "policy3"]


@query("eva_17_policy_flags", S.with_(("policies",), f"SELECT {S.SEGS}, label, {S.ins(POL)} FROM policies"))
def policy_flag_days(spark: Spark, sf: str) -> DataFrame:
    return shape(policy_flags(spark, sf), ["pump_id", "date", "label", *POL])


_POLM = " UNION ALL ".join(f"""SELECT '{p}' AS policy, count(*) FILTER (label = 'normal') AS n_normal, count(*) FILTER (label = 'abnormal') AS n_abnormal, count(*) FILTER (label = 'normal' AND {p} = 1) AS n_fa, count(*) FILTER (label = 'abnormal' AND {p} = 1) AS n_det,
  count(*) FILTER (label = 'normal' AND pump_id = 3) AS s_normal, count(*) FILTER (label = 'normal' AND pump_id = 3 AND {p} = 1) AS s_fa, count(*) FILTER (label = 'abnormal' AND pump_id = 3 AND {p} = 1 AND baseline = 0) AS recovered FROM policies""" for p in POL)
S.cte("polm", ("policies",), f"SELECT *, round(n_fa / greatest(n_normal, 1), 4) AS fa_rate, round(n_det / greatest(n_abnormal, 1), 4) AS det_rate, round(s_fa / greatest(s_normal, 1), 4) AS s_fa_rate FROM ({_POLM})")


@query("eva_18_policy_metrics", S.with_(("polm",), f"""SELECT m.policy AS policy, {', '.join(S.i('m.' + c, c) for c in ('n_fa', 'n_det', 's_fa', 'recovered'))}, {S.r('m.fa_rate', 'fa_rate')}, {S.r('m.det_rate', 'det_rate')},
  {S.i('(m.recovered >= 10 AND round((m.fa_rate - b.fa_rate) * 100, 6) <= 3 AND round((m.s_fa_rate - b.s_fa_rate) * 100, 6) <= 5)::INT', 'accepted')} FROM polm m, (SELECT * FROM polm WHERE policy = 'baseline') b"""))
def policy_metrics(spark: Spark, sf: str) -> DataFrame:
    return shape(E.policy_metrics(materialize(policy_flags(spark, sf)), 3), ["policy", "n_fa", "n_det", "s_fa", "recovered", "fa_rate", "det_rate", "accepted"])


SWEEP = [0.5, 1.0, 1.5, 2.0, 2.5, 3.0, 4.0]


@query("eva_19_z_sweep", S.with_(("zsteps", "policies"), f"""SELECT {S.r('t', 'threshold')}, {S.ins(['recovered', 'n_missed', 'detected_above'])}, {S.r('round(100.0 * recovered / greatest(n_missed, 1), 1)', 'pct_recovered')}, {S.i('coalesce((t = max(t) FILTER (recovered >= 10) OVER ())::INT, 0)', 'recommended')} FROM (
  SELECT t, count(*) FILTER (grp = 'missed' AND z >= t) AS recovered, count(*) FILTER (grp = 'missed') AS n_missed, count(*) FILTER (grp = 'detected' AND z >= t) AS detected_above FROM (
    SELECT pump_id, date, CASE WHEN baseline = 1 THEN 'detected' ELSE 'missed' END AS grp, max(max_z) AS z FROM zsteps JOIN policies USING (pump_id, date) WHERE zsteps.label = 'abnormal' GROUP BY 1, 2, 3), (SELECT unnest({SWEEP}::DOUBLE[]) AS t) GROUP BY 1)"""))
def z_sweep(spark: Spark, sf: str) -> DataFrame:
    s = materialize(CS.z_steps(spark, sf).select("pump_id", "date", "label", "distance", "warning", "max_z"))
    days = s.where(F.col("label") == "abnormal").groupBy("pump_id", "date").agg(
        F.max("max_z").alias("peak_z"), (F.count(F.when(F.col("distance") >= F.col("warning"), 1)) >= 2).alias("_hit"))
    return shape(E.z_sweep(days.withColumn("grp", F.when(F.col("_hit"), "detected").otherwise("missed")), SWEEP))


RATE_Z = E.normal_exceed_rate(2.0, 3)


@query("eva_20_expected_false_days", S.with_(("tagged",), f"""SELECT {S.i('pump_id')}, {S.i('n_days')}, {S.r('expected_days')} FROM (SELECT pump_id, count(*) AS n_days, sum(CASE WHEN n < 3 THEN 0.0 ELSE greatest(0.0, 1.0::DOUBLE
  - (pow(q, n) + n * p * pow(q, n - 1) + (n * (n - 1) / 2) * p * p * pow(q, n - 2))) END) AS expected_days FROM (SELECT *, {RATE_Z!r}::DOUBLE AS p, 1.0::DOUBLE - {RATE_Z!r}::DOUBLE AS q FROM (
    SELECT pump_id, date, count(*) AS n FROM tagged WHERE label = 'normal' AND flow IS NOT NULL GROUP BY 1, 2)) GROUP BY 1)"""))
def expected_false_days(spark: Spark, sf: str) -> DataFrame:
    days = V.tagged(V.readings(spark, sf)).where("flow IS NOT NULL").groupBy("pump_id", "date", "label").agg(F.count(F.lit(1)).alias("n_steps"))
    return shape(E.expected_false_days(days, RATE_Z))


@query("eva_21_day_profile", S.with_(("l1_steps",), f"""SELECT grp, {S.SEGS}, {S.rs(['mean', 'max', 'p50', 'p95', 'gap_to_warning'])} FROM (SELECT CASE WHEN count(*) FILTER (dist >= warning) >= 1 THEN 'detected' ELSE 'missed' END AS grp, pump_id, date, avg(dist) AS mean, max(dist) AS max,
  quantile_cont(dist, 0.5) AS p50, quantile_cont(dist, 0.95) AS p95, max(warning) - max(dist) AS gap_to_warning FROM l1_steps WHERE label = 'abnormal' GROUP BY pump_id, date)"""))
def day_profile(spark: Spark, sf: str) -> DataFrame:
    s = materialize(CS.l1_steps(spark, sf).where(F.col("label") == "abnormal").select("pump_id", "date", "distance", "warning"))
    hit = F.count(F.when(F.col("distance") >= F.col("warning"), 1)) >= 1
    days = s.groupBy("pump_id", "date").agg(F.when(hit, "detected").otherwise("missed").alias("grp"))
    return shape(E.day_profile(days, s, "distance", "grp"), ["grp", "pump_id", "date", "mean", "max", "p50", "p95", "gap_to_warning"])


# Benchmark runs: an order is a run of the model named by status and priority.
S.cte("bruns", (), """SELECT o_orderpriority || '/' || o_orderstatus AS model, o_orderkey AS run, CASE WHEN o_custkey % 2 = 0 THEN 'neural' ELSE 'classical' END AS model_type, (o_totalprice % 1000) / 1000 AS auc_roc, (o_totalprice % 777) / 777 AS f1,
  o_custkey % 97 AS seconds, CASE WHEN o_orderkey % 7 = 0 THEN 'failed' END AS error FROM orders""")


def runs(spark: Spark, sf: str) -> DataFrame:
    o, price = V.table(spark, sf, "orders"), F.col("o_totalprice")
    return o.select(
        F.concat_ws("/", "o_orderpriority", "o_orderstatus").alias("model"), F.col("o_orderkey").alias("run"),
        F.when(F.col("o_custkey") % 2 == 0, "neural").otherwise("classical").alias("model_type"), (price % 1000 / 1000).alias("auc_roc"),
        (price % 777 / 777).alias("f1"), (F.col("o_custkey") % 97).alias("seconds"), F.when(F.col("o_orderkey") % 7 == 0, "failed").alias("error"))


@query("eva_22_benchmark_table", S.with_(("bruns",), f"""SELECT model, {S.i('rank')}, {S.r('auc_roc')}, {S.r('f1')}, {S.i('bf::INT', 'best_f1')}, {S.i('fa::INT', 'fastest')}, {S.i('bt::INT', 'best_of_type')} FROM (SELECT *, row_number() OVER (ORDER BY auc_roc DESC, model) AS rank, row_number() OVER (ORDER BY f1 DESC, model) = 1 AS bf,
  row_number() OVER (ORDER BY seconds, model) = 1 AS fa, row_number() OVER (PARTITION BY model_type ORDER BY auc_roc DESC, model) = 1 AS bt FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY run DESC) AS k FROM bruns) WHERE k = 1 AND error IS NULL)"""))
def benchmark_table(spark: Spark, sf: str) -> DataFrame:
    return shape(E.benchmark_table(runs(spark, sf), "run"), ["model", "rank", "auc_roc", "f1", "best_f1", "fastest", "best_of_type"])


@query("eva_25_run_summary", S.with_(("res_long",), f"""SELECT {S.r('n', 'normal_mse')}, {S.r('a', 'abnormal_mse')}, {S.r('a / n', 'val_ratio')} FROM (SELECT avg(m) FILTER (label = 'normal') AS n, avg(m) FILTER (label = 'abnormal') AS a FROM (
  SELECT label, channel, avg(v * v) AS m FROM res_long GROUP BY 1, 2))"""))
def run_summary(spark: Spark, sf: str) -> DataFrame:
    long = K.unpivot(V.residual_rows(spark, sf), V.OUTPUTS, ["label"])
    return shape(E.run_summary(long.select("label", "channel", (F.col("value") * F.col("value")).alias("mse"))))


@query("eva_26_trial_table", S.with_(("bruns",), f"""SELECT {S.i('place')}, {S.i('trial')}, {S.r('f1')}, {S.r('auc_roc')} FROM (SELECT run AS trial, round(f1, 2) AS f1, round(auc_roc, 2) AS auc_roc, row_number() OVER (ORDER BY round(f1, 2) DESC, round(auc_roc, 2) DESC, seconds DESC, run) AS place FROM bruns WHERE error IS NULL) WHERE place <= 15"""))
def trial_table(spark: Spark, sf: str) -> DataFrame:
    t = runs(spark, sf).select(
        F.col("run").alias("trial"), F.round("f1", 2).alias("f1"), F.round("auc_roc", 2).alias("auc_roc"), F.col("seconds").alias("ratio"),
        F.coalesce("error", F.lit("ok")).alias("state"))
    return shape(E.trial_table(t), ["place", "trial", "f1", "auc_roc"])


# --- monitoring ----------------------------------------------------------------

# A day log over the readings: two day scores, the season and the day status.
S.cte("log", ("tagged",), "SELECT pump_id, date, avg(flow) / 10 AS l1_mean, avg(outlet_pressure) / 100 AS l2_mean, CASE WHEN day(date) % 5 = 0 THEN '' ELSE max(season) END AS season, CASE WHEN (day(date) + pump_id) % 4 = 0 THEN 'WARNING' ELSE ' Normal ' END AS day_status FROM tagged GROUP BY 1, 2")


def log(spark: Spark, sf: str) -> DataFrame:
    r = V.tagged(V.readings(spark, sf))
    return r.groupBy("pump_id", "date").agg(
        (F.avg("flow") / 10).alias("l1_mean"), (F.avg("outlet_pressure") / 100).alias("l2_mean"),
        F.when(F.dayofmonth("date") % 5 == 0, "").otherwise(F.max("season")).alias("season"),
        F.when((F.dayofmonth("date") + F.col("pump_id")) % 4 == 0, "WARNING").otherwise(" Normal ").alias("day_status"))


S.cte("nlog", ("log",), "SELECT * FROM log WHERE lower(trim(day_status)) = 'normal'")
S.cte("rolled", ("nlog",), "SELECT pump_id, avg(l1_mean) FILTER (k <= 20) AS l1_rolling_mean, avg(l2_mean) FILTER (k <= 20) AS l2_rolling_mean, count(*) AS n_normal_days, max(date) AS last_date FROM (SELECT *, row_number() OVER (PARTITION BY pump_id ORDER BY date DESC) AS k FROM nlog) GROUP BY 1")


@query("mon_01_day_log", S.with_(("l1_days", "l2_days"), f"SELECT {S.SEGS}, {S.r('a.day_mean', 'l1_mean')}, {S.r('b.day_smoothed', 'l2_mean')}, a.status AS day_status, " +
    S.SEASON.format("a.date") + " AS season FROM l1_days a LEFT JOIN l2_days b USING (pump_id, date)"))
def day_log_rows(spark: Spark, sf: str) -> DataFrame:
    return shape(day_log(spark, sf), ["pump_id", "date", "l1_mean", "l2_mean", "day_status", "season"])


_DRIFT = """SELECT pump_id, metric, rolling_mean, (rolling_mean - t) / t AS drift, CASE WHEN abs((rolling_mean - t) / t) >= 0.30 THEN 'CRITICAL' WHEN abs((rolling_mean - t) / t) >= 0.15 THEN 'WARNING' END AS level FROM (
  SELECT pump_id, 'l1_mahalanobis' AS metric, l1_rolling_mean AS rolling_mean, 3.5::DOUBLE AS t FROM rolled WHERE n_normal_days >= 15 UNION ALL SELECT pump_id, 'l2_smoothed_mse', l2_rolling_mean, 0.7::DOUBLE FROM rolled WHERE n_normal_days >= 15)"""
S.cte("drifted", ("rolled",), f"SELECT * FROM ({_DRIFT}) WHERE level IS NOT NULL")


def _drift(spark: Spark, sf: str) -> DataFrame:
    training = spark.createDataFrame([("l1_mahalanobis", 3.5), ("l2_smoothed_mse", 0.7)], "metric string, training_mean double")
    return M.drift(log(spark, sf), training, 20)


@query("mon_02_drift", S.with_(("drifted",), f"SELECT {S.i('pump_id')}, metric, {S.rs(['rolling_mean', 'drift'])}, level FROM drifted"))
def drift(spark: Spark, sf: str) -> DataFrame:
    return shape(_drift(spark, sf), ["pump_id", "metric", "rolling_mean", "drift", "level"])


@query("mon_03_rolling_stats", S.with_(("rolled",), f"SELECT {S.i('pump_id')}, {S.rs(['l1_rolling_mean', 'l2_rolling_mean'])}, {S.i('n_normal_days')}, {S.d('last_date', 'last_date')} FROM rolled"))
def rolling_stats(spark: Spark, sf: str) -> DataFrame:
    return shape(M.rolling_stats(log(spark, sf), 20), ["pump_id", "l1_rolling_mean", "l2_rolling_mean", "n_normal_days", "last_date"])


@query("mon_04_recalibration", S.with_(("log",), f"""SELECT {S.SEGS}, CASE WHEN day(date) = 13 THEN 'post_maintenance' WHEN l1_mean > 7 THEN 'drift_alert' WHEN month(date) IN (1, 4, 7, 10) AND (pump_id = 2 OR date - DATE '2023-10-20' > 85) THEN 'quarterly' ELSE 'none' END AS reason FROM log"""))
def recalibration(spark: Spark, sf: str) -> DataFrame:
    last = F.when(F.col("pump_id") != 2, F.lit("2023-10-20").cast("date"))
    alerts = F.when(F.col("l1_mean") > 7, 1).otherwise(0)
    reason = M.recalibration_reason(F.col("date"), last, alerts, F.dayofmonth("date") == 13)
    return shape(log(spark, sf).select("pump_id", "date", reason.alias("reason")))


S.cte("old_thr", ("readings",), "SELECT pump_id, avg(flow) AS warning, max(flow) AS alarm, CASE WHEN pump_id = 2 THEN 0.0 ELSE min(flow) END AS mean FROM readings WHERE day(date) <= 15 AND pump_id <> 3 GROUP BY 1")
S.cte("new_thr", ("readings",), "SELECT pump_id, avg(flow) AS warning, max(flow) AS alarm, min(flow) AS mean FROM readings WHERE day(date) > 15 AND pump_id <> 4 GROUP BY 1")
S.cte("thr_change", ("old_thr", "new_thr"), "SELECT *, CASE WHEN o IS NULL OR abs(o) <= 1e-8 THEN (CASE WHEN n IS NULL OR abs(n) <= 1e-8 THEN 0.0 ELSE 'inf'::DOUBLE END) ELSE (n - o) / o END AS pct FROM (" + " UNION ALL ".join(
    f"SELECT pump_id, '{m}' AS metric, a.{m} AS o, b.{m} AS n FROM old_thr a FULL JOIN new_thr b USING (pump_id)" for m in ("warning", "alarm", "mean")) + ") WHERE o IS NOT NULL OR n IS NOT NULL")


def _changes(spark: Spark, sf: str) -> DataFrame:
    r, day, p = V.readings(spark, sf), F.dayofmonth("date"), F.col("pump_id")
    old = r.where((day <= 15) & (p != 3)).groupBy("pump_id").agg(F.avg("flow").alias("warning"), F.max("flow").alias("alarm"), F.min("flow").alias("mean"))
    old = old.withColumn("mean", F.when(p == 2, 0.0).otherwise(F.col("mean")))
    new = r.where((day > 15) & (p != 4)).groupBy("pump_id").agg(F.avg("flow").alias("warning"), F.max("flow").alias("alarm"), F.min("flow").alias("mean"))
    return M.compare_thresholds(old, new, ["warning", "alarm", "mean"])


@query("mon_05_compare_thresholds", S.with_(("thr_change",), f"SELECT {S.i('pump_id')}, metric, {S.r('o', 'old')}, {S.r('n', 'new')}, {S.r('CASE WHEN isinf(pct) THEN 999999 ELSE pct END', 'pct_change')} FROM thr_change"))
def compare_thresholds(spark: Spark, sf: str) -> DataFrame:
    c = _changes(spark, sf)
    return shape(c.withColumn("pct_change", F.when(F.col("pct_change") == float("inf"), 999999.0).otherwise(F.col("pct_change"))), ["pump_id", "metric", "old", "new", "pct_change"])


@query("mon_06_should_apply", S.with_(("thr_change",), f"SELECT {S.i('coalesce(bool_or(abs(pct) > 0.05), false)::INT', 'apply')} FROM thr_change"))
def should_apply(spark: Spark, sf: str) -> DataFrame:
    return shape(M.should_apply(_changes(spark, sf)))


S.cte("slog", ("nlog",), "SELECT pump_id, CASE WHEN lower(coalesce(season, '')) = '' THEN " + S.SEASON.format("date") + " ELSE lower(season) END AS season, l1_mean, l2_mean FROM nlog WHERE l1_mean IS NOT NULL")
S.cte("sstats", ("slog",), "SELECT pump_id, season, avg(l1_mean) AS l1_avg, stddev_pop(l1_mean) AS l1_std, avg(l2_mean) AS l2_avg, stddev_pop(l2_mean) AS l2_std, count(*) AS n_days FROM slog GROUP BY 1, 2")
SS = ["l1_avg", "l1_std", "l2_avg", "l2_std"]


@query("mon_08_seasonal_stats", S.with_(("sstats",), f"SELECT {S.i('pump_id')}, season, {S.rs(SS)}, {S.i('n_days')} FROM sstats"))
def seasonal_stats(spark: Spark, sf: str) -> DataFrame:
    return shape(M.seasonal_stats(log(spark, sf)), ["pump_id", "season", *SS, "n_days"])


@query("mon_09_seasonal_deviation", S.with_(("sstats",), f"""SELECT {S.i('pump_id')}, season, {S.r('z1', 'z_l1')}, {S.i('coalesce((abs(z1) >= 0.9)::INT, 0)', 'deviates_l1')} FROM (SELECT pump_id, season, n_days, CASE WHEN s > 0 THEN (l1_avg - m) / s END AS z1 FROM (
  SELECT *, CASE WHEN pump_id = 1 THEN 4.0 ELSE avg(l1_avg) OVER (PARTITION BY pump_id) END AS m, CASE WHEN pump_id = 1 THEN 0.5 ELSE stddev_pop(l1_avg) OVER (PARTITION BY pump_id) END AS s FROM sstats)) WHERE n_days >= 10"""))
def seasonal_deviation(spark: Spark, sf: str) -> DataFrame:
    stats = M.seasonal_stats(log(spark, sf))
    stored = stats.where(F.col("pump_id") == 1).select(
        "pump_id", "season", F.lit(4.0).alias("l1_mean"), F.lit(0.5).alias("l1_std"), F.lit(0.4).alias("l2_mean"), F.lit(0.1).alias("l2_std"))
    return shape(M.seasonal_deviation(stats, stored, 0.9), ["pump_id", "season", "z_l1", "deviates_l1"])


@query("mon_10_seasonal_report", S.with_(("sstats",), f"""SELECT {S.i('pump_id')}, season, {S.i('coalesce(n_days, 0)', 'n_days')}, CASE WHEN l1_avg IS NULL THEN '-' ELSE 'shown' END AS l1_shown FROM (SELECT DISTINCT pump_id FROM sstats),
  (SELECT unnest(['winter', 'spring', 'summer', 'autumn']) AS season) LEFT JOIN sstats USING (pump_id, season)""".replace("(SELECT DISTINCT pump_id FROM sstats),", "((SELECT DISTINCT pump_id FROM sstats) CROSS JOIN").replace("AS season) LEFT", "AS season)) LEFT")))
def seasonal_report(spark: Spark, sf: str) -> DataFrame:
    rep = M.seasonal_report(M.seasonal_stats(log(spark, sf)))
    return shape(rep.withColumn("l1_shown", F.when(F.col("l1_avg") == "-", "-").otherwise("shown")), ["pump_id", "season", "n_days", "l1_shown"])


# --- exploratory statistics ------------------------------------------------------

S.cte("hist_edges", ("marks",), "SELECT CASE WHEN b <= a THEN lo ELSE a END AS lo, CASE WHEN b <= a THEN hi ELSE b END AS hi FROM (SELECT quantile_cont(flow, 0.005) AS a, quantile_cont(flow, 0.995) AS b, min(flow) AS lo, max(flow) AS hi FROM marks)")
S.cte("hist", ("marks", "hist_edges"), "SELECT label, least(floor((flow - lo) * 49.0::DOUBLE / (hi - lo)), 48) AS bin, count(*) AS n, max(hi - lo) AS w FROM marks, hist_edges WHERE flow >= lo AND flow <= hi GROUP BY 1, 2")


@query("eda_01_density_histogram", S.with_(("hist",), f"SELECT label, {S.ins(['bin', 'n'])}, {S.r('n / (sum(n) OVER (PARTITION BY label) * (w / 49))', 'density')} FROM hist"))
def density_histogram(spark: Spark, sf: str) -> DataFrame:
    return shape(D.density_histogram(marks(spark, sf), "flow", "label"), ["label", "bin", "n", "density"])


S.cte("boxq", ("marks",), "SELECT pump_id, label, quantile_cont(flow, 0.25) AS q1, quantile_cont(flow, 0.5) AS med, quantile_cont(flow, 0.75) AS q3, quantile_cont(flow, 0.01) AS axis_low, quantile_cont(flow, 0.99) AS axis_high FROM marks GROUP BY 1, 2")
BOX = ["q1", "med", "q3", "axis_low", "axis_high", "whisker_low", "whisker_high"]


@query("eda_02_box_statistics", S.with_(("boxq", "marks"), f"""SELECT {S.i('pump_id')}, label, {S.rs(BOX)}, {S.i('n')} FROM (SELECT q.*, min(flow) FILTER (flow >= q1 - 1.5 * (q3 - q1) AND flow <= q3 + 1.5 * (q3 - q1)) AS whisker_low,
  max(flow) FILTER (flow >= q1 - 1.5 * (q3 - q1) AND flow <= q3 + 1.5 * (q3 - q1)) AS whisker_high, count(*) AS n FROM boxq q JOIN marks USING (pump_id, label) GROUP BY ALL)"""))
def box_statistics(spark: Spark, sf: str) -> DataFrame:
    return shape(D.box_statistics(marks(spark, sf), "flow", ["pump_id", "label"]), ["pump_id", "label", *BOX, "n"])


_PAIRS = [(a, b) for n, a in enumerate(S.CH) for b in S.CH[:n]]


@query("eda_03_correlation", S.with_(("tagged",), f"SELECT channel_a, channel_b, {S.rs(['r_first', 'r_second'])}, {S.r('r_second - r_first', 'difference')} FROM (" + " UNION ALL ".join(
    f"SELECT '{a}' AS channel_a, '{b}' AS channel_b, corr({a}, {b}) FILTER (label = 'normal') AS r_first, corr({a}, {b}) FILTER (label = 'abnormal') AS r_second FROM tagged WHERE {' AND '.join(c + ' IS NOT NULL' for c in S.CH)}" for a, b in _PAIRS) + ")"))
def correlation(spark: Spark, sf: str) -> DataFrame:
    r = V.tagged(V.readings(spark, sf))
    return shape(D.correlation_difference(r, V.CHANNELS, "label", "normal", "abnormal"))


def _component_ctes(matrix: str, size: int, count: int) -> None:
    """Leading eigenvectors in SQL: squaring a matrix again and again leaves the projection on the first one; it is taken
    out and the next one follows. Matrices are flat lists in ``m``."""
    at = lambda i, j: f"m[({i}) * {size} + ({j}) + 1]"
    square = f"[list_sum([{at(f't // {size}', 'k')} * {at('k', f't % {size}')} FOR k IN range({size})]) FOR t IN range({size * size})]"
    trace = "list_sum([" + at("k", "k") + f" FOR k IN range({size})])"
    source = matrix
    for c in range(1, count + 1):
        S.cte(f"pc{c}_power", (source,), f"""SELECT 0 AS it, m FROM {source} UNION ALL
  SELECT it + 1, [x / {trace} FOR x IN m] FROM (SELECT it, {square} AS m FROM pc{c}_power WHERE it < 60)""")
        S.cte(f"pc{c}_vector", (f"pc{c}_power",), f"""SELECT [x * sign(list_first(list_sort(v, 'DESC')) + list_first(list_sort(v))) FOR x IN v] AS v FROM (
  SELECT [{at('k', 'j')} / sqrt({at('j', 'j')}) FOR k IN range({size})] AS v FROM (SELECT m, list_position([{at('k', 'k')} FOR k IN range({size})], list_max([{at('k', 'k')} FOR k IN range({size})])) - 1 AS j
    FROM pc{c}_power WHERE it = 60))""")
        S.cte(f"pc{c}", (f"pc{c}_vector", source), f"""SELECT v, m, list_sum([{at(f't // {size}', f't % {size}')} * v[t // {size} + 1] * v[t % {size} + 1] FOR t IN range({size * size})]) AS value FROM pc{c}_vector, {source}""")
        S.cte(f"pc{c}_rest", (f"pc{c}",), f"SELECT [m[t + 1] - value * v[t // {size} + 1] * v[t % {size} + 1] FOR t IN range({size * size})] AS m FROM pc{c}")
        source = f"pc{c}_rest"


S.cte("pc_matrix", ("readings",), "SELECT [" + ", ".join(f"corr({a}, {b})" for a in S.CH for b in S.CH) + "] AS m FROM readings WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in S.CH))
_component_ctes("pc_matrix", len(S.CH), 3)


@query("eda_04_principal_components", S.with_(("pc1", "pc2", "pc3", "readings"), " UNION ALL ".join(
    f"SELECT 'pc{c}' AS component, {S.CH!r}[k] AS channel, {S.r('v[k]', 'loading')}, {S.r(f'value / {len(S.CH)}', 'explained')}, {S.r('sqrt(value * (n - 1) / n)', 'spread')} FROM pc{c}, (SELECT unnest(range(1, {len(S.CH) + 1})) AS k), "
    f"(SELECT count(*) AS n FROM readings WHERE {' AND '.join(f'{x} IS NOT NULL' for x in S.CH)})" for c in (1, 2, 3)), recursive=True))
def principal_components(spark: Spark, sf: str) -> DataFrame:
    scores, loadings = D.principal_components(V.grid(spark, sf).select("pump_id", "ts", *V.CHANNELS), V.CHANNELS)
    spread = scores.agg(*[F.stddev_pop(f"pc{i}").alias(f"pc{i}") for i in (1, 2, 3)])
    long = spread.select(F.explode(F.map_from_arrays(F.array(*[F.lit(f"pc{i}") for i in (1, 2, 3)]), F.array("pc1", "pc2", "pc3"))).alias("component", "spread"))
    return shape(loadings.join(long, "component"))


@query("eda_05_speed_regimes")
def speed_regimes(spark: Spark, sf: str) -> DataFrame:
    placed, _ = D.speed_regimes(V.grid(spark, sf))
    return shape(placed.groupBy("regime").agg(F.count(F.lit(1)).alias("n"), F.avg("speed").alias("centre")))


@query("eda_05_speed_histogram", S.with_(("readings",), f"""SELECT {S.i('pump_id')}, {S.ins(['bin', 'n'])} FROM (SELECT pump_id, least(floor((speed - lo) * 60.0::DOUBLE / (hi - lo)), 59) AS bin, count(*) AS n FROM readings,
  (SELECT min(speed) AS lo, max(speed) AS hi FROM readings) WHERE speed IS NOT NULL GROUP BY 1, 2)"""))
def speed_histogram(spark: Spark, sf: str) -> DataFrame:
    return shape(D.speed_histogram(V.readings(spark, sf)), ["pump_id", "bin", "n"])


@query("eda_06_month_counts", f"SELECT {S.i('l_linenumber')}, " + ", ".join(S.i(f"count(*) FILTER (month(l_shipdate) = {m})", f"m{m:02d}") for m in range(1, 13)) + " FROM lineitem GROUP BY l_linenumber")
def month_counts(spark: Spark, sf: str) -> DataFrame:
    return shape(D.month_counts(V.table(spark, sf, "lineitem"), "l_shipdate", "l_linenumber"))


@query("eda_07_group_sample", S.with_(("readings",), f"""SELECT {S.STEPS}, {S.rs(S.CH)} FROM (
  SELECT *, row_number() OVER (PARTITION BY pump_id ORDER BY {S.hash_order(['pump_id', 'ts'])}, pump_id, ts) AS k FROM readings) WHERE k <= 50"""))
def group_sample(spark: Spark, sf: str) -> DataFrame:
    from rotorline.operators.features import sample_rows

    return shape(sample_rows(V.readings(spark, sf), 50, ["pump_id", "ts"], by=["pump_id"]))


# --- outlier models ----------------------------------------------------------------


@query("out_01_isolation_forest")
def isolation_forest(spark: Spark, sf: str) -> DataFrame:
    e = V.table(spark, sf, "embeddings")
    return shape(O.isolation_forest(e, e, "embedding", ["vec_id"]), ["vec_id", "label", "forest_score"])


S.cte("emb", (), "SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings")
S.cte("pairs", ("emb",), "SELECT a.vec_id AS i, b.vec_id AS j, list_distance(a.v, b.v) AS d FROM emb a, emb b")
S.cte("near", ("pairs",), "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d, j) AS k FROM pairs WHERE i <> j) WHERE k <= 20")
S.cte("kd", ("near",), "SELECT i, max(d) AS kd FROM near GROUP BY 1")
S.cte("lrd", ("near", "kd"), "SELECT n.i, 1.0::DOUBLE / (avg(greatest(n.d, kd.kd)) + 1e-10) AS lrd FROM near n JOIN kd ON kd.i = n.j GROUP BY 1")
S.cte("near_new", ("pairs",), "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d, j) AS k FROM pairs) WHERE k <= 20")


@query("out_02_local_outlier_factor", S.with_(("near_new", "kd", "lrd"), f"SELECT {S.i('vec_id')}, {S.r('lof', 'lof', 5)} FROM (SELECT n.i AS vec_id, avg(l.lrd) * (avg(greatest(n.d, kd.kd)) + 1e-10) - 1.5 AS lof FROM near_new n JOIN kd ON kd.i = n.j JOIN lrd l ON l.i = n.j GROUP BY 1)"))
def local_outlier_factor(spark: Spark, sf: str) -> DataFrame:
    e = V.table(spark, sf, "embeddings")
    return shape(O.local_outlier_factor(e, e, "embedding", ["vec_id"]), ["vec_id", "lof"], digits=5)


@query("out_03_pca_reconstruction")
def pca_reconstruction(spark: Spark, sf: str) -> DataFrame:
    e = V.table(spark, sf, "embeddings")
    return shape(O.pca_reconstruction(e, e, "embedding"), ["vec_id", "label", "pca_error"])


@query("out_04_distance_flag", S.with_(("l1_steps",), f"SELECT {S.i('pump_id')}, {S.i('n_flagged')} FROM (SELECT pump_id, count(*) FILTER (dist * dist > 9.0) AS n_flagged FROM l1_steps GROUP BY 1)"))
def distance_flag(spark: Spark, sf: str) -> DataFrame:
    s = CS.l1_steps(spark, sf)
    flag = O.distance_flag(F.col("distance") * F.col("distance"), 9.0)
    return shape(s.groupBy("pump_id").agg(F.sum(flag).alias("n_flagged")))


@query("det_20_outlier_vote")
def outlier_vote(spark: Spark, sf: str) -> DataFrame:
    """Three models over the period feature vector; the detector fires on three votes."""
    from rotorline.operators import detectors, periods
    from rotorline.plans.catalog_quality import features

    f = materialize(features(spark, sf))
    columns = O.vote_columns(V.SYSTEM)
    key = ["pump_id", "date", "period_id"]
    normal = V.label_of(F.col("date"), F.col("pump_id")) == "normal"
    votes = O.period_votes(f, columns, key, normal, 20.0, 0.5)
    base = periods.baseline_wide(periods.baseline_long(f, V.SYSTEM))
    joined = detectors.with_baseline(f.join(votes, key, "left"), base)
    return shape(detectors.detect(joined, V.SYSTEM, "ml_ensemble"))

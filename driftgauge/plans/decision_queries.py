"""Trend detectors, decision rules and the governed decision run."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftgauge.operators import batches as B
from driftgauge.operators import decisions as D
from driftgauge.operators import drift as R
from driftgauge.operators import labels as L
from driftgauge.operators import windows as W
from driftgauge.plans import canon as C
from driftgauge.plans.drift_queries import GENERAL_SIGNATURE_SQL, SENSOR_SIGNATURE_SQL
from driftgauge.plans.label_queries import DELAY, JITTER, RECENT_SQL, VISIBLE_SQL
from driftgauge.plans.registry import query, r6
from driftgauge.session import settled

def trend_sql(source: str = "signals") -> str:
    return f"""trend AS (SELECT *, CASE WHEN count(*) OVER w32>=8 THEN least(1.0,
   0.45*(stddev_pop(positive_rate) OVER w32+abs(positive_rate-quantile_cont(positive_rate,0.5) OVER w32))
   +0.30*abs(mean_conf-avg(mean_conf) OVER w32)
   +0.25*greatest(0.0,output_score-quantile_cont(output_score,0.25) OVER w32)) ELSE 0.0 END AS drift_score,
  CASE WHEN count(*) OVER w12>=4 THEN (score-first_value(score) OVER w12)/(count(*) OVER w12-1) ELSE 0.0 END AS shift_slope,
  CASE WHEN count(*) OVER w16>=4 THEN (score+collapse_risk-first_value(score+collapse_risk) OVER w16)/(count(*) OVER w16-1) ELSE 0.0 END AS loss_slope,
  score-lag(score) OVER (PARTITION BY stream_id ORDER BY step) AS shift_delta
  FROM {source} WINDOW w32 AS (PARTITION BY stream_id ORDER BY step ROWS BETWEEN 31 PRECEDING AND CURRENT ROW),
  w12 AS (PARTITION BY stream_id ORDER BY step ROWS BETWEEN 11 PRECEDING AND CURRENT ROW),
  w16 AS (PARTITION BY stream_id ORDER BY step ROWS BETWEEN 15 PRECEDING AND CURRENT ROW))"""


TREND_SQL = trend_sql()


@query("trend_detectors", C.event_sql(TREND_SQL) + """SELECT stream_id, step, round(drift_score,6) AS drift_score,
round(shift_slope,6) AS shift_slope, round(loss_slope,6) AS loss_slope, round(shift_delta,6) AS shift_delta,
shift_slope>=0.04 AS proactive_hold, loss_slope>=0.08 AS loss_block FROM trend""")
def trend_detectors(spark, folder):
    t = W.trend_columns(C.event_signals(spark, folder), C.step_bound(spark, folder, "events"))
    return t.select("stream_id", "step", r6("drift_score"), r6("shift_slope"), r6("loss_slope"), r6("shift_delta"),
                    "proactive_hold", "loss_block")


@query("severe_runs", C.event_sql("""g AS (SELECT *, sum(CASE WHEN severe THEN 0 ELSE 1 END) OVER (PARTITION BY stream_id ORDER BY step) AS k FROM signals)""")
       + """SELECT stream_id, step, CASE WHEN severe THEN count(*) FILTER (WHERE severe) OVER (PARTITION BY stream_id, k ORDER BY step) ELSE 0 END AS severe_run FROM g""")
def severe_runs(spark, folder):
    return W.severe_runs(C.event_signals(spark, folder), C.step_bound(spark, folder, "events"))


def _ema_sql(name: str, source: str, columns: dict[str, tuple[str, float, float]]) -> str:
    first = ", ".join(f"{d}*{s}+(1-{d})*{c}" for c, d, s in columns.values())
    then = ", ".join(f"{d}*e.{n}+(1-{d})*s.{c}" for n, (c, d, s) in columns.items())
    return f"""{name}(stream_id, step, {', '.join(columns)}) AS (SELECT stream_id, step, {first} FROM {source} WHERE step=0
  UNION ALL SELECT s.stream_id, s.step, {then} FROM {name} e JOIN {source} s ON s.stream_id=e.stream_id AND s.step=e.step+1)"""


_SCALES = {f"{n}_{k}": (c, d, 0.0) for n, d in W.EXPERTS for k, c in (("shift", "score"), ("output", "output_score"))}
TIMESCALE_SQL = _ema_sql("ema", "signals", _SCALES) + """,
ts AS (SELECT *, 0.6*short_shift+0.4*short_output AS us, 0.6*medium_shift+0.4*medium_output AS um, 0.6*long_shift+0.4*long_output AS ul FROM ema),
tx AS (SELECT *, CASE WHEN us>=greatest(um,ul) THEN 'short' WHEN um>=ul THEN 'medium' ELSE 'long' END AS expert FROM ts)"""
_GAIN = "least(1.0,greatest(0.0,CASE expert WHEN 'short' THEN 0.5*short_shift+0.5*short_output WHEN 'medium' THEN 0.5*medium_shift+0.5*medium_output ELSE 0.5*long_shift+0.5*long_output END))"


@query("timescales", C.event_sql(TIMESCALE_SQL) + f"SELECT stream_id, step, expert, round({_GAIN},6) AS gain FROM tx")
def timescales(spark, folder):
    t = W.timescales(C.event_signals(spark, folder))
    return t.select("stream_id", "step", "expert", r6("gain"))


@query("running_averages", C.event_sql("src AS (SELECT s.stream_id, s.step, s.score, k.capital, s.batch_accuracy FROM signals s JOIN risk k ON s.stream_id=k.stream_id AND s.step=k.step)",
    _ema_sql("ema", "src", {"shift_ema": ("score", 0.84, 0.0), "capital_ema": ("capital", 0.84, 0.0), "accuracy_ema": ("batch_accuracy", 0.84, 0.5)}), upto="capital") + """
SELECT stream_id, step, round(shift_ema,6) AS shift_ema, round(capital_ema,6) AS capital_ema, round(accuracy_ema,6) AS accuracy_ema,
round(accuracy_ema-lag(accuracy_ema) OVER (PARTITION BY stream_id ORDER BY step),6) AS accuracy_trend FROM ema""")
def running_averages(spark, folder):
    """Running means of shift, capital and accuracy, and the change of the last one."""
    rows = C.step_bound(spark, folder, "events")
    risk = R.risk_capital(C.event_signals(spark, folder), ["score", "batch_accuracy"])
    e = W.ema_columns(risk, {"shift_ema": ("score", 0.84, 0.0), "capital_ema": ("capital", 0.84, 0.0),
                             "accuracy_ema": ("batch_accuracy", 0.84, 0.5)})
    from driftgauge.operators.ordered import bounded_windows
    e = bounded_windows(e, ["stream_id"], "step", 1, lambda w: {
        "accuracy_trend": F.col("accuracy_ema") - F.lag("accuracy_ema", 1).over(w)}, rows)
    return e.select("stream_id", "step", *[r6(c) for c in ("shift_ema", "capital_ema", "accuracy_ema", "accuracy_trend")])


_MISS = """ms AS (SELECT stream_id, step, CASE WHEN (p>=0.5)<>(y=1) THEN 1.0 ELSE 0.0 END::DOUBLE AS miss FROM batched WHERE idx%48=0)"""


@query("conformal_alpha", C.event_sql(_MISS, """al(stream_id, step, alpha) AS (SELECT stream_id, step, CAST(least(0.40,greatest(0.02,0.10+0.05*(miss-(1-0.9)))) AS DOUBLE) FROM ms WHERE step=0
 UNION ALL SELECT m.stream_id, m.step, least(0.40,greatest(0.02,a.alpha+0.05*(m.miss-(1-0.9)))) FROM al a JOIN ms m ON m.stream_id=a.stream_id AND m.step=a.step+1)""", upto="batched")
       + "SELECT stream_id, step, round(alpha,6) AS alpha FROM al")
def conformal_alpha(spark, folder):
    b = C.event_batches(spark, folder)
    miss = ((F.col("p") >= 0.5).cast("int") != F.col("y")).cast("double")
    first = b.groupBy("stream_id", "step").agg(F.min_by(miss, "idx").alias("miss"))
    return W.conformal_alpha(first).select(
        "stream_id", "step", r6("alpha"))


_PH = """ph(stream_id, step, n, mean, total, low, stat, drift) AS (
 SELECT stream_id, -1::BIGINT, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, false FROM stats WHERE step=0
 UNION ALL SELECT stream_id, step, CASE WHEN hit THEN 0 ELSE n1 END, CASE WHEN hit THEN 0 ELSE m1 END, CASE WHEN hit THEN 0 ELSE t1 END, CASE WHEN hit THEN 0 ELSE l1 END, t1-l1, hit
 FROM (SELECT *, n1>=8 AND t1-l1>0.4 AS hit FROM (SELECT *, least(low,t1) AS l1 FROM (SELECT *, total+x-m1-0.005 AS t1 FROM (
  SELECT s.stream_id, s.step, p.n+1 AS n1, p.mean+((1-s.batch_accuracy)-p.mean)/(p.n+1) AS m1, p.total, p.low, 1-s.batch_accuracy AS x
  FROM ph p JOIN stats s ON s.stream_id=p.stream_id AND s.step=p.step+1)))))"""


@query("page_hinkley", C.event_sql(_PH, upto="stats") + "SELECT stream_id, step, round(stat,6) AS statistic, drift FROM ph WHERE step>=0")
def page_hinkley(spark, folder):
    s = C.event_stats(spark, folder).withColumn("error", 1 - F.col("batch_accuracy"))
    p = W.page_hinkley(s, "error", 8, 0.005, 0.4)
    return p.select("stream_id", "step", r6("statistic"), "drift")


_ERRORS = C.line_sql("er AS (SELECT stream_id, step, (1-batch_accuracy)::DOUBLE AS x FROM stats)", upto="stats")


# c holds the running sums of the window.
@query("adaptive_window", _ERRORS.rstrip() + """, aw(stream_id, step, c, drift) AS (SELECT stream_id, -1::BIGINT, CAST([] AS DOUBLE[]), false FROM er WHERE step=0
 UNION ALL SELECT stream_id, step, CASE WHEN hit IS NULL THEN c1 ELSE list_transform(c1[hit+1:n], lambda v: v-c1[hit]) END, hit IS NOT NULL
 FROM (SELECT *, CASE WHEN n>=8 THEN list_filter(range(1, n), lambda i: abs(c1[i]/i-(c1[n]-c1[i])/(n-i))>=sqrt(0.5*(1.0/i+1.0/(n-i))*ln(2.0*n/0.002)))[1] END AS hit
  FROM (SELECT *, len(c1) AS n FROM (SELECT e.stream_id, e.step, list_append(a.c, coalesce(a.c[-1],0)+e.x) AS c1 FROM aw a JOIN er e ON e.stream_id=a.stream_id AND e.step=a.step+1))))
SELECT stream_id, step, len(c) AS window_size, drift FROM aw WHERE step>=0""")
def adaptive_window(spark, folder):
    s = C.line_stats(spark, folder).withColumn("error", 1 - F.col("batch_accuracy"))
    return W.adaptive_window(s, "error")


# Merging runs over the levels: each element of the reduced list after the first only names a level.
_MERGED = """list_reduce(list_concat([list_append(b.w, struct_pack(k:=0::BIGINT, s:=e.x))], list_transform(range(0, 24), lambda l: [struct_pack(k:=l, s:=0.0::DOUBLE)])),
 lambda a, d: CASE WHEN len(list_filter(a, lambda z: z.k=d[1].k))<=5 THEN a ELSE list_concat(list_concat(a[1:list_position(list_transform(a, lambda z: z.k), d[1].k)-1],
  [struct_pack(k:=d[1].k+1, s:=a[list_position(list_transform(a, lambda z: z.k), d[1].k)].s+a[list_position(list_transform(a, lambda z: z.k), d[1].k)+1].s)]),
  a[list_position(list_transform(a, lambda z: z.k), d[1].k)+2:]) END)"""
_N0 = "list_sum(list_transform(w1[1:i], lambda z: pow(2.0,z.k)))"
_S0 = "list_sum(list_transform(w1[1:i], lambda z: z.s))"


@query("bucketed_window", _ERRORS.rstrip() + f""", bw(stream_id, step, w, drift) AS (SELECT stream_id, -1::BIGINT, CAST([] AS STRUCT(k BIGINT, s DOUBLE)[]), false FROM er WHERE step=0
 UNION ALL SELECT stream_id, step, CASE WHEN hit IS NULL THEN w1 ELSE w1[hit+1:] END, hit IS NOT NULL
 FROM (SELECT *, CASE WHEN n>=8 THEN list_filter(range(1, len(w1)), lambda i: abs({_S0}/{_N0}-(t-{_S0})/(n-{_N0}))>=sqrt(0.5*(1.0/{_N0}+1.0/(n-{_N0}))*ln(2.0*n/0.002)))[1] END AS hit
  FROM (SELECT *, list_sum(list_transform(w1, lambda z: pow(2.0,z.k))) AS n, list_sum(list_transform(w1, lambda z: z.s)) AS t
   FROM (SELECT e.stream_id, e.step, {_MERGED} AS w1 FROM bw b JOIN er e ON e.stream_id=b.stream_id AND e.step=b.step+1))))
SELECT stream_id, step, CAST(list_sum(list_transform(w, lambda z: pow(2.0,z.k))) AS BIGINT) AS window_size, len(w) AS buckets, drift FROM bw WHERE step>=0""")
def bucketed_window(spark, folder):
    """The adaptive window with logarithmic state."""
    s = C.line_stats(spark, folder).withColumn("error", 1 - F.col("batch_accuracy"))
    return W.bucketed_window(s, "error")


_PSI = "+".join(f"(greatest(c{i}/240.0,1e-4)-r{i})*ln(greatest(c{i}/240.0,1e-4)/r{i})" for i in range(10))
_HIST = ", ".join(f"count(*) FILTER (WHERE least(floor(p*10),9)={i}) AS b{i}" for i in range(10))


@query("rolling_stability", C.event_sql(
    f"h AS (SELECT stream_id, step, {_HIST} FROM batched GROUP BY 1,2)",
    f"ro AS (SELECT stream_id AS rs, {', '.join(f'greatest(sum(b{i})/240.0,1e-4) AS r{i}' for i in range(10))} FROM h WHERE step<5 GROUP BY 1)",
    f"hw AS (SELECT stream_id, step, {', '.join(f'sum(b{i}) OVER w AS c{i}' for i in range(10))} FROM h WINDOW w AS (PARTITION BY stream_id ORDER BY step ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))",
    f"pv AS (SELECT stream_id, step, {_PSI} AS v FROM hw JOIN ro ON rs=stream_id)",
    """rp(stream_id, step, since, psi, drift) AS (SELECT stream_id, step, 0, NULL::DOUBLE, false FROM pv WHERE step=0
 UNION ALL SELECT stream_id, step, CASE WHEN n>=5 AND v>=0.2 THEN 0 ELSE n END, CASE WHEN n>=5 THEN v END, n>=5 AND v>=0.2
 FROM (SELECT p.stream_id, p.step, p.v, CASE WHEN p.step<5 THEN 0 ELSE r.since+1 END AS n FROM rp r JOIN pv p ON p.stream_id=r.stream_id AND p.step=r.step+1))""",
    upto="batched") + "SELECT stream_id, step, round(psi,6) AS psi, drift FROM rp")
def rolling_stability(spark, folder):
    h = W.score_histograms(C.event_batches(spark, folder))
    return W.rolling_psi(h).withColumn("psi", F.round("psi", 6))


_H = ", ".join(f"count(*) FILTER (WHERE least(floor(p*10),9)={i}) AS b{i}" for i in range(10))
_HW = ", ".join(f"sum(b{i}) OVER w AS c{i}" for i in range(10))


@query("rolling_stability_open", C.event_sql(
    f"h AS (SELECT stream_id, step, {_H} FROM batched GROUP BY 1,2)",
    f"ro AS (SELECT stream_id AS rs, {', '.join(f'greatest(sum(b{i})/240.0,1e-4) AS r{i}' for i in range(10))} FROM h WHERE step<5 GROUP BY 1)",
    f"hw AS (SELECT stream_id, step, {_HW} FROM h WINDOW w AS (PARTITION BY stream_id ORDER BY step ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))",
    upto="batched") + "SELECT stream_id, step, round(" + "+".join(
        f"(greatest(c{i}/240.0,1e-4)-r{i})*ln(greatest(c{i}/240.0,1e-4)/r{i})" for i in range(10))
    + ",6) AS psi FROM hw JOIN ro ON rs=stream_id WHERE step>=9")
def rolling_stability_open(spark, folder):
    h = W.score_histograms(C.event_batches(spark, folder))
    return W.rolling_psi_open(h, rows=C.step_bound(spark, folder, "events")).select("stream_id", "step", r6("psi"))


@query("temporal_context", """WITH RECURSIVE o AS (SELECT event_type AS k, event_id, epoch(ts) AS t, value AS a, CAST(user_id AS DOUBLE) AS b,
 row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id)-1 AS idx, count(*) OVER (PARTITION BY event_type) AS n FROM events),
g AS (SELECT *, coalesce(t-lag(t) OVER (PARTITION BY k ORDER BY idx),0) AS gap FROM o),
md AS (SELECT k AS mk, median(gap) AS m FROM g WHERE gap>0 GROUP BY 1),
e(k, idx, sa, sb, la, lb) AS (SELECT k, -1::BIGINT, a, b, a, b FROM o WHERE idx=0
 UNION ALL SELECT o.k, o.idx, 0.85*sa+0.15*a, 0.85*sb+0.15*b, 0.97*la+0.03*a, 0.97*lb+0.03*b FROM e JOIN o ON o.k=e.k AND o.idx=e.idx+1)
SELECT event_id, round(g.idx/greatest(1,n-1),6) AS place, round(ln(1+greatest(0,gap)/greatest(m,1e-6)),5) AS log_gap, round((a+b)/2,6) AS row_mean,
round(abs(a-b)/2,6) AS row_std, round((abs(a-sa)+abs(b-sb))/2,9) AS short_abs, round((abs(a-la)+abs(b-lb))/2,9) AS long_abs,
round(sqrt(((a-sa)*(a-sa)+(b-sb)*(b-sb))/2),9) AS short_rms, round((sa-la+sb-lb)/2,9) AS trend
FROM g JOIN md ON mk=g.k JOIN e ON e.k=g.k AND e.idx=g.idx-1""")
def temporal_context(spark, folder):
    e = spark.read.parquet(f"{folder}/events.parquet").select(
        F.col("event_type").alias("k"), "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("value").alias("a"),
        F.col("user_id").cast("double").alias("b")).withColumn("t", F.col("us") / 1e6)
    c = W.temporal_context(e, "k", "t", ["a", "b"], [F.col("us"), F.col("event_id")],
                           C.stream_rows(spark, folder, "events"))
    five = lambda n: F.round(n, 5).alias(n)
    return c.select("event_id", r6("place"), five("log_gap"), r6("row_mean"), r6("row_std"),
                    *[F.round(n, 9).alias(n) for n in ("short_abs", "long_abs", "short_rms", "trend")])


# ---- rules as columns ------------------------------------------------------------------------

def trended(spark, folder):
    """Signals with trend columns, recent reveals and a fixed miscoverage level.

    With delayed labels no label is known when a batch is scored, so the level keeps its start value.
    """
    rows = C.step_bound(spark, folder, "events")
    stats = settled(C.event_stats(spark, folder))
    signals = R.drift_surface(stats, len(C.EVENT_FEATURES), rows, ready=True)
    recent = L.recent_reveals(stats, DELAY, JITTER, rows=rows).select(
        "stream_id", "step", "recent_accuracy", "revealed_accuracy", "revealed_rate")
    t = W.trend_columns(signals, rows).join(recent, ["stream_id", "step"])
    return t.withColumn("alpha", F.lit(0.10))


_HALFW = "(0.1+(1-mean_conf)*0.5)"
UNCERTAIN_SQL = f"""CASE WHEN collapse_risk>=CASE WHEN score>=1.75 THEN 0.62 ELSE 0.55 END OR {_HALFW}>=CASE WHEN score>=1.75 THEN 0.40 ELSE 0.35 END
 THEN 'tighten_abstention' WHEN ({_HALFW}<=0.12 AND score<1.75) OR (score>=1.75 AND {_HALFW}<=0.18 AND collapse_risk<0.5) THEN 'relax_abstention' ELSE 'hold_threshold' END"""
_SAT = "(score>=8.0 OR feature_score>=6.0 OR (severe AND feature_score>=3.0 AND output_score>=0.6))"
_PROFILE_SQL = "CASE stream_id WHEN 'error' THEN 'sensor' WHEN 'purchase' THEN 'fraud' WHEN 'view' THEN 'sensor_safe' ELSE 'general' END"


def _profile():
    s = F.col("stream_id")
    return (F.when(s == "error", "sensor").when(s == "purchase", "fraud").when(s == "view", "sensor_safe")
            .otherwise("general"))


def _clip01(x: str) -> str:
    return f"greatest(0.0,least(1.0,{x}))"


RULES_SQL = f"""pr AS (SELECT t.*, e.gain, {_PROFILE_SQL} AS profile FROM trend t JOIN (SELECT stream_id AS es, step AS ep, {_GAIN} AS gain FROM tx) e ON es=stream_id AND ep=step),
sg AS (SELECT *, profile IN ('sensor','sensor_safe') AND {_SAT} AS saturated, {UNCERTAIN_SQL} AS uncertainty,
 CASE WHEN profile IN ('sensor','sensor_safe') THEN {SENSOR_SIGNATURE_SQL} ELSE {GENERAL_SIGNATURE_SQL} END AS signature FROM pr),
op AS (SELECT *, CASE WHEN saturated THEN 0.0
 WHEN profile='sensor_safe' THEN CASE signature WHEN 'covariate_drift' THEN {_clip01('0.35*feature_score-0.45*output_score-0.55*collapse_risk')} WHEN 'mixed_drift' THEN {_clip01('0.10*feature_score-0.35*output_score')} ELSE {_clip01('0.08*output_score')} END
 WHEN profile='sensor' THEN CASE signature WHEN 'covariate_drift' THEN {_clip01('0.55*feature_score-0.35*output_score-0.45*collapse_risk')} WHEN 'mixed_drift' THEN {_clip01('0.25*feature_score-0.30*output_score')} ELSE {_clip01('0.15*output_score')} END
 WHEN profile='fraud' THEN CASE signature WHEN 'label_drift' THEN {_clip01('0.75*output_score+0.25*collapse_risk')} ELSE {_clip01('0.25*feature_score+0.20*output_score')} END
 ELSE {_clip01('0.30*feature_score+0.30*output_score')} END AS base_chance FROM sg),
ru AS (SELECT *, CASE WHEN base_chance<=0 THEN base_chance WHEN uncertainty='tighten_abstention' THEN least(0.25,{_clip01('0.7*base_chance+0.3*gain')}) ELSE {_clip01('0.7*base_chance+0.3*gain')} END AS opportunity FROM op)"""


@query("decision_columns", C.event_sql(TREND_SQL, TIMESCALE_SQL, RULES_SQL) + """SELECT stream_id, step, profile, signature, saturated,
uncertainty, round(opportunity,6) AS opportunity FROM ru""")
def decision_columns(spark, folder):
    """Signature, saturation, uncertainty and opportunity under four controller profiles."""
    t = trended(spark, folder)
    gain = W.timescales(t).select("stream_id", "step", "gain")
    d = D.decision_inputs(t.join(gain, ["stream_id", "step"]), _profile())
    return d.select("stream_id", "step", "profile", "signature", "saturated", "uncertainty", r6("opportunity"))


def _allowed_sql(profile_expr: str, signature: str) -> str:
    rows = []
    for (p, s), acts in D.BOUNDED_ACTIONS.items():
        kept = [a for a in D.BASE_ACTIONS if a in acts]
        rows.append(f"WHEN {profile_expr}='{p}' AND {signature}='{s}' THEN {kept!r}")
    return "CASE " + " ".join(rows) + " END"


_BENIGN = "coalesce(revealed_accuracy>0.92 AND revealed_rate<=ref_mean_p+0.05,false)"


@query("allowed_actions", C.event_sql(TREND_SQL, TIMESCALE_SQL, RULES_SQL, VISIBLE_SQL, RECENT_SQL) + f"""SELECT u.stream_id, u.step,
array_to_string(CASE WHEN (profile='sensor_safe' AND (saturated OR opportunity<0.35)) OR (profile='sensor' AND (saturated OR opportunity<0.20)) OR {_BENIGN}
THEN ['none','hold'] ELSE {_allowed_sql('profile', 'signature')} END, ',') AS allowed FROM ru u LEFT JOIN recent r ON r.stream_id=u.stream_id AND r.step=u.step""")
def allowed_actions(spark, folder):
    """Base actions cut by profile, signature, stand-down and the benign gate."""
    t = trended(spark, folder)
    gain = W.timescales(t).select("stream_id", "step", "gain")
    d = D.decision_inputs(t.join(gain, ["stream_id", "step"]), _profile())
    return d.select("stream_id", "step", F.array_join("allowed", ",").alias("allowed"))


@query("action_guards", C.event_sql(VISIBLE_SQL, RECENT_SQL) + """SELECT s.stream_id, s.step, coalesce(recent_accuracy<=0.85,true) AS may_recalibrate,
mean_conf-ref_mean_conf>=0.04 AS may_cool, coalesce(revealed_rate,ref_mean_p)-ref_mean_p>=0.07 AS may_shift_labels,
CASE WHEN c>=CASE WHEN score>=1.75 THEN 0.92 ELSE 0.88 END AND collapse_risk>=CASE WHEN score>=1.75 THEN 0.42 ELSE 0.35 END THEN 'reset'
WHEN c>=CASE WHEN score>=1.75 THEN 0.78 ELSE 0.72 END AND collapse_risk>=CASE WHEN score>=1.75 THEN 0.28 ELSE 0.22 END THEN 'recalibrate' END AS advice
FROM (SELECT *, greatest(n_pred_pos,n-n_pred_pos)/n AS c FROM signals) s LEFT JOIN recent r ON r.stream_id=s.stream_id AND r.step=s.step""")
def action_guards(spark, folder):
    t = trended(spark, folder)
    return t.select("stream_id", "step", D.recalibrate_guard(F.col("recent_accuracy")).alias("may_recalibrate"),
                    D.cool_guard().alias("may_cool"), D.label_shift_guard(F.col("revealed_rate")).alias("may_shift_labels"),
                    D.concentration_advice(R.concentration(F.col("n_pred_pos"), F.col("n"))).alias("advice"))


@query("mode_gates", """SELECT event_id, CASE WHEN event_id%3<2 THEN 'none' WHEN event_type IN ('click','view') THEN event_type ELSE 'none' END AS action,
CASE event_id%3 WHEN 0 THEN 'shadow_mode_no_mutation' WHEN 1 THEN 'recommend_mode_pending_approval' ELSE
CASE WHEN event_type IN ('click','view') THEN 'allowed' ELSE 'bounded_auto_blocked:'||event_type END END AS reason FROM events""")
def mode_gates(spark, folder):
    e = spark.read.parquet(f"{folder}/events.parquet")
    k = F.col("event_id") % 3
    mode = F.when(k == 0, "shadow").when(k == 1, "recommend").otherwise("bounded_auto")
    a, r = D.mode_gate(mode, F.col("event_type"), F.array(F.lit("click"), F.lit("view")))
    return e.select("event_id", a.alias("action"), r.alias("reason"))


@query("scalar_reliability", C.event_sql() + "SELECT stream_id, step, round(greatest(0.0,least(1.0,1-0.18*feature_score-0.22*output_score-0.35*collapse_risk)),6) AS reliability FROM signals")
def scalar_reliability(spark, folder):
    return C.event_signals(spark, folder).select("stream_id", "step", r6(D.scalar_reliability(), "reliability"))


# ---- the governed run ------------------------------------------------------------------------

DECISION_INPUT_SQL = f"""inp AS (SELECT t.stream_id, t.step, g.strategy, n_steps, score, feature_score, output_score, collapse_risk, alert, severe, mean_p, mean_conf,
  ref_mean_p, ref_mean_conf, e_value, conf68, conf80, conf90, drift_score, loss_slope>=0.08 AS loss_block, batch_accuracy, recent_accuracy, {_HALFW} AS half_width,
  {UNCERTAIN_SQL} AS uncertainty, {GENERAL_SIGNATURE_SQL} AS signature, CASE WHEN {_BENIGN} THEN ['none','hold'] ELSE {_allowed_sql("'general'", GENERAL_SIGNATURE_SQL)} END AS allowed
  FROM trend t LEFT JOIN recent r ON r.stream_id=t.stream_id AND r.step=t.step CROSS JOIN (SELECT unnest({list(D.STRATEGIES)!r}) AS strategy) g)"""

# State of the run: masks hold one bit per step of the last 24, bit a for an event a steps ago.
DECISION_SQL = """run(stream_id, strategy, step, cap, cool, runlen, since, ticks, temp, bias, acted, resets, blocks,
    recommended_action, action_taken, effective_mode, risk_alert, retrain_recommended, budget_limited, budget_reason) AS (
  SELECT stream_id, strategy, -1::BIGINT, 1.0::DOUBLE, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 1.0::DOUBLE, 0.0::DOUBLE, 0::BIGINT, 0::BIGINT, 0::BIGINT,
    'none', 'none', 'bounded_auto', false, false, false, NULL::VARCHAR FROM inp WHERE step=0
  UNION ALL
  SELECT stream_id, strategy, step, c9, cool9, run9, since9, ticks9, temp9, bias9,
    acted1|CAST(act9 NOT IN ('none','hold','abstain') AS BIGINT), resets1|CAST(act9='reset' AS BIGINT), blocks9,
    ask9, act9, mode9, alert9,
    CASE WHEN strategy='frozen' THEN alert9 OR alert OR severe ELSE
      ((severe OR collapse_risk>=0.55 OR c9>=12.0) AND act9 IN ('none','hold','abstain'))
      OR (limited9 AND (alert OR alert9) AND bit_count(blocks9)>=2)
      OR (ask9 IN ('adapt','reset') AND act9 IN ('none','hold') AND (alert9 OR severe)) END OR drift_score>=0.75, limited9, why9
  FROM (SELECT *,
    CASE WHEN act9='reset' THEN 1.0 WHEN strategy<>'frozen' AND act9 IN ('none','hold') AND ask9 NOT IN ('none','hold','abstain') AND NOT severe
      THEN greatest(1.0,1.0+(c0-1.0)*0.55) ELSE c0 END AS c9, act9<>'reset' AND c9>=8.0 AS alert9,
    CASE act9 WHEN 'recalibrate' THEN CASE WHEN strategy='multi_action'
        THEN least(greatest(0.7*temp+0.3*least(greatest(1-1.4*(ref_mean_conf-mean_conf),0.70),1.30),0.70),1.30)
        ELSE least(greatest(0.75*temp+0.25*least(greatest(1-1.4*(ref_mean_conf-mean_conf),0.65),1.35),0.65),1.35) END
      WHEN 'cool_confidence' THEN least(greatest(0.85*temp+0.15*least(greatest(1-1.4*(ref_mean_conf-mean_conf),0.80),1.40),0.80),1.40)
      WHEN 'reset' THEN 1.0 ELSE temp END AS temp9,
    CASE act9 WHEN 'label_shift' THEN 0.65*bias+0.35*least(greatest(ln(pt/(1-pt))-ln(ps/(1-ps)),-1.10),1.10) WHEN 'reset' THEN 0.0 ELSE bias END AS bias9
   FROM (SELECT *,
     loss_block AND act1 NOT IN ('none','hold') AS lossy, CASE WHEN lossy THEN 'none' ELSE act1 END AS act9,
     why0 IS NOT NULL OR lossy AS limited9, CASE WHEN lossy THEN 'loss_slope' ELSE why0 END AS why9,
     CASE WHEN why0 IS NOT NULL THEN 'recommend' ELSE 'bounded_auto' END AS mode9,
     blocks1|CAST(why0 IS NOT NULL AS BIGINT) AS blocks9
    FROM (SELECT *,
      CASE WHEN list_contains(allowed, ask9) THEN ask9 ELSE 'none' END AS act0,
      CASE WHEN act0 NOT IN ('none','hold') AND bit_count(acted1)>=8 THEN 'max_auto_actions_per_window'
           WHEN act0='reset' AND bit_count(resets1)>=1 THEN 'max_resets_per_window' END AS why0,
      CASE WHEN why0 IS NOT NULL THEN 'none' ELSE act0 END AS act1
     FROM (SELECT *,
       CASE WHEN uncertainty='tighten_abstention' THEN
          CASE WHEN ask0 IN ('adapt','reset','covariate_refresh') OR (ask0='bn_refresh' AND score<1.75) THEN 'hold'
               WHEN ask0 IN ('none','hold') AND score<1.75 AND collapse_risk>=0.45 THEN 'abstain' ELSE ask0 END
        WHEN uncertainty='relax_abstention' AND ask0 IN ('none','hold') AND collapse_risk>=CASE WHEN score>=1.75 THEN 0.30 ELSE 0.25 END
          AND half_width<=CASE WHEN score>=1.75 THEN 0.20 ELSE 0.15 END THEN 'recalibrate' ELSE ask0 END AS ask1,
       CASE WHEN ask1<>ask0 AND ask1='recalibrate' AND recent_accuracy>0.85 THEN 'hold' ELSE ask1 END AS ask9
      FROM (SELECT *,
        CASE strategy WHEN 'naive' THEN CASE WHEN score<1.0 THEN 'none' WHEN conf68>0 THEN 'adapt' ELSE 'hold' END
         WHEN 'scheduled_retrain' THEN CASE WHEN ticks+1<6 THEN 'none' WHEN conf68>0 THEN 'adapt' ELSE 'recalibrate' END
         WHEN 'controller' THEN CASE WHEN cool>0 THEN 'hold' WHEN calm THEN 'none' WHEN c0>=18 OR run1>=3 OR collapse_risk>=0.55 THEN 'reset' WHEN sure>0 THEN 'adapt' ELSE 'hold' END
         WHEN 'multi_action' THEN CASE WHEN cool>0 THEN 'hold' WHEN hard AND since1>0 THEN 'abstain' WHEN hard THEN 'reset' WHEN score<0.95 AND NOT risky THEN 'none'
           WHEN output_score>0.18 AND abs(mean_p-ref_mean_p)>0.08 AND feature_score<0.95 THEN 'label_shift'
           WHEN feature_score>0.95 AND output_score<0.35 AND mean_conf>=0.78 THEN 'bn_refresh'
           WHEN abs(ref_mean_conf-mean_conf)>0.05 AND collapse_risk<0.40 AND feature_score<1.55 THEN CASE WHEN ref_mean_conf<mean_conf THEN 'cool_confidence' ELSE 'recalibrate' END
           WHEN (score>=1.55 OR risky) AND mean_conf<0.72 THEN 'abstain' WHEN sure>0 THEN 'adapt' ELSE 'hold' END
         ELSE 'none' END AS ask0,
        CASE strategy WHEN 'controller' THEN CASE WHEN cool>0 THEN cool-1 WHEN calm THEN 0 WHEN ask0='hold' THEN 1 ELSE 2 END
         WHEN 'multi_action' THEN CASE WHEN cool>0 THEN cool-1 WHEN ask0='none' THEN 0 WHEN ask0 IN ('reset','adapt') THEN 2 ELSE 1 END ELSE 0 END AS cool9,
        CASE WHEN strategy='controller' AND ask0='reset' THEN 0 ELSE run1 END AS run9,
        CASE WHEN strategy='multi_action' AND ask0='reset' THEN 3 ELSE since1 END AS since9,
        CASE WHEN strategy='scheduled_retrain' THEN (ticks+1)%6 ELSE 0 END AS ticks9
       FROM (SELECT i.*, r.cool, r.ticks, r.temp, r.bias,
          least(100.0,greatest(1.0,r.cap*0.92*i.e_value)) AS c0, c0>=8.0 AS risky,
          (r.acted<<1)&16777215 AS acted1, (r.resets<<1)&16777215 AS resets1, (r.blocks<<1)&16777215 AS blocks1,
          greatest(0,r.since-1) AS since1, CASE WHEN i.severe OR risky THEN i.conf90 ELSE i.conf80 END AS sure,
          i.score<1.0 AND NOT risky AS calm, c0>=25.0 OR i.collapse_risk>=0.70 AS hard,
          CASE WHEN r.cool>0 THEN r.runlen WHEN calm THEN 0 WHEN i.severe OR risky OR i.score>=1.7 THEN r.runlen+1 ELSE 0 END AS run1,
          least(greatest(i.ref_mean_p,1e-4),1-1e-4) AS ps, least(greatest(i.mean_p,1e-4),1-1e-4) AS pt
        FROM run r JOIN inp i ON i.stream_id=r.stream_id AND i.strategy=r.strategy AND i.step=r.step+1))))))
),
dec AS (SELECT i.stream_id, i.strategy, i.step, n_steps, score AS shift_score, feature_score, output_score, collapse_risk, alert, severe, signature, batch_accuracy, u.cap AS capital,
  recommended_action, action_taken, effective_mode, risk_alert, retrain_recommended, budget_limited, budget_reason, temp AS temperature, bias,
  abs(temp-1)+abs(bias) AS parameter_drift, action_taken='abstain' OR recommended_action='abstain' AS abstained, action_taken NOT IN ('none','hold') AS explicit_action,
  CASE WHEN collapse_risk>=0.5 OR recommended_action='reset' THEN 'escalate' WHEN alert AND recommended_action IN ('adapt','reset') THEN 'caution' WHEN alert THEN 'monitor' ELSE 'normal' END AS trust_state,
  greatest(0.0,least(1.0,1-0.20*feature_score-0.28*output_score-0.32*collapse_risk-least(0.45,0.04*greatest(0,u.cap-1))
    -CASE recommended_action WHEN 'reset' THEN 0.08 WHEN 'abstain' THEN 0.05 ELSE 0 END)) AS reliability,
  action_taken IN ('none','hold') OR (score>=1.75 AND action_taken IN ('recalibrate','label_shift','bn_refresh','adapt') AND abs(temp-1)+abs(bias)<1.5)
   OR NOT (((score>=1.75 AND (action_taken='reset' OR (action_taken='adapt' AND abs(temp-1)+abs(bias)>=1.5)))
      OR (score<1.75 AND collapse_risk>=0.65+0.10*least(1.0,greatest(0.0,score-1.2)/1.2))) AND effective_mode='bounded_auto'
    OR (abs(temp-1)+abs(bias)>=CASE WHEN score>=1.75 THEN 1.85 ELSE 1.25 END AND collapse_risk>=0.45)) AS safety_ok
  FROM run u JOIN inp i ON i.stream_id=u.stream_id AND i.strategy=u.strategy AND i.step=u.step)"""


def decision_sql(*extra: str, mode: str = "bounded_auto") -> str:
    """WITH clause up to the table `dec` of decisions over events; the other modes take no action."""
    run = DECISION_SQL
    if mode != "bounded_auto":
        run = run.replace("CASE WHEN list_contains(allowed, ask9) THEN ask9 ELSE 'none' END AS act0", "'none' AS act0").replace("'bounded_auto'", f"'{mode}'")
    return C.event_sql(TREND_SQL, VISIBLE_SQL, RECENT_SQL, DECISION_INPUT_SQL, run, *extra)


def decision_table(spark, folder, rules=D.Rules(), strategies=D.STRATEGIES):
    """Decisions of every strategy over every event stream, written once: it is a small table."""
    inputs = D.decision_inputs(trended(spark, folder).withColumn("gain", F.lit(0.0)), F.lit("general"), rules)
    out = D.decide(inputs, strategies, rules, ["n_steps", "batch_accuracy"])
    return settled(out)


_DEC_OUT = """SELECT stream_id, strategy, step, signature, recommended_action, action_taken, effective_mode, round(capital,6) AS capital, risk_alert,
retrain_recommended, budget_limited, budget_reason, round(temperature,6) AS temperature, round(bias,6) AS bias, abstained, trust_state,
round(reliability,6) AS reliability, safety_ok FROM dec"""


@query("governed_decisions", decision_sql() + _DEC_OUT)
def governed_decisions(spark, folder):
    d = decision_table(spark, folder)
    return d.select("stream_id", "strategy", "step", "signature", "recommended_action", "action_taken",
                    "effective_mode", r6("capital"), "risk_alert", "retrain_recommended", "budget_limited",
                    "budget_reason", r6("temperature"), r6("bias"), "abstained", "trust_state", r6("reliability"),
                    "safety_ok")


# The same run with a controller profile per stream and the gain of the competing averages.
_PROFILE_INPUT_SQL = f"""inp AS (SELECT u.stream_id, u.step, g.strategy, n_steps, score, feature_score, output_score, collapse_risk, alert, severe, mean_p, mean_conf,
  ref_mean_p, ref_mean_conf, e_value, conf68, conf80, conf90, drift_score, loss_slope>=0.08 AS loss_block, batch_accuracy, recent_accuracy, {_HALFW} AS half_width,
  uncertainty, signature, profile, saturated, opportunity, CASE WHEN (profile='sensor_safe' AND (saturated OR opportunity<0.35)) OR (profile='sensor' AND (saturated OR opportunity<0.20)) OR {_BENIGN}
  THEN ['none','hold'] ELSE {_allowed_sql('profile', 'signature')} END AS allowed
  FROM ru u LEFT JOIN recent r ON r.stream_id=u.stream_id AND r.step=u.step CROSS JOIN (SELECT unnest({list(D.STRATEGIES)!r}) AS strategy) g)"""
_PROFILE_RUN_SQL = DECISION_SQL.replace("""       CASE WHEN uncertainty='tighten_abstention' THEN
          CASE WHEN ask0 IN ('adapt','reset','covariate_refresh') OR (ask0='bn_refresh' AND score<1.75) THEN 'hold'
               WHEN ask0 IN ('none','hold') AND score<1.75 AND collapse_risk>=0.45 THEN 'abstain' ELSE ask0 END
        WHEN uncertainty='relax_abstention' AND ask0 IN ('none','hold')""", """       CASE WHEN profile='sensor' AND signature='covariate_drift' AND NOT saturated AND opportunity>=0.35 AND ask0 IN ('bn_refresh','adapt') THEN 'covariate_refresh'
        WHEN profile IN ('sensor','sensor_safe') AND signature IN ('covariate_drift','mixed_drift') AND ask0 IN ('adapt','bn_refresh') THEN 'latent_recenter' ELSE ask0 END AS askp,
       CASE WHEN uncertainty='tighten_abstention' THEN
          CASE WHEN askp IN ('adapt','reset','covariate_refresh') OR (askp='bn_refresh' AND score<1.75) THEN 'hold'
               WHEN askp IN ('none','hold') AND score<1.75 AND collapse_risk>=0.45 THEN 'abstain' ELSE askp END
        WHEN uncertainty='relax_abstention' AND askp IN ('none','hold')""").replace("THEN 'recalibrate' ELSE ask0 END AS ask1", "THEN 'recalibrate' ELSE askp END AS ask1")


@query("governed_profiles", C.event_sql(TREND_SQL, TIMESCALE_SQL, RULES_SQL, VISIBLE_SQL, RECENT_SQL, _PROFILE_INPUT_SQL, _PROFILE_RUN_SQL) + """SELECT stream_id, strategy, step,
signature, recommended_action, action_taken, round(capital,6) AS capital, risk_alert, retrain_recommended, budget_limited, round(temperature,6) AS temperature FROM dec""")
def governed_profiles(spark, folder):
    """The governed run with the profile of each stream and the timescale gain, so that profile and maintenance overrides take part."""
    t = trended(spark, folder)
    inputs = D.decision_inputs(t.join(W.timescales(t).select("stream_id", "step", "gain"), ["stream_id", "step"]), _profile(), D.Rules())
    d = D.decide(inputs, D.STRATEGIES, D.Rules(), ["n_steps", "batch_accuracy"])
    return d.select("stream_id", "strategy", "step", "signature", "recommended_action", "action_taken", r6("capital"), "risk_alert",
                    "retrain_recommended", "budget_limited", r6("temperature"))

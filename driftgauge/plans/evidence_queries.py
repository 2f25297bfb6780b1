"""Reports that compare strategies over all streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from driftgauge.operators import batches as B
from driftgauge.operators import decisions as D
from driftgauge.operators import drift as R
from driftgauge.operators import evidence as E
from driftgauge.operators import prepare as P
from driftgauge.operators import windows as W
from driftgauge.plans import canon as C
from driftgauge.plans.decision_queries import decision_sql, decision_table
from driftgauge.plans.label_queries import DELAY, JITTER
from driftgauge.operators.labels import visible_at
from driftgauge.plans.registry import query, r6
from driftgauge.session import settled
from driftgauge.sources import sinks

QUIET = "('none','hold')"
MUT = "('adapt','reset','bn_refresh','covariate_refresh','recalibrate','label_shift')"
SURFACE_SQL = """cor AS (SELECT stream_id, strategy, step, avg(abs(q-p)) AS mean_abs_delta, max(abs(q-p)) AS max_abs_delta,
  count(*) FILTER (WHERE (q>=0.5)<>(p>=0.5)) AS flipped, avg(CASE WHEN (q>=0.5)=(y=1) THEN 1.0 ELSE 0.0 END) AS acc
  FROM (SELECT b.stream_id, b.step, b.p, b.y, d.strategy, CASE WHEN temperature=1 AND bias=0 THEN p ELSE
    1/(1+exp(-((ln(least(greatest(p,1e-6),1-1e-6)/(1-least(greatest(p,1e-6),1-1e-6)))+bias)/temperature))) END AS q
    FROM batched b JOIN dec d ON b.stream_id=d.stream_id AND b.step=d.step) GROUP BY 1,2,3),
surf AS (SELECT *, accuracy-0.06*CAST(risk_alert AS INTEGER)-0.03*least(1.0,parameter_drift)-0.10*CAST(abstained AS INTEGER)
    -0.04*CAST(action_taken='reset' AS INTEGER) AS utility FROM (SELECT d.*, c.mean_abs_delta, c.max_abs_delta, c.flipped, c.max_abs_delta>1e-6 AS correction_applied,
    CASE WHEN abstained THEN 0.0 ELSE c.acc END AS accuracy FROM dec d JOIN cor c ON c.stream_id=d.stream_id AND c.strategy=d.strategy AND c.step=d.step))"""


def _mean(cond: str) -> str:
    return f"avg(CASE WHEN {cond} THEN 1.0 ELSE 0.0 END)"


SUMMARY_SQL = f"""summ AS (SELECT stream_id, strategy, count(*) AS steps, round(avg(accuracy),12) AS mean_accuracy, round(avg(utility),12) AS mean_utility,
 avg(capital) AS mean_risk_capital, avg(shift_score) AS mean_shift_score, avg(reliability) AS mean_reliability, avg(parameter_drift) AS mean_parameter_drift,
 {_mean(f'action_taken NOT IN {QUIET}')} AS intervention_rate, count(*) FILTER (WHERE action_taken='reset') AS reset_count,
 count(*) FILTER (WHERE risk_alert) AS risk_alert_count, min(step) FILTER (WHERE shift_score>=1.0) AS first_drift_step,
 {_mean(f'recommended_action NOT IN {QUIET}')} AS recommendation_rate,
 count(*) FILTER (WHERE recommended_action=action_taken AND action_taken NOT IN {QUIET})/greatest(1.0,count(*) FILTER (WHERE recommended_action NOT IN {QUIET})) AS recommendation_execution_rate,
 1000*{_mean(f'action_taken IN {MUT}')} AS interventions_per_1000, count(*) FILTER (WHERE retrain_recommended) AS retrain_count,
 min(step) FILTER (WHERE retrain_recommended) AS first_retrain_step, count(*) FILTER (WHERE budget_limited) AS budget_limited_count,
 {_mean('correction_applied')} AS correction_applied_rate, {_mean('correction_applied AND NOT explicit_action')} AS correction_only_rate,
 avg(flipped) AS mean_flipped, count(*) FILTER (WHERE action_taken IN {MUT} AND safety_ok)/nullif(CAST(count(*) FILTER (WHERE action_taken IN {MUT}) AS DOUBLE),0) AS safety_rate
 FROM surf GROUP BY 1,2)"""
INTS = ["steps", "reset_count", "risk_alert_count", "first_drift_step", "retrain_count", "first_retrain_step", "budget_limited_count"]
REALS = ["mean_accuracy", "mean_utility", "mean_risk_capital", "mean_shift_score", "mean_reliability", "mean_parameter_drift",
         "intervention_rate", "recommendation_rate", "recommendation_execution_rate", "interventions_per_1000",
         "correction_applied_rate", "correction_only_rate", "mean_flipped", "safety_rate"]
_R = lambda cols: ", ".join(f"round({c},6) AS {c}" for c in cols)

EVENTS_SQL = """harm AS (SELECT a.stream_id, a.strategy, count(*) FILTER (WHERE (b.risk_alert OR b.retrain_recommended) AND NOT (a.risk_alert OR a.retrain_recommended)) AS events_avoided
 FROM surf a JOIN surf b ON a.stream_id=b.stream_id AND a.step=b.step AND b.strategy='frozen' GROUP BY 1,2)"""
VERSUS_SQL = """vs AS (SELECT s.*, b.mean_accuracy AS base_mean_accuracy, b.mean_utility AS base_mean_utility, b.mean_risk_capital AS base_mean_risk_capital,
 s.risk_alert_count/CAST(s.steps AS DOUBLE) AS alert_rate, b.risk_alert_count/CAST(b.steps AS DOUBLE) AS base_alert_rate, events_avoided,
 s.mean_utility-b.mean_utility AS utility_delta,
 greatest(CASE WHEN b.mean_risk_capital>0 THEN 1-s.mean_risk_capital/b.mean_risk_capital END,
  CASE WHEN b.risk_alert_count>0 THEN 1-(s.risk_alert_count/CAST(s.steps AS DOUBLE))/(b.risk_alert_count/CAST(b.steps AS DOUBLE)) END,
  CASE WHEN b.retrain_count>0 THEN 1-s.retrain_count/CAST(b.retrain_count AS DOUBLE) END) AS risk_reduction,
 CASE WHEN s.first_retrain_step IS NULL AND b.first_retrain_step IS NULL THEN 0 WHEN b.first_retrain_step IS NULL THEN NULL
  WHEN s.first_retrain_step IS NULL THEN s.steps-b.first_retrain_step ELSE s.first_retrain_step-b.first_retrain_step END AS retrain_deferral
 FROM summ s JOIN summ b ON s.stream_id=b.stream_id AND b.strategy='frozen' JOIN harm h ON h.stream_id=s.stream_id AND h.strategy=s.strategy WHERE s.strategy<>'frozen')"""


def surface_table(spark, folder, rules=D.Rules(), strategies=D.STRATEGIES):
    """Decisions joined with their effect on the rows, written once for all parts of a report."""
    d = decision_table(spark, folder, rules, strategies)
    return settled(E.surfaces(d, C.event_batches(spark, folder)))


def summary_table(spark, folder):
    return E.strategy_summary(surface_table(spark, folder))


def versus_table(spark, folder):
    s = surface_table(spark, folder)
    summary = E.strategy_summary(s)
    return E.versus_baseline(summary, E.harmful_events(s)), summary, s


@query("decision_surfaces", decision_sql(SURFACE_SQL) + """SELECT stream_id, strategy, step, round(mean_abs_delta,6) AS mean_abs_delta,
round(max_abs_delta,6) AS max_abs_delta, flipped, correction_applied, round(accuracy,6) AS accuracy, round(utility,6) AS utility FROM surf""")
def decision_surfaces(spark, folder):
    s = surface_table(spark, folder)
    return s.select(*E.KEY, "step", r6("mean_abs_delta"), r6("max_abs_delta"), "flipped", "correction_applied",
                    r6("accuracy"), r6("utility"))


@query("strategy_summary", decision_sql(SURFACE_SQL, SUMMARY_SQL) + f"SELECT stream_id, strategy, {', '.join(INTS)}, {_R(REALS)} FROM summ")
def strategy_summary(spark, folder):
    return summary_table(spark, folder).select(*E.KEY, *INTS, *[r6(c) for c in REALS])


_VS = ["utility_delta", "risk_reduction"]


@query("versus_frozen", decision_sql(SURFACE_SQL, SUMMARY_SQL, EVENTS_SQL, VERSUS_SQL) +
       f"SELECT stream_id, strategy, {_R(_VS)}, events_avoided, retrain_deferral FROM vs")
def versus_frozen(spark, folder):
    return versus_table(spark, folder)[0].select(*E.KEY, *[r6(c) for c in _VS], "events_avoided", "retrain_deferral")


_KPI_SQL = """k AS (SELECT *, CASE WHEN base_alert_rate>0 THEN (1-alert_rate/base_alert_rate)*100 WHEN alert_rate=0 THEN 100.0 ELSE 0.0 END AS alert_reduction_pct,
 CASE WHEN base_mean_risk_capital>0 THEN (1-mean_risk_capital/base_mean_risk_capital)*100 ELSE 0.0 END AS exposure_reduction_pct,
 (mean_accuracy-base_mean_accuracy)*100 AS accuracy_delta_pp FROM vs)"""


@query("buyer_kpis", decision_sql(SURFACE_SQL, SUMMARY_SQL, EVENTS_SQL, VERSUS_SQL, _KPI_SQL) + """SELECT stream_id, strategy,
round(alert_reduction_pct,5) AS alert_reduction_pct, round(exposure_reduction_pct,5) AS exposure_reduction_pct, round(accuracy_delta_pp,5) AS accuracy_delta_pp,
abs(accuracy_delta_pp)<=1.0 AS accuracy_equivalent, alert_reduction_pct>=10 OR exposure_reduction_pct>=10 AS material_reduction,
CASE WHEN alert_reduction_pct>=50 THEN 'Alarms cut by '||CAST(round(alert_reduction_pct) AS BIGINT)||' %' WHEN exposure_reduction_pct>=50 THEN 'Risk exposure cut by '||CAST(round(exposure_reduction_pct) AS BIGINT)||' %'
WHEN accuracy_delta_pp>1.0 THEN 'Decision quality improved' ELSE 'Operational risk signals compared with the frozen model' END AS headline FROM k""")
def buyer_kpis(spark, folder):
    k = E.buyer_kpis(versus_table(spark, folder)[0])
    five = lambda n: F.round(n, 5).alias(n)
    return k.select(*E.KEY, five("alert_reduction_pct"), five("exposure_reduction_pct"), five("accuracy_delta_pp"),
                    "accuracy_equivalent", "material_reduction", "headline")


@query("business_kpis", decision_sql(SURFACE_SQL) + f"""SELECT stream_id, strategy, count(*) AS steps,
round(avg(utility-0.08*CAST(retrain_recommended AS INTEGER)),6) AS mean_business_score, round({_mean('risk_alert')},6) AS alert_rate,
round({_mean('retrain_recommended')},6) AS retrain_rate, round({_mean('explicit_action')},6) AS intervention_rate, round(avg(capital),6) AS mean_risk_capital FROM surf GROUP BY 1,2""")
def business_kpis(spark, folder):
    k = E.business_kpis(surface_table(spark, folder))
    return k.select(*E.KEY, "steps", *[r6(c) for c in k.columns if c not in {*E.KEY, "steps"}])


_CHECK_SQL = f"""sz AS (SELECT stream_id, count(*) AS n_rows FROM scores GROUP BY 1),
ev AS (SELECT v.*, n_rows, v.mean_utility-n.mean_utility AS d_naive, v.mean_utility-r.mean_utility AS d_sched FROM vs v JOIN sz USING (stream_id)
 JOIN summ n ON n.stream_id=v.stream_id AND n.strategy='naive' JOIN summ r ON r.stream_id=v.stream_id AND r.strategy='scheduled_retrain' WHERE v.strategy='multi_action'),
ck AS (SELECT stream_id, n_rows>=400 AS stream_size, coalesce(utility_delta>=0.0 OR risk_reduction*100>=5.0,false) AS economic_win, d_naive>=0 AS beat_naive, d_sched>=0 AS beat_scheduled_retrain,
 safety_rate IS NULL OR safety_rate>=0.85 OR (d_sched>=0 AND safety_rate>=0.65) AS adaptation_safety,
 intervention_rate>0 OR recommendation_execution_rate>0 OR recommendation_rate>0.05 OR correction_applied_rate>0.05 OR mean_flipped>0 AS policy_activity,
 coalesce(utility_delta>=0.02 AND risk_reduction*100>=15,false) AS stretch_passed FROM ev)"""
_ALL = "stream_size AND economic_win AND beat_naive AND beat_scheduled_retrain AND adaptation_safety AND policy_activity"


def _checks(spark, folder):
    versus, summary, _ = versus_table(spark, folder)
    sizes = C.event_scores(spark, folder).groupBy("stream_id").agg(F.count(F.lit(1)).alias("n_rows"))
    return E.source_checks(versus, summary, sizes, "multi_action", ["naive", "scheduled_retrain"])


@query("source_checks", decision_sql(SURFACE_SQL, SUMMARY_SQL, EVENTS_SQL, VERSUS_SQL, _CHECK_SQL) + f"""SELECT stream_id, concat_ws(';',
CASE WHEN NOT stream_size THEN 'stream_size' END, CASE WHEN NOT economic_win THEN 'economic_win' END, CASE WHEN NOT beat_naive THEN 'beat_naive' END,
CASE WHEN NOT beat_scheduled_retrain THEN 'beat_scheduled_retrain' END, CASE WHEN NOT adaptation_safety THEN 'adaptation_safety' END,
CASE WHEN NOT policy_activity THEN 'policy_activity' END) AS failed, {_ALL} AS passed, stretch_passed FROM ck""")
def source_checks(spark, folder):
    c = _checks(spark, folder)
    failed = F.transform(F.filter("checks", lambda x: ~x["passed"]), lambda x: x["name"])
    return c.select("stream_id", F.concat_ws(";", failed).alias("failed"), "passed", "stretch_passed")


@query("suite_verdict", decision_sql(SURFACE_SQL, SUMMARY_SQL, EVENTS_SQL, VERSUS_SQL, _CHECK_SQL) + f"""SELECT count(*) AS n_sources,
count(*) FILTER (WHERE {_ALL}) AS core_passing, bool_or(stretch_passed) AS stretch_any, count(*) FILTER (WHERE {_ALL})>=2 AS suite_passed FROM ck""")
def suite_verdict(spark, folder):
    return E.suite_verdict(_checks(spark, folder))


@query("head_to_head", decision_sql(SURFACE_SQL, SUMMARY_SQL) + "SELECT stream_id, " + ", ".join(
    f"round(max(mean_utility) FILTER (WHERE strategy='{s}'),6) AS {s}" for s in D.STRATEGIES) + """,
round(max(mean_utility) FILTER (WHERE strategy='multi_action')-max(mean_utility) FILTER (WHERE strategy='controller'),6) AS delta FROM summ GROUP BY 1""")
def head_to_head(spark, folder):
    h = E.head_to_head(summary_table(spark, folder), D.STRATEGIES, "multi_action", "controller")
    return h.select("stream_id", *[r6(c) for c in (*D.STRATEGIES, "delta")])


@query("action_counts", decision_sql() + """SELECT stream_id, strategy, kind, action, count(*) AS n FROM (SELECT stream_id, strategy, 'taken' AS kind, action_taken AS action FROM dec
UNION ALL SELECT stream_id, strategy, 'recommended', recommended_action FROM dec) GROUP BY ALL""")
def action_counts(spark, folder):
    return E.action_counts(decision_table(spark, folder))


_REV = f"""rev AS (SELECT s.*, CASE WHEN v.visible_at<=s.n_steps-1 THEN accuracy END AS revealed_accuracy FROM surf s
 JOIN (SELECT stream_id AS vs_, step AS vp, visible_at FROM vis) v ON vs_=s.stream_id AND vp=s.step)"""


def _revealed(spark, folder):
    s = surface_table(spark, folder)
    seen = visible_at(F.col("step"), DELAY, JITTER) <= F.col("n_steps") - 1
    return s.withColumn("revealed_accuracy", F.when(seen, F.col("accuracy")))


@query("driver_buckets", decision_sql(SURFACE_SQL, _REV) + """SELECT stream_id, strategy, CASE WHEN explicit_action THEN 'explicit_action'
WHEN correction_applied THEN 'correction_only' ELSE 'passive' END AS bucket, count(*) AS n, count(revealed_accuracy) AS revealed,
round(round(avg(revealed_accuracy),12),6) AS mean_accuracy, round(round(avg(utility) FILTER (WHERE revealed_accuracy IS NOT NULL),12),6) AS mean_utility,
round(round(avg(mean_abs_delta),12),6) AS mean_delta, round(round(avg(flipped),12),6) AS mean_flips FROM rev GROUP BY 1,2,3""")
def driver_buckets(spark, folder):
    b = E.driver_buckets(_revealed(spark, folder))
    return b.select(*E.KEY, "bucket", "n", "revealed", *[r6(c) for c in ("mean_accuracy", "mean_utility", "mean_delta", "mean_flips")])


@query("revealed_alerts", decision_sql(SURFACE_SQL, _REV) + """SELECT a.stream_id, a.strategy, round(avg(CASE WHEN a.revealed_accuracy<0.5 THEN 1.0 ELSE 0.0 END),6) AS alert_rate,
round(avg(greatest(0.0,0.5-a.revealed_accuracy)),6) AS burden, count(*) FILTER (WHERE b.revealed_accuracy<0.5 AND a.revealed_accuracy>=0.5) AS avoided,
count(*) FILTER (WHERE a.revealed_accuracy<0.5 AND b.revealed_accuracy>=0.5) AS introduced, round(avg(a.revealed_accuracy-b.revealed_accuracy),6) AS mean_delta
FROM rev a JOIN rev b ON a.stream_id=b.stream_id AND a.step=b.step AND b.strategy='frozen' WHERE a.revealed_accuracy IS NOT NULL GROUP BY 1,2""")
def revealed_alerts(spark, folder):
    a = E.revealed_alerts(_revealed(spark, folder), 0.5)
    return a.select(*E.KEY, r6("alert_rate"), r6("burden"), "avoided", "introduced", r6("mean_delta"))


@query("common_steps", C.event_sql(upto="batched") + "SELECT stream_id, step FROM batched WHERE step%2=0 GROUP BY 1,2 INTERSECT SELECT stream_id, step FROM batched WHERE step%3=0 GROUP BY 1,2")
def common_steps(spark, folder):
    b = C.event_batches(spark, folder).select("stream_id", "step").distinct()
    runs = b.where(F.col("step") % 2 == 0).withColumn("strategy", F.lit("a")).unionByName(
        b.where(F.col("step") % 3 == 0).withColumn("strategy", F.lit("b")))
    return E.common_steps(runs, "a", "b")


@query("failure_drivers")
def failure_drivers(spark, folder):
    """Gain from corrections and from actions: the full run against the same run without one of them."""
    full = surface_table(spark, folder, strategies=["multi_action"])
    still = surface_table(spark, folder, D.Rules(mode="shadow"), ["multi_action"])
    raw = F.when(F.col("abstained"), 0.0).otherwise(F.col("batch_accuracy")) - F.col("accuracy") + F.col("utility")
    f = full.groupBy("stream_id").agg(F.avg("utility").alias("full"), F.avg(raw).alias("no_correction"))
    j = f.join(still.groupBy("stream_id").agg(F.avg("utility").alias("no_actions")), "stream_id")
    c, a = F.col("full") - F.col("no_correction"), F.col("full") - F.col("no_actions")
    return j.select("stream_id", r6(c, "correction_gain"), r6(a, "action_gain"), E.driver_label(c, a).alias("driver"))


@query("acceptance_checks", decision_sql(SURFACE_SQL, SUMMARY_SQL) + """, ps AS (SELECT c.strategy AS candidate, c.stream_id, c.mean_utility-f.mean_utility AS vs_frozen,
 c.mean_utility-r.mean_utility AS vs_scheduled, m.mean_utility-c.mean_utility AS gap, c.intervention_rate AS action_rate FROM summ c JOIN summ f ON f.stream_id=c.stream_id AND f.strategy='frozen'
 JOIN summ r ON r.stream_id=c.stream_id AND r.strategy='scheduled_retrain' JOIN summ m ON m.stream_id=c.stream_id AND m.strategy='multi_action' WHERE c.strategy IN ('controller','naive')),
g AS (SELECT candidate, round(avg(vs_frozen),12) AS vf, round(avg(vs_scheduled),12) AS vr, round(avg(gap),12) AS mg, max(gap) AS wg, count(*) FILTER (WHERE gap<=0.03) AS k, avg(action_rate) AS ar FROM ps GROUP BY 1)
SELECT candidate, round(vf,6) AS vs_frozen, round(wg,6) AS worst_gap, k AS within, concat_ws(';', CASE WHEN vf<0 THEN 'mean_utility_vs_frozen' END,
CASE WHEN vr<0 THEN 'mean_utility_vs_scheduled' END, CASE WHEN mg>0.01 THEN 'mean_gap_vs_full' END, CASE WHEN wg>0.03 THEN 'worst_gap_vs_full' END,
CASE WHEN k<2 THEN 'source_coverage' END, CASE WHEN ar>0.05 THEN 'mean_action_rate' END) AS failed FROM g""")
def acceptance_checks(spark, folder):
    s = settled(summary_table(spark, folder).select(*E.KEY, "mean_utility", "intervention_rate"))
    u = s.groupBy("stream_id").pivot("strategy", list(D.STRATEGIES)).agg(F.first("mean_utility"))
    c = s.where(F.col("strategy").isin("controller", "naive")).join(
        u.select("stream_id", F.col("frozen").alias("f"), F.col("scheduled_retrain").alias("r"),
                 F.col("multi_action").alias("m")), "stream_id")
    per = c.select(F.col("strategy").alias("candidate"), (F.col("mean_utility") - F.col("f")).alias("vs_frozen"),
                   (F.col("mean_utility") - F.col("r")).alias("vs_scheduled"), (F.col("m") - F.col("mean_utility")).alias("gap"),
                   F.lit(None).cast("double").alias("burden_delta"), F.col("intervention_rate").alias("action_rate"))
    return E.acceptance(per).select("candidate", r6("vs_frozen"), r6("worst_gap"), "within",
                                    F.concat_ws(";", "failed").alias("failed"))


def _mode_kpis_sql(mode: str) -> str:
    return decision_sql(SURFACE_SQL, mode=mode) + f"""SELECT stream_id, strategy, round(avg(utility-0.08*CAST(retrain_recommended AS INTEGER)),6) AS score,
round({_mean('risk_alert')},6) AS alert_rate, round({_mean('explicit_action')},6) AS intervention_rate FROM surf WHERE strategy IN ('frozen','multi_action') GROUP BY 1,2"""


@query("dual_mode", f"""SELECT stream_id, strategy, a.score AS shadow_score, a.alert_rate AS shadow_alert_rate, a.intervention_rate AS shadow_intervention_rate,
b.score AS bounded_auto_score, b.alert_rate AS bounded_auto_alert_rate, b.intervention_rate AS bounded_auto_intervention_rate
FROM ({_mode_kpis_sql('shadow')}) a JOIN ({_mode_kpis_sql('bounded_auto')}) b USING (stream_id, strategy)""")
def dual_mode(spark, folder):
    """Shadow and bounded runs of one controller side by side."""
    parts = []
    for mode in ("shadow", "bounded_auto"):
        s = surface_table(spark, folder, D.Rules(mode=mode), ["frozen", "multi_action"])
        parts.append(E.business_kpis(s, ["stream_id", "strategy", "operating_mode"]))
    both = parts[0].unionByName(parts[1])
    return both.groupBy(*E.KEY).pivot("operating_mode", ["shadow", "bounded_auto"]).agg(
        F.round(F.first("mean_business_score"), 6).alias("score"), F.round(F.first("alert_rate"), 6).alias("alert_rate"),
        F.round(F.first("intervention_rate"), 6).alias("intervention_rate"))


# ---- across runs -----------------------------------------------------------------------------

_RUN_METRICS = ["mean_accuracy", "mean_utility", "mean_risk_capital", "mean_shift_score", "mean_reliability"]
_RUN_UNPIVOT = " UNION ALL ".join(f"SELECT stream_id, strategy, '{m}' AS metric, {m} AS value FROM summ" for m in _RUN_METRICS)


@query("across_runs", decision_sql(SURFACE_SQL, SUMMARY_SQL) + f"""SELECT strategy, metric, round(avg(value),6) AS mean, round(stddev_pop(value),5) AS std
FROM ({_RUN_UNPIVOT}) GROUP BY 1,2""")
def across_runs(spark, folder):
    long = E.unpivot_metrics(summary_table(spark, folder), E.KEY, _RUN_METRICS)
    return E.across_runs(long, "stream_id").select("strategy", "metric", r6("mean"), F.round("std", 5).alias("std"))


@query("benchmark_wins", decision_sql(SURFACE_SQL, SUMMARY_SQL) + """SELECT strategy, count(*) FILTER (WHERE mean_utility>=bu-1e-6) AS utility_wins, round(avg(mean_utility-fu),6) AS utility_margin,
count(*) FILTER (WHERE mean_accuracy>=ba-1e-6) AS accuracy_wins, round(avg(mean_accuracy-fa),6) AS accuracy_margin FROM summ JOIN
(SELECT stream_id AS bs, max(mean_utility) AS bu, max(mean_accuracy) AS ba, max(mean_utility) FILTER (WHERE strategy='frozen') AS fu, max(mean_accuracy) FILTER (WHERE strategy='frozen') AS fa FROM summ GROUP BY 1)
ON bs=stream_id GROUP BY 1""")
def benchmark_wins(spark, folder):
    s = settled(summary_table(spark, folder))
    w = E.wins(s, "stream_id", {"utility": "mean_utility", "accuracy": "mean_accuracy"})
    return w.select("strategy", "utility_wins", r6("utility_margin"), "accuracy_wins", r6("accuracy_margin"))


_EDGE = """edge AS (SELECT stream_id, strategy, round(avg(accuracy) FILTER (WHERE step<least(10,n_steps//4+1)),12) AS early_accuracy,
 round(avg(accuracy) FILTER (WHERE step>n_steps-1-least(10,n_steps//4+1)),12) AS final_accuracy FROM surf GROUP BY 1,2)"""


def _edges(spark, folder):
    width = F.least(F.lit(10), F.floor(F.col("n_steps") / 4) + 1)
    return E.edge_accuracy(surface_table(spark, folder), E.KEY, F.col("n_steps") - 1, width)


@query("edge_accuracy", decision_sql(SURFACE_SQL, _EDGE) + "SELECT stream_id, strategy, round(early_accuracy,6) AS early_accuracy, round(final_accuracy,6) AS final_accuracy FROM edge")
def edge_accuracy(spark, folder):
    return _edges(spark, folder).select(*E.KEY, r6("early_accuracy"), r6("final_accuracy"))


@query("significance", decision_sql(SURFACE_SQL, _EDGE) + """, dl AS (SELECT a.strategy, a.final_accuracy-b.final_accuracy AS d FROM edge a JOIN edge b ON a.stream_id=b.stream_id AND b.strategy='frozen'),
g AS (SELECT strategy, count(d) AS n, avg(d) AS m, stddev_samp(d) AS sd, count(*) FILTER (WHERE d>0) AS n_positive FROM dl GROUP BY 1)
SELECT strategy, n, round(m,6) AS mean, round(sd,6) AS std, n_positive, CASE WHEN sd<1e-10 THEN 'degenerate' ELSE 't' END AS method,
CASE WHEN sd>=1e-10 THEN round(m/(sd/sqrt(n)),4) END AS t FROM g""")
def significance(spark, folder):
    e = settled(_edges(spark, folder))
    base = e.where(F.col("strategy") == "frozen").select("stream_id", F.col("final_accuracy").alias("b"))
    d = e.join(base, "stream_id").select("strategy", (F.col("final_accuracy") - F.col("b")).alias("d"))
    return E.t_statistics(d, ["strategy"], "d").select("strategy", "n", r6("mean"), r6("std"), "n_positive", "method",
                                                       (F.round("t", 4) + 0.0).alias("t"))


@query("false_alarms", C.line_sql() + f"""SELECT stream_id, count(*) AS n, round({_mean('alert')},6) AS false_alert_rate, round({_mean('severe')},6) AS false_severe_rate,
round(avg(score),6) AS mean_shift, round(max(score),6) AS max_shift FROM signals WHERE step<greatest(5,n_steps//4) GROUP BY 1""")
def false_alarms(spark, folder):
    f = E.false_alarms(C.line_signals(spark, folder))
    return f.select("stream_id", "n", *[r6(c) for c in ("false_alert_rate", "false_severe_rate", "mean_shift", "max_shift")])


_MAGS = [0.0, 0.5, 1.5]


@query("detector_scoreboard", "WITH RECURSIVE " + ",\n".join([
    C.EVENT_SCORES_SQL, C.batched_sql(C.EVENT_ORDER_SQL).replace("batched AS", "plain AS"),
    f"""batched AS (SELECT stream_id||'|'||m AS stream_id, step, n_steps, p, y, m, CASE WHEN step>=n_steps//2 THEN f0*(1+m) ELSE f0 END AS f0, f1 FROM plain, (SELECT unnest({_MAGS}) AS m))""",
    C.stats_sql(C.EVENT_FEATURES), C.reference_sql(C.EVENT_FEATURES), C.signals_sql(C.EVENT_FEATURES)]) + """,
al AS (SELECT stream_id, step, n_steps//2 AS onset, greatest(2,n_steps//4) AS fs, detector, CASE detector WHEN 'batch' THEN alert ELSE feature_score>=1.75 END AS alarm FROM signals, (SELECT unnest(['batch','feature']) AS detector)),
tr AS (SELECT detector, stream_id, split_part(stream_id,'|',2) AS magnitude, count(*) FILTER (WHERE alarm AND step>=fs AND step<onset)/CAST(count(*) FILTER (WHERE step>=fs AND step<onset) AS DOUBLE) AS far,
 min(step) FILTER (WHERE alarm AND step>=onset)-any_value(onset) AS latency FROM al GROUP BY 1,2,3)
SELECT detector, magnitude, count(*) AS trials, round(avg(far),6) AS false_alarm_rate, round(avg(latency),6) AS mean_latency, round(avg(CASE WHEN latency IS NULL THEN 1.0 ELSE 0.0 END),6) AS missed_rate FROM tr GROUP BY 1,2""")
def detector_scoreboard(spark, folder):
    """Two detectors on every stream with a known scale drift of several sizes from its middle on."""
    b = C.event_batches(spark, folder)
    m = F.explode(F.array(*[F.lit(x) for x in _MAGS])).alias("m")
    b = b.select("stream_id", "step", "n_steps", "p", "y", "f0", "f1", m)
    late = F.col("step") >= F.floor(F.col("n_steps") / 2)
    b = b.withColumn("f0", F.when(late, F.col("f0") * (1 + F.col("m"))).otherwise(F.col("f0"))).withColumn(
        "stream_id", F.concat_ws("|", "stream_id", F.col("m").cast("string")))
    s = R.drift_surface(B.batch_stats(b, C.EVENT_FEATURES), 2, C.step_bound(spark, folder, "events"))
    kinds = F.explode(F.array(
        F.struct(F.lit("batch").alias("detector"), F.col("alert").alias("alarm")),
        F.struct(F.lit("feature").alias("detector"), (F.col("feature_score") >= 1.75).alias("alarm"))))
    a = s.select("stream_id", "step", F.floor(F.col("n_steps") / 2).alias("onset"),
                 F.greatest(F.lit(2), F.floor(F.col("n_steps") / 4)).alias("first_step"),
                 F.split("stream_id", r"\|")[1].alias("magnitude"), kinds.alias("k")).select("*", "k.*").drop("k")
    d = E.detector_scores(a, ["stream_id"], ["detector", "magnitude"])
    return d.select("detector", "magnitude", "trials", r6("false_alarm_rate"), r6("mean_latency"), r6("missed_rate"))


@query("served_accuracy", C.line_sql("""o AS (SELECT regime, y, step%9=4 AS abstained, strategy, CAST(p>=t AS INTEGER) AS yhat FROM batched, (SELECT unnest(['frozen','cautious']) AS strategy, unnest([0.5,0.35]) AS t))""",
    upto="batched", tail=True) + """SELECT strategy, coalesce(regime,'*') AS regime, count(*) AS n, round(avg(CASE WHEN yhat=y AND NOT abstained THEN 1.0 ELSE 0.0 END),6) AS accuracy,
round(count(*) FILTER (WHERE yhat=y AND NOT abstained)/greatest(1.0,count(*) FILTER (WHERE NOT abstained)),6) AS served_accuracy, round(avg(CASE WHEN abstained THEN 0.0 ELSE 1.0 END),6) AS coverage
FROM o GROUP BY GROUPING SETS ((strategy, regime), (strategy))""")
def served_accuracy(spark, folder):
    from driftgauge.operators.metrics import outcomes_by_strategy
    b = C.line_batches(spark, folder, keep_tail=True)
    o = outcomes_by_strategy(b, {"frozen": (F.col("p"), 0.5), "cautious": (F.col("p"), 0.35)}, ["step", "regime"])
    s = E.served_accuracy(o.withColumn("abstained", F.col("step") % 9 == 4))
    return s.select("strategy", "regime", "n", r6("accuracy"), r6("served_accuracy"), r6("coverage"))


# ---- episodes, audit, approvals --------------------------------------------------------------

_EPI = """ev AS (SELECT *, risk_alert OR retrain_recommended OR shift_score>=1.0 AS on_ FROM dec),
gi AS (SELECT *, sum(CASE WHEN on_ THEN 0 ELSE 1 END) OVER (PARTITION BY stream_id, strategy ORDER BY step) AS island FROM ev),
ac AS (SELECT stream_id, strategy, island, string_agg(action_taken||':'||n, ', ' ORDER BY action_taken||':'||n) AS action_summary FROM
 (SELECT stream_id, strategy, island, action_taken, count(*) AS n FROM gi WHERE on_ GROUP BY ALL) GROUP BY 1,2,3),
ep AS (SELECT g.stream_id, g.strategy, min(step) AS start_step, max(step) AS end_step, max(shift_score) AS peak_shift_score, max(capital) AS peak_risk_capital,
 bool_or(retrain_recommended) AS retrain_recommended, any_value(action_summary) AS action_summary FROM gi g JOIN ac a ON a.stream_id=g.stream_id AND a.strategy=g.strategy AND a.island=g.island
 WHERE on_ GROUP BY g.stream_id, g.strategy, g.island)"""


@query("drift_episodes", decision_sql(_EPI) + """SELECT stream_id, strategy, start_step, end_step, round(peak_shift_score,6) AS peak_shift_score,
round(peak_risk_capital,6) AS peak_risk_capital, retrain_recommended, action_summary FROM ep
QUALIFY row_number() OVER (PARTITION BY stream_id, strategy ORDER BY peak_risk_capital DESC, peak_shift_score DESC, start_step)<=5""")
def drift_episodes(spark, folder):
    e = W.episodes(decision_table(spark, folder), rows=C.step_bound(spark, folder, "events"))
    return E.top_episodes(e).select(*E.KEY, "start_step", "end_step", r6("peak_shift_score"), r6("peak_risk_capital"),
                                    "retrain_recommended", "action_summary")


@query("worst_batches", decision_sql(SURFACE_SQL) + """SELECT stream_id, strategy, step, round(accuracy,6) AS accuracy, action_taken FROM surf
QUALIFY row_number() OVER (PARTITION BY stream_id, strategy ORDER BY round(accuracy,9), step)<=3""")
def worst_batches(spark, folder):
    s = surface_table(spark, folder).withColumn("accuracy", F.round("accuracy", 9))
    return E.worst_batches(s).select(*E.KEY, "step", r6("accuracy"), "action_taken")


@query("event_worthy", decision_sql() + f"""SELECT stream_id, strategy, step FROM dec WHERE action_taken NOT IN {QUIET} OR recommended_action NOT IN {QUIET}
OR risk_alert OR retrain_recommended OR budget_limited""")
def event_worthy(spark, folder):
    return P.event_worthy(decision_table(spark, folder)).select(*E.KEY, "step")


@query("interesting_events", decision_sql() + f"""SELECT stream_id, strategy, step, action_taken, recommended_action FROM dec WHERE action_taken NOT IN {QUIET}
OR recommended_action NOT IN {QUIET} OR risk_alert OR retrain_recommended OR budget_limited
QUALIFY row_number() OVER (PARTITION BY stream_id, strategy ORDER BY step)<=8""")
def interesting_events(spark, folder):
    """First eight eventful batches of every timeline, as the report shows them."""
    first = Window.partitionBy(*E.KEY).orderBy("step")
    return P.event_worthy(decision_table(spark, folder)).withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= 8).select(
        *E.KEY, "step", "action_taken", "recommended_action")


@query("budget_use", decision_sql() + """SELECT stream_id, strategy, step, CAST(coalesce(sum(CASE WHEN action_taken NOT IN ('none','hold','abstain') THEN 1 ELSE 0 END) OVER w,0) AS BIGINT) AS actions_in_window,
CAST(coalesce(sum(CASE WHEN action_taken='reset' THEN 1 ELSE 0 END) OVER w,0) AS BIGINT) AS resets_in_window FROM dec
WINDOW w AS (PARTITION BY stream_id, strategy ORDER BY step ROWS BETWEEN 23 PRECEDING AND 1 PRECEDING)""")
def budget_use(spark, folder):
    b = W.budget_use(decision_table(spark, folder), rows=C.step_bound(spark, folder, "events"))
    return b.select(*E.KEY, "step", "actions_in_window", "resets_in_window")


@query("audit_log", decision_sql() + """SELECT sha256(stream_id||'|'||step||'|'||strategy) AS record_id, stream_id, strategy, step, action_taken FROM dec""")
def audit_log(spark, folder):
    """The log after the same decisions were appended twice."""
    d = decision_table(spark, folder)
    rows = sinks.audit_rows(d.withColumnRenamed("capital", "risk_capital"), F.lit("2024-01-01 00:00:00").cast("timestamp"),
                            F.to_json(F.struct("signature", "profile")))
    path = sinks.scratch(spark, "audit")
    sinks.append_audit(rows, path)
    sinks.append_audit(rows, path)
    return spark.read.parquet(path).select("record_id", *E.KEY, "step", "action_taken")


@query("recent_audit", decision_sql() + "SELECT stream_id, strategy, step FROM dec ORDER BY step DESC, stream_id, strategy LIMIT 40")
def recent_audit(spark, folder):
    """The newest records of the log, exported as JSON lines and read back."""
    path = sinks.scratch(spark, "audit-export")
    sinks.export_audit(decision_table(spark, folder).select(*E.KEY, "step"), path, 40)
    return spark.read.schema("stream_id string, strategy string, step long").json(path)


@query("decision_records", decision_sql() + """SELECT stream_id, strategy, step, action_taken AS action, CAST(risk_alert AS VARCHAR) AS alert FROM dec""")
def decision_records(spark, folder):
    """Decision records as JSON messages, and two of their fields read from the text."""
    d = decision_table(spark, folder)
    m = d.select(*E.KEY, "step", F.to_json(F.struct("step", "action_taken", "risk_alert", "trust_state")).alias("value"))
    return m.select(*E.KEY, "step", F.get_json_object("value", "$.action_taken").alias("action"),
                    F.get_json_object("value", "$.risk_alert").alias("alert"))


@query("run_gauges", decision_sql(SURFACE_SQL) + """SELECT stream_id, strategy, round(max_by(shift_score,step),6) AS shift_score, round(max_by(capital,step),6) AS capital,
round(max_by(accuracy,step),6) AS accuracy, count(*) FILTER (WHERE risk_alert) AS alerts FROM surf GROUP BY 1,2""")
def run_gauges(spark, folder):
    g = E.gauges(surface_table(spark, folder))
    return g.select(*E.KEY, r6("shift_score"), r6("capital"), r6("accuracy"), "alerts")


@query("intervention_counter", decision_sql() + "SELECT action_taken, effective_mode, count(*) AS n FROM dec GROUP BY 1,2")
def intervention_counter(spark, folder):
    return E.intervention_counter(decision_table(spark, folder))


@query("report_artifacts", decision_sql() + """SELECT 'summary' AS part, count(DISTINCT (stream_id, strategy)) AS n FROM dec
UNION ALL SELECT 'versus', count(DISTINCT (stream_id, strategy)) FROM dec WHERE strategy<>'frozen'""")
def report_artifacts(spark, folder):
    """Report parts written as JSON and counted after reading them back."""
    versus, summary, _ = versus_table(spark, folder)
    path = sinks.scratch(spark, "report")
    sinks.write_report({"summary": summary, "versus": versus}, path)
    counts = [spark.read.json(f"{path}/{n}").agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("part"), "n")
              for n in ("summary", "versus")]
    return counts[0].unionByName(counts[1])


@query("approvals", decision_sql(mode="recommend") + f"""SELECT stream_id, step, CASE WHEN recommended_action NOT IN {QUIET} THEN 'accepted' ELSE 'rejected' END AS outcome
FROM dec WHERE strategy='multi_action' AND step%2=0""")
def approvals(spark, folder):
    """Approvals of recommend-mode decisions; those without a pending recommendation are rejected."""
    d = decision_table(spark, folder, D.Rules(mode="recommend"), ["multi_action"])
    asked = d.where(F.col("step") % 2 == 0).select(
        "stream_id", "step", "strategy", F.lit("recalibrate").alias("approved_action"), F.lit("ops").alias("approver"))
    good, bad = D.approved(d, asked)
    return good.select("stream_id", "step", F.lit("accepted").alias("outcome")).unionByName(
        bad.select("stream_id", "step", F.lit("rejected").alias("outcome")))


_PARAMS = """pv AS (SELECT stream_id, step AS version, temperature, bias FROM dec WHERE strategy='multi_action')"""


@query("parameter_versions", decision_sql(_PARAMS) + """SELECT p.stream_id, p.version, round(p.temperature,6) AS temperature, round(p.bias,6) AS bias, NULL::BIGINT AS restored_from
FROM pv p JOIN (SELECT stream_id AS s, max(version) AS t FROM pv GROUP BY 1) ON s=stream_id WHERE version>t-5+1
UNION ALL SELECT p.stream_id, t+1, round(p.temperature,6), round(p.bias,6), p.version FROM pv p JOIN (SELECT stream_id AS s, max(version) AS t FROM pv GROUP BY 1) ON s=stream_id WHERE version=3""")
def parameter_versions(spark, folder):
    """Roll every stream back to version 3 and keep the last five versions."""
    d = decision_table(spark, folder, strategies=["multi_action"])
    p = d.select("stream_id", F.col("step").alias("version"), "temperature", "bias")
    targets = p.select("stream_id").distinct().withColumn("to_version", F.lit(3).cast("long"))
    out = D.kept_versions(D.rolled_back(p, targets), 5)
    return out.select("stream_id", "version", r6("temperature"), r6("bias"), "restored_from")


@query("latest_parameters", decision_sql(_PARAMS) + "SELECT stream_id, max(version) AS version, round(max_by(temperature,version),6) AS temperature, round(max_by(bias,version),6) AS bias FROM pv GROUP BY 1")
def latest_parameters(spark, folder):
    d = decision_table(spark, folder, strategies=["multi_action"])
    p = D.latest_parameters(d.select("stream_id", F.col("step").alias("version"), "temperature", "bias"))
    return p.select("stream_id", "version", r6("temperature"), r6("bias"))


@query("action_tiers", decision_sql() + """SELECT strategy, CASE WHEN recommended_action IN ('adapt','reset','abstain') THEN 'high' ELSE 'low' END AS tier, count(*) AS n FROM dec GROUP BY 1,2""")
def action_tiers(spark, folder):
    """Recommendations by risk tier of the action table."""
    d = D.with_tier(decision_table(spark, folder), D.action_table(spark, [("notify_owner", "medium")]))
    return d.groupBy("strategy", "tier").agg(F.count(F.lit(1)).alias("n"))

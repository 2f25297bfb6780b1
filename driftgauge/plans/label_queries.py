"""Delayed labels, what is pending, and the quality of scored rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftgauge.functions import scalar as S
from driftgauge.operators import labels as L
from driftgauge.operators import metrics as M
from driftgauge.plans import canon as C
from driftgauge.plans.drift_queries import surface
from driftgauge.plans.registry import query, r6

DELAY, JITTER = 12, 6
_DEFF = f"greatest(0, {DELAY}+((step*7+{DELAY})%{2 * JITTER + 1})-{JITTER})"
VISIBLE_SQL = f"""vis AS (SELECT *, max(step+{_DEFF}) OVER (PARTITION BY stream_id ORDER BY step
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS visible_at FROM stats)"""


@query("reveal_steps", C.event_sql(VISIBLE_SQL, upto="stats") + f"""SELECT stream_id, step, {_DEFF} AS delay, visible_at,
visible_at>n_steps-1 AS flushed, least(visible_at,n_steps-1) AS reveal_step FROM vis""")
def reveal_steps(spark, folder):
    s = C.event_stats(spark, folder).select("stream_id", "step", "n_steps")
    r = L.with_reveal_step(s, DELAY, JITTER)
    return r.select("stream_id", "step", L.effective_delay(F.col("step"), DELAY, JITTER).alias("delay"),
                    "visible_at", "flushed", "reveal_step")


@query("reveal_steps_with_gaps", C.line_sql(f"""vis AS (SELECT *, max(step+{_DEFF}) OVER (PARTITION BY stream_id ORDER BY step
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS visible_at FROM stats WHERE step%5<>2)""", upto="stats") +
       "SELECT stream_id, step, visible_at FROM vis")
def reveal_steps_with_gaps(spark, folder):
    s = C.line_stats(spark, folder).select("stream_id", "step").where(F.col("step") % 5 != 2)
    return L.visible_at_some(s, DELAY, JITTER, rows=C.step_bound(spark, folder, "lineitem"))


@query("fixed_delay_outcomes", C.event_sql(upto="stats") + """SELECT stream_id, step+12 AS seen_at, step,
round(batch_accuracy,6) AS batch_accuracy FROM stats WHERE step+12<n_steps""")
def fixed_delay_outcomes(spark, folder):
    """Outcome of a batch at the step where a fixed delay makes it visible."""
    s = C.event_stats(spark, folder).select("stream_id", "step", "n_steps", "batch_accuracy")
    s = s.withColumn("seen_at", L.visible_at(F.col("step"), 12))
    return s.where(F.col("seen_at") < F.col("n_steps")).select(
        "stream_id", "seen_at", "step", r6("batch_accuracy"))


@query("reveal_outcomes", C.event_sql(upto="batched") + """SELECT stream_id||'-'||step AS batch_id, round(avg(CASE WHEN (p>=0.5)=(y=1)
THEN 1.0 ELSE 0.0 END)*CASE WHEN step%7=3 THEN 0 ELSE 1 END,6) AS batch_accuracy, CASE WHEN step%7=3 THEN 0.0 ELSE 1.0 END AS coverage,
round(avg(y-p),6) AS mean_residual, round(avg(y),6) AS label_rate FROM batched GROUP BY stream_id, step""")
def reveal_outcomes(spark, folder):
    """Labels joined to the scored rows by batch id, with abstained batches serving nothing."""
    key = F.concat_ws("-", "stream_id", F.col("step").cast("string"))
    b = C.event_batches(spark, folder).withColumn("batch_id", key)
    scored = b.select("batch_id", "step", "event_id", "p", S.predicted(F.col("p")).alias("yhat"))
    reveals = b.select("batch_id", "event_id", "y")
    rows = L.outcomes_at_reveal(scored, reveals, ["batch_id", "event_id"])
    m = L.reveal_metrics(rows, ["batch_id"], F.col("step") % 7 == 3)
    return m.select("batch_id", *[r6(c) for c in ("batch_accuracy", "coverage", "mean_residual", "label_rate")])


@query("first_reveals", """WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events)
SELECT user_id, event_id, k=1 AS accepted FROM r""")
def first_reveals(spark, folder):
    """A second reveal of one batch is rejected."""
    e = spark.read.parquet(f"{folder}/events.parquet").select("user_id", "event_id")
    good, bad = L.first_reveals(e, ["user_id"], "event_id")
    return good.withColumn("accepted", F.lit(True)).unionByName(bad.withColumn("accepted", F.lit(False)))


@query("pending_decisions", C.event_sql(VISIBLE_SQL, upto="stats") +
       "SELECT stream_id, step FROM vis WHERE step<=20 AND visible_at>20")
def pending_decisions(spark, folder):
    s = C.event_stats(spark, folder).select("stream_id", "step")
    return L.pending_at(s, s.withColumn("visible_at", L.visible_at(F.col("step"), DELAY, JITTER)), 20)


@query("pending_summary", C.event_sql(VISIBLE_SQL, upto="stats") + """SELECT a.stream_id, a.step, count(b.step) AS pending,
round(coalesce(avg(a.step-b.step),0.0),6) AS mean_age, coalesce(max(a.step-b.step),0) AS max_age,
round(coalesce(avg(CASE WHEN a.step-b.step>=24 THEN 1.0 ELSE 0.0 END),0.0),6) AS stale_share
FROM vis a LEFT JOIN vis b ON a.stream_id=b.stream_id AND b.step<a.step AND b.visible_at>=a.step GROUP BY 1,2""")
def pending_summary(spark, folder):
    p = L.pending_summary(C.event_stats(spark, folder), DELAY, JITTER)
    return p.select("stream_id", "step", "pending", r6("mean_age"), "max_age", r6("stale_share"))


RECENT_SQL = """pos AS (SELECT a.stream_id, a.step, max(b.step) AS newest FROM vis a JOIN vis b ON a.stream_id=b.stream_id
  AND b.visible_at<a.step GROUP BY 1,2),
recent AS (SELECT p.stream_id, p.step, avg(v.batch_accuracy) AS recent_accuracy,
  CASE WHEN count(*)>=2 THEN avg(v.batch_accuracy) END AS revealed_accuracy,
  CASE WHEN count(*)>=2 THEN avg(v.label_rate) END AS revealed_rate
  FROM pos p JOIN vis v ON v.stream_id=p.stream_id AND v.step BETWEEN p.newest-4 AND p.newest GROUP BY 1,2)"""


@query("recent_reveals", C.event_sql(VISIBLE_SQL, RECENT_SQL, upto="stats") + """SELECT s.stream_id, s.step,
round(recent_accuracy,6) AS recent_accuracy, round(revealed_accuracy,6) AS revealed_accuracy, round(revealed_rate,6) AS revealed_rate
FROM stats s LEFT JOIN recent r ON s.stream_id=r.stream_id AND s.step=r.step""")
def recent_reveals(spark, folder):
    stats = C.event_stats(spark, folder)
    r = L.recent_reveals(stats, DELAY, JITTER, rows=C.step_bound(spark, folder, "events"))
    return r.select("stream_id", "step", r6("recent_accuracy"), r6("revealed_accuracy"), r6("revealed_rate"))


_CAL = "1/(1+exp(-((ln(least(greatest(p,1e-6),1-1e-6)/(1-least(greatest(p,1e-6),1-1e-6)))-0.2)/1.25)))"


@query("correction_stats", C.event_sql(f"n AS (SELECT *, {_CAL} AS q FROM batched)", upto="batched") + """SELECT stream_id, step,
round(avg(abs(q-p)),6) AS mean_abs_delta, round(max(abs(q-p)),6) AS max_abs_delta,
count(*) FILTER (WHERE (q>=0.5)<>(p>=0.5)) AS flipped, max(abs(q-p))>1e-6 AS applied FROM n GROUP BY 1,2""")
def correction_stats(spark, folder):
    b = C.event_batches(spark, folder)
    b = b.withColumn("q", S.calibrated(F.col("p"), F.lit(1.25), F.lit(-0.2)))
    c = L.correction_stats(b, ["stream_id", "step"], "p", "q")
    return c.select("stream_id", "step", r6("mean_abs_delta"), r6("max_abs_delta"), "flipped", "applied")


@query("delayed_rewards", C.event_sql(VISIBLE_SQL, upto="capital") + """,
u AS (SELECT s.stream_id, s.step, s.batch_accuracy AS acc, k.capital, v.visible_at-s.step AS d,
  s.batch_accuracy-0.06*CAST(k.capital>=8 AS INTEGER)-0.03*0.2 AS util FROM signals s JOIN risk k ON s.stream_id=k.stream_id AND s.step=k.step
  JOIN vis v ON v.stream_id=s.stream_id AND v.step=s.step),
w AS (SELECT *, 1/(1+0.06*greatest(0,d-1)+0.03*greatest(0,4-1)+0.35*0.25) AS weight FROM u)
SELECT stream_id, step, round(util,6) AS utility, round(weight,6) AS weight,
round(least(greatest(util-0.01*greatest(0,capital-1)+0.15*least(greatest(acc-0.5,-0.5),0.5),-2),2)*least(greatest(weight,0.35),1),6) AS reward,
round(util+0.20*(acc-0.5)+0.05*(acc-0.5)-0.18*abs(acc-0.7)-0.02*greatest(0,1-0.9),6) AS retrospective,
round(least(greatest(1-0.3*least(1.0,d/12.0)-0.4*abs(acc-0.7)-0.2*greatest(0,1-0.9),0.2),1),6) AS trust FROM w""")
def delayed_rewards(spark, folder):
    risk = surface(spark, folder).select("stream_id", "step", "capital", "risk_alert")
    s = C.event_stats(spark, folder).select("stream_id", "step", "batch_accuracy").join(risk, ["stream_id", "step"])
    lit, acc = F.lit, F.col("batch_accuracy")
    d = L.visible_at(F.col("step"), DELAY, JITTER) - F.col("step")
    u = L.utility(acc, F.col("risk_alert"), lit(0.2), lit(False), lit("none"))
    s = s.withColumn("utility", u).withColumn("weight", L.delay_weight(d, lit(4), lit(0.25)))
    reward = L.delayed_reward(F.col("utility"), F.col("capital"), acc, lit(0.5), F.col("weight"))
    retro = L.retrospective_reward(F.col("utility"), acc, lit(0.5), acc, lit(0.7), lit(0.9))
    trust = L.reward_trust(d, acc, lit(0.7), lit(0.9), 0.3, 0.4, 0.2, 0.2)
    return s.select("stream_id", "step", r6("utility"), r6("weight"), r6(reward, "reward"),
                    r6(retro, "retrospective"), r6(trust, "trust"))


# ---- quality of scored rows ------------------------------------------------------------------

def outcomes(spark, folder, name="lineitem"):
    """All rows of every stream, those of a partial last batch too, under three scoring strategies."""
    # The position inside the stream is a unique row id.
    b = (C.line_batches if name == "lineitem" else C.event_batches)(spark, folder, keep_tail=True).withColumn("rid", F.col("idx"))
    p = F.col("p")
    variants = {"frozen": (p, 0.5), "cautious": (p, 0.35),
                "calibrated": (F.round(S.calibrated(p, F.lit(1.25), F.lit(-0.2)), 9), 0.5)}
    return M.outcomes_by_strategy(b, variants, ["stream_id", "step", "rid"])


OUTCOMES_SQL = f"""outcomes AS (SELECT stream_id, step, idx AS rid, y, 'frozen' AS strategy, p, CAST(p>=0.5 AS INTEGER) AS yhat FROM batched
UNION ALL SELECT stream_id, step, idx, y, 'cautious', p, CAST(p>=0.35 AS INTEGER) FROM batched
UNION ALL SELECT stream_id, step, idx, y, 'calibrated', round({_CAL},9), CAST(round({_CAL},9)>=0.5 AS INTEGER) FROM batched)"""
KEY = ["stream_id", "strategy"]


def class_sql(keys: str, source: str = "outcomes") -> str:
    return f"""SELECT *, CASE WHEN tp+fp>0 THEN tp/(tp+fp) ELSE 0.0 END AS precision, CASE WHEN tp+fn>0 THEN tp/(tp+fn) ELSE 0.0 END AS recall,
  CASE WHEN tp+fn>0 AND fp+tn>0 THEN (tp/(tp+fn)+tn/(fp+tn))/2 WHEN tp+fn>0 THEN tp/(tp+fn) WHEN fp+tn>0 THEN tn/(fp+tn) ELSE 0.0 END AS balanced_accuracy
  FROM (SELECT {keys}, count(*) AS n, count(*) FILTER (WHERE y=1 AND yhat=1) AS tp, count(*) FILTER (WHERE y=0 AND yhat=1) AS fp,
  count(*) FILTER (WHERE y=1 AND yhat=0) AS fn, count(*) FILTER (WHERE y=0 AND yhat=0) AS tn FROM {source} GROUP BY {keys})"""


def rank_sql(keys: str, source: str = "outcomes") -> str:
    on = " AND ".join(f"g.{k.strip()}=t.{k.strip()}" for k in keys.split(","))
    return f"""SELECT {', '.join('g.' + k.strip() for k in keys.split(','))}, any_value(np) AS n_pos, any_value(nn) AS n_neg,
  CASE WHEN any_value(np)>0 AND any_value(nn)>0 THEN sum(pos*(below+neg/2.0))/any_value(np)/any_value(nn) END AS roc_auc,
  CASE WHEN any_value(np)>0 AND any_value(nn)>0 THEN sum(pos*(tp/(tp+fp)))/any_value(np) END AS pr_auc
  FROM (SELECT *, sum(pos) OVER (PARTITION BY {keys} ORDER BY p DESC) AS tp, sum(neg) OVER (PARTITION BY {keys} ORDER BY p DESC) AS fp,
    coalesce(sum(neg) OVER (PARTITION BY {keys} ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS below
    FROM (SELECT {keys}, p, CAST(sum(y) AS DOUBLE) AS pos, CAST(sum(1-y) AS DOUBLE) AS neg FROM {source} GROUP BY {keys}, p)) g
  JOIN (SELECT {keys}, sum(y) AS np, sum(1-y) AS nn FROM {source} GROUP BY {keys}) t ON {on} GROUP BY {', '.join('g.' + k.strip() for k in keys.split(','))}"""


@query("classification_metrics", C.line_sql(OUTCOMES_SQL, f"m AS ({class_sql('stream_id, strategy')})", upto="batched", tail=True) + """
SELECT stream_id, strategy, n, tp, fp, fn, tn, round((tp+fn)/n,6) AS positive_rate, round((tp+tn)/n,6) AS accuracy,
round(balanced_accuracy,6) AS balanced_accuracy, round(precision,6) AS precision, round(recall,6) AS recall,
round(CASE WHEN precision+recall>0 THEN 2*precision*recall/(precision+recall) ELSE 0.0 END,6) AS f1,
round(CASE WHEN fp+tn>0 THEN fp/(fp+tn) ELSE 0.0 END,6) AS false_positive_rate,
round(CASE WHEN tp+fn>0 THEN fn/(tp+fn) ELSE 0.0 END,6) AS false_negative_rate,
round((fp+20.0*fn)/n,6) AS cost_weighted_error FROM m""")
def classification_metrics(spark, folder):
    m = M.classification(outcomes(spark, folder), KEY)
    counts = ["n", "tp", "fp", "fn", "tn"]
    return m.select(*KEY, *counts, *[r6(c) for c in m.columns if c not in {*KEY, *counts}])


@query("ranking_metrics", C.line_sql(OUTCOMES_SQL, f"m AS ({rank_sql('stream_id, strategy')})", upto="batched", tail=True) + """
SELECT stream_id, strategy, CAST(n_pos AS BIGINT) AS n_pos, CAST(n_neg AS BIGINT) AS n_neg, round(roc_auc,6) AS roc_auc, round(pr_auc,6) AS pr_auc FROM m""")
def ranking_metrics(spark, folder):
    rows = C.stream_rows(spark, folder, "lineitem")
    m = M.ranking(outcomes(spark, folder), KEY, rows)
    return m.select(*KEY, "n_pos", "n_neg", r6("roc_auc"), r6("pr_auc"))


RECALL_SQL = """wk AS (SELECT *, row_number() OVER w AS rank, CAST(sum(y) OVER (PARTITION BY stream_id, strategy ORDER BY p DESC, rid
   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS tp, lag(p) OVER w AS before FROM outcomes
   WINDOW w AS (PARTITION BY stream_id, strategy ORDER BY p DESC, rid)),
hit AS (SELECT stream_id, strategy, min(rank) AS h FROM wk WHERE tp/rank>={t} GROUP BY 1,2),
stp AS (SELECT w.stream_id, w.strategy, min(rank) AS s FROM wk w JOIN hit ON w.stream_id=hit.stream_id AND w.strategy=hit.strategy
   WHERE rank>h AND tp/rank<{t} AND p<before GROUP BY 1,2),
best AS (SELECT w.stream_id, w.strategy, max(tp) AS tp FROM wk w LEFT JOIN stp ON w.stream_id=stp.stream_id AND w.strategy=stp.strategy
   WHERE tp/rank>={t} AND (s IS NULL OR rank<s) GROUP BY 1,2),
tot AS (SELECT stream_id, strategy, sum(y) AS np, sum(1-y) AS nn FROM outcomes GROUP BY 1,2)"""


@query("recall_at_precision", C.line_sql(OUTCOMES_SQL, RECALL_SQL.replace("{t}", "0.36"), upto="batched", tail=True) + """
SELECT t.stream_id, t.strategy, CASE WHEN np>0 AND nn>0 THEN round(coalesce(tp/np,0.0),6) END AS recall_at_precision FROM tot t
LEFT JOIN best b ON t.stream_id=b.stream_id AND t.strategy=b.strategy""")
def recall_at_precision(spark, folder):
    m = M.recall_at_precision(outcomes(spark, folder), KEY, ["rid"], 0.36)
    return m.select(*KEY, r6("recall_at_precision"))


_HALVES = """mid AS (SELECT stream_id AS ms, strategy AS mg, (min(step)+max(step)+1)//2 AS m FROM outcomes GROUP BY 1,2),
hv AS (SELECT o.*, CASE WHEN step<m THEN 'first' ELSE 'second' END AS half FROM outcomes o JOIN mid ON ms=stream_id AND mg=strategy)"""
HALF_SQL = f"""{_HALVES}, hc AS ({class_sql('stream_id, strategy, half', 'hv')}), hr AS ({rank_sql('stream_id, strategy, half', 'hv')}),
hd AS (SELECT c.stream_id, c.strategy, max(recall) FILTER (WHERE c.half='first') AS first_recall, max(recall) FILTER (WHERE c.half='second') AS second_recall,
 max(recall) FILTER (WHERE c.half='second')-max(recall) FILTER (WHERE c.half='first') AS recall_delta,
 max(balanced_accuracy) FILTER (WHERE c.half='second')-max(balanced_accuracy) FILTER (WHERE c.half='first') AS balanced_accuracy_delta,
 max(pr_auc) FILTER (WHERE c.half='second')-max(pr_auc) FILTER (WHERE c.half='first') AS pr_auc_delta
 FROM hc c JOIN hr r ON c.stream_id=r.stream_id AND c.strategy=r.strategy AND c.half=r.half GROUP BY 1,2)"""


@query("half_deltas", C.line_sql(OUTCOMES_SQL, HALF_SQL, upto="batched", tail=True) + """SELECT stream_id, strategy,
round(first_recall,6) AS first_recall, round(second_recall,6) AS second_recall, round(recall_delta,6) AS recall_delta,
round(balanced_accuracy_delta,6) AS balanced_accuracy_delta, round(pr_auc_delta,6) AS pr_auc_delta FROM hd""")
def half_deltas(spark, folder):
    rows = C.stream_rows(spark, folder, "lineitem")
    d = M.half_deltas(outcomes(spark, folder), KEY, rows)
    return d.select(*KEY, *[r6(c) for c in d.columns if c not in KEY])


SPREAD_METRICS = ["balanced_accuracy", "pr_auc", "recall", "f1", "cost_weighted_error", "second_recall", "recall_delta"]


def quality_summary(spark, folder):
    rows = C.stream_rows(spark, folder, "lineitem")
    o = outcomes(spark, folder)
    m = M.classification(o, KEY).join(M.ranking(o, KEY, rows).select(*KEY, "roc_auc", "pr_auc"), KEY)
    return m.join(M.half_deltas(o, KEY, rows).drop("pr_auc_delta", "balanced_accuracy_delta"), KEY)


_SUMMARY_SQL = f"""cm AS ({class_sql('stream_id, strategy')}), rm AS ({rank_sql('stream_id, strategy')}),
qs AS (SELECT cm.*, CASE WHEN precision+recall>0 THEN 2*precision*recall/(precision+recall) ELSE 0.0 END AS f1,
 (fp+20.0*fn)/n AS cost_weighted_error, (tp+fn)/n AS positive_rate, pr_auc, first_recall, second_recall, recall_delta FROM cm JOIN rm ON cm.stream_id=rm.stream_id AND cm.strategy=rm.strategy
 JOIN hd ON cm.stream_id=hd.stream_id AND cm.strategy=hd.strategy)"""
_UNPIVOT = " UNION ALL ".join(f"SELECT stream_id, '{m}' AS metric, {m} AS v FROM qs" for m in SPREAD_METRICS)
SPREAD_SQL = f"""sp AS (SELECT stream_id, metric, max(v)-min(v) AS spread FROM ({_UNPIVOT}) GROUP BY 1,2),
hr2 AS (SELECT stream_id, concat_ws('; ', CASE WHEN positive_rate<0.001 THEN 'extreme_imbalance' END,
 CASE WHEN balanced_accuracy>=0.95 THEN 'balanced_accuracy_already_high' END,
 CASE WHEN second_recall>=first_recall-0.01 THEN 'no_late_degradation' END) AS reasons FROM qs WHERE strategy='frozen')"""


@query("metric_spreads", C.line_sql(OUTCOMES_SQL, HALF_SQL, _SUMMARY_SQL, SPREAD_SQL, upto="batched", tail=True) +
       "SELECT stream_id, metric, round(spread,6) AS spread, coalesce(spread>=0.005,false) AS rankable FROM sp")
def metric_spreads(spark, folder):
    s = M.metric_spreads(quality_summary(spark, folder), ["stream_id"], SPREAD_METRICS)
    return s.select("stream_id", "metric", r6("spread"), "rankable")


@query("headroom", C.line_sql(OUTCOMES_SQL, HALF_SQL, _SUMMARY_SQL, SPREAD_SQL, upto="batched", tail=True) +
       "SELECT stream_id, reasons, reasons='' AS has_headroom FROM hr2")
def headroom(spark, folder):
    s = quality_summary(spark, folder).where(F.col("strategy") == "frozen")
    return M.headroom(s).select("stream_id", "reasons", "has_headroom")


@query("rankable_sources", C.line_sql(OUTCOMES_SQL, HALF_SQL, _SUMMARY_SQL, SPREAD_SQL, upto="batched", tail=True) + """SELECT count(*) AS n_sources,
count(*) FILTER (WHERE k>=2) AS with_rankable_metrics, count(*) FILTER (WHERE reasons='' AND k>=2) AS rankable FROM (SELECT stream_id, count(*) FILTER
 (WHERE spread>=0.005) AS k FROM sp GROUP BY 1) a JOIN hr2 USING (stream_id)""")
def rankable_sources(spark, folder):
    q = quality_summary(spark, folder)
    k = M.metric_spreads(q, ["stream_id"], SPREAD_METRICS).groupBy("stream_id").agg(
        F.count_if("rankable").alias("k"))
    h = M.headroom(q.where(F.col("strategy") == "frozen")).select("stream_id", "has_headroom").join(k, "stream_id")
    return h.agg(F.count(F.lit(1)).alias("n_sources"), F.count_if(F.col("k") >= 2).alias("with_rankable_metrics"),
                 F.count_if(F.col("has_headroom") & (F.col("k") >= 2)).alias("rankable"))


_BINS = ", ".join(f"greatest(count(*) FILTER (WHERE least(floor(p*10),9)={i})/CAST(count(*) AS DOUBLE),1e-4) AS b{i}" for i in range(10))


@query("stability_index", C.event_sql(
    f"ch AS (SELECT stream_id, step, {_BINS} FROM batched GROUP BY 1,2)",
    f"rh AS (SELECT stream_id AS rs, {', '.join(f'b{i} AS r{i}' for i in range(10))} FROM (SELECT stream_id, {_BINS} FROM batched WHERE step<5 GROUP BY 1))",
    upto="batched") + f"""SELECT stream_id, step, round({'+'.join(f'(b{i}-r{i})*ln(b{i}/r{i})' for i in range(10))},6) AS psi FROM ch JOIN rh ON rs=stream_id""")
def stability_index(spark, folder):
    b = C.event_batches(spark, folder)
    return M.histogram_psi(b, b.where(F.col("step") < 5), ["stream_id", "step"]).select("stream_id", "step", r6("psi"))

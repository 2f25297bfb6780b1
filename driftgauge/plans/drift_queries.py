"""Drift core: batches, statistics, reference, signals, capital."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftgauge.functions import scalar as S
from driftgauge.operators import batches as B
from driftgauge.operators import drift as D
from driftgauge.plans import canon as C
from driftgauge.plans.registry import query, r6

SURFACE = ["feature_score", "output_score", "collapse_risk", "score"]
_round = lambda names: ", ".join(f"round({n},6) AS {n}" for n in names)


def surface(spark, folder, name="events", batch=C.BATCH):
    """Per stream and batch: signals, p-value, risk capital and both alerts."""
    signals = (C.event_signals if name == "events" else C.line_signals)(spark, folder, batch)
    keep = [*SURFACE, "alert", "severe", "p_value"]
    return D.risk_capital(signals, keep)


def _surface_out(df):
    return df.select("stream_id", "step", *[r6(c) for c in SURFACE], "alert", "severe", r6("p_value"),
                     r6("capital"), "risk_alert")


_SURFACE_SQL = f"""SELECT s.stream_id, s.step, {_round(SURFACE)}, alert, severe, round(p_value,6) AS p_value,
round(capital,6) AS capital, capital>=8.0 AS risk_alert
FROM signals s JOIN risk r ON s.stream_id=r.stream_id AND s.step=r.step"""


@query("drift_surface_events", C.event_sql(upto="capital") + _SURFACE_SQL)
def drift_surface_events(spark, folder):
    return _surface_out(surface(spark, folder))


@query("drift_surface_lineitem", C.line_sql(upto="capital") + _SURFACE_SQL)
def drift_surface_lineitem(spark, folder):
    return _surface_out(surface(spark, folder, "lineitem"))


@query("row_steps", C.event_sql(upto="batched") + "SELECT stream_id, event_id, idx, step FROM batched")
def row_steps(spark, folder):
    return C.event_batches(spark, folder).select("stream_id", "event_id", "idx", "step")


@query("row_steps_with_tail", "WITH " + ",\n".join([
    C.EVENT_SCORES_SQL, C.batched_sql(C.EVENT_ORDER_SQL, tail=True)])
    + " SELECT stream_id, event_id, step, n_steps FROM batched")
def row_steps_with_tail(spark, folder):
    return C.event_batches(spark, folder, keep_tail=True).select("stream_id", "event_id", "step", "n_steps")


_STATS = ["mean_entropy", "mean_p", "positive_rate", "mean_conf", "batch_accuracy", "label_rate", "mean_residual"]


@query("batch_stats_events", C.event_sql(upto="stats") + f"""SELECT stream_id, step, n,
round(m_f0,6) AS mean_f0, round(v_f0,6) AS var_f0, round(m_f1,6) AS mean_f1, round(v_f1,6) AS var_f1,
{_round(_STATS)} FROM stats""")
def batch_stats_events(spark, folder):
    at = F.element_at
    return C.event_stats(spark, folder).select(
        "stream_id", "step", "n", r6(at("f_mean", 1), "mean_f0"), r6(at("f_var", 1), "var_f0"),
        r6(at("f_mean", 2), "mean_f1"), r6(at("f_var", 2), "var_f1"), *[r6(c) for c in _STATS])


@query("array_feature_moments", """SELECT label, CAST(j-1 AS INTEGER) AS j, count(*) AS n, round(avg(x),5) AS mean_x,
round(var_pop(x),5) AS var_x FROM (SELECT label, generate_subscripts(embedding,1) AS j,
CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) GROUP BY 1,2""")
def array_feature_moments(spark, folder):
    e = spark.read.parquet(f"{folder}/embeddings.parquet")
    return B.array_moments(e, ["label"], "embedding").select(
        "label", "j", "n", F.round("f_mean", 5).alias("mean_x"), F.round("f_var", 5).alias("var_x"))


_REF = ["ref_mean_entropy", "ref_mean_p", "ref_positive_rate", "ref_mean_conf"]


@query("reference_profile", C.event_sql(upto="ref") + f"""SELECT stream_id, ref_batches,
round(rm_f0,5) AS mean_f0, round(rv_f0,5) AS var_f0, round(rm_f1,5) AS mean_f1, round(rv_f1,5) AS var_f1,
{_round(_REF)} FROM ref""")
def reference_profile(spark, folder):
    at = F.element_at
    r = B.reference_profile(B.reference_window(C.event_stats(spark, folder)), 2)
    five = lambda c, n: F.round(c, 5).alias(n)
    return r.select("stream_id", "ref_batches", five(at("ref_mean", 1), "mean_f0"),
                    five(at("ref_var", 1), "var_f0"), five(at("ref_mean", 2), "mean_f1"),
                    five(at("ref_var", 2), "var_f1"), *[r6(c) for c in _REF])


@query("reference_risk_scores", C.event_sql() + """SELECT stream_id, count(*) AS n_scores,
round(min(raw_risk),6) AS lowest, round(max(raw_risk),6) AS highest, round(sum(raw_risk),5) AS total
FROM signals WHERE step < greatest(2, n_steps//4) GROUP BY 1""")
def reference_risk_scores(spark, folder):
    lists = D.reference_scores(B.reference_window(C.event_signals(spark, folder)))
    total = F.aggregate("ref_scores", F.lit(0.0), lambda s, x: s + x)
    return lists.select("stream_id", F.size("ref_scores").cast("long").alias("n_scores"),
                        r6(F.element_at("ref_scores", 1), "lowest"),
                        r6(F.element_at("ref_scores", -1), "highest"), F.round(total, 5).alias("total"))


@query("tail_p_values", C.line_sql() + """SELECT stream_id, step, tail_count, round(p_value,6) AS p_value,
round(e_value,6) AS e_value FROM signals""")
def tail_p_values(spark, folder):
    """The ranked form: no list of reference scores is built."""
    stats = C.line_stats(spark, folder)
    ref = B.reference_profile(B.reference_window(stats), len(C.LINE_FEATURES))
    return D.tail_counts(D.shift_signals(stats, ref, len(C.LINE_FEATURES))).select(
        "stream_id", "step", "tail_count", r6("p_value"), r6("e_value"))


@query("scalar_shift", C.event_sql(upto="ref") + f""", j AS (
SELECT s.stream_id, step, abs(m_f0-rm_f0)+0.5*abs(v_f0-(rv_f0-1e-6)) AS feature_score,
 abs(mean_entropy-ref_mean_entropy)+abs(positive_rate-ref_positive_rate)+0.5*abs(mean_conf-ref_mean_conf) AS output_score,
 greatest(0.0,ref_mean_entropy-mean_entropy)+greatest(0.0,abs(positive_rate-0.5)-abs(ref_positive_rate-0.5)) AS collapse_risk,
 m_f0-rm_f0 AS drift_direction FROM stats s JOIN ref r ON s.stream_id=r.stream_id)
SELECT stream_id, step, round(feature_score,4) AS feature_score, round(output_score,6) AS output_score,
round(drift_direction,8) AS drift_direction,
feature_score+0.75*output_score+0.5*collapse_risk>=1.0 AS alert,
feature_score+0.75*output_score+0.5*collapse_risk>=1.8 OR collapse_risk>=0.35 AS severe FROM j""")
def scalar_shift(spark, folder):
    stats = C.event_stats(spark, folder)
    ref = B.reference_profile(B.reference_window(stats), 1, eps=0.0)
    return D.scalar_signals(stats, ref).select(
        "stream_id", "step", F.round("feature_score", 4).alias("feature_score"), r6("output_score"),
        F.round("drift_direction", 8).alias("drift_direction"), "alert", "severe")


_CONC = "greatest(n_pred_pos,n-n_pred_pos)/CAST(n AS DOUBLE)"
_ENRICHED_SQL = f"""enriched AS (SELECT * EXCLUDE (collapse_risk, score, alert, severe),
 {_CONC} AS class_concentration,
 greatest(collapse_risk, greatest({_CONC}-0.5,0.0)*1.25+greatest(0.0,0.35-mean_entropy)) AS collapse_risk FROM signals),
en AS (SELECT *, feature_score+0.75*output_score+0.65*collapse_risk AS score FROM enriched)"""


@query("collapse_enriched", C.event_sql(_ENRICHED_SQL) + """SELECT stream_id, step,
round(class_concentration,6) AS class_concentration, round(greatest(0.0,0.35-mean_entropy),6) AS entropy_collapse,
round(collapse_risk,6) AS collapse_risk, round(score,6) AS score, score>=1.1 OR collapse_risk>=0.18 AS alert,
score>=1.75 OR collapse_risk>=0.30 AS severe FROM en""")
def collapse_enriched(spark, folder):
    e = D.enriched(C.event_signals(spark, folder))
    return e.select("stream_id", "step", r6("class_concentration"),
                    r6(D.entropy_collapse(F.col("mean_entropy")), "entropy_collapse"),
                    r6("collapse_risk"), r6("score"), "alert", "severe")


_COLLAPSE = "(collapse_risk>=0.30 OR (severe AND output_score>=0.22))"
_CALM = "(NOT alert AND feature_score<0.9 AND output_score<0.14)"
GENERAL_SIGNATURE_SQL = f"""CASE WHEN {_COLLAPSE} THEN 'collapse_risk' WHEN {_CALM} THEN 'stable'
 WHEN feature_score>=greatest(1.15,1.45*output_score) AND collapse_risk<0.22 THEN 'covariate_drift'
 WHEN output_score>=greatest(0.18,1.2*feature_score) THEN 'label_drift'
 WHEN alert OR severe THEN 'mixed_drift' ELSE 'stable' END"""
SENSOR_SIGNATURE_SQL = f"""CASE WHEN (feature_score>=4.0 OR (score>=6.0 AND feature_score>=2.5)
   OR (severe AND feature_score>=2.0 AND output_score<=0.30)) AND collapse_risk<0.30 THEN 'reference_break'
 WHEN {_COLLAPSE} THEN 'collapse_risk' WHEN {_CALM} THEN 'stable'
 WHEN feature_score>=greatest(1.10,1.60*output_score) AND collapse_risk<0.22 THEN 'covariate_drift'
 WHEN output_score>=greatest(0.18,1.3*feature_score) OR alert OR severe THEN 'mixed_drift' ELSE 'stable' END"""


@query("shift_signatures", C.event_sql() + f"""SELECT stream_id, step,
{GENERAL_SIGNATURE_SQL} AS general_signature, {SENSOR_SIGNATURE_SQL} AS sensor_signature FROM signals""")
def shift_signatures(spark, folder):
    s = C.event_signals(spark, folder)
    return s.select("stream_id", "step", D.shift_signature(F.lit("general")).alias("general_signature"),
                    D.shift_signature(F.lit("sensor")).alias("sensor_signature"))


@query("behaviour_signature", C.event_sql(upto="batched") + """SELECT stream_id, step, round(avg(p),6) AS mean_p,
round(stddev_pop(p),6) AS std_p, round(avg(-(p*ln(p+1e-9)+(1-p)*ln(1-p+1e-9))),6) AS mean_entropy,
round(avg(CASE WHEN greatest(p,1-p)>0.7 THEN 1.0 ELSE 0.0 END),6) AS confident_share FROM batched GROUP BY 1,2""")
def behaviour_signature(spark, folder):
    b = B.behaviour_signature(C.event_batches(spark, folder))
    return b.select("stream_id", "step", *[r6(c) for c in ("mean_p", "std_p", "mean_entropy", "confident_share")])


_Z = ", ".join(f"({f}-rm_{f})/sqrt(rv_{f}+1e-6) AS z{i}" for i, f in enumerate(C.LINE_FEATURES))
_ZAGG = ", ".join(f"avg(z{i}) AS a{i}, var_pop(z{i}) AS b{i}, avg(abs(z{i})) AS c{i}, "
                  f"avg(pow(least(greatest(z{i},-3),3),3)) AS d{i}" for i in range(4))
_norm4 = lambda t: "sqrt(" + "+".join(t.format(i=i) for i in range(4)) + ")"


@query("pooled_signature", C.line_sql(
    f"z AS (SELECT b.stream_id, step, {_Z} FROM batched b JOIN ref r ON b.stream_id=r.stream_id)",
    f"za AS (SELECT stream_id, step, {_ZAGG} FROM z GROUP BY 1,2)", upto="ref") + f"""SELECT stream_id, step,
{', '.join(f'round({k}{i},5) AS {n}_{i}' for k, n in zip('abcd', ('mean', 'var', 'abs', 'skew')) for i in range(4))},
round({_norm4('a{i}*a{i}')},5) AS mean_norm, round({_norm4('(b{i}-1)*(b{i}-1)')},5) AS var_norm,
round((c0+c1+c2+c3)/4,5) AS abs_mean, round((abs(d0)+abs(d1)+abs(d2)+abs(d3))/4,5) AS skew_mean FROM za""")
def pooled_signature(spark, folder):
    b = C.line_batches(spark, folder)
    ref = B.reference_profile(B.reference_window(B.batch_stats(b, C.LINE_FEATURES)), 4)
    s = B.pooled_signature(b, ref, C.LINE_FEATURES)
    names = [f"{n}_{i}" for n in ("mean", "var", "abs", "skew") for i in range(4)]
    names += ["mean_norm", "var_norm", "abs_mean", "skew_mean"]
    return s.select("stream_id", "step",
                    *[(F.round(F.element_at("signature", i + 1), 5) + 0.0).alias(n) for i, n in enumerate(names)])


@query("score_functions", C.event_sql(upto="scores") + f"""SELECT event_id, round({C.sql_entropy('p')},6) AS entropy,
round(-(p*ln(p+1e-9)+(1-p)*ln(1-p+1e-9)),6) AS behaviour_entropy, round(greatest(p,1-p),6) AS confidence,
round(ln(least(greatest(p,1e-6),1-1e-6)/(1-least(greatest(p,1e-6),1-1e-6))),6) AS logit,
round(1/(1+exp(-least(greatest(f0/10,-40),40))),6) AS squashed, CAST(p>=0.5 AS INTEGER) AS yhat,
CAST(p>=least(greatest(0.99,0.05),0.95) AS INTEGER) AS yhat_strict,
round(1/(1+exp(-(0.02*f0-0.01*f1-0.2))),6) AS linear FROM scores""")
def score_functions(spark, folder):
    p = F.col("p")
    return C.event_scores(spark, folder).select(
        "event_id", r6(S.entropy(p), "entropy"), r6(S.behaviour_entropy(p), "behaviour_entropy"),
        r6(S.confidence(p), "confidence"), r6(S.logit(p), "logit"),
        r6(S.sigmoid(F.col("f0") / 10, 40), "squashed"), S.predicted(p).alias("yhat"),
        S.predicted(p, 0.99).alias("yhat_strict"),
        r6(S.linear_score([0.02, -0.01], [F.col("f0"), F.col("f1")], -0.2), "linear"))

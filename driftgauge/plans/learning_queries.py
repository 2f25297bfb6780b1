"""Regimes, bandit statistics, calibration and residual learning, text and models."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from driftgauge.functions import scalar as S
from driftgauge.operators import batches as B
from driftgauge.operators import drift as R
from driftgauge.operators import labels as L
from driftgauge.operators import learning as M
from driftgauge.operators import regimes as G
from driftgauge.operators import text as X
from driftgauge.operators.decisions import scalar_reliability
from driftgauge.operators.labels import utility
from driftgauge.plans import canon as C
from driftgauge.plans.decision_queries import decision_sql
from driftgauge.plans.evidence_queries import SURFACE_SQL, surface_table
from driftgauge.plans.label_queries import DELAY, JITTER, VISIBLE_SQL
from driftgauge.plans.registry import query, r6, table
from driftgauge.session import settled

WIDTH = 2 * len(C.EVENT_FEATURES) + 4


def _embedded(spark, folder):
    """Batch rows with an embedding of their moments mixed with the model's behaviour."""
    b = C.event_batches(spark, folder)
    stats = settled(B.batch_stats(b, C.EVENT_FEATURES))
    sig = B.behaviour_signature(b).select("stream_id", "step", F.array(
        "mean_p", "std_p", "mean_entropy", "confident_share").alias("behaviour"))
    j = stats.join(sig, ["stream_id", "step"])
    e = S.mixed_embedding(S.regime_embedding(F.col("f_mean"), F.col("f_var")), F.col("behaviour"))
    return settled(j.withColumn("embedding", e))


_SQUASH = "list_transform({v}, lambda x: tanh(x/(2.5*(sqrt(list_dot_product({v},{v})/2.0)+1e-6))))"
_EMB = f"""beh AS (SELECT stream_id AS bs, step AS bp, [avg(p), stddev_pop(p), avg(-(p*ln(p+1e-9)+(1-p)*ln(1-p+1e-9))), avg(CASE WHEN greatest(p,1-p)>0.7 THEN 1.0 ELSE 0.0 END)] AS bv FROM batched GROUP BY 1,2),
em1 AS (SELECT s.*, bv, list_concat({_SQUASH.format(v='[m_f0,m_f1]')}, {_SQUASH.format(v='[v_f0,v_f1]')}) AS raw FROM stats s JOIN beh ON bs=stream_id AND bp=step),
em2 AS (SELECT *, list_transform(raw, lambda x: x/sqrt(list_dot_product(raw,raw))) AS e FROM em1),
em3 AS (SELECT *, list_concat(list_transform(e, lambda x: 0.4*x), list_transform(bv, lambda x: 0.6*x*(0.5/(sqrt(list_dot_product(bv,bv)/4.0)+1e-6)))) AS mx FROM em2),
em AS (SELECT *, list_transform(mx, lambda x: x/sqrt(list_dot_product(mx,mx))) AS embedding FROM em3)"""


@query("regime_embeddings", C.event_sql(_EMB, upto="stats") + "SELECT stream_id, step, " + ", ".join(
    f"round(embedding[{i + 1}],6) AS e{i}" for i in range(WIDTH)) + " FROM em")
def regime_embeddings(spark, folder):
    return _embedded(spark, folder).select("stream_id", "step", *[r6(F.col("embedding")[i], f"e{i}") for i in range(WIDTH)])


_PROTO = """pro AS (SELECT stream_id AS ps, step AS name, embedding AS c FROM em WHERE step IN (0,9,19,29)),
ds AS (SELECT e.stream_id, e.step, name, sqrt(list_sum(list_transform(list_zip(embedding, c), lambda z: (z[1]-z[2])*(z[1]-z[2])))) AS d,
 list_dot_product(embedding,c)/((sqrt(list_dot_product(embedding,embedding))+1e-6)*(sqrt(list_dot_product(c,c))+1e-6)) AS sim FROM em e JOIN pro ON ps=e.stream_id)"""


@query("nearest_prototypes", C.event_sql(_EMB, _PROTO, upto="stats") + """SELECT stream_id, step, round(min(d),6) AS distance, min_by(name, d) AS nearest FROM ds GROUP BY 1,2""")
def nearest_prototypes(spark, folder):
    e = _embedded(spark, folder).select("stream_id", "step", "embedding")
    p = e.where(F.col("step").isin(0, 9, 19, 29)).select("stream_id", F.col("step").alias("name"), F.col("embedding").alias("c"))
    return G.nearest(e, p, "stream_id", "embedding", "c", "name").select("stream_id", "step", r6("distance"), "nearest")


@query("blended_similarity", C.event_sql(_EMB, _PROTO, upto="stats") + "SELECT stream_id, step, name, round(sim,6) AS similarity, round(0.4*sim+0.6*d,6) AS mixed FROM ds")
def blended_similarity(spark, folder):
    e = _embedded(spark, folder).select("stream_id", "step", "embedding")
    p = e.where(F.col("step").isin(0, 9, 19, 29)).select("stream_id", F.col("step").alias("name"), F.col("embedding").alias("c"))
    j = e.join(p, "stream_id")
    sim = S.cosine(F.col("embedding"), F.col("c"))
    mixed = S.blended(sim, S.euclidean(F.col("embedding"), F.col("c")))
    return j.select("stream_id", "step", "name", r6(sim, "similarity"), r6(mixed, "mixed"))


@query("pooled_chunks", "SELECT vec_id, " + ", ".join(
    f"round(list_avg(CAST(embedding[{a}:{b}] AS DOUBLE[])),6) AS q{i}" for i, (a, b) in enumerate(
        [(1, 11), (12, 22), (23, 33), (34, 44), (45, 54), (55, 64)])) + " FROM embeddings")
def pooled_chunks(spark, folder):
    e = table(spark, folder, "embeddings").select("vec_id", S.pooled(F.col("embedding").cast("array<double>"), 64).alias("q"))
    return e.select("vec_id", *[r6(F.col("q")[i], f"q{i}") for i in range(6)])


def _regime_events(spark, folder):
    """All decisions and reveals of the event streams, in order."""
    e = _embedded(spark, folder)
    sig = R.drift_surface(e, len(C.EVENT_FEATURES), C.step_bound(spark, folder, "events"), ready=True)
    acc = F.col("batch_accuracy")
    reward = L.retrospective_reward(utility(acc, F.col("alert"), F.lit(0.0), F.lit(False), F.lit("none")), acc, acc, acc, scalar_reliability(), F.lit(1.0))
    reveals = L.with_reveal_step(sig, DELAY, JITTER).select("stream_id", "step", "reveal_step", reward.alias("reward"), "batch_accuracy", "label_rate")
    return G.feedback_events(e, reveals, "embedding")


def regimes(spark, folder):
    return settled(G.assign_regimes(_regime_events(spark, folder), WIDTH))


# Events in order, and the prototypes of a stream as a list that each event replaces one entry of.
_SIM = "list_transform({p}, lambda x: list_dot_product(x.c, {e}))"
_CONFIDENCE = """least(1.0,greatest(0.0,0.60*{m}+0.14*least(1.0,{q}.n/4)+0.10*least(1.0,greatest(0.0,{q}.w-0.45)/0.20)+0.10*greatest(0.0,1-(now-{q}.s)/16.0)+0.06*{q}.k))"""
_NOVELTY = "least(1.0,greatest(0.0,greatest(0.0,1-{m})+0.18*greatest(0.0,0.60-{k})+0.12*{q}.v))"
_EVENT_SQL = f"""evs AS (SELECT stream_id, step AS time, 0 AS kind, step, embedding AS vec, NULL::DOUBLE AS reward, NULL::DOUBLE AS acc, NULL::DOUBLE AS rate FROM em
 UNION ALL SELECT v.stream_id, least(v.visible_at,v.n_steps-1), 1, v.step, [1.0,0,0,0,0,0,0,0], v.batch_accuracy-0.06*CAST(s.alert AS INTEGER)-0.18*abs(v.batch_accuracy-greatest(0.0,least(1.0,1-0.18*s.feature_score-0.22*s.output_score-0.35*s.collapse_risk))),
  v.batch_accuracy, v.label_rate FROM vis v JOIN signals s ON s.stream_id=v.stream_id AND s.step=v.step),
ev AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY time, kind, step) AS o FROM evs)"""
_REGIME_SQL = f"""rg(stream_id, o, kind, step, now, ac, ps, wait, i, sim, conf, novel, good) AS (
 SELECT stream_id, 0::BIGINT, 0, 0::BIGINT, 0::BIGINT, 0.5::DOUBLE, CAST([] AS STRUCT(c DOUBLE[], n DOUBLE, w DOUBLE, k DOUBLE, v DOUBLE, s BIGINT, q DOUBLE)[]),
  CAST([] AS STRUCT(st BIGINT, i BIGINT, k DOUBLE, v DOUBLE)[]), 0::BIGINT, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, false FROM ev WHERE o=1
 UNION ALL
 SELECT stream_id, o, kind, step, now, ac1, ps1,
  CASE WHEN kind=0 THEN list_append(wait, struct_pack(st:=step, i:=i1, k:=k1, v:=v1)) ELSE list_filter(wait, lambda x: x.st<>step) END, i1, m1,
  CASE WHEN kind=0 THEN k1 ELSE ps1[i1].k END, CASE WHEN kind=0 THEN v1 ELSE ps1[i1].v END, good1
 FROM (SELECT *, {_NOVELTY.format(m='m1', k='k1', q='q1')} AS v1
 FROM (SELECT *, {_CONFIDENCE.format(m='m1', q='q1')} AS k1
 FROM (SELECT *, CASE WHEN kind=0 THEN ps1[i1] END AS q1, CASE WHEN kind=0 THEN list_dot_product(ps1[i1].c, vec) END AS m1
 FROM (SELECT *, CASE WHEN kind=0 THEN list_position(sims1, list_max(sims1)) ELSE old.i END AS i1
 FROM (SELECT *, CASE WHEN kind=0 THEN {_SIM.format(p='ps1', e='vec')} END AS sims1
 FROM (SELECT *, list_concat(list_concat(ps[1:slot-1], [entry]), ps[slot+1:]) AS ps1
 FROM (SELECT *, CASE WHEN kind=1 THEN struct_pack(c:=p.c, n:=p.n, w:=0.84*p.w+0.16*reward, k:=0.84*p.k+0.16*least(1.0,greatest(0.0,old.k+CASE WHEN good1 THEN 0.10 ELSE -0.04 END)),
     v:=0.84*p.v+0.16*least(1.0,greatest(0.0,old.v*CASE WHEN good1 THEN 0.65 ELSE 1.10 END)), s:=now, q:=0.84*p.q+0.16*least(1.0,greatest(0.0,rate)))
   WHEN found THEN struct_pack(c:=vec, n:=1.0, w:=greatest(0.45,coalesce(p0.w,0.5)), k:=greatest(0.30,k0), v:=v0, s:=now, q:=0.5)
   ELSE struct_pack(c:=list_transform(mixed, lambda x: x/sqrt(list_dot_product(mixed,mixed))), n:=p.n+1, w:=p.w, k:=0.84*p.k+0.16*k0, v:=0.84*p.v+0.16*v0, s:=now, q:=p.q) END AS entry
 FROM (SELECT *, ps[slot] AS p, list_transform(list_zip(coalesce(ps[slot].c, vec), vec), lambda z: 0.82*z[1]+0.18*z[2]) AS mixed
 FROM (SELECT *, CASE WHEN kind=1 THEN old.i WHEN NOT found THEN b0 WHEN len(ps)<12 THEN len(ps)+1 ELSE list_position(worth, list_min(worth)) END AS slot
 FROM (SELECT *, CASE WHEN p0 IS NULL THEN 1.0 ELSE {_NOVELTY.format(m='m0', k='k0', q='p0')} END AS v0, kind=0 AND (p0 IS NULL OR m0<0.88) AS found,
   CASE WHEN kind=0 THEN list_transform(ps, lambda x: x.w+0.18*x.k+0.10*least(1.0,x.n/4)+0.06*greatest(0.0,1-(now-x.s)/16.0)-0.10*x.v) END AS worth
 FROM (SELECT *, CASE WHEN p0 IS NULL THEN 0.0 ELSE {_CONFIDENCE.format(m='m0', q='p0')} END AS k0
 FROM (SELECT *, ps[b0] AS p0, CASE WHEN kind=0 THEN list_dot_product(ps[b0].c, vec) END AS m0, kind=1 AND acc>=ac1 AS good1
 FROM (SELECT e.*, r.ps, r.wait, CASE WHEN e.kind=0 THEN e.step ELSE r.now END AS now, CASE WHEN e.kind=1 THEN 0.82*r.ac+0.18*e.acc ELSE r.ac END AS ac1,
   list_filter(r.wait, lambda x: x.st=e.step)[1] AS old, CASE WHEN e.kind=0 THEN list_position({_SIM.format(p='r.ps', e='e.vec')}, list_max({_SIM.format(p='r.ps', e='e.vec')})) END AS b0
   FROM rg r JOIN ev e ON e.stream_id=r.stream_id AND e.o=r.o+1)))))))))))))
)"""
_REGIMES = C.event_sql(_EMB, VISIBLE_SQL, _EVENT_SQL, _REGIME_SQL)


@query("regime_assignment", _REGIMES + """SELECT stream_id, step, CAST(i-1 AS INTEGER) AS prototype, round(sim,6) AS similarity, round(conf,6) AS confidence, round(novel,6) AS novelty,
sim>=0.93 OR conf>=0.58 AS familiar, (sim>=0.93 OR conf>=0.58) AND conf>=0.64 AND novel<=0.28 AS reuse_ready, CAST(len(ps) AS INTEGER) AS prototypes FROM rg WHERE o>0 AND kind=0""")
def regime_assignment(spark, folder):
    r = regimes(spark, folder).where("kind = 0")
    return r.select("stream_id", "step", "prototype", r6("similarity"), r6("confidence"), r6("novelty"), "familiar", "reuse_ready", "prototypes")


@query("regime_feedback", _REGIMES + """SELECT stream_id, step, CAST(i-1 AS INTEGER) AS prototype, good AS successful, round(ps[i].w,6) AS reward, round(conf,6) AS confidence,
round(novel,6) AS novelty FROM rg WHERE o>0 AND kind=1""")
def regime_feedback(spark, folder):
    """What each reveal made of the prototype that its decision named."""
    r = regimes(spark, folder).where("kind = 1")
    return r.select("stream_id", "step", "prototype", "successful", r6("prototype_reward", "reward"), r6("confidence"), r6("novelty"))


@query("regime_diagnostics", _REGIMES.rstrip() + """, last AS (SELECT stream_id, max_by(ps, o) AS ps FROM rg GROUP BY 1),
one AS (SELECT stream_id, unnest(ps) AS p FROM last)
SELECT stream_id, count(*) AS prototype_count, round(avg(p.w),6) AS mean_reward, round(avg(p.k),6) AS mean_confidence, round(avg(p.v),6) AS mean_novelty FROM one GROUP BY 1""")
def regime_diagnostics(spark, folder):
    """Means over the prototypes as they stand after the last event."""
    last = G.last_prototypes(_regime_events(spark, folder), WIDTH)
    d = G.regime_diagnostics(last)
    return d.select("stream_id", "prototype_count", r6("mean_reward"), r6("mean_confidence"), r6("mean_novelty"))


@query("cluster_routing")
def cluster_routing(spark, folder):
    e = _embedded(spark, folder)
    return G.route_clusters(e, "embedding", WIDTH, rows=C.step_bound(spark, folder, "events"))


_REG = """pp AS (SELECT stream_id, step AS prototype, batch_accuracy AS reward, CASE WHEN stream_id IN ('click','view') THEN 'web' ELSE 'core' END AS family FROM stats),
pk AS (SELECT *, family||':'||substr(sha256('dim=8'),1,8) AS registry_key FROM pp),
pu AS (SELECT * FROM pk QUALIFY row_number() OVER (PARTITION BY registry_key ORDER BY reward DESC, stream_id, prototype)<=20)"""


def _prototypes(spark, folder):
    e = _embedded(spark, folder).select("stream_id", F.col("step").alias("prototype"), F.col("batch_accuracy").alias("reward"),
                                        F.col("embedding").alias("c"))
    return e, F.when(F.col("stream_id").isin("click", "view"), "web").otherwise("core")


@query("registry_push", C.event_sql(_REG, upto="stats") + "SELECT registry_key, stream_id, prototype, round(reward,6) AS reward FROM pu")
def registry_push(spark, folder):
    p, family = _prototypes(spark, folder)
    return G.pushed(p, family, "c").select("registry_key", "stream_id", "prototype", r6("reward"))


@query("registry_pull", C.event_sql(_REG, upto="stats") + """SELECT stream_id, count(*) AS n, count(*) FILTER (WHERE shared) AS n_shared FROM (SELECT stream_id, false AS shared FROM pk
UNION ALL SELECT w.stream_id, true FROM (SELECT DISTINCT stream_id, registry_key FROM pk) w JOIN pu ON pu.registry_key=w.registry_key) GROUP BY 1""")
def registry_pull(spark, folder):
    p, family = _prototypes(spark, folder)
    got = G.pulled(p, G.pushed(p, family, "c"), family, "c")
    return got.groupBy("stream_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("shared").alias("n_shared"))


@query("support_scores", C.line_sql("""mm AS (SELECT regime AS mr, avg(l_quantity) AS mq, avg(l_discount) AS md FROM batched GROUP BY 1),
sc AS (SELECT b.*, p+0.15*sqrt((l_quantity-mq)*(l_quantity-mq)+(l_discount-md)*(l_discount-md)) AS s FROM batched b JOIN mm ON mr=regime)""", upto="batched", tail=True) + """
SELECT regime, stream_id, idx, round(s,6) AS support_score FROM sc QUALIFY row_number() OVER (PARTITION BY regime ORDER BY round(s,9) DESC, stream_id, idx)<=96""")
def support_scores(spark, folder):
    b = C.line_batches(spark, folder, keep_tail=True)
    s = G.support_scores(b, "regime", ["l_quantity", "l_discount"], F.col("p"))
    best = G.top_k(s, ["regime"], [F.round("support_score", 9).desc(), F.col("stream_id"), F.col("idx")], 96)
    return best.select("regime", "stream_id", "idx", r6("support_score"))


@query("diverse_support")
def diverse_support(spark, folder):
    b = C.line_batches(spark, folder, keep_tail=True).withColumn("id", F.concat_ws("-", "stream_id", F.col("idx").cast("string")))
    return G.diverse_support(b, "regime", ["l_quantity", "l_discount"], "y", F.col("p"), "id",
                             rows=2 * C.stream_rows(spark, folder, "lineitem")).select("regime", "rank", "id", "picked")


@query("prototype_staleness", C.event_sql(upto="stats") + "SELECT stream_id, step, round(greatest(0.0,1-greatest(0,n_steps-1-step)/16.0),6) AS recency FROM stats")
def prototype_staleness(spark, folder):
    s = C.event_stats(spark, folder)
    return s.select("stream_id", "step", r6(G.staleness(F.col("n_steps") - 1, F.col("step")), "recency"))


# ---- specialists -----------------------------------------------------------------------------

def _specialists(e):
    c = F.col
    s = e.where(c("step").isin(0, 9, 19, 29))
    ema = lambda k: (c("batch_accuracy") + k) / 2
    return s.select(
        "stream_id", c("step").alias("specialist"), c("embedding").alias("home"), c("f_mean").alias("support_mean"),
        c("f_var").alias("support_var"), c("label_rate").alias("support_rate"), ema(0.6).alias("reward_ema"),
        ema(0.9).alias("similarity_ema"), ema(-0.3).alias("lift_ema"), ema(0.0).alias("recurrence_reward_ema"),
        ema(-0.2).alias("route_advantage_ema"), ema(-0.4).alias("future_reuse_ema"), ema(-0.4).alias("support_quality_ema"),
        ema(0.7).alias("regime_confidence_ema"), ema(0.7).alias("exchangeability_ema"), ema(0.5).alias("cluster_quality"),
        ema(0.4).alias("coreset_quality"), (c("step") % 7).alias("usage_count"), (c("step") % 4).alias("successful_reuses"),
        (c("step") % 2).alias("shadow_wins"), c("step").alias("last_used_step"), (c("step") % 10).alias("reveal_count"),
        ema(1.0).alias("quality_ema"), F.lit(0).alias("probation_remaining"))


_SPEC = """sp AS (SELECT stream_id AS ss, step AS specialist, embedding AS home, m_f0 AS sm0, m_f1 AS sm1, v_f0 AS sv0, v_f1 AS sv1, label_rate AS sr, batch_accuracy AS a FROM em WHERE step IN (0,9,19,29)),
rt AS (SELECT e.stream_id, e.step, specialist, sqrt(list_sum(list_transform(list_zip(embedding, home), lambda z: (z[1]-z[2])*(z[1]-z[2])))) AS d,
 list_dot_product(embedding,home)/((sqrt(list_dot_product(embedding,embedding))+1e-6)*(sqrt(list_dot_product(home,home))+1e-6)) AS sim,
 least(1.0,greatest(0.0,0.7*exp(-0.65*least((abs(m_f0-sm0)/sqrt(sv0+1e-6)+abs(m_f1-sm1)/sqrt(sv1+1e-6))/2+0.5*(abs(v_f0-sv0)/(sv0+1e-6)+abs(v_f1-sv1)/(sv1+1e-6))/2,6.0))+0.3*exp(-4.0*abs(label_rate-sr)))) AS fit,
 abs(label_rate-sr)>0.15 AS stale, a FROM em e JOIN sp ON ss=e.stream_id),
rs AS (SELECT *, d-0.12*sim-(0.16*greatest(0,(a+0.6)/2-0.45)+0.10*greatest(0,(a+0.9)/2-0.75)+0.12*greatest(0,(a-0.3)/2)+0.20*greatest(0,a/2)+0.18*greatest(0,(a-0.2)/2)+0.16*greatest(0,(a-0.4)/2)
 +0.08*greatest(0,(a-0.4)/2)+0.10*greatest(0,(a+0.7)/2-0.55)+0.08*greatest(0,(a+0.7)/2-0.55)+0.14*greatest(0,(a+0.5)/2-0.45)+0.10*greatest(0,(a+0.4)/2-0.45)
 +0.18*greatest(0,sim-0.8)+0.18*greatest(0,fit-0.65)+0.06*least(1.0,(specialist%7)/6.0)+0.05*least(1.0,(specialist%4)/3.0)+0.04*least(1.0,(specialist%2)/3.0)
 +CASE WHEN step-specialist<=6 THEN 0.05 ELSE 0 END+CASE WHEN specialist%10>=4 THEN 0.12*greatest(0,(a+1.0)/2-0.65) ELSE 0 END) AS score FROM rt)"""


@query("specialist_routing", C.event_sql(_EMB, _SPEC, upto="stats") + """SELECT stream_id, step, specialist, round(score,6) AS route_score, round(fit,6) AS fit, stale FROM rs
QUALIFY row_number() OVER (PARTITION BY stream_id, step ORDER BY score, specialist)=1""")
def specialist_routing(spark, folder):
    e = _embedded(spark, folder)
    got = G.route(e.withColumn("signature", F.col("embedding")), _specialists(e))
    return got.select("stream_id", "step", "specialist", r6("route_score"), r6("fit"), "stale")


@query("retired_specialists", C.event_sql(upto="stats") + """SELECT stream_id, step AS specialist, (n_steps-1-step>=24 AND step%10>=2 AND (batch_accuracy+0.6)/2<0.58 AND batch_accuracy/2<0.3 AND step%4=0 AND step%2=0)
OR (step%10>=1 AND (batch_accuracy-0.4)/2<0.02 AND (batch_accuracy-0.4)/2<0.05 AND step%4=0 AND step%2=0)
OR (step%4>=3 AND step%10>=8 AND (batch_accuracy+1.0)/2<0.75 AND (batch_accuracy+1.0)/2<0.82) AS retired FROM stats WHERE step IN (0,9,19,29)""".replace("batch_accuracy/2<0.3", "batch_accuracy/2<0.08"))
def retired_specialists(spark, folder):
    e = _embedded(spark, folder)
    s = _specialists(e).join(e.select("stream_id", "n_steps").distinct(), "stream_id")
    return G.retired(s, F.col("n_steps") - 1, least_reward=0.58).select("stream_id", "specialist", "retired")


# ---- bandit ----------------------------------------------------------------------------------

_CTX = ["1.0::DOUBLE", "feature_score", "output_score", "collapse_risk", "mean_p-ref_mean_p", "ref_mean_conf-mean_conf", "least(capital,25.0)/25.0",
        "CAST(alert AS INTEGER)", "CAST(risk_alert AS INTEGER)"]
_BAND = f"""bx AS (SELECT s.recommended_action AS action, s.utility-0.01*greatest(0,s.capital-1) AS reward, {', '.join(f'{c} AS x{i}' for i, c in enumerate(
    [c.replace('feature_score', 's.feature_score').replace('output_score', 's.output_score').replace('collapse_risk', 's.collapse_risk').replace('(capital', '(s.capital').replace('(alert', '(s.alert').replace('(risk_alert', '(s.risk_alert') for c in _CTX]))}
 FROM surf s JOIN signals g ON g.stream_id=s.stream_id AND g.step=s.step WHERE s.strategy='multi_action')"""


def bandit_rows(spark, folder):
    s = surface_table(spark, folder, strategies=["multi_action"])
    sig = C.event_signals(spark, folder).select("stream_id", "step", "mean_p", "ref_mean_p", "mean_conf", "ref_mean_conf")
    j = s.join(sig, ["stream_id", "step"])
    reward = F.col("utility") - 0.01 * F.greatest(F.lit(0.0), F.col("capital") - 1)
    return settled(j.withColumn("x", M.bandit_context()).withColumn("reward", reward).withColumnRenamed("recommended_action", "action"))


@query("bandit_statistics", decision_sql(SURFACE_SQL, _BAND) + """SELECT action, count(*) AS n, """ + ", ".join(
    f"round(sum(x{i}*x{j}){'+1.0' if i == j else ''},5) AS a{i}{j}" for i in range(9) for j in range(i, 9)) + ", " + ", ".join(
    f"round(sum(reward*x{i}),5) AS b{i}" for i in range(9)) + " FROM bx GROUP BY 1")
def bandit_statistics(spark, folder):
    b = M.bandit_statistics(bandit_rows(spark, folder), ["action"])
    five = lambda c, n: (F.round(c, 5) + 0.0).alias(n)
    return b.select("action", "n", *[five(F.col("matrix")[9 * i + j], f"a{i}{j}") for i in range(9) for j in range(i, 9)],
                    *[five(F.col("vector")[i], f"b{i}") for i in range(9)])


@query("bandit_choices")
def bandit_choices(spark, folder):
    rows = bandit_rows(spark, folder).withColumnRenamed("shift_score", "score")
    sol = M.bandit_solutions(M.bandit_statistics(rows, ["stream_id", "action"]), ["stream_id", "action"])
    actions = ["none", "bn_refresh", "label_shift", "recalibrate", "adapt", "reset"]
    return M.bandit_choice(rows, sol, actions).select("stream_id", "step", "choice", r6("bound"))


# ---- calibration and residuals ---------------------------------------------------------------

_CALSQL = """cal(stream_id, step, t, b) AS (SELECT stream_id, -1::BIGINT, 1.0::DOUBLE, 0.0::DOUBLE FROM signals WHERE step=0 UNION ALL
 SELECT s.stream_id, s.step, CASE WHEN abs(s.mean_conf-s.ref_mean_conf)>0.01 THEN least(greatest(0.75*c.t+0.25*least(greatest(1-1.4*(s.ref_mean_conf-s.mean_conf),0.65),1.35),0.65),1.35) ELSE c.t END,
 CASE WHEN abs(s.mean_p-s.ref_mean_p)>0.02 THEN 0.65*c.b+0.35*least(greatest(ln(s.mean_p/(1-s.mean_p))-ln(s.ref_mean_p/(1-s.ref_mean_p)),-1.25),1.25) ELSE c.b END
 FROM cal c JOIN signals s ON s.stream_id=c.stream_id AND s.step=c.step+1)"""


def _flagged(spark, folder):
    s = C.event_signals(spark, folder)
    return (s.withColumn("recalibrate", F.abs(F.col("mean_conf") - F.col("ref_mean_conf")) > 0.01)
            .withColumn("shift_labels", F.abs(F.col("mean_p") - F.col("ref_mean_p")) > 0.02)
            .withColumn("refresh", F.col("feature_score") > 0.3))


@query("calibration_path", C.event_sql(_CALSQL) + "SELECT stream_id, step, round(t,6) AS temperature, round(b,6) AS bias FROM cal WHERE step>=0")
def calibration_path(spark, folder):
    p = M.calibration_path(_flagged(spark, folder), rows=C.step_bound(spark, folder, "events"))
    return p.select("stream_id", "step", r6("temperature"), r6("bias"))


@query("calibrated_rows", C.event_sql(_CALSQL) + """SELECT b.stream_id, b.step, round(avg(1/(1+exp(-((ln(least(greatest(p,1e-6),1-1e-6)/(1-least(greatest(p,1e-6),1-1e-6)))+c.b)/c.t)))),6) AS mean_q
FROM batched b JOIN cal c ON c.stream_id=b.stream_id AND c.step=b.step GROUP BY 1,2""")
def calibrated_rows(spark, folder):
    """Rows scored with the parameters of their batch."""
    p = M.calibration_path(_flagged(spark, folder), rows=C.step_bound(spark, folder, "events"))
    j = C.event_batches(spark, folder).join(p, ["stream_id", "step"])
    q = S.calibrated(F.col("p"), F.col("temperature"), F.col("bias"))
    return j.groupBy("stream_id", "step").agg(r6(F.avg(q), "mean_q"))


@query("running_statistics", C.event_sql("""rn(stream_id, step, m, d, s) AS (
 SELECT stream_id, -1::BIGINT, rm_f0, greatest(sqrt(rv_f0),1e-3), 0.0::DOUBLE FROM signals WHERE step=0
 UNION ALL SELECT g.stream_id, g.step, CASE WHEN feature_score>0.3 THEN 0.7*m+0.3*m_f0 ELSE m END,
  CASE WHEN feature_score>0.3 THEN greatest(0.7*d+0.3*greatest(sqrt(v_f0),1e-3),1e-3) ELSE d END,
  CASE WHEN feature_score>0.3 THEN least(0.85,s+0.18) ELSE s END FROM rn r JOIN signals g ON g.stream_id=r.stream_id AND g.step=r.step+1)""") +
       "SELECT stream_id, step, round(round(m,9),6) AS mean_f0, round(round(d,9),6) AS std_f0, round(s,6) AS strength FROM rn WHERE step>=0")
def running_statistics(spark, folder):
    r = M.running_statistics(_flagged(spark, folder), 2, rows=C.step_bound(spark, folder, "events"))
    at = F.element_at
    return r.select("stream_id", "step", r6(F.round(at("run_mean", 1), 9), "mean_f0"), r6(F.round(at("run_std", 1), 9), "std_f0"), r6("strength"))


@query("pseudo_label_step", C.event_sql("""g AS (SELECT stream_id, step, avg((p-CAST(p>=0.5 AS INTEGER))*f0) FILTER (WHERE greatest(p,1-p)>=0.7) AS gw,
 avg(p-CAST(p>=0.5 AS INTEGER)) FILTER (WHERE greatest(p,1-p)>=0.7) AS gb, avg(CASE WHEN greatest(p,1-p)>=0.7 THEN 1.0 ELSE 0.0 END) AS sel FROM batched GROUP BY 1,2)""", upto="batched") + """
SELECT stream_id, step, round(sel,6) AS selected, round(CASE WHEN sel>0 THEN least(greatest(1.1-0.12*(gw+0.08*(1.1-1.0)),0.2),1.8) ELSE 1.1 END,6) AS weight,
round(CASE WHEN sel>0 THEN least(greatest(0.1-0.12*(gb+0.08*0.1),-0.8),0.8) ELSE 0.1 END,6) AS bias FROM g""")
def pseudo_label_step(spark, folder):
    b = C.event_batches(spark, folder)
    got = M.pseudo_label_step(b, ["stream_id", "step"], "f0", 1.1, 0.1, 1.0, 0.0, 0.12, 0.7, 0.08, 0.8)
    got = got.withColumn("weight", F.coalesce("weight", F.lit(1.1)))
    return got.select("stream_id", "step", r6("selected"), r6("weight"), r6("bias"))


@query("residual_learning")
def residual_learning(spark, folder):
    """Correction parameters learned from reveals, with rank gradients, regimes and expert gates."""
    rows = C.step_bound(spark, folder, "events")
    stats = settled(C.event_stats(spark, folder))
    sig = R.drift_surface(stats, 2, rows, ready=True)
    risk = R.risk_capital(sig)
    j = sig.join(risk, ["stream_id", "step"]).withColumn("x", M.bandit_context())
    reg = regimes(spark, folder).where("kind = 0").select("stream_id", "step", "prototype", "similarity", "novelty",
                                        F.col("confidence").alias("recurrence"), F.col("prototype_reward").alias("reward"))
    b = C.event_batches(spark, folder)
    ref = B.reference_profile(B.reference_window(stats), 2)
    rb = b.join(ref.select("stream_id", "ref_mean", "ref_var", "ref_positive_rate"), "stream_id")
    z = S.standardized([F.col(c) for c in C.EVENT_FEATURES], F.col("ref_mean"), F.col("ref_var"))
    rb = rb.withColumn("z", z)
    rb = rb.withColumn("v", S.rank_vector(F.col("z"), F.col("p"), S.segment_of(F.col("p"), F.col("z"))))
    width = 2 + 2 + 6
    rate = F.col("ref_positive_rate")
    weight = S.clip((1 - rate) / F.greatest(rate, F.lit(1e-3)), 1, 12)
    grad = M.rank_gradient(rb, ["stream_id", "step"], "v", width, weight)
    gates = M.expert_gates(F.col("prototype") >= 0, F.col("recurrence"), F.col("similarity"), F.col("novelty"), F.col("reward"),
                           F.col("shift_delta"), F.col("capital_ema"), F.col("reliability_ema"), F.col("stale_share"))
    known = M.reveal_inputs(j.withColumn("reliability", scalar_reliability()), DELAY, JITTER, rows=rows)
    full = (j.join(reg, ["stream_id", "step"]).join(grad, ["stream_id", "step"]).join(known, ["stream_id", "step"]).withColumn("gates", gates)
            .withColumn("learn_ranks", F.col("ref_positive_rate") < 0.20))
    p = M.residual_path(full, 9, width, rows=rows)
    return p.select("stream_id", "step", r6("delta"), r6("threshold"), r6("rank_bias"), F.size("rank_weights").alias("n_ranks"))


# ---- text and models -------------------------------------------------------------------------

STOP = ["the", "and", "of", "to", "in", "is", "it", "that", "de", "la", "le", "les", "der", "die", "und", "el", "los"]
_STOPSQL = "(" + ",".join(f"'{w}'" for w in STOP) + ")"
_TF = f"""w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}_]+'), lambda x: length(x)>=2 AND x NOT IN {_STOPSQL}) AS ws FROM documents),
tk AS (SELECT doc_id, unnest(ws) AS term FROM w UNION ALL SELECT doc_id, unnest(list_transform(range(1, len(ws)), lambda i: ws[i]||' '||ws[i+1])) FROM w),
tf AS (SELECT doc_id, term, count(*) AS tf FROM tk GROUP BY 1,2),
vo AS (SELECT term, count(*) AS df, sum(tf) AS total FROM tf GROUP BY 1 HAVING count(*)>=2 ORDER BY total DESC, term LIMIT 4000),
vi AS (SELECT *, ln((1.0+(SELECT count(*) FROM documents))/(1.0+df))+1.0 AS idf FROM vo),
wt AS (SELECT doc_id, term, tf*idf AS x, sqrt(sum(tf*idf*tf*idf) OVER (PARTITION BY doc_id)) AS z FROM tf JOIN vi USING (term))"""


VOCABULARY = 4000


def text_weights(spark, folder):
    d = table(spark, folder, "documents").select("doc_id", "text")
    found = X.terms(d, "doc_id", "text", STOP)
    vocab = settled(X.vocabulary(found, d.count(), 2, VOCABULARY))
    return X.weighted_terms(found, vocab, "doc_id"), vocab


@query("term_vocabulary", f"WITH {_TF} SELECT term, df, CAST(total AS BIGINT) AS total, round(idf,6) AS idf FROM vi")
def term_vocabulary(spark, folder):
    return text_weights(spark, folder)[1].select("term", "df", "total", r6("idf"))


@query("term_weights", f"WITH {_TF} SELECT doc_id, term, round(x/z,6) AS weight FROM wt")
def term_weights(spark, folder):
    return text_weights(spark, folder)[0].select("doc_id", "term", r6("weight"))


@query("text_dimensions")
def text_dimensions(spark, folder):
    w, _ = text_weights(spark, folder)
    return X.reduced(w, "doc_id", VOCABULARY, 8).select("doc_id", *[F.round(f"d{i}", 6).alias(f"d{i}") for i in range(8)])


@query("logistic_scores")
def logistic_scores(spark, folder):
    """A balanced logistic baseline fitted on the first half of each stream and applied to the rest."""
    b = C.line_batches(spark, folder, keep_tail=True)
    early = b.where(F.col("step") < F.floor(F.col("n_steps") / 2)).select(*C.LINE_FEATURES, "y")
    late = b.where(F.col("step") >= F.floor(F.col("n_steps") / 2)).drop("p")
    model = M.logistic_baseline(early, C.LINE_FEATURES)
    out = M.score_with_model(late, model)
    return out.groupBy("stream_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("p"), 4).alias("mean_p"))


_WV = [0.02, -0.01]


@query("function_scores", C.event_sql(upto="scores") + "SELECT event_id, round(1/(1+exp(-(0.02*f0-0.01*f1))),6) AS q FROM scores")
def function_scores(spark, folder):
    s = C.event_scores(spark, folder)
    w = np.array(_WV)
    return M.score_with_function(s, C.EVENT_FEATURES, lambda x: 1 / (1 + np.exp(-(x @ w))), "q").select("event_id", r6("q"))


@query("registered_scorer", C.event_sql(upto="scores") + "SELECT event_id, round(1/(1+exp(-(0.02*f0-0.01*f1))),6) AS q FROM scores")
def registered_scorer(spark, folder):
    w = np.array(_WV)
    M.register_scorer(spark, "linear_scorer", lambda x: 1 / (1 + np.exp(-(x @ w))))
    s = C.event_scores(spark, folder)
    return s.select("event_id", r6(F.call_function("linear_scorer", F.array(*C.EVENT_FEATURES)), "q"))

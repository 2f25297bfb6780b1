"""Table preparation over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftgauge.functions import scalar as S
from driftgauge.operators import batches as B
from driftgauge.operators import prepare as P
from driftgauge.plans import canon as C
from driftgauge.plans.registry import query, r6, table
from driftgauge.session import stored
from driftgauge.sources import resolve as R

ORDER_TIME = ("o_orderdate", "o_orderkey")


def _time():
    return [F.col(c) for c in ORDER_TIME]


_POS = ("SELECT *, row_number() OVER (ORDER BY o_orderdate, o_orderkey)-1 AS idx, count(*) OVER () AS n FROM orders")


@query("record_metadata", """SELECT event_id, CAST(regime IS NOT NULL AS INTEGER)+1+CAST(user_id%3<>0 AS INTEGER) AS n_meta,
regime, CASE WHEN user_id%3<>0 THEN CAST(user_id AS VARCHAR) END AS meta_user
FROM (SELECT *, CASE WHEN event_id%5<>0 THEN event_type END AS regime FROM events)""")
def record_metadata(spark, folder):
    e = table(spark, folder, "events")
    meta = P.record_metadata({
        "regime": F.when(F.col("event_id") % 5 != 0, F.col("event_type")), "sample_id": F.col("event_id"),
        "meta_user": F.when(F.col("user_id") % 3 != 0, F.col("user_id"))})
    out = e.select("event_id", meta.alias("m"))
    return out.select("event_id", F.size("m").alias("n_meta"), F.col("m")["regime"].alias("regime"),
                      F.col("m")["meta_user"].alias("meta_user"))


@query("controller_profiles", """SELECT o_orderkey, CASE WHEN o_orderkey%4=0 THEN 'sensor_safe'
WHEN o_orderpriority='1-URGENT' THEN 'fraud' WHEN o_orderpriority='2-HIGH' THEN 'sensor' ELSE 'general' END AS profile
FROM orders""")
def controller_profiles(spark, folder):
    o = table(spark, folder, "orders")
    wedge = F.when(F.col("o_orderpriority") == "1-URGENT", "fraud_risk").when(
        F.col("o_orderpriority") == "2-HIGH", "predictive_maintenance")
    explicit = F.when(F.col("o_orderkey") % 4 == 0, "sensor_safe")
    return o.select("o_orderkey", P.controller_profile(explicit, wedge).alias("profile"))


@query("class_labels", """SELECT vec_id, CASE label WHEN 1 THEN 1 WHEN 2 THEN 0 END AS y,
coalesce(CASE label WHEN 1 THEN 1 WHEN 2 THEN 0 END,-1) AS y_or_unknown, CAST(label>=5 AS INTEGER) AS y_high
FROM embeddings""")
def class_labels(spark, folder):
    e = table(spark, folder, "embeddings")
    return e.select("vec_id", P.class_label(F.col("label")).alias("y"),
                    P.class_label_or_unknown(F.col("label")).alias("y_or_unknown"),
                    (F.col("label") >= 5).cast("int").alias("y_high"))


@query("labelled_only", "SELECT vec_id, CASE label WHEN 1 THEN 1 ELSE 0 END AS y FROM embeddings WHERE label IN (1,2)")
def labelled_only(spark, folder):
    e = table(spark, folder, "embeddings").select("vec_id", P.class_label(F.col("label")).alias("y"))
    return e.where(F.col("y").isNotNull())


@query("remaining_life", """SELECT l_orderkey, l_linenumber, m-l_linenumber AS rul,
CAST(m-l_linenumber<=2 AS INTEGER) AS label, count(*) AS n FROM (SELECT *, max(l_linenumber)
OVER (PARTITION BY l_orderkey) AS m FROM lineitem) GROUP BY ALL""")
def remaining_life(spark, folder):
    t = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber")
    return P.remaining_life(t, "l_orderkey", "l_linenumber", 2).groupBy(
        "l_orderkey", "l_linenumber", "rul", "label").agg(F.count(F.lit(1)).alias("n"))


@query("primary_groups", """SELECT d.doc_id, CASE WHEN lang='de' THEN 'german' WHEN toxic=1 THEN 'toxic'
WHEN quality=1 THEN 'good' ELSE 'none' END AS grp FROM documents d LEFT JOIN labels l ON d.doc_id=l.doc_id""")
def primary_groups(spark, folder):
    d = table(spark, folder, "documents").select("doc_id", "lang").join(
        table(spark, folder, "labels"), "doc_id", "left")
    return d.select("doc_id", P.primary_group({"german": F.col("lang") == "de", "toxic": F.col("toxic") == 1,
                                               "good": F.col("quality") == 1}).alias("grp"))


@query("batch_regimes", C.line_sql("""r AS (SELECT *, CASE WHEN l_orderkey%2=0 AND step%3<>0 THEN regime END AS rr FROM batched)""",
                                   upto="batched") + """SELECT stream_id, step,
coalesce(max_by(rr, idx) FILTER (WHERE rr IS NOT NULL), 'replay_step_'||step) AS regime FROM r GROUP BY 1,2""")
def batch_regimes(spark, folder):
    b = C.line_batches(spark, folder)
    known = F.when((F.col("l_orderkey") % 2 == 0) & (F.col("step") % 3 != 0), F.col("regime"))
    return P.regime_of_batch(b.withColumn("regime", known))


@query("position_regimes", C.event_sql(upto="batched") + """SELECT stream_id, step,
CASE WHEN step<floor(n_steps/4) THEN 'stable' WHEN step<floor(n_steps/2) THEN 'covariate_drift'
WHEN step<floor(3*n_steps/4) THEN 'label_shift' ELSE 'abrupt_shift' END AS quarter,
CASE WHEN (step+0.5)/n_steps<0.25 THEN 'early_test' WHEN (step+0.5)/n_steps<0.5 THEN 'mid_test'
WHEN (step+0.5)/n_steps<0.75 THEN 'late_test' ELSE 'terminal' END AS progress,
CASE WHEN avg(y)<0.05 THEN 'clean' WHEN avg(y)<0.20 THEN 'emerging' ELSE 'high' END AS rate
FROM batched GROUP BY stream_id, step, n_steps""")
def position_regimes(spark, folder):
    b = C.event_batches(spark, folder).groupBy("stream_id", "step", "n_steps").agg(F.avg("y").alias("r"))
    s, n = F.col("step"), F.col("n_steps")
    return b.select("stream_id", "step", P.quarter_regime(s, n).alias("quarter"),
                    P.progress_regime(s, s + 1, n).alias("progress"), P.rate_regime(F.col("r")).alias("rate"))


@query("phase_schedule", C.event_sql("g AS (SELECT *, step/greatest(1,n_steps-1) AS pr FROM batched)", upto="batched") + """
SELECT event_id, CASE WHEN pr<0.3 THEN 'pre_shock' WHEN pr<0.6 THEN 'macro_shock' WHEN pr<0.8 THEN 'recovery'
ELSE 'new_normal' END AS phase, round(f0*CASE WHEN pr<0.3 THEN 1.0
WHEN pr<0.6 THEN 1.0+0.8*least(1.0,(pr-0.3)/(0.6-0.3)*1.5) WHEN pr<0.8 THEN 1.8-0.8*((pr-0.6)/(0.8-0.6)) ELSE 1.05 END,6) AS f0
FROM g""")
def phase_schedule(spark, folder):
    b = C.event_batches(spark, folder)
    progress = F.col("step") / F.greatest(F.lit(1), F.col("n_steps") - 1)
    name, factor = P.phase_schedule(progress, 0.3, 0.6, 0.8, 1.8)
    return b.select("event_id", name.alias("phase"), r6(F.col("f0") * factor, "f0"))


_MOVE = {"stable": "x", "covariate_drift": "CASE WHEN i<8 THEN x*(1+0.35*least(1.0,step/12.0)) ELSE x END",
         "label_shift": "CASE WHEN i<6 THEN x*1.2 ELSE x END",
         "abrupt_shift": "CASE WHEN i<10 THEN tanh(1.5*x) ELSE x END"}


@query("drift_injection", f"""WITH r AS (SELECT vec_id, vec_id%20 AS step, ['stable','covariate_drift','label_shift',
'abrupt_shift','other'][1+vec_id%5] AS regime, embedding FROM embeddings),
u AS (SELECT vec_id, step, regime, generate_subscripts(embedding,1)-1 AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM r)
SELECT vec_id, regime, round(sum(CASE regime {' '.join(f"WHEN '{k}' THEN {v}" for k, v in _MOVE.items())}
ELSE x*1.1 END),5) AS total FROM u GROUP BY 1,2""")
def drift_injection(spark, folder):
    e = table(spark, folder, "embeddings")
    names = ["stable", "covariate_drift", "label_shift", "abrupt_shift", "other"]
    regime = F.element_at(F.array(*[F.lit(x) for x in names]), (F.col("vec_id") % 5 + 1).cast("int"))
    e = e.select("vec_id", regime.alias("regime"), (F.col("vec_id") % 20).alias("step"),
                 F.col("embedding").cast("array<double>").alias("x"))
    moved = P.injected(F.col("x"), F.col("regime"), F.col("step"))
    return e.select("vec_id", "regime", F.round(F.aggregate(moved, F.lit(0.0), lambda s, v: s + v), 5).alias("total"))


# ---- splits ----------------------------------------------------------------------------------

@query("temporal_split", f"""SELECT o_orderkey, CASE WHEN idx < CASE WHEN greatest(1,floor(n*(1.0-0.4)))>=n THEN n-1
ELSE greatest(1,floor(n*(1.0-0.4))) END THEN 'train' ELSE 'test' END AS part FROM ({_POS})""")
def temporal_split(spark, folder):
    o = table(spark, folder, "orders").select(*ORDER_TIME)
    return P.temporal_split(o, _time(), 0.4).select("o_orderkey", "part")


@query("banded_split", f"""SELECT o_orderkey, CASE WHEN idx<floor(n*0.55) THEN 'train' WHEN idx<floor(n*0.75)
THEN 'validation' ELSE 'test' END AS part FROM ({_POS})""")
def banded_split(spark, folder):
    o = table(spark, folder, "orders").select(*ORDER_TIME)
    return P.banded_split(o, _time()).select("o_orderkey", "part")


@query("customer_split", f"""WITH p AS ({_POS}), c AS (SELECT *, greatest(4,floor(0.5*n)) AS a,
least(greatest(greatest(4,floor(0.5*n))+2,floor(0.75*n)),n-1) AS b FROM p)
SELECT o_orderkey, CASE WHEN idx<a THEN 'train' WHEN idx<b THEN 'validation' ELSE 'test' END AS part,
CASE WHEN b-a<2 THEN idx>=n-greatest(2,n//4) ELSE idx>=a AND idx<b END AS validates FROM c""")
def customer_split(spark, folder):
    o = table(spark, folder, "orders").select(*ORDER_TIME)
    return P.customer_split(o, _time()).select("o_orderkey", "part", "validates")


@query("recent_tail", f"SELECT o_orderkey FROM ({_POS}) WHERE idx>=floor(n*(1.0-0.3))")
def recent_tail(spark, folder):
    o = table(spark, folder, "orders").select(*ORDER_TIME)
    return P.recent_tail(o, _time(), 0.3).select("o_orderkey")


@query("rebalanced_rows", f"""WITH p AS (SELECT *, CAST(o_orderpriority='1-URGENT' AS INTEGER) AS y FROM ({_POS})),
t AS (SELECT * FROM p WHERE idx>=3000 AND n>6000), neg AS (SELECT *, row_number() OVER (ORDER BY idx)-1 AS k FROM t WHERE y=0)
SELECT o_orderkey, y FROM p WHERE idx<3000 OR n<=6000 UNION ALL SELECT o_orderkey, y FROM t WHERE y=1
UNION ALL SELECT o_orderkey, y FROM neg WHERE k < greatest(0, 3000-(SELECT count(*) FROM t WHERE y=1))""")
def rebalanced_rows(spark, folder):
    o = table(spark, folder, "orders").select(
        *ORDER_TIME, (F.col("o_orderpriority") == "1-URGENT").cast("int").alias("y"))
    return P.rebalanced(o, _time(), "y", 6000).select("o_orderkey", "y")


@query("hashed_split", """SELECT o_orderkey, CASE WHEN CAST('0x'||substr(md5('7:'||o_orderkey),1,8) AS BIGINT)/4294967296.0<0.3 THEN 'test' ELSE 'train' END AS part
FROM orders""")
def hashed_split(spark, folder):
    return P.hashed_split(table(spark, folder, "orders").select("o_orderkey"), ["o_orderkey"], 0.3, 7)


@query("entity_split", """WITH u AS (SELECT l_suppkey, row_number() OVER (ORDER BY l_suppkey)-1 AS i, count(*) OVER () AS n
FROM (SELECT DISTINCT l_suppkey FROM lineitem)) SELECT l_suppkey, CASE WHEN i<greatest(1,floor(n*0.6)) THEN 'train' ELSE 'test' END AS part,
count(*) AS n_rows FROM lineitem JOIN u USING (l_suppkey) GROUP BY 1,2""")
def entity_split(spark, folder):
    t = table(spark, folder, "lineitem").select("l_suppkey", "l_linenumber")
    return P.entity_split(t, "l_suppkey", "l_linenumber").groupBy("l_suppkey", "part").agg(
        F.count(F.lit(1)).alias("n_rows"))


@query("entity_folds", """WITH u AS (SELECT DISTINCT l_suppkey, fold FROM lineitem, range(4) r(fold)),
h AS (SELECT l_suppkey, fold, count(*) OVER (PARTITION BY fold) AS n,
  row_number() OVER (PARTITION BY fold ORDER BY CAST('0x'||substr(md5('3:'||l_suppkey||':'||fold),1,8) AS BIGINT), l_suppkey)-1 AS i FROM u)
SELECT CAST(fold AS INTEGER) AS fold, l_suppkey, CASE WHEN i<greatest(1,floor(n*0.6)) THEN 'train' ELSE 'test' END AS part FROM h WHERE n>greatest(1,floor(n*0.6))""")
def entity_folds(spark, folder):
    return P.entity_folds(table(spark, folder, "lineitem"), "l_suppkey", 4, seed=3)


@query("unit_membership", """SELECT count(*) FILTER (WHERE l_suppkey%2=0) AS kept, count(*) FILTER (WHERE l_suppkey%2=1) AS dropped
FROM lineitem""")
def unit_membership(spark, folder):
    """Semi and anti join with the chosen units."""
    t = table(spark, folder, "lineitem").select("l_suppkey")
    chosen = table(spark, folder, "supplier").where(F.col("s_suppkey") % 2 == 0).select(
        F.col("s_suppkey").alias("l_suppkey"))
    kept = t.join(chosen, "l_suppkey", "left_semi").select(F.lit(1).alias("k"), F.lit(0).alias("d"))
    gone = t.join(chosen, "l_suppkey", "left_anti").select(F.lit(0).alias("k"), F.lit(1).alias("d"))
    return kept.unionByName(gone).agg(F.sum("k").alias("kept"), F.sum("d").alias("dropped"))


@query("cyclic_replay", """WITH p AS (SELECT event_id, value, row_number() OVER (ORDER BY ts,event_id)-1 AS idx, count(*) OVER () AS n FROM events),
t AS (SELECT range AS pos FROM range(250*48*2))
SELECT pos//48 AS step, (pos//48)//250 AS cycle, (pos//48)%250 AS local_step, count(*) AS n, min(event_id) AS lo, max(event_id) AS hi
FROM t JOIN p ON idx = pos % n GROUP BY 1,2,3""")
def cyclic_replay(spark, folder):
    e = table(spark, folder, "events").select("event_id", "ts")
    r = P.cyclic_replay(e, [F.col("ts"), F.col("event_id")], 250, 48, 2)
    return r.groupBy("step", "cycle", "local_step").agg(
        F.count(F.lit(1)).alias("n"), F.min("event_id").alias("lo"), F.max("event_id").alias("hi"))


# ---- numeric columns -------------------------------------------------------------------------

_HOLES = """SELECT o_orderkey, CASE WHEN o_orderkey%7=0 THEN NULL ELSE o_totalprice END AS price,
CASE WHEN o_orderkey%11=0 THEN NULL ELSE c_acctbal END AS bal FROM orders JOIN customer ON o_custkey=c_custkey"""


def _holes(spark, folder):
    o = table(spark, folder, "orders").join(
        table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    inf = F.lit(float("inf"))
    return o.select(
        "o_orderkey", F.when(F.col("o_orderkey") % 7 == 0, inf).otherwise(F.col("o_totalprice")).alias("price"),
        F.when(F.col("o_orderkey") % 11 == 0, F.lit(float("nan"))).otherwise(F.col("c_acctbal")).alias("bal"))


@query("median_fill", f"""WITH h AS ({_HOLES}) SELECT o_orderkey, round(coalesce(price,(SELECT median(price) FROM h)),6) AS price,
round(coalesce(bal,(SELECT median(bal) FROM h)),6) AS bal FROM h""")
def median_fill(spark, folder):
    h = _holes(spark, folder)
    cols = ["price", "bal"]
    return P.filled(h, cols, P.medians(h, cols)).select("o_orderkey", r6("price"), r6("bal"))


@query("constant_fill", f"SELECT o_orderkey, coalesce(price,-999.0) AS price, coalesce(bal,0.0) AS bal FROM ({_HOLES})")
def constant_fill(spark, folder):
    h = _holes(spark, folder)
    return P.filled(P.filled(h, ["price"], -999.0), ["bal"], 0.0)


@query("standard_scale_train", f"""WITH p AS ({_POS}), j AS (SELECT p.*, c_acctbal FROM p JOIN customer ON o_custkey=c_custkey),
s AS (SELECT avg(o_totalprice) AS m1, stddev_pop(o_totalprice) AS d1, avg(c_acctbal) AS m2, stddev_pop(c_acctbal) AS d2
FROM j WHERE idx<floor(n*(1.0-0.4))) SELECT o_orderkey, round((o_totalprice-m1)/d1,6) AS o_totalprice,
round((c_acctbal-m2)/d2,6) AS c_acctbal FROM j, s""")
def standard_scale_train(spark, folder):
    """Scale fitted on the training part only, applied to all rows."""
    o = P.temporal_split(table(spark, folder, "orders"), _time(), 0.4)
    o = o.join(table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    cols = ["o_totalprice", "c_acctbal"]
    scale = P.StandardScale.fit(o.where(F.col("part") == "train"), cols)
    return scale.apply(o).select("o_orderkey", *[r6(c) for c in cols])


@query("column_ranking", f"""WITH h AS ({_HOLES}), u AS (SELECT 'price' AS name, price AS v FROM h UNION ALL SELECT 'bal', bal FROM h
UNION ALL SELECT 'o_orderkey', o_orderkey FROM h) SELECT name, round(avg(CASE WHEN v IS NULL THEN 0.0 ELSE 1.0 END),6) AS coverage,
round(stddev_samp(v),4) AS spread, round(avg(CASE WHEN v IS NULL THEN 0.0 ELSE 1.0 END)*(stddev_samp(v)+1e-6),4) AS rank_score FROM u GROUP BY 1""")
def column_ranking(spark, folder):
    h = _holes(spark, folder)
    return P.column_ranking(h, P.numeric_columns(h)).select(
        "name", r6("coverage"), F.round("spread", 4).alias("spread"), F.round("rank_score", 4).alias("rank_score"))


@query("top_columns", f"""WITH h AS ({_HOLES}), u AS (SELECT 'price' AS name, price AS v FROM h UNION ALL SELECT 'bal', bal FROM h
UNION ALL SELECT 'o_orderkey', o_orderkey FROM h) SELECT name FROM u GROUP BY 1
ORDER BY avg(CASE WHEN v IS NULL THEN 0.0 ELSE 1.0 END)*(stddev_samp(v)+1e-6) DESC LIMIT 2""")
def top_columns(spark, folder):
    h = _holes(spark, folder)
    return P.top_columns(h, P.numeric_columns(h), 2).select("name")


@query("numeric_feature_columns", """SELECT unnest(['l_quantity','l_extendedprice','l_discount','l_tax','l_suppkey',
'l_partkey','l_linenumber']) AS name, unnest([s1,s2,s3,s4,s5,s6,s7]) AS total FROM (SELECT round(sum(l_quantity),2) AS s1,
round(sum(l_extendedprice),2) AS s2, round(sum(l_discount),2) AS s3, round(sum(l_tax),2) AS s4,
CAST(sum(l_suppkey) AS DOUBLE) AS s5, CAST(sum(l_partkey) AS DOUBLE) AS s6, CAST(sum(l_linenumber) AS DOUBLE) AS s7 FROM lineitem)""")
def numeric_feature_columns(spark, folder):
    """Columns chosen by the numeric fallback, with their totals."""
    t = table(spark, folder, "lineitem")
    cols = R.feature_columns(t, exclude=["l_orderkey"])
    return P.unpivoted(t, cols).groupBy("name").agg(F.round(F.sum("value"), 2).alias("total"))


@query("resolved_features", """SELECT event_id, [value, CAST(user_id AS DOUBLE)] AS features, 2 AS width,
substr(sha256('dim=2'),1,8) AS fingerprint FROM events""")
def resolved_features(spark, folder):
    e = table(spark, folder, "events").select(
        "event_id", F.col("value").alias("feature_0"), F.col("user_id").alias("f_1"), F.lit(3).alias("other"))
    out = e.select("event_id", R.features_array(e).alias("features"))
    return out.withColumn("width", F.size("features")).withColumn(
        "fingerprint", S.schema_fingerprint(F.col("width")))


@query("first_features", "SELECT vec_id, CAST(embedding[1:8] AS DOUBLE[]) AS features FROM embeddings")
def first_features(spark, folder):
    e = table(spark, folder, "embeddings")
    return e.select("vec_id", F.slice("embedding", 1, 8).cast("array<double>").alias("features"))


@query("balanced_support_rows", C.event_sql("""r AS (SELECT *, row_number() OVER (PARTITION BY stream_id, step, y ORDER BY idx) AS k FROM batched)""",
    """f AS (SELECT *, row_number() OVER (PARTITION BY stream_id, step ORDER BY CAST(k>6 AS INTEGER), idx) AS q FROM r)""",
    upto="batched") + "SELECT stream_id, step, event_id, y FROM f WHERE q<=12")
def balanced_support_rows(spark, folder):
    b = C.event_batches(spark, folder)
    return P.balanced_first_rows(b, ["stream_id", "step"], "y", "idx", 12).select("stream_id", "step", "event_id", "y")


@query("entity_enrichment", """SELECT o_orderkey, c_mktsegment, n_name FROM orders LEFT JOIN customer ON o_custkey=c_custkey
LEFT JOIN nation ON c_nationkey=n_nationkey""")
def entity_enrichment(spark, folder):
    """Transactions with their identity rows; unmatched ones stay."""
    c = table(spark, folder, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment", "c_nationkey")
    n = table(spark, folder, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return (table(spark, folder, "orders").join(c, "o_custkey", "left").join(n, "c_nationkey", "left")
            .select("o_orderkey", "c_mktsegment", "n_name"))


@query("class_join", "SELECT d.doc_id, lang, toxic FROM documents d JOIN labels l ON d.doc_id=l.doc_id")
def class_join(spark, folder):
    return table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id").select(
        "doc_id", "lang", "toxic")


# ---- checks ----------------------------------------------------------------------------------

_LBL = """SELECT user_id, CASE WHEN user_id%10=0 THEN 0.0 WHEN user_id%10=1 THEN 1.0 WHEN user_id%10=2 AND event_id%2=0 THEN 2.0
WHEN user_id%10=3 THEN NULL ELSE CAST(event_id%2 AS DOUBLE) END AS y FROM events"""


def _odd_labels(spark, folder):
    u, e = F.col("user_id"), F.col("event_id")
    y = (F.when(u % 10 == 0, 0.0).when(u % 10 == 1, 1.0).when((u % 10 == 2) & (e % 2 == 0), 2.0)
         .when(u % 10 == 3, F.lit(None)).otherwise((e % 2).cast("double")))
    return table(spark, folder, "events").select("user_id", y.alias("y"))


@query("label_warnings", f"""SELECT user_id, count(y) AS n, CASE WHEN count(y)=0 THEN 'empty_label_array' ELSE concat_ws(';',
CASE WHEN count(*) FILTER (WHERE y NOT IN (0,1))>0 THEN 'out_of_range_labels' END,
CASE WHEN avg(y)=0 THEN 'all_negative_labels' WHEN avg(y)=1 THEN 'all_positive_labels' WHEN avg(y)<0.01 THEN 'extreme_class_imbalance_low'
WHEN avg(y)>0.99 THEN 'extreme_class_imbalance_high' END) END AS warnings FROM ({_LBL}) GROUP BY 1""")
def label_warnings(spark, folder):
    return P.label_warnings(_odd_labels(spark, folder), ["user_id"], "y").select(
        "user_id", "n", F.concat_ws(";", "warnings").alias("warnings"))


@query("out_of_range_labels", f"""SELECT user_id, list_sort(list(DISTINCT y)) AS out_of_range FROM ({_LBL})
WHERE y IS NOT NULL AND y NOT IN (0,1) GROUP BY 1""")
def out_of_range_labels(spark, folder):
    return P.out_of_range_labels(_odd_labels(spark, folder), ["user_id"], "y")


@query("label_completeness", C.event_sql(upto="batched") + """SELECT stream_id, step,
bool_and(NOT (event_id%97=0)) AS labelled FROM batched GROUP BY 1,2""")
def label_completeness(spark, folder):
    b = C.event_batches(spark, folder)
    y = F.when(F.col("event_id") % 97 != 0, F.col("y"))
    return b.groupBy("stream_id", "step").agg(F.bool_and(y.isNotNull()).alias("labelled"))


@query("idempotent_answers", """SELECT user_id, event_type, event_id, round(value,6) AS value FROM (SELECT *,
row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events) WHERE k=1""")
def idempotent_answers(spark, folder):
    e = table(spark, folder, "events").select("user_id", "event_type", "ts", "event_id", "value")
    return P.first_answers(e, ["user_id", "event_type"], [F.col("ts"), F.col("event_id")]).select(
        "user_id", "event_type", "event_id", r6("value"))


@query("redacted_metadata", """SELECT vec_id, '<redacted_list_len_64>' AS embedding, '<redacted_float_list_len_6>' AS short_vector,
'['||label||','||label+1||']' AS steps FROM embeddings""")
def redacted_metadata(spark, folder):
    e = table(spark, folder, "embeddings").select(
        "vec_id", "embedding", F.slice("embedding", 1, 6).alias("short_vector"),
        F.array("label", F.col("label") + 1).alias("steps"))
    return e.select("vec_id", *[P.redacted(e.schema[c].dataType, F.col(c)).alias(c)
                                for c in ("embedding", "short_vector", "steps")])


@query("batch_ids", """SELECT event_id, coalesce(CASE WHEN event_id%2=0 THEN 'r'||event_id%4 END, event_type) AS regime_id,
event_type||'-'||event_id AS batch_id FROM events""")
def batch_ids(spark, folder):
    e = table(spark, folder, "events")
    meta = P.record_metadata({
        "regime_id": F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("r"), (F.col("event_id") % 4).cast("string"))),
        "batch_id": F.concat_ws("-", "event_type", F.col("event_id").cast("string"))})
    e = e.withColumn("meta", meta)
    return e.select("event_id", F.coalesce(F.col("meta")["regime_id"], "event_type").alias("regime_id"),
                    F.col("meta")["batch_id"].alias("batch_id"))


# ---- correction vectors ----------------------------------------------------------------------

_SEG = "((CASE WHEN p<0.10 THEN 0 WHEN p<0.35 THEN 1 ELSE 2 END)+CASE WHEN (z0+z1+z2+z3)/4>=0 THEN 3 ELSE 0 END)"
_ZLINE = ", ".join(f"({f}-rm_{f})/sqrt(rv_{f}+1e-6) AS z{i}" for i, f in enumerate(C.LINE_FEATURES))
_RANKW = [0.05, -0.04, 0.03, -0.02, 0.06, -0.10, 0.01, 0.02, 0.03, -0.01, -0.02, -0.03]


@query("segments_and_corrections", C.line_sql(
    f"z AS (SELECT b.*, {_ZLINE} FROM batched b JOIN ref r ON b.stream_id=r.stream_id)",
    f"g AS (SELECT *, {_SEG} AS segment, ln(p/(1-p)) AS lg FROM z)",
    "d AS (SELECT *, least(greatest((" + "+".join(f"{w}*z{i}" for i, w in enumerate(_RANKW[:4]))
    + f"+{_RANKW[4]}*lg+{_RANKW[5]}*greatest(p,1-p)+[" + ",".join(map(str, _RANKW[6:]))
    + "][segment+1]+0.01)*least(greatest(0.55+0.25*0.5+0.20*0.9,0.40),1.10),-0.5),0.5) AS row_delta FROM g)",
    upto="ref", tail=True) + """SELECT stream_id, segment, count(*) AS n, round(sum(row_delta),4) AS delta,
round(sum(1/(1+exp(-(lg+0.1+row_delta)))),4) AS corrected, round(sum(1/(1+exp(-((lg-0.2)/1.25)))),4) AS calibrated
FROM d GROUP BY 1,2""")
def segments_and_corrections(spark, folder):
    """Risk segment, rank vector, row delta, corrected and calibrated score of every row."""
    b = C.line_batches(spark, folder, keep_tail=True)
    ref = B.reference_profile(B.reference_window(B.batch_stats(b, C.LINE_FEATURES)), 4)
    j = b.join(stored(ref.select("stream_id", "ref_mean", "ref_var")), "stream_id")
    p, lit = F.col("p"), F.lit
    j = j.withColumn("z", S.standardized([F.col(c) for c in C.LINE_FEATURES], F.col("ref_mean"), F.col("ref_var")))
    j = j.withColumn("segment", S.segment_of(p, F.col("z")))
    vec = S.rank_vector(F.col("z"), p, F.col("segment"))
    delta = S.rank_delta(vec, F.array(*[lit(w) for w in _RANKW]), lit(0.01), lit(0.1), lit(0.5), lit(0.9))
    j = j.withColumn("row_delta", delta)
    return j.groupBy("stream_id", "segment").agg(
        F.count(lit(1)).alias("n"), F.round(F.sum("row_delta"), 4).alias("delta"),
        F.round(F.sum(S.corrected(p, lit(0.1), F.col("row_delta"))), 4).alias("corrected"),
        F.round(F.sum(S.calibrated(p, lit(1.25), lit(-0.2))), 4).alias("calibrated"))


@query("twelve_segments", C.event_sql("m AS (SELECT *, median(f0) OVER (PARTITION BY stream_id, step) AS med FROM batched)",
                                      upto="batched") + """SELECT event_id, least(11,(CASE WHEN p<0.08 THEN 0 WHEN p<0.25 THEN 1
WHEN p<0.55 THEN 2 ELSE 3 END)+CASE WHEN f0>=med THEN 4 ELSE 0 END+CASE WHEN step/n_steps>=0.55 THEN 8 ELSE 0 END) AS segment FROM m""")
def twelve_segments(spark, folder):
    """Segments that need the median inside each batch."""
    from pyspark.sql import Window
    b = C.event_batches(spark, folder)
    med = F.percentile("f0", F.lit(0.5)).over(Window.partitionBy("stream_id", "step"))
    b = b.withColumn("med", med)
    seg = S.segment_of_twelve(F.col("p"), F.col("step") / F.col("n_steps"), F.col("f0"), F.col("med"))
    return b.select("event_id", seg.alias("segment"))


@query("recentred_features", """SELECT l_orderkey, l_linenumber, l_partkey, round((1-0.3)*l_quantity+0.3*((l_quantity-24.0)/9.5*14.0+25.5),6) AS l_quantity,
round(0.3+abs(1.1-1)+abs(-0.2),6) AS drift_l1, round(sqrt(0.09+(0.1*0.1)+0.04),6) AS drift_l2, count(*) AS n FROM lineitem GROUP BY ALL""")
def recentred_features(spark, folder):
    t, lit = table(spark, folder, "lineitem"), F.lit
    x = S.recentred(F.col("l_quantity"), lit(24.0), lit(9.5), lit(25.5), lit(14.0), lit(0.3))
    return t.select("l_orderkey", "l_linenumber", "l_partkey", r6(x, "l_quantity"),
                    r6(S.drift_l1(lit(1.1), lit(-0.2), lit(0.3)), "drift_l1"),
                    r6(S.drift_l2(lit(1.1), lit(-0.2), lit(0.09)), "drift_l2")).groupBy(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "drift_l1", "drift_l2").agg(F.count(lit(1)).alias("n"))


@query("conformal_scores", C.event_sql(upto="scores") + """SELECT event_id,
round(CASE WHEN event_id%3=0 THEN 1-greatest(p,1-p) WHEN (p>=0.5)<>(y=1) THEN 1.0 ELSE 1-greatest(p,1-p) END,6) AS score,
round(0.1+(1-greatest(p,1-p))*0.5,6) AS half_width FROM scores""")
def conformal_scores(spark, folder):
    s = C.event_scores(spark, folder)
    y = F.when(F.col("event_id") % 3 != 0, F.col("y"))
    p = F.col("p")
    return s.select("event_id", r6(S.nonconformity(p, y), "score"),
                    r6(S.interval_half_width(F.lit(0.1), S.confidence(p)), "half_width"))

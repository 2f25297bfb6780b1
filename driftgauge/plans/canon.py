"""The given tables seen as scored streams, in Spark and as SQL text for the value check."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftgauge.functions import scalar as S
from driftgauge.operators.batches import assign_steps, batch_stats
from driftgauge.operators.drift import drift_surface
from driftgauge.operators.ordered import largest_group
from driftgauge.plans.registry import table

BATCH = 48
EVENT_FEATURES = ["f0", "f1"]
LINE_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LINE_WEIGHTS = [0.05, 10.0, -10.0]
LINE_BIAS = -1.35
LINE_ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
              "l_extendedprice", "l_discount", "l_tax", "l_returnflag"]


def event_scores(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events")
    return e.select(
        F.col("event_type").alias("stream_id"), "ts", "event_id", "user_id",
        F.col("value").alias("f0"),
        F.get_json_object("props", "$.k").cast("double").alias("f1"),
        (1 - F.exp(-F.col("value") / 50)).alias("p"),
        (F.col("user_id") % 2).cast("int").alias("y"),
    )


def line_scores(spark: SparkSession, folder: str) -> DataFrame:
    t = table(spark, folder, "lineitem")
    p = S.linear_score(LINE_WEIGHTS, [F.col("l_quantity"), F.col("l_discount"), F.col("l_tax")], LINE_BIAS)
    # Rounded, so that scores equal by arithmetic are equal in every engine.
    p = F.round(p, 9)
    return t.select(
        F.col("l_linestatus").alias("stream_id"), *LINE_ORDER, p.alias("p"),
        (F.col("l_returnflag") == "R").cast("int").alias("y"),
        F.year("l_shipdate").cast("string").alias("regime"),
    )


def stream_rows(spark: SparkSession, folder: str, name: str) -> int:
    """Rows of the largest stream: one count over one column."""
    key = {"events": "event_type", "lineitem": "l_linestatus"}[name]
    return largest_group(table(spark, folder, name).select(key), [key])


def event_batches(spark: SparkSession, folder: str, batch: int = BATCH, **kw) -> DataFrame:
    rows = stream_rows(spark, folder, "events")
    return assign_steps(event_scores(spark, folder), batch, [F.col("ts"), F.col("event_id")], rows=rows, **kw)


def line_batches(spark: SparkSession, folder: str, batch: int = BATCH, **kw) -> DataFrame:
    rows = stream_rows(spark, folder, "lineitem")
    return assign_steps(line_scores(spark, folder), batch, [F.col(c) for c in LINE_ORDER], rows=rows, **kw)


def step_bound(spark: SparkSession, folder: str, name: str, batch: int = BATCH) -> int:
    return stream_rows(spark, folder, name) // batch + 1


def event_stats(spark: SparkSession, folder: str, batch: int = BATCH) -> DataFrame:
    return batch_stats(event_batches(spark, folder, batch), EVENT_FEATURES)


def line_stats(spark: SparkSession, folder: str, batch: int = BATCH) -> DataFrame:
    return batch_stats(line_batches(spark, folder, batch), LINE_FEATURES)


def event_signals(spark: SparkSession, folder: str, batch: int = BATCH) -> DataFrame:
    return drift_surface(event_stats(spark, folder, batch), len(EVENT_FEATURES),
                         step_bound(spark, folder, "events", batch))


def line_signals(spark: SparkSession, folder: str, batch: int = BATCH) -> DataFrame:
    return drift_surface(line_stats(spark, folder, batch), len(LINE_FEATURES),
                         step_bound(spark, folder, "lineitem", batch))


# ---- the same tables as SQL -------------------------------------------------------------------

def sql_entropy(p: str) -> str:
    q = f"least(greatest({p},1e-6),1-1e-6)"
    return f"(-({q}*ln({q})+(1-{q})*ln(1-{q})))"


EVENT_SCORES_SQL = """scores AS (
  SELECT event_type AS stream_id, ts, event_id, user_id, value AS f0,
         CAST(json_extract_string(props,'$.k') AS DOUBLE) AS f1,
         1-exp(-value/50) AS p, CAST(user_id%2 AS INTEGER) AS y FROM events)"""

LINE_SCORES_SQL = f"""scores AS (
  SELECT l_linestatus AS stream_id, {', '.join(LINE_ORDER)},
         round(1/(1+exp(-({LINE_BIAS}+0.05*l_quantity+10.0*l_discount-10.0*l_tax))),9) AS p,
         CAST(l_returnflag='R' AS INTEGER) AS y, CAST(year(l_shipdate) AS VARCHAR) AS regime FROM lineitem)"""


def batched_sql(order: str, batch: int = BATCH, tail: bool = False) -> str:
    keep = "" if tail else f"WHERE idx//{batch} < total//{batch}"
    steps = f"(total+{batch}-1)//{batch}" if tail else f"total//{batch}"
    return f"""batched AS (
  SELECT *, idx//{batch} AS step, {steps} AS n_steps FROM (
    SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY {order})-1 AS idx,
           count(*) OVER (PARTITION BY stream_id) AS total FROM scores) {keep})"""


EVENT_ORDER_SQL = "ts, event_id"
LINE_ORDER_SQL = ", ".join(LINE_ORDER)


def stats_sql(features: list[str]) -> str:
    moments = ", ".join(f"avg({f}) AS m_{f}, var_pop({f}) AS v_{f}" for f in features)
    return f"""stats AS (
  SELECT stream_id, step, count(*) AS n, max(n_steps) AS n_steps, {moments},
         avg({sql_entropy('p')}) AS mean_entropy, avg(p) AS mean_p,
         avg(CASE WHEN p>=0.5 THEN 1.0 ELSE 0.0 END) AS positive_rate, avg(greatest(p,1-p)) AS mean_conf,
         sum(CASE WHEN p>=0.5 THEN 1 ELSE 0 END) AS n_pred_pos,
         avg(CASE WHEN greatest(p,1-p)>=0.68 THEN 1.0 ELSE 0.0 END) AS conf68,
         avg(CASE WHEN greatest(p,1-p)>=0.80 THEN 1.0 ELSE 0.0 END) AS conf80,
         avg(CASE WHEN greatest(p,1-p)>=0.90 THEN 1.0 ELSE 0.0 END) AS conf90,
         avg(CASE WHEN (p>=0.5)=(y=1) THEN 1.0 ELSE 0.0 END) AS batch_accuracy,
         avg(y) AS label_rate, avg(y-p) AS mean_residual
  FROM batched GROUP BY 1,2)"""


def reference_sql(features: list[str]) -> str:
    moments = ", ".join(f"avg({f}) AS rm_{f}, var_pop({f})+1e-6 AS rv_{f}" for f in features)
    return f"""ref AS (
  SELECT stream_id, count(DISTINCT step) AS ref_batches, {moments},
         avg({sql_entropy('p')}) AS ref_mean_entropy, avg(p) AS ref_mean_p,
         avg(CASE WHEN p>=0.5 THEN 1.0 ELSE 0.0 END) AS ref_positive_rate, avg(greatest(p,1-p)) AS ref_mean_conf
  FROM batched WHERE step < greatest(2, n_steps//4) GROUP BY 1)"""


def signals_sql(features: list[str]) -> str:
    k = len(features)
    mean_gap = "+".join(f"abs(m_{f}-rm_{f})/sqrt(rv_{f}+1e-6)" for f in features)
    var_gap = "+".join(f"abs(v_{f}-rv_{f})/(rv_{f}+1e-6)" for f in features)
    return f"""parts AS (
  SELECT s.*, r.* EXCLUDE (stream_id), ({mean_gap})/{k}+0.5*({var_gap})/{k} AS feature_score,
    abs(mean_entropy-ref_mean_entropy)+0.75*abs(mean_p-ref_mean_p)+abs(positive_rate-ref_positive_rate)
      +0.5*abs(mean_conf-ref_mean_conf) AS output_score,
    greatest(0.0,ref_mean_entropy-mean_entropy)
      +greatest(0.0,abs(positive_rate-0.5)-abs(ref_positive_rate-0.5)) AS collapse_risk
  FROM stats s JOIN ref r ON s.stream_id=r.stream_id),
scored AS (
  SELECT *, feature_score+0.75*output_score+0.65*collapse_risk AS score,
    output_score+0.5*feature_score+collapse_risk AS raw_risk FROM parts),
signals AS (
  SELECT *, score>=1.1 AS alert, score>=1.75 OR collapse_risk>=0.30 AS severe,
    (tail_count+1.0)/(ref_batches+1.0) AS p_value, 0.5*pow((tail_count+1.0)/(ref_batches+1.0),-0.5) AS e_value
  FROM (SELECT a.*, (SELECT count(*) FROM scored b WHERE b.stream_id=a.stream_id
                     AND b.step < greatest(2,b.n_steps//4) AND b.raw_risk>=a.raw_risk) AS tail_count
        FROM scored a))"""


def capital_sql(source: str = "signals") -> str:
    return f"""risk(stream_id, step, capital) AS (
  SELECT stream_id, step, least(100.0,greatest(1.0,1.0*0.92*e_value)) FROM {source} WHERE step=0
  UNION ALL
  SELECT s.stream_id, s.step, least(100.0,greatest(1.0,r.capital*0.92*s.e_value))
  FROM risk r JOIN {source} s ON s.stream_id=r.stream_id AND s.step=r.step+1)"""


def event_sql(*extra: str, upto: str = "signals", batch: int = BATCH) -> str:
    """WITH clause over events up to a stage, followed by further named parts."""
    return _with([EVENT_SCORES_SQL, batched_sql(EVENT_ORDER_SQL, batch)], EVENT_FEATURES, upto, extra)


def line_sql(*extra: str, upto: str = "signals", batch: int = BATCH, tail: bool = False) -> str:
    return _with([LINE_SCORES_SQL, batched_sql(LINE_ORDER_SQL, batch, tail)], LINE_FEATURES, upto, extra)


def _with(head: list[str], features: list[str], upto: str, extra: tuple[str, ...]) -> str:
    parts = list(head)
    for stage, text in (("stats", stats_sql(features)), ("ref", reference_sql(features)),
                        ("signals", signals_sql(features)), ("capital", capital_sql())):
        if upto in ("scores", "batched"):
            break
        parts.append(text)
        if stage == upto:
            break
    if upto == "scores":
        parts = parts[:1]
    return "WITH RECURSIVE " + ",\n".join([*parts, *extra]) + "\n"

"""Streams over the given tables, run to completion into a table."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftgauge.plans import canon as C
from driftgauge.plans.decision_queries import decision_sql, decision_table
from driftgauge.plans.registry import query, r6
from driftgauge.plans.source_queries import batch_messages, event_messages
from driftgauge.sources import payloads, sinks
from driftgauge.streaming import live


def event_stream(spark, folder):
    e = live.table_stream(spark, folder, "events.parquet")
    return e.select(
        F.col("event_type").alias("stream_id"), F.col("ts").cast("timestamp").alias("ts"), "event_id", F.col("value").alias("f0"),
        (1 - F.exp(-F.col("value") / 50)).alias("p"), (F.col("user_id") % 2).cast("int").alias("y"))


def finished(spark, stream, name):
    path = sinks.scratch(spark, name)
    live.run_available(stream, path, sinks.scratch(spark, f"{name}-checkpoint"))
    return spark.read.parquet(path)


_MARK = "(SELECT max(ts)-INTERVAL 1 HOUR FROM events)"


@query("stream_window_stats", f"""SELECT event_type AS stream_id, epoch(time_bucket(INTERVAL 6 HOUR, ts))::BIGINT AS start, count(*) AS n, round(avg(value),6) AS mean_f0,
round(avg(1-exp(-value/50)),6) AS mean_p, round(avg(user_id%2),6) AS label_rate FROM events GROUP BY 1, time_bucket(INTERVAL 6 HOUR, ts)
HAVING time_bucket(INTERVAL 6 HOUR, ts)+INTERVAL 6 HOUR <= {_MARK}""")
def stream_window_stats(spark, folder):
    """Six-hour windows; those the watermark has not passed yet stay in state."""
    w = live.window_stats(event_stream(spark, folder), ["f0"], "ts", "1 hour", "6 hours")
    out = finished(spark, w, "windows")
    return out.select("stream_id", F.unix_timestamp("start").alias("start"), "n", r6("mean_f0"), r6("mean_p"), r6("label_rate"))


@query("stream_sliding_stats", f"""SELECT event_type AS stream_id, epoch(s)::BIGINT AS start, count(*) AS n, round(avg(value),6) AS mean_f0 FROM
(SELECT *, time_bucket(INTERVAL 6 HOUR, ts)-INTERVAL 6 HOUR*k AS s FROM events, (SELECT unnest([0,1]) AS k)) GROUP BY 1, s HAVING s+INTERVAL 12 HOUR <= {_MARK}""")
def stream_sliding_stats(spark, folder):
    w = live.window_stats(event_stream(spark, folder), ["f0"], "ts", "1 hour", "12 hours", slide="6 hours")
    out = finished(spark, w, "sliding")
    return out.select("stream_id", F.unix_timestamp("start").alias("start"), "n", r6("mean_f0"))


@query("stream_session_stats", f"""WITH g AS (SELECT *, CASE WHEN ts-lag(ts) OVER (PARTITION BY event_type ORDER BY ts)<INTERVAL 20 MINUTE THEN 0 ELSE 1 END AS b FROM events),
s AS (SELECT *, sum(b) OVER (PARTITION BY event_type ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g)
SELECT event_type AS stream_id, epoch_us(min(ts)) AS start, count(*) AS n, round(avg(value),6) AS mean_f0 FROM s GROUP BY event_type, sid HAVING max(ts)+INTERVAL 20 MINUTE <= {_MARK}""")
def stream_session_stats(spark, folder):
    w = live.window_stats(event_stream(spark, folder), ["f0"], "ts", "1 hour", "", gap="20 minutes")
    out = finished(spark, w, "sessions")
    return out.select("stream_id", F.unix_micros("start").alias("start"), "n", r6("mean_f0"))


@query("stream_first_of", "SELECT event_id, event_type AS stream_id FROM events")
def stream_first_of(spark, folder):
    """Every event is sent twice and kept once."""
    e = event_stream(spark, folder).select("event_id", "stream_id", "ts")
    out = live.first_of(e.unionByName(e), ["stream_id", "event_id"], "ts", "2 hours")
    return finished(spark, out, "first").select("event_id", "stream_id")


def _reveals(e):
    delay = F.make_interval(hours=(F.col("event_id") % 30).cast("int"))
    return e.select("event_id", F.col("y").alias("label"), (F.col("ts") + delay).alias("reveal_ts"))


@query("stream_reveals", "SELECT event_id, event_type AS stream_id, CAST(user_id%2 AS INTEGER) AS label FROM events WHERE event_id%30<=24")
def stream_reveals(spark, folder):
    """Labels up to a day late, in any order, joined to their decisions."""
    e = event_stream(spark, folder).select("event_id", "stream_id", "ts", "p", "y")
    out = live.revealed(e.drop("y"), _reveals(e), ["event_id"], "24 HOURS", how="inner")
    return finished(spark, out, "reveals").select("event_id", "stream_id", "label")


@query("late_reveals", "SELECT event_id FROM events WHERE event_id%30>24")
def late_reveals(spark, folder):
    e = spark.read.parquet(f"{folder}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.lit(1).alias("y"))
    return live.late_reveals(e.drop("y"), _reveals(e), ["event_id"], "24 HOURS").select("event_id")


@query("stream_capital", C.event_sql(upto="capital") + "SELECT stream_id, step, round(capital,6) AS capital, capital>=8.0 AS risk_alert FROM risk")
def stream_capital(spark, folder):
    """Capital as keyed state over signals that arrive in several micro-batches."""
    path = sinks.scratch(spark, "signals")
    s = C.event_signals(spark, folder).select("stream_id", "step", "e_value")
    last = s.agg(F.max("step")).first()[0] or 0
    for low in range(0, last + 1, max(1, last // 3 + 1)):
        s.where((F.col("step") >= low) & (F.col("step") < low + max(1, last // 3 + 1))).coalesce(1).write.mode("append").parquet(path)
    base, name = path.rsplit("/", 1)
    stream = live.table_stream(spark, base, name, files_per_trigger=1)
    return finished(spark, live.live_capital(stream), "capital").select("stream_id", "step", r6("capital"), "risk_alert")


@query("stream_messages", """SELECT CASE WHEN event_id%5 IN (3,4) THEN 'refused' ELSE 'accepted' END AS kind, count(*) AS n FROM events GROUP BY 1
UNION ALL SELECT 'labels', CAST(sum(k) AS BIGINT) FROM (SELECT count(*)//48 AS k FROM events GROUP BY event_type)""")
def stream_messages(spark, folder):
    """One source with two kinds of messages: scored ones are parsed or refused, label messages go their own way."""
    path = sinks.scratch(spark, "messages")
    event_messages(spark, folder).select("value").write.text(f"{path}/events")
    batch_messages(spark, folder).select("value").write.text(f"{path}/labels")
    m = live.folder_messages(spark, f"{path}/events", "events").unionByName(live.folder_messages(spark, f"{path}/labels", "labels"))
    scored, labelled = live.routed(m, "labels")
    p = payloads.parse_events(scored.select("value"))
    one = p.select(F.when(p["error"].isNull(), "accepted").otherwise("refused").alias("kind"))
    q = payloads.parse_labels(labelled.select("value"))
    two = q.select(F.when(q["error"].isNull(), "labels").otherwise("refused").alias("kind"))
    return finished(spark, one.unionByName(two), "routed").groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("stream_batches", C.event_sql(upto="batched") + "SELECT stream_id||'-'||step AS batch_id, count(*) AS n, round(avg(f0),6) AS mean_f0, round(avg(p),6) AS mean_p FROM batched GROUP BY 1")
def stream_batches(spark, folder):
    """Batches made by the producer: one message each, aggregated by batch id."""
    path = sinks.scratch(spark, "batch-messages")
    batch_messages(spark, folder).select("value").write.text(path)
    m = payloads.parse_batches(live.folder_messages(spark, path, "events").select("value")).where(F.col("error").isNull())
    rows = m.select("batch_id", F.col("features")[0].alias("f0"), F.col("label").alias("y"),
                    (1 - F.exp(-F.col("features")[0] / 50)).alias("p"))
    out = sinks.scratch(spark, "batch-rows")

    def add(df, epoch):  # a batch is one message, so no state outlives its micro-batch; a repeated epoch replaces itself
        live.batch_aggregates(df, ["batch_id"], ["f0"]).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    live.run_batches(rows, add, sinks.scratch(spark, "batch-checkpoint"))
    return spark.read.parquet(out).select("batch_id", "n", r6("mean_f0"), r6("mean_p"))


@query("stream_fan_out", decision_sql() + """SELECT strategy, count(*) AS audit_rows, count(*) AS json_rows, 1 AS failed_targets
FROM dec WHERE strategy='multi_action' GROUP BY 1""")
def stream_fan_out(spark, folder):
    """Decisions streamed to the audit log and a JSON target; a broken third target is recorded, not swallowed."""
    d = decision_table(spark, folder, strategies=["multi_action"]).withColumnRenamed("capital", "risk_capital")
    src = sinks.scratch(spark, "decisions")
    sinks.audit_rows(d, F.lit("2024-01-01 00:00:00").cast("timestamp"), F.to_json(F.struct("signature"))).write.parquet(src)
    base, name = src.rsplit("/", 1)
    log, lines = sinks.scratch(spark, "audit"), sinks.scratch(spark, "lines")

    def broken(df, epoch):
        raise RuntimeError("target is down")

    fan = live.FanOut([live.audit_writer(log)], {"lines": live.json_writer(lines, sinks.FILE_FIELDS), "broken": broken})
    live.run_batches(live.table_stream(spark, base, name), fan, sinks.scratch(spark, "fan-checkpoint"))
    return spark.read.parquet(log).groupBy("strategy").agg(F.count(F.lit(1)).alias("audit_rows")).withColumn(
        "json_rows", F.lit(spark.read.json(lines).count())).withColumn("failed_targets", F.lit(len({n for _, n, _ in fan.failures})))

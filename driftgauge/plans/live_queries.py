"""The live run over the given events: signals and decisions in the stream, steps out of order, state carried into a second run."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftgauge.operators import batches as B
from driftgauge.plans import canon as C
from driftgauge.plans.decision_queries import DECISION_INPUT_SQL, DECISION_SQL, trend_sql
from driftgauge.plans.registry import query, r6
from driftgauge.session import settled, stored
from driftgauge.sources import sinks
from driftgauge.streaming import governed as G
from driftgauge.streaming import live
from driftgauge.streaming import repair as P

#: Later than every event: moves the watermark past all batches.
FAR = "2100-01-01"
LATE = "3650 days"


def _live_sql(source: str, *extra: str) -> str:
    """Decisions, level and means of the strategy multi_action over `source`, whose steps have no gaps; no label is known."""
    return ",\n".join([trend_sql(source),
        f"recent AS (SELECT stream_id, step, NULL::DOUBLE AS recent_accuracy, NULL::DOUBLE AS revealed_accuracy, NULL::DOUBLE AS revealed_rate FROM {source})",
        DECISION_INPUT_SQL, DECISION_SQL,
        "miss AS (SELECT stream_id, step, CASE WHEN (p>=0.5)<>(y=1) THEN 1.0 ELSE 0.0 END::DOUBLE AS miss FROM batched WHERE idx%48=0)",
        """lv(stream_id, step, alpha, shift_mean, capital_mean, accuracy_mean) AS (
  SELECT stream_id, -1::BIGINT, 0.10::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.5::DOUBLE FROM dec WHERE strategy='multi_action' AND step=0
  UNION ALL SELECT d.stream_id, d.step, least(0.40,greatest(0.02,l.alpha+0.05*(m.miss-(1-0.9)))), 0.84*l.shift_mean+0.16*d.shift_score,
    0.84*l.capital_mean+0.16*d.capital, 0.84*l.accuracy_mean+0.16*d.batch_accuracy
  FROM lv l JOIN dec d ON d.stream_id=l.stream_id AND d.step=l.step+1 AND d.strategy='multi_action'
  JOIN placed q ON q.stream_id=d.stream_id AND q.step=d.step JOIN miss m ON m.stream_id=d.stream_id AND m.step=q.real_step)""",
        """uses AS (SELECT stream_id, step, count(*) FILTER (WHERE action_taken NOT IN ('none','hold','abstain')) OVER w AS actions_used,
  count(*) FILTER (WHERE action_taken='reset') OVER w AS resets_used FROM dec WHERE strategy='multi_action'
  WINDOW w AS (PARTITION BY stream_id ORDER BY step ROWS BETWEEN 23 PRECEDING AND CURRENT ROW))""", *extra])


_ALL_STEPS = "placed AS (SELECT stream_id, step, step AS real_step FROM signals)"
_STATE = ["capital", "temperature", "bias", "alpha", "shift_mean", "capital_mean", "accuracy_mean"]
_STATE_SQL = ", ".join(f"round({'d.' if c in ('capital', 'temperature', 'bias') else 'lv.'}{c},6) AS {c}" for c in _STATE)
_LIVE_OUT = f"""SELECT d.stream_id, d.step, d.recommended_action, d.action_taken, d.budget_limited, d.risk_alert, d.retrain_recommended,
CAST(r.cool AS DOUBLE) AS cooldown, u.actions_used, u.resets_used, {_STATE_SQL}
FROM dec d JOIN lv USING (stream_id, step) JOIN uses u USING (stream_id, step) JOIN run r ON r.stream_id=d.stream_id AND r.step=d.step AND r.strategy='multi_action'
WHERE d.strategy='multi_action'"""


def _out(df):
    return df.select("stream_id", "step", "recommended_action", "action_taken", "budget_limited", "risk_alert", "retrain_recommended", "cooldown", "actions_used",
                     "resets_used", *[r6(c) for c in _STATE])


def batch_rows(spark, folder):
    """Events with the batch that their producer puts them in and the time at which it closes the batch."""
    b = settled(C.event_batches(spark, folder).select("stream_id", "step", "n_steps", "idx", F.col("ts").cast("timestamp").alias("ts"), "event_id", "p", "y", *C.EVENT_FEATURES))
    closed = b.groupBy("stream_id", "step").agg(F.max("ts").alias("closed_at"))
    return b.join(closed, ["stream_id", "step"])


def heartbeat(rows, days=0):
    """A message of an unnamed stream that only carries time; a null name would be filtered before the watermark sees it."""
    names = [F.lit("" if f.name == "stream_id" else None).cast(f.dataType).alias(f.name) for f in rows.schema if f.name != "closed_at"]
    beat = rows.sparkSession.range(1).select(*names, F.date_add(F.lit(FAR).cast("date"), days).cast("timestamp").alias("closed_at"))
    return beat.select(*rows.columns)


def in_files(parts, spark, name):
    """One file per part, in this order; a stream reads one after the other. Parts are computed in many tasks before one task writes the file."""
    path = sinks.scratch(spark, name)
    for part in parts:
        stored(part).coalesce(1).write.mode("append").parquet(path)
    base, last = path.rsplit("/", 1)
    return live.table_stream(spark, base, last, files_per_trigger=1)


def shuffled(rows, n=3):
    """Parts with the steps of every stream mixed."""
    return [rows.where(F.pmod(F.xxhash64("step"), F.lit(n)) == i) for i in range(n)]


def finished(spark, stream, name, checkpoint=None, keyed=False):
    path = sinks.scratch(spark, name)
    live.run_available(stream, path, checkpoint or sinks.scratch(spark, f"{name}-checkpoint"), keyed=keyed)
    return spark.read.parquet(path)


def live_signals(spark, folder, name):
    rows = batch_rows(spark, folder)
    versions = settled(G.reference_versions(B.batch_stats(rows, C.EVENT_FEATURES), len(C.EVENT_FEATURES)))
    sent = rows.drop("n_steps", "idx", "ts")
    stream = in_files([*shuffled(sent), heartbeat(sent)], spark, name)
    return G.live_signals(stream, C.EVENT_FEATURES, versions, LATE)


@query("stream_signals", C.event_sql(upto="signals") + """SELECT stream_id, step, n, round(feature_score,6) AS feature_score, round(output_score,6) AS output_score,
round(score,6) AS score, alert, severe, round(p_value,6) AS p_value, 1 AS reference_version FROM signals""")
def stream_signals(spark, folder):
    """Signals of batches that close in the stream, against the version of the reference in force."""
    out = finished(spark, live_signals(spark, folder, "signal-rows"), "signals", keyed=True)
    return out.select("stream_id", "step", "n", r6("feature_score"), r6("output_score"), r6("score"), "alert", "severe", r6("p_value"), "reference_version")


@query("stream_decisions", C.event_sql(_ALL_STEPS, _live_sql("signals")) + _LIVE_OUT)
def stream_decisions(spark, folder):
    """Rows in, decisions out: closed batches, signals, state and one decision per step in one streaming query."""
    inputs = G.live_inputs(live_signals(spark, folder, "decision-rows"), F.lit("general"))
    out = finished(spark, G.governed(inputs), "decided", keyed=True)
    return _out(out.where("status = 'decided'"))


def _step_table(spark, folder):
    """One row per step with all that a decision needs from its own batch."""
    rows = batch_rows(spark, folder)
    miss = ((F.col("p") >= 0.5).cast("int") != F.col("y")).cast("double")
    first = rows.groupBy("stream_id", "step", "closed_at").agg(F.min_by(miss, "idx").alias("miss"))
    inputs = G.live_inputs(C.event_signals(spark, folder), F.lit("general")).join(first, ["stream_id", "step"])
    return settled(inputs.select("stream_id", "step", "closed_at", "miss", "batch_accuracy", *G._ROW))


_MISSING, _TWICE, _REMEMBER = "step%17=5", "step%11=0", 64
_HELD_SQL = C.event_sql(f"""kept AS (SELECT * EXCLUDE (step), step AS real_step, row_number() OVER (PARTITION BY stream_id ORDER BY step)-1 AS step FROM signals WHERE NOT {_MISSING})""",
    "placed AS (SELECT stream_id, step, real_step FROM kept)", _live_sql("kept")) + f""",
ans AS (SELECT p.stream_id, p.real_step AS step, d.action_taken, round(d.capital,6) AS capital, round(lv.alpha,6) AS alpha,
  p.real_step-coalesce(lag(p.real_step) OVER (PARTITION BY p.stream_id ORDER BY p.step),-1)-1 AS skipped, max(p.real_step) OVER (PARTITION BY p.stream_id) AS last
  FROM placed p JOIN dec d ON d.stream_id=p.stream_id AND d.step=p.step AND d.strategy='multi_action' JOIN lv ON lv.stream_id=p.stream_id AND lv.step=p.step)
SELECT stream_id, step, 'decided' AS status, skipped, action_taken, capital, alpha FROM ans
UNION ALL SELECT stream_id, step, CASE WHEN step>last-{_REMEMBER} THEN 'repeated' ELSE 'late' END, CASE WHEN step>last-{_REMEMBER} THEN skipped END,
  CASE WHEN step>last-{_REMEMBER} THEN action_taken END, CASE WHEN step>last-{_REMEMBER} THEN capital END, CASE WHEN step>last-{_REMEMBER} THEN alpha END
FROM ans WHERE {_TWICE}"""


@query("stream_out_of_order", _HELD_SQL)
def stream_out_of_order(spark, folder):
    """Steps arrive mixed, some never, some twice: gaps are waited for and then passed over, a repeated step gets its first answer."""
    steps = _step_table(spark, folder)
    here = steps.where(f"NOT ({_MISSING})")
    again = here.where(_TWICE).withColumn("closed_at", F.date_add(F.lit(FAR).cast("date"), 1).cast("timestamp"))
    stream = in_files([*shuffled(here), heartbeat(here), again], spark, "mixed-steps").withWatermark("closed_at", LATE)
    out = finished(spark, G.governed(stream, limit=1_000_000, remember=_REMEMBER), "held", keyed=True)
    return out.select("stream_id", "step", "status", "skipped", "action_taken", r6("capital"), r6("alpha"))


@query("stream_resumed", C.event_sql(_ALL_STEPS, _live_sql("signals")) + _LIVE_OUT)
def stream_resumed(spark, folder):
    """A run that ends in the middle, with steps still waiting, and a second one that takes over its saved state."""
    steps = _step_table(spark, folder)
    half = steps.groupBy("stream_id").agg((F.max("step") / 2).cast("long").alias("half"))
    rows = steps.join(half, "stream_id")
    early = (F.col("step") <= F.col("half")) | ((F.col("step") > F.col("half") + 3) & (F.col("step") <= F.col("half") + 6))
    first, rest = rows.where(early).drop("half"), rows.where(~early).drop("half")
    checkpoint, store = sinks.scratch(spark, "first-run"), sinks.scratch(spark, "state")
    one = finished(spark, G.governed(in_files(shuffled(first), spark, "first-steps").withWatermark("closed_at", LATE), limit=1_000_000), "first-half", checkpoint, keyed=True)
    G.save_state(G.saved_state(spark, checkpoint), store, 1)
    stream = in_files(shuffled(rest), spark, "other-steps").withWatermark("closed_at", LATE)
    two = finished(spark, G.governed(stream, limit=1_000_000, initial=G.load_state(spark, store)), "second-half", keyed=True)
    return _out(one.unionByName(two).where("status = 'decided'"))


@query("repaired_outcomes", C.event_sql(upto="batched") + """SELECT stream_id, step, CAST(date_trunc('day', max(ts)) AS DATE) AS day, count(*) AS n, count(*) AS revealed,
round(avg(CASE WHEN (p>=0.5)=(y=1) THEN 1.0 ELSE 0.0 END),6) AS batch_accuracy, round(avg(y),6) AS label_rate FROM batched GROUP BY 1,2""")
def repaired_outcomes(spark, folder):
    """Outcomes from the labels that the stream join saw, then repaired by the late ones: equal to the answer of all labels."""
    rows = batch_rows(spark, folder).withColumn("day", F.to_date("closed_at"))
    decided = settled(rows.select("day", "stream_id", "step", "event_id", "ts", "p", "y"))
    delay = F.make_interval(hours=(F.col("event_id") % 30).cast("int"))
    reveals = decided.select("event_id", F.col("y").alias("label"), (F.col("ts") + delay).alias("reveal_ts"))
    stream = live.revealed(in_files([decided.select("event_id", "ts")], spark, "decided"), in_files([reveals], spark, "reveals"), ["event_id"], "24 HOURS", how="inner")
    timely = finished(spark, stream, "timely").select("event_id", "label", "reveal_ts")
    table, side = sinks.scratch(spark, "outcomes"), sinks.scratch(spark, "late-labels")
    sinks.replace_partitions(P.outcomes(decided, timely), table, ["day"])
    P.keep_late(live.late_reveals(decided, reveals, ["event_id"], "24 HOURS").select("event_id", "label", "reveal_ts"), decided, side, 0)
    P.repair(decided, timely, spark.read.parquet(side), table)
    return spark.read.parquet(table).select("stream_id", "step", "day", "n", "revealed", r6("batch_accuracy"), r6("label_rate"))

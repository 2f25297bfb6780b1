"""Sources and sinks: derived files and messages are written, read back and compared."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftgauge.plans import canon as C
from driftgauge.plans.registry import query, r6, table
from driftgauge.sources import files, payloads, sinks
from driftgauge.sources.resolve import time_column


@query("parquet_scan", """SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice),2) AS total FROM orders
WHERE o_orderdate >= TIMESTAMP '1997-01-01' GROUP BY 1""")
def parquet_scan(spark, folder):
    o = files.replay_table(spark, f"{folder}/orders.parquet")
    return o.where(F.col("o_orderdate") >= F.lit("1997-01-01").cast("timestamp")).groupBy("o_orderpriority").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("replay_csv_round_trip", """SELECT event_type AS regime, user_id%2 AS label, count(*) AS n, round(sum(value),4) AS total
FROM events GROUP BY 1,2""")
def replay_csv_round_trip(spark, folder):
    """Canonical export to CSV, then the CSV scan with its schema."""
    e = table(spark, folder, "events").select(
        F.col("ts").cast("string").alias("timestamp"), (F.col("user_id") % 2).alias("label"),
        F.col("event_type").alias("regime"), "value")
    path = sinks.scratch(spark, "replay") + ".csv"
    sinks.replay_export(e, ["value"], path)
    schema = T.StructType.fromDDL("timestamp string, label bigint, regime string, feature_0 double")
    return files.replay_table(spark, path, schema).groupBy("regime", "label").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("feature_0"), 4).alias("total"))


@query("event_csv", """SELECT CAST(event_id AS VARCHAR) AS event_id, [value, CAST(user_id AS DOUBLE)] AS features,
CASE WHEN event_id%4<>0 THEN CAST(user_id%2 AS INTEGER) END AS label, 'live' AS regime_id FROM events""")
def event_csv(spark, folder):
    e = table(spark, folder, "events").select(
        "event_id", F.col("ts").cast("string").alias("timestamp"),
        F.when(F.col("event_id") % 4 == 0, F.lit("NaN")).otherwise((F.col("user_id") % 2).cast("string")).alias("label"),
        F.col("value").alias("feature_0"), F.col("user_id").alias("feature_1"))
    path = sinks.scratch(spark, "events")
    e.write.option("header", True).csv(path)
    schema = T.StructType.fromDDL(
        "event_id bigint, timestamp string, label double, feature_0 double, feature_1 double")
    return files.event_table_csv(spark, path, schema).select("event_id", "features", "label", "regime_id")


@query("event_csv_without_ids", "SELECT count(*) AS n, 0 AS lowest, count(*)-1 AS highest, count(*) AS n_ids FROM orders")
def event_csv_without_ids(spark, folder):
    o = table(spark, folder, "orders").select(F.col("o_totalprice").alias("feature_0"), F.lit(1).alias("label"))
    path = sinks.scratch(spark, "no-ids")
    o.write.option("header", True).csv(path)
    got = files.event_table_csv(spark, path, T.StructType.fromDDL("feature_0 double, label int"))
    i = F.col("event_id").cast("long")
    return got.agg(F.count(F.lit(1)).alias("n"), F.min(i).alias("lowest"), F.max(i).alias("highest"),
                   F.count_distinct(i).alias("n_ids"))


@query("event_json_lines", """SELECT CAST(event_id AS VARCHAR) AS event_id, [value] AS features, CAST(user_id%2 AS INTEGER) AS label,
CASE WHEN event_id%3=0 THEN 'live' ELSE event_type END AS regime_id FROM events""")
def event_json_lines(spark, folder):
    e = table(spark, folder, "events").select(
        F.col("event_id").cast("string").alias("event_id"), F.col("ts").cast("string").alias("timestamp"),
        F.array("value").alias("features"), (F.col("user_id") % 2).cast("int").alias("label"),
        F.when(F.col("event_id") % 3 != 0, F.col("event_type")).alias("regime_id"))
    path = sinks.scratch(spark, "lines")
    e.write.json(path)
    return files.event_lines(spark, path).select("event_id", "features", "label", "regime_id")


@query("positional_sensor_text", """SELECT l_suppkey AS unit, max(l_linenumber) AS last_cycle, count(*) AS n, round(sum(l_quantity),2) AS s1
FROM lineitem GROUP BY 1""")
def positional_sensor_text(spark, folder):
    t = table(spark, folder, "lineitem")
    line = F.concat_ws(" ", F.col("l_suppkey"), F.lit(" "), F.col("l_linenumber"), F.col("l_quantity"), F.lit(" "))
    path = sinks.scratch(spark, "sensor")
    t.select(line.alias("value")).write.text(path)
    got = files.positional_text(spark, path, [("unit", "bigint"), ("time_cycle", "int"), ("s1", "double")])
    return got.groupBy("unit").agg(F.max("time_cycle").alias("last_cycle"), F.count(F.lit(1)).alias("n"),
                                   F.round(F.sum("s1"), 2).alias("s1"))


@query("sparse_sensor_text", """SELECT CAST(label=3 AS INTEGER) AS label, count(*) AS n, round(sum(CAST(embedding[1] AS DOUBLE)),4) AS first,
round(sum(CAST(embedding[64] AS DOUBLE)),4) AS last FROM embeddings GROUP BY 1""")
def sparse_sensor_text(spark, folder):
    e = table(spark, folder, "embeddings")
    pairs = F.transform("embedding", lambda x, i: F.concat((i + 1).cast("string"), F.lit(":"), x.cast("double").cast("string")))
    path = sinks.scratch(spark, "sparse")
    e.select(F.concat_ws(" ", F.col("label").cast("string"), F.array_join(pairs, " ")).alias("value")).write.text(path)
    got = files.sparse_text(spark, path, target=3)
    return got.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum(F.element_at("features", 1)), 4).alias("first"),
        F.round(F.sum(F.element_at("features", 64)), 4).alias("last"))


@query("headless_csv_join", """SELECT c_nationkey AS node_class, count(*) AS n, round(sum(o_totalprice),2) AS total
FROM orders JOIN customer ON o_custkey=c_custkey GROUP BY 1""")
def headless_csv_join(spark, folder):
    """Header-less features joined with their classes."""
    path = sinks.scratch(spark, "nodes")
    table(spark, folder, "orders").select("o_custkey", "o_totalprice").write.csv(path)
    nodes = files.headless_csv(spark, path, T.StructType.fromDDL("id bigint, f0 double"))
    classes = table(spark, folder, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("node_class"))
    return nodes.join(classes, "id").groupBy("node_class").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("f0"), 2).alias("total"))


@query("training_table", """SELECT CAST(label AS INTEGER) AS label, count(*) AS n, min(time_rank) AS first_rank, max(time_rank) AS last_rank,
round(sum(feature_0),2) AS f0 FROM (SELECT CAST(o_orderstatus='F' AS INTEGER) AS label, epoch(o_orderdate)::BIGINT AS time_rank,
o_totalprice AS feature_0 FROM orders) GROUP BY 1""")
def training_table(spark, folder):
    """Standardized table written in time order and read back; its time column is resolved by name."""
    o = table(spark, folder, "orders")
    path = sinks.scratch(spark, "training")
    sinks.write_training_table(sinks.training_table(
        o, F.unix_timestamp("o_orderdate"), F.col("o_orderstatus") == "F", ["o_totalprice"]), path)
    got = spark.read.parquet(path)
    t = time_column(got)
    return got.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.min(t).alias("first_rank"),
                                    F.max(t).alias("last_rank"), F.round(F.sum("feature_0"), 2).alias("f0"))


# ---- messages --------------------------------------------------------------------------------

def event_messages(spark, folder):
    """Events as JSON messages in every accepted spelling, and two refused ones."""
    e = table(spark, folder, "events")
    k = F.get_json_object("props", "$.k").cast("double")
    vec, y, i = F.array("value", k), (F.col("user_id") % 2).cast("int"), F.col("event_id").cast("string")
    kind = F.col("event_id") % 5
    msg = (F.when(kind == 0, F.to_json(F.struct(i.alias("event_id"), vec.alias("features"), y.alias("label"),
                                                F.col("event_type").alias("regime_id"))))
           .when(kind == 1, F.to_json(F.struct(i.alias("batch_id"), vec.alias("features"), F.array(y).alias("labels"),
                                               F.col("event_type").alias("regime"))))
           .when(kind == 2, F.to_json(F.struct(i.alias("event_id"), F.array(vec).alias("features"))))
           .when(kind == 3, F.to_json(F.struct(i.alias("event_id"), F.array(vec, vec).alias("features"))))
           .otherwise(F.to_json(F.struct(vec.alias("features")))))
    return e.select(F.col("event_id").alias("n"), msg.alias("value"))


@query("event_messages", """SELECT event_id AS n, CASE WHEN event_id%5=4 THEN NULL ELSE CAST(event_id AS VARCHAR) END AS event_id,
CASE WHEN event_id%5=3 THEN NULL ELSE value END AS f0, CASE WHEN event_id%5 IN (0,1) THEN CAST(user_id%2 AS INTEGER) END AS label,
CASE WHEN event_id%5 IN (0,1) THEN event_type ELSE 'live' END AS regime_id,
CASE event_id%5 WHEN 3 THEN 'matrix_in_event' WHEN 4 THEN 'missing_id' END AS error FROM events""")
def parsed_event_messages(spark, folder):
    p = payloads.parse_events(event_messages(spark, folder))
    return p.select("n", "event_id", F.get("features", F.lit(0)).alias("f0"), "label", "regime_id", "error")


def batch_messages(spark, folder):
    """One message per batch; a batch is small, so its rows meet in one list."""
    b = C.event_batches(spark, folder)
    rows = F.array_sort(F.collect_list(F.struct("idx", F.array("f0", "f1").alias("x"), "y")))
    g = b.groupBy("stream_id", "step").agg(rows.alias("r"))
    key = F.concat_ws("-", "stream_id", F.col("step").cast("string"))
    return g.select("stream_id", "step", F.to_json(F.struct(
        key.alias("batch_id"), F.transform("r", lambda s: s["x"]).alias("features"),
        F.transform("r", lambda s: s["y"]).alias("labels"), F.col("stream_id").alias("regime"))).alias("value"))


@query("batch_messages", C.event_sql(upto="batched") + """SELECT stream_id||'-'||step AS batch_id, CAST(idx-step*48 AS INTEGER) AS row,
f0, f1, y AS label, stream_id AS regime_id FROM batched""")
def parsed_batch_messages(spark, folder):
    p = payloads.parse_batches(batch_messages(spark, folder).select("value"))
    return p.select("batch_id", "row", F.col("features")[0].alias("f0"), F.col("features")[1].alias("f1"),
                    "label", "regime_id")


@query("label_messages", C.event_sql(upto="batched") + """SELECT stream_id||'-'||step AS batch_id, count(*) AS n_labels,
CAST(sum(y) AS BIGINT) AS n_positive FROM batched GROUP BY 1""")
def parsed_label_messages(spark, folder):
    p = payloads.parse_labels(batch_messages(spark, folder).select("value"))
    total = F.aggregate("labels", F.lit(0).cast("long"), lambda s, x: s + x)
    return p.select("batch_id", F.size("labels").cast("long").alias("n_labels"), total.alias("n_positive"))


_CASES = {0: "", 1: "features_required", 2: "features_not_numeric", 3: "labels_length", 4: "features_not_1d_or_2d",
          5: "too_many_features", 6: "features_empty"}


@query("message_checks", """SELECT event_id AS n, CASE event_id%7 """
       + " ".join(f"WHEN {k} THEN '{v}'" for k, v in _CASES.items())
       + """ END AS errors, event_id%7=0 AS valid FROM events""")
def message_checks(spark, folder):
    """Validation rules over messages broken in known ways."""
    e = table(spark, folder, "events")
    k = F.col("event_id") % 7
    text = F.col("value").cast("string")
    msg = (F.when(k == 0, F.concat(F.lit('{"features": [['), text, F.lit(', 1.0]], "labels": [1]}')))
           .when(k == 1, F.lit('{"labels_only": true}'))
           .when(k == 2, F.concat(F.lit('{"features": ["a", '), text, F.lit("]}")))
           .when(k == 3, F.concat(F.lit('{"features": [['), text, F.lit(']], "labels": [1, 0]}')))
           .when(k == 4, F.concat(F.lit('{"features": [[['), text, F.lit("]]]}")))
           .when(k == 5, F.concat(F.lit('{"features": ['), F.array_join(F.array_repeat(text, 9), ","), F.lit("]}")))
           .otherwise(F.lit('{"features": []}')))
    c = payloads.validated(e.select(F.col("event_id").alias("n"), msg.alias("value")), max_width=8)
    return c.select("n", F.concat_ws(";", "errors").alias("errors"), (F.size("errors") == 0).alias("valid"))


@query("message_kinds", """SELECT event_id%5=3 AS is_batch, count(*) AS n FROM events GROUP BY 1""")
def message_kinds(spark, folder):
    return payloads.is_batch(event_messages(spark, folder), "value").groupBy("is_batch").agg(
        F.count(F.lit(1)).alias("n"))


@query("reference_rows", C.event_sql(upto="batched") + """SELECT stream_id AS regime, count(*) AS n, round(avg(f0),6) AS mean_f0,
CAST(sum(y) AS BIGINT) AS n_positive FROM batched WHERE step < greatest(2, n_steps//4) GROUP BY 1""")
def reference_rows(spark, folder):
    """Reference batches saved as JSON and loaded back as rows."""
    b = C.event_batches(spark, folder).where(F.col("step") < F.greatest(F.lit(2), F.floor(F.col("n_steps") / 4)))
    g = b.groupBy("stream_id", "step").agg(F.collect_list(F.struct(F.array("f0", "f1").alias("x"), "y")).alias("r"))
    path = sinks.scratch(spark, "reference")
    g.select(F.col("r.x").alias("features"), F.col("r.y").alias("labels"), F.col("stream_id").alias("regime")).write.json(path)
    return files.reference_rows(spark, path).groupBy("regime").agg(
        F.count(F.lit(1)).alias("n"), r6(F.avg(F.col("features")[0]), "mean_f0"),
        F.sum("label").alias("n_positive"))


@query("dataset_manifest", """SELECT 'events' AS dataset_id, count(*) AS row_count FROM events UNION ALL
SELECT 'lineitem', count(*) FROM lineitem UNION ALL SELECT 'orders', count(*) FROM orders""")
def dataset_manifest(spark, folder):
    frames = {n: (f"{folder}/{n}.parquet", table(spark, folder, n)) for n in ("events", "lineitem", "orders")}
    return sinks.manifest(frames).drop("path")

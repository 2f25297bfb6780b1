"""Live scoring: messages in, signals and decisions out, labels whenever they arrive."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from contextlib import contextmanager, nullcontext
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from driftgauge.operators.batches import label_aggregates, output_aggregates
from driftgauge.operators.drift import DECAY, MAX_CAPITAL, RISK_ALERT
from driftgauge.sources import sinks


# ---- sources ---------------------------------------------------------------------------------

@dataclass(frozen=True)
class TopicSource:
    """Connection of the topic source; the connector package comes with the cluster."""

    servers: str
    events_topic: str
    labels_topic: str | None = None
    group: str = "driftgauge"
    starting: str = "earliest"
    max_per_trigger: int | None = None
    security: Mapping[str, str] = field(default_factory=dict)

    def options(self) -> dict[str, str]:
        topics = [t for t in (self.events_topic, self.labels_topic) if t]
        out = {"kafka.bootstrap.servers": self.servers, "subscribe": ",".join(topics),
               "kafka.group.id": self.group, "startingOffsets": self.starting}
        if self.max_per_trigger:
            out["maxOffsetsPerTrigger"] = str(self.max_per_trigger)
        # Security settings are client settings: security.protocol, sasl.mechanism, sasl.jaas.config, ssl.*
        return {**out, **{f"kafka.{k}": v for k, v in self.security.items()}}


def topic_messages(spark: SparkSession, source: TopicSource) -> DataFrame:
    raw = spark.readStream.format("kafka").options(**source.options()).load()
    return raw.select("topic", F.col("value").cast("string").alias("value"), F.col("timestamp").alias("arrived"))


def folder_messages(spark: SparkSession, path: str, topic: str, files_per_trigger: int | None = None) -> DataFrame:
    """Text files with one message per line, in place of a topic."""
    reader = spark.readStream
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.text(path).select(F.lit(topic).alias("topic"), "value", F.current_timestamp().alias("arrived"))


def table_stream(spark: SparkSession, folder: str, name: str, files_per_trigger: int | None = None) -> DataFrame:
    """A table folder or file as a stream, with its own schema."""
    schema = spark.read.parquet(f"{folder}/{name}").schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", name if name.endswith(".parquet") else "*.parquet")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder if name.endswith(".parquet") else f"{folder}/{name}")


def routed(messages: DataFrame, labels_topic: str) -> tuple[DataFrame, DataFrame]:
    """Messages to score and label messages."""
    is_label = F.col("topic") == labels_topic
    return messages.where(~is_label), messages.where(is_label)


# ---- operators -------------------------------------------------------------------------------

def first_of(stream: DataFrame, keys: Sequence[str], time: str, late: str) -> DataFrame:
    """One row per key among rows that arrive within `late` of each other."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(list(keys))


def batch_aggregates(rows: DataFrame, keys: Sequence[Column | str], features: Sequence[str]) -> DataFrame:
    """Statistics per producer-made batch or per time window; the same aggregates as in batch mode."""
    aggs = [F.count(F.lit(1)).alias("n")]
    aggs += [F.avg(F.col(f).cast("double")).alias(f"mean_{f}") for f in features]
    aggs += [F.var_pop(F.col(f).cast("double")).alias(f"var_{f}") for f in features]
    return rows.groupBy(*keys).agg(*aggs, *output_aggregates(F.col("p")), *label_aggregates(F.col("p"), F.col("y")))


def window_stats(rows: DataFrame, features: Sequence[str], time: str, late: str, length: str, slide: str | None = None,
                 gap: str | None = None) -> DataFrame:
    """Tumbling, sliding or session windows per stream."""
    w = F.session_window(time, gap) if gap else F.window(time, length, slide) if slide else F.window(time, length)
    out = batch_aggregates(rows.withWatermark(time, late), [w.alias("w"), "stream_id"], features)
    return out.select("stream_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"),
                      *[c for c in out.columns if c not in ("w", "stream_id")])


def revealed(decisions: DataFrame, reveals: DataFrame, keys: Sequence[str], longest: str, late: str = "1 hour",
             how: str = "leftOuter") -> DataFrame:
    """Decisions with the labels that arrive up to `longest` after them, in any order.

    The time range bounds the state. A decision without labels comes out once the watermark has passed its range.
    """
    d = decisions.withWatermark("ts", late).alias("d")
    r = reveals.withWatermark("reveal_ts", late).alias("r")
    on = F.lit(True)
    for k in keys:
        on = on & (F.col(f"d.{k}") == F.col(f"r.{k}"))
    on = on & (F.col("r.reveal_ts") >= F.col("d.ts")) & (F.col("r.reveal_ts") <= F.col("d.ts") + F.expr(f"INTERVAL {longest}"))
    return d.join(r, on, how).select("d.*", *[F.col(f"r.{c}") for c in reveals.columns if c not in set(keys)])


def late_reveals(decisions: DataFrame, reveals: DataFrame, keys: Sequence[str], longest: str) -> DataFrame:
    """Reveals outside the range of the stream join, for the batch job that repairs them."""
    j = reveals.join(decisions.select(*keys, "ts"), list(keys))
    return j.where(F.col("reveal_ts") > F.col("ts") + F.expr(f"INTERVAL {longest}")).drop("ts")


def live_capital(signals: DataFrame) -> DataFrame:
    """Risk capital per stream as keyed state.

    A call gets the rows of one stream in one micro-batch, whose size the source's rate limit bounds.
    """
    def update(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        capital = state.get[0] if state.exists else 1.0
        pdf = pd.concat(list(frames)).sort_values("step")
        values = []
        for e in pdf["e_value"]:
            capital = min(MAX_CAPITAL, max(1.0, capital * DECAY * e))
            values.append(capital)
        state.update((capital,))
        yield pd.DataFrame({"stream_id": key[0], "step": pdf["step"].to_numpy(), "capital": values,
                            "risk_alert": [v >= RISK_ALERT for v in values]})

    return signals.select("stream_id", "step", "e_value").groupBy("stream_id").applyInPandasWithState(
        update, "stream_id string, step long, capital double, risk_alert boolean", "capital double", "append",
        GroupStateTimeout.NoTimeout)


# ---- sinks -----------------------------------------------------------------------------------
Writer = Callable[[DataFrame, int], None]


@dataclass
class FanOut:
    """Writes each micro-batch to several targets; a failing optional one is recorded and does not stop the others."""

    required: Sequence[Writer]
    optional: Mapping[str, Writer] = field(default_factory=dict)
    failures: list[tuple[int, str, str]] = field(default_factory=list)

    def __call__(self, df: DataFrame, epoch: int) -> None:
        df.persist()
        try:
            for write in self.required:
                write(df, epoch)
            for name, write in self.optional.items():
                try:
                    write(df, epoch)
                except Exception as e:  # noqa: BLE001
                    self.failures.append((epoch, name, str(e)))
        finally:
            df.unpersist()


def audit_writer(path: str) -> Writer:
    """Appends records by id, so that a repeated micro-batch changes nothing and reads the days it has records of."""
    return lambda df, epoch: sinks.append_audit(df, path, epoch)


def json_writer(path: str, fields: Sequence[str]) -> Writer:
    """One folder per micro-batch, replaced when the micro-batch is repeated."""
    return lambda df, epoch: df.select(*fields).write.mode("overwrite").json(f"{path}/epoch={epoch}")


def topic_writer(servers: str, topic: str, fields: Sequence[str]) -> Writer:
    return lambda df, epoch: sinks.message(df, fields).write.format("kafka").option(
        "kafka.bootstrap.servers", servers).option("topic", topic).save()


#: Native memory of all keyed state of an executor, whatever the number of its partitions, unless the session bounds it itself.
STORE_MB = 256


@contextmanager
def keyed_store(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB, which `transformWithState` needs, in bounded memory; the session's own settings are set again after."""
    base = "spark.sql.streaming.stateStore."
    wanted = {f"{base}providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
    if spark.conf.get(f"{base}rocksdb.boundedMemoryUsage", "false") != "true":
        wanted |= {f"{base}rocksdb.boundedMemoryUsage": "true", f"{base}rocksdb.maxMemoryUsageMB": str(STORE_MB)}
    before = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", keyed: bool = False) -> StreamingQuery:
    """Process everything there is now into a table, and stop. `keyed`: the stream has a keyed processor such as `governed`, or more state than the heap holds."""
    writer = (stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
              .outputMode(mode).trigger(availableNow=True))
    # A started stream has its own copy of the settings.
    with keyed_store(stream.sparkSession) if keyed else nullcontext():
        q = writer.start()
    q.awaitTermination()
    return q


def run_batches(stream: DataFrame, write: Writer, checkpoint: str, mode: str = "append") -> StreamingQuery:
    q = (stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode(mode)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return q

"""Writers of tables, audit logs and reports."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftgauge.session import checkpoint_folder


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared checkpoint folder."""
    return f"{checkpoint_folder(spark)}/exports/{name}-{uuid.uuid4().hex}"


def replay_export(df: DataFrame, features: Sequence[str], path: str) -> None:
    """Canonical replay table as headed CSV."""
    df.select("timestamp", "label", "regime", *[F.col(c).alias(f"feature_{i}") for i, c in enumerate(features)]
              ).write.mode("overwrite").option("header", True).csv(path)


def training_table(df: DataFrame, time: Column, label: Column, features: Sequence[str]) -> DataFrame:
    return df.select(time.alias("time_rank"), label.cast("int").alias("label"),
                     *[F.col(c).cast("double").alias(f"feature_{i}") for i, c in enumerate(features)])


def write_training_table(df: DataFrame, path: str) -> None:
    """Sorted by time: ranges over partitions, then inside each one."""
    df.repartitionByRange("time_rank").sortWithinPartitions("time_rank").write.mode("overwrite").parquet(path)


# The columns of the audit log and of its two exports.
AUDIT_COLUMNS = ("record_id", "stream_id", "step", "strategy", "operating_mode", "recommended_action",
                 "action_taken", "reason", "shift_score", "risk_capital", "risk_alert", "trust_state",
                 "retrain_recommended", "budget_limited", "recorded_at", "metadata")
TOPIC_FIELDS = ("record_id", "stream_id", "step", "operating_mode", "recommended_action", "action_taken", "reason",
                "shift_score", "risk_capital", "risk_alert", "trust_state", "metadata")
FILE_FIELDS = tuple(c for c in TOPIC_FIELDS if c != "metadata")


def audit_rows(decisions: DataFrame, recorded_at: Column, metadata: Column) -> DataFrame:
    """Audit records with an id made from the decision's key, so a repeated write is the same record."""
    key = F.sha2(F.concat_ws("|", "stream_id", F.col("step").cast("string"), "strategy"), 256)
    full = (decisions.withColumn("record_id", key).withColumn("recorded_at", recorded_at)
            .withColumn("metadata", metadata))
    return full.select(*AUDIT_COLUMNS)


def _folder(df: DataFrame, path: str, partitions: Sequence[str]) -> DataFrame:
    """The partitioned table at `path` with the schema of df; made if it is not there yet."""
    df.limit(0).write.partitionBy(*partitions).mode("append").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def replace_partitions(df: DataFrame, path: str, partitions: Sequence[str]) -> None:
    """Replaces the partitions that df has rows of, and no other."""
    df.write.partitionBy(*partitions).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def days_of(df: DataFrame, most: int = 10_000) -> list:
    """The distinct days of a frame, for partition pruning; a calendar bounds them."""
    days = [r[0] for r in df.select("day").distinct().limit(most + 1).collect()]
    if len(days) > most:
        raise ValueError(f"more than {most} days in one write")
    return days


def append_audit(rows: DataFrame, path: str, epoch: int = 0) -> None:
    """Adds the records that the log does not have, in partitions (day of `recorded_at`, epoch).

    `recorded_at` is the time of the decision, so a record always falls on the same day, and only the partitions of the days at
    hand are read. A repeated epoch replaces its own partitions by the same records.
    """
    rows = rows.dropDuplicates(["record_id"]).withColumns({"day": F.to_date("recorded_at"), "epoch": F.lit(epoch).cast("long")})
    log = _folder(rows, path, ["day", "epoch"])
    seen = log.where(F.col("day").isin(days_of(rows)) & (F.col("epoch") != epoch)).select("day", "record_id")
    replace_partitions(rows.join(seen, ["day", "record_id"], "left_anti").select(*rows.columns), path, ["day", "epoch"])


def recent_audit(audit: DataFrame, limit: int = 10_000) -> DataFrame:
    """The most recent records in ascending order; the limit is the export's own."""
    tie = [F.col("stream_id"), F.col("strategy")]
    return audit.orderBy(F.desc("step"), *tie).limit(limit).orderBy("step", *tie)


def export_audit(audit: DataFrame, path: str, limit: int = 10_000) -> None:
    recent_audit(audit, limit).write.mode("overwrite").json(path)


def message(df: DataFrame, fields: Sequence[str], key: str = "stream_id") -> DataFrame:
    """Key and JSON value, as a topic sink wants them."""
    return df.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct(*fields)).alias("value"))


def write_report(frames: Mapping[str, DataFrame], path: str) -> None:
    """One JSON folder per report part."""
    for name, df in frames.items():
        df.write.mode("overwrite").json(f"{path}/{name}")


def manifest(frames: Mapping[str, tuple[str, DataFrame]]) -> DataFrame:
    """Dataset id, path and row count of every source."""
    parts = [df.agg(F.count(F.lit(1)).alias("row_count")).select(
        F.lit(name).alias("dataset_id"), F.lit(path).alias("path"), "row_count")
        for name, (path, df) in frames.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out

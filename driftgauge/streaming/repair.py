"""Labels that come later than the stream join waits: kept in a side table, and repaired by a batch job that rewrites only the days they touch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftgauge.sources import sinks

KEYS = ("stream_id", "step")


def outcomes(decided: DataFrame, labels: DataFrame, row: str = "event_id") -> DataFrame:
    """Per batch what its labels say so far. decided: day, stream_id, step, row id, p; labels: row id, label (the first of a row counts, by reveal_ts)."""
    first = labels.groupBy(row).agg(F.min_by("label", "reveal_ts").alias("label"))
    hit = ((F.col("p") >= 0.5).cast("int") == F.col("label")).cast("double")
    return decided.join(first, row, "left").groupBy("day", *KEYS).agg(
        F.count(F.lit(1)).alias("n"), F.count("label").alias("revealed"), F.avg(hit).alias("batch_accuracy"), F.avg("label").alias("label_rate"))


def keep_late(late: DataFrame, decided: DataFrame, path: str, epoch: int, row: str = "event_id") -> None:
    """Puts late labels into the side table, by the day of their decision; a repeated epoch replaces itself."""
    placed = late.join(decided.select("day", row), row).withColumn("epoch", F.lit(epoch).cast("long"))
    sinks.replace_partitions(placed, path, ["day", "epoch"])


def repair(decided: DataFrame, labels: DataFrame, side: DataFrame, path: str, rows: Sequence[str] = ("event_id", "label", "reveal_ts")) -> list:
    """Recomputes the outcomes of the days in the side table from all their labels, and replaces these partitions only. Returns the days.

    decided and side have `day`, so the tables that are partitioned by it are read for these days only. Running it again changes nothing.
    """
    days = sinks.days_of(side)
    known = labels.select(*rows).unionByName(side.select(*rows))
    sinks.replace_partitions(outcomes(decided.where(F.col("day").isin(days)), known, rows[0]), path, ["day"])
    return days

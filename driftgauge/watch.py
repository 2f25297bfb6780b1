"""A watched set of streams: score, reveal, ask for retraining, summarize."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftgauge.operators import decisions as D
from driftgauge.operators import evidence as E
from driftgauge.operators import labels as L
from driftgauge.operators import windows as W
from driftgauge.operators.batches import assign_steps, batch_stats
from driftgauge.operators.drift import drift_surface
from driftgauge.operators.ordered import largest_group
from driftgauge.session import settled


@dataclass(frozen=True)
class Watch:
    """Scored rows have stream_id, p, y (null where unknown), the features and the order columns."""

    features: Sequence[str]
    order: Sequence[str]
    batch_size: int = 48
    delay: int = 0
    jitter: int = 0
    strategies: Sequence[str] = ("frozen", "multi_action")
    profile: str = "general"
    rules: D.Rules = field(default_factory=D.Rules)

    def batches(self, scores: DataFrame) -> DataFrame:
        rows = largest_group(scores, ["stream_id"])
        return assign_steps(scores, self.batch_size, [F.col(c) for c in self.order], rows=rows)

    def score_batches(self, batched: DataFrame, alpha: float | Column = 0.10) -> DataFrame:
        """Decisions of every strategy for every batch."""
        stats = settled(batch_stats(batched, self.features))
        rows = largest_group(stats, ["stream_id"])
        signals = W.trend_columns(drift_surface(stats, len(self.features), rows, ready=True), rows)
        recent = L.recent_reveals(stats, self.delay, self.jitter, rows=rows).select(
            "stream_id", "step", "recent_accuracy", "revealed_accuracy", "revealed_rate")
        gain = W.timescales(signals).select("stream_id", "step", "gain")
        full = signals.join(recent, ["stream_id", "step"]).join(gain, ["stream_id", "step"])
        level = alpha if isinstance(alpha, Column) else F.lit(float(alpha))
        inputs = D.decision_inputs(full.withColumn("alpha", level), F.lit(self.profile), self.rules)
        return D.decide(inputs, self.strategies, self.rules, ["n_steps", "batch_accuracy"])

    def reveal(self, decisions: DataFrame, batched: DataFrame) -> DataFrame:
        """Decisions with the outcome of their batch."""
        return E.surfaces(decisions, batched)

    def retrain_needed(self, decisions: DataFrame) -> DataFrame:
        """Latest retrain flag of each stream and strategy."""
        return decisions.groupBy("stream_id", "strategy").agg(
            F.max_by("retrain_recommended", "step").alias("retrain_needed"))

    def summary(self, surfaces: DataFrame) -> DataFrame:
        return E.strategy_summary(surfaces)

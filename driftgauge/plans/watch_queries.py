"""The watch over two streams of wide rows, from scoring to summary."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftgauge.plans import canon as C
from driftgauge.plans.registry import query, r6
from driftgauge.session import settled
from driftgauge.watch import Watch


@query("watched_lineitem")
def watched_lineitem(spark, folder):
    w = Watch(C.LINE_FEATURES, C.LINE_ORDER, delay=12, jitter=6, profile="fraud")
    b = w.batches(C.line_scores(spark, folder))
    d = settled(w.score_batches(b))
    s = w.summary(w.reveal(d, b)).join(w.retrain_needed(d), ["stream_id", "strategy"])
    return s.select("stream_id", "strategy", "steps", r6("mean_accuracy"), r6("mean_utility"), r6("intervention_rate"),
                    F.col("retrain_needed"))

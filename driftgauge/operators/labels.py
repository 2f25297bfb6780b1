"""Labels that arrive late: when they are visible, what is still pending, and what they say."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftgauge.functions import scalar as S
from driftgauge.operators.ordered import bounded_windows


def effective_delay(step: Column, delay: int, jitter: int = 0) -> Column:
    if delay <= 0 or jitter <= 0:
        return F.lit(max(0, delay)).cast("long")
    return F.greatest(F.lit(0).cast("long"), delay + (step * 7 + delay) % (2 * jitter + 1) - jitter)


def visible_at(step: Column, delay: int, jitter: int = 0) -> Column:
    """Step at which the labels of `step` come out of a first-in first-out queue.

    The queue opens only when its head is due, so this is the running maximum of the due steps.
    A due step cannot be passed by one more than 2 * jitter steps older, so the maximum over that
    many steps is exact, and no window is needed.
    """
    due = [F.when(step >= k, step - k + effective_delay(step - k, delay, jitter)) for k in range(2 * jitter + 1)]
    return F.greatest(*due) if len(due) > 1 else due[0]


def visible_at_some(df: DataFrame, delay: int, jitter: int, keys: Sequence[str] = ("stream_id",),
                    rows: int | None = None) -> DataFrame:
    """The same when only some steps have labels: a window over the rows that do."""
    due = df.withColumn("_due", F.col("step") + effective_delay(F.col("step"), delay, jitter))
    out = bounded_windows(
        due, keys, "step", 2 * jitter,
        lambda w: {"visible_at": F.max("_due").over(w.rangeBetween(-2 * jitter, 0))}, rows)
    return out.drop("_due")


def with_reveal_step(decisions: DataFrame, delay: int, jitter: int = 0) -> DataFrame:
    """`reveal_step` of every batch; labels not out by the end of the stream are flushed there."""
    v = visible_at(F.col("step"), delay, jitter)
    out = decisions.withColumn("visible_at", v)
    last = F.col("n_steps") - 1
    return (out.withColumn("flushed", F.col("visible_at") > last)
            .withColumn("reveal_step", F.least(F.col("visible_at"), last)))


def outcomes_at_reveal(decisions: DataFrame, reveals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Decisions joined to the labels that name them, by batch id or by step."""
    return decisions.join(reveals, list(keys))


def pending_at(decisions: DataFrame, reveals: DataFrame, step: int, keys: Sequence[str] = ("stream_id", "step")
               ) -> DataFrame:
    """Decisions up to `step` whose labels are not visible yet."""
    seen = reveals.where(F.col("visible_at") <= step).select(*keys)
    return decisions.where(F.col("step") <= step).join(seen, list(keys), "left_anti")


def pending_summary(decisions: DataFrame, delay: int, jitter: int = 0) -> DataFrame:
    """Queue length and age at the start of every step.

    A batch waits for a number of steps bounded by the delay, so each one is spread over the steps that see it.
    """
    stale = max(4, delay * 2 if delay > 0 else 8)
    d = decisions.select("stream_id", "step", "n_steps", visible_at(F.col("step"), delay, jitter).alias("_v"))
    last = F.least(F.col("_v"), F.col("n_steps") - 1)
    waits = d.where(last > F.col("step")).select(
        "stream_id", F.col("step").alias("_from"), F.explode(F.sequence(F.col("step") + 1, last)).alias("step"))
    age = F.col("step") - F.col("_from")
    got = waits.groupBy("stream_id", "step").agg(
        F.count(F.lit(1)).alias("pending"), F.avg(age).alias("mean_age"), F.max(age).alias("max_age"),
        F.avg((age >= stale).cast("double")).alias("stale_share"))
    zero = {"pending": 0, "mean_age": 0.0, "max_age": 0, "stale_share": 0.0}
    return decisions.select("stream_id", "step").join(got, ["stream_id", "step"], "left").na.fill(zero)


def first_reveals(reveals: DataFrame, keys: Sequence[str], order: str) -> tuple[DataFrame, DataFrame]:
    """Accepted reveals (the first of each batch) and the rejected later ones; `order` is unique."""
    first = reveals.groupBy(*keys).agg(F.min(order).alias(order))
    on = [*keys, order]
    return reveals.join(first, on, "left_semi"), reveals.join(first, on, "left_anti")


def reveal_metrics(rows: DataFrame, keys: Sequence[str], abstained: Column | None = None) -> DataFrame:
    """Accuracy, coverage, residual and positive rate of a batch; nothing is served when abstaining."""
    hit = (F.col("yhat") == F.col("y")).cast("double")
    off = F.max(abstained.cast("int")) == 1 if abstained is not None else F.lit(False)
    return rows.groupBy(*keys).agg(
        F.when(off, 0.0).otherwise(F.avg(hit)).alias("batch_accuracy"),
        F.when(off, 0.0).otherwise(1.0).alias("coverage"),
        F.avg(F.col("y") - F.col("p")).alias("mean_residual"), F.avg(F.col("y").cast("double")).alias("label_rate"))


def correction_stats(rows: DataFrame, keys: Sequence[str], raw: str, new: str) -> DataFrame:
    delta = F.abs(F.col(new) - F.col(raw))
    flip = (F.col(new) >= 0.5) != (F.col(raw) >= 0.5)
    got = rows.groupBy(*keys).agg(
        F.avg(delta).alias("mean_abs_delta"), F.max(delta).alias("max_abs_delta"),
        F.count_if(flip).alias("flipped"))
    return got.withColumn("applied", F.col("max_abs_delta") > 1e-6)


def recent_reveals(stats: DataFrame, delay: int, jitter: int = 0, last: int = 5, rows: int | None = None) -> DataFrame:
    """What the controller knows at each step: means over the last reveals before it.

    Adds `recent_accuracy` (one reveal is enough), and `revealed_accuracy` and `revealed_rate` (from two on).
    """
    def columns(w):
        back = w.rowsBetween(-(last - 1), 0)
        return {"_acc": F.avg("batch_accuracy").over(back), "_rate": F.avg("label_rate").over(back),
                "_k": F.count("batch_accuracy").over(back), "_next": F.lead("_v").over(w)}

    base = stats.select("stream_id", "step", "n_steps", "batch_accuracy", "label_rate",
                        visible_at(F.col("step"), delay, jitter).alias("_v"))
    w = bounded_windows(base, ["stream_id"], "step", last, columns, rows, ahead=1)
    # Reveal s is the newest one for decisions after its own step up to the step of the next reveal.
    start = F.col("_v") + 1
    end = F.least(F.coalesce("_next", F.col("n_steps") - 1), F.col("n_steps") - 1)
    newest = w.where(start <= end).select(
        "stream_id", F.explode(F.sequence(start, end)).alias("step"),
        F.col("_acc").alias("recent_accuracy"),
        F.when(F.col("_k") >= 2, F.col("_acc")).alias("revealed_accuracy"),
        F.when(F.col("_k") >= 2, F.col("_rate")).alias("revealed_rate"))
    return stats.join(newest, ["stream_id", "step"], "left")


def utility(accuracy: Column, alert: Column, drift: Column, abstained: Column, action: Column) -> Column:
    """Accuracy (0.5 when unknown) less the operational penalties."""
    return (F.coalesce(accuracy, F.lit(0.5)) - 0.06 * alert.cast("double") - 0.03 * F.least(F.lit(1.0), drift)
            - 0.10 * abstained.cast("double") - 0.04 * (action == "reset").cast("double"))


def delay_weight(delay_steps: Column, outstanding: Column, stale: Column) -> Column:
    zero = F.lit(0)
    return 1 / (1 + 0.06 * F.greatest(zero, delay_steps - 1) + 0.03 * F.greatest(zero, outstanding - 1) + 0.35 * stale)


def delayed_reward(util: Column, capital: Column, accuracy: Column, baseline: Column, weight: Column) -> Column:
    """Utility less a capital penalty, plus the lift over the baseline, scaled by the delay weight."""
    base = util - 0.01 * F.greatest(F.lit(0.0), capital - 1)
    lifted = S.clip(base + 0.15 * S.clip(accuracy - baseline, -0.5, 0.5), -2, 2)
    return F.when(accuracy.isNull() | baseline.isNull(), base).otherwise(lifted) * S.clip(weight, 0.35, 1)


def retrospective_reward(util: Column, accuracy: Column, base_accuracy: Column, revealed: Column,
                         reliability: Column, coverage: Column) -> Column:
    return (util + 0.20 * (accuracy - base_accuracy) + 0.05 * (revealed - base_accuracy)
            - 0.18 * F.abs(accuracy - reliability) - 0.02 * F.greatest(F.lit(0.0), 1 - coverage))


def reward_trust(delay_steps: Column, accuracy: Column, reliability: Column, coverage: Column,
                 delay_scale: float, calibration_scale: float, coverage_scale: float, least: float) -> Column:
    raw = (1 - delay_scale * F.least(F.lit(1.0), delay_steps / 12.0)
           - calibration_scale * F.abs(accuracy - reliability)
           - coverage_scale * F.greatest(F.lit(0.0), 1 - coverage))
    return S.clip(raw, least, 1)

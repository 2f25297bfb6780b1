"""Rows of a stream to numbered batches, and batches to one statistics row each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftgauge.functions import scalar as S
from driftgauge.operators.ordered import row_index
from driftgauge.session import stored

# Confidence levels at which the policies count usable rows.
CONFIDENT_LEVELS = {"conf68": 0.68, "conf80": 0.80, "conf90": 0.90}


def assign_steps(
    scores: DataFrame,
    batch_size: int,
    order: Sequence[Column],
    keep_tail: bool = False,
    max_steps: int | None = None,
    rows: int | None = None,
    stream: str = "stream_id",
) -> DataFrame:
    """Number rows along `order` within each stream and add `idx`, `step` and `n_steps`.

    A partial last batch is dropped unless `keep_tail`.
    """
    out = row_index(scores, [stream], order, rows, total="_n")
    whole = F.ceil if keep_tail else F.floor
    steps = whole(F.col("_n") / batch_size).cast("long")
    if max_steps is not None:
        steps = F.least(steps, F.lit(max_steps).cast("long"))
    out = out.withColumn("step", F.floor(F.col("idx") / batch_size).cast("long")).withColumn("n_steps", steps)
    return out.where(F.col("step") < F.col("n_steps")).drop("_n")


def output_aggregates(p: Column) -> list[Column]:
    """Per-batch aggregates of the score column."""
    return [
        F.avg(S.entropy(p)).alias("mean_entropy"),
        F.avg(p).alias("mean_p"),
        F.avg((p >= 0.5).cast("double")).alias("positive_rate"),
        F.avg(S.confidence(p)).alias("mean_conf"),
        F.sum((p >= 0.5).cast("long")).alias("n_pred_pos"),
        *[F.avg((S.confidence(p) >= v).cast("double")).alias(k) for k, v in CONFIDENT_LEVELS.items()],
    ]


def label_aggregates(p: Column, y: Column) -> list[Column]:
    """Per-batch label aggregates; all null when any row of the batch has no label."""
    full = F.count(y) == F.count(F.lit(1))
    hit = ((p >= 0.5).cast("int") == y).cast("double")
    return [
        full.alias("labelled"),
        F.when(full, F.avg(hit)).alias("batch_accuracy"),
        F.when(full, F.avg(y.cast("double"))).alias("label_rate"),
        F.when(full, F.avg(y - p)).alias("mean_residual"),
    ]


def batch_stats(batched: DataFrame, features: Sequence[str], labels: bool = True,
                keys: Sequence[str] = ("stream_id", "step")) -> DataFrame:
    """One row per batch: count, feature moments as arrays, output and label aggregates.

    Feature columns stay wide so the scan prunes them and one partial aggregation does the work.
    """
    p = F.col("p")
    aggs = [F.count(F.lit(1)).alias("n"), F.first("n_steps").alias("n_steps")]
    aggs += [F.avg(F.col(f).cast("double")).alias(f"_m_{f}") for f in features]
    aggs += [F.var_pop(F.col(f).cast("double")).alias(f"_v_{f}") for f in features]
    aggs += output_aggregates(p)
    if labels:
        aggs += label_aggregates(p, F.col("y"))
    out = batched.groupBy(*keys).agg(*aggs)
    mean = F.array(*[F.col(f"_m_{f}") for f in features]).alias("f_mean")
    var = F.array(*[F.col(f"_v_{f}") for f in features]).alias("f_var")
    drop = [f"_{k}_{f}" for f in features for k in "mv"]
    return out.select("*", mean, var).drop(*drop)


def array_moments(df: DataFrame, keys: Sequence[str], array: str) -> DataFrame:
    """Mean and population variance per position of an array column, for widths not known in the plan."""
    long = df.select(*keys, F.posexplode(array).alias("j", "x"))
    return long.groupBy(*keys, "j").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("x").cast("double")).alias("f_mean"),
        F.var_pop(F.col("x").cast("double")).alias("f_var"))


def reference_window(stats: DataFrame, share: int = 4, least: int = 2) -> DataFrame:
    """Batches of the reference window: the first `max(least, steps // share)` of each stream."""
    return stats.where(F.col("step") < F.greatest(F.lit(least), F.floor(F.col("n_steps") / share)))


def reference_profile(window: DataFrame, width: int, eps: float = 1e-6) -> DataFrame:
    """One profile per stream from batch rows, so the event rows are not read a second time.

    Moments of the union of batches follow from the batch moments weighted by batch size.
    """
    n = F.col("n")
    total = F.sum(n)
    aggs = []
    for j in range(1, width + 1):
        m, v = F.element_at("f_mean", j), F.element_at("f_var", j)
        aggs += [(F.sum(n * m) / total).alias(f"_m{j}"), (F.sum(n * (v + m * m)) / total).alias(f"_s{j}")]
    names = ["mean_entropy", "mean_p", "positive_rate", "mean_conf"]
    aggs += [(F.sum(n * F.col(c)) / total).alias(f"ref_{c}") for c in names]
    got = window.groupBy("stream_id").agg(F.count(F.lit(1)).alias("ref_batches"), *aggs)
    return got.select(
        "stream_id", "ref_batches",
        F.array(*[F.col(f"_m{j}") for j in range(1, width + 1)]).alias("ref_mean"),
        F.array(*[F.greatest(F.col(f"_s{j}") - F.col(f"_m{j}") * F.col(f"_m{j}"), F.lit(0.0)) + eps
                  for j in range(1, width + 1)]).alias("ref_var"),
        *[f"ref_{c}" for c in names],
    )


def pooled_signature(batched: DataFrame, reference: DataFrame, features: Sequence[str]) -> DataFrame:
    """28 numbers per batch: pooled mean, variance, absolute mean and clipped cube of the standardized
    features in six chunks, and four norms."""
    # Stored, so that the few rows are broadcast and the rows are not dealt by stream.
    joined = batched.join(stored(reference.select("stream_id", "ref_mean", "ref_var")), "stream_id")
    aggs = []
    for i, f in enumerate(features):
        z = (F.col(f).cast("double") - F.element_at("ref_mean", i + 1)) / F.sqrt(
            F.element_at("ref_var", i + 1) + 1e-6)
        aggs += [F.avg(z).alias(f"_a{i}"), F.var_pop(z).alias(f"_b{i}"), F.avg(F.abs(z)).alias(f"_c{i}"),
                 F.avg(F.pow(S.clip(z, -3, 3), 3)).alias(f"_d{i}")]
    got = joined.groupBy("stream_id", "step").agg(*aggs)
    width = len(features)
    arrays = {k: F.array(*[F.col(f"_{k}{i}") for i in range(width)]) for k in "abcd"}
    got = got.select("stream_id", "step", *[v.alias(f"z_{k}") for k, v in arrays.items()])
    pools = {k: S.pooled(F.col(f"z_{k}"), width, min(6, width)) for k in "abcd"}
    got = got.select("stream_id", "step", "z_c", "z_d", *[v.alias(f"q_{k}") for k, v in pools.items()])
    tail = F.array(
        S.norm(F.col("q_a")),
        S.norm(F.transform("q_b", lambda x: x - 1)),
        S.mean_of(F.col("z_c")),
        S.mean_of(F.transform("z_d", lambda x: F.abs(x))),
    )
    return got.select("stream_id", "step", F.concat("q_a", "q_b", "q_c", "q_d", tail).alias("signature"))


def behaviour_signature(batched: DataFrame) -> DataFrame:
    """Mean, population deviation, entropy and share of confident scores per batch."""
    p = F.col("p")
    return batched.groupBy("stream_id", "step").agg(
        F.avg(p).alias("mean_p"), F.stddev_pop(p).alias("std_p"),
        F.avg(S.behaviour_entropy(p)).alias("mean_entropy"),
        F.avg((S.confidence(p) > 0.7).cast("double")).alias("confident_share"))

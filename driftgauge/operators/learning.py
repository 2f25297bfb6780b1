"""What can be learned from logged decisions: bandit statistics, calibration, residual corrections, models."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftgauge.functions import scalar as S
from driftgauge.operators.labels import delay_weight, pending_summary, with_reveal_step
from driftgauge.operators.ordered import bounded_windows, clamped_scan, ordered_fold
from driftgauge.session import settled

CONTEXT = 9
DOUBLE = T.DoubleType()


# ---- linear bandit ---------------------------------------------------------------------------

def bandit_context() -> Column:
    """Nine numbers that describe a batch to the bandit."""
    return F.array(
        F.lit(1.0), F.col("feature_score"), F.col("output_score"), F.col("collapse_risk"),
        F.col("mean_p") - F.col("ref_mean_p"), F.col("ref_mean_conf") - F.col("mean_conf"),
        F.least(F.col("capital"), F.lit(25.0)) / 25.0, F.col("alert").cast("double"), F.col("risk_alert").cast("double"))


def bandit_statistics(rows: DataFrame, keys: Sequence[str], context: str = "x", reward: str = "reward",
                      width: int = CONTEXT, ridge: float = 1.0) -> DataFrame:
    """Matrix and vector of each action: ridge identity plus the sums of outer products and of rewards.

    Sums do not depend on order, so this is one partial aggregation; rows are not multiplied.
    """
    x = [F.col(context)[i] for i in range(width)]
    upper = {(i, j): F.sum(x[i] * x[j]).alias(f"_a{i}_{j}") for i in range(width) for j in range(i, width)}
    got = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), *upper.values(), *[F.sum(F.col(reward) * x[i]).alias(f"_b{i}") for i in range(width)])
    cell = lambda i, j: F.col(f"_a{min(i, j)}_{max(i, j)}") + (ridge if i == j else 0.0)
    matrix = F.array(*[cell(i, j) for i in range(width) for j in range(width)])
    vector = F.array(*[F.col(f"_b{i}") for i in range(width)])
    return got.select(*keys, "n", matrix.alias("matrix"), vector.alias("vector"))


def bandit_solutions(statistics: DataFrame, keys: Sequence[str], width: int = CONTEXT) -> DataFrame:
    """Inverse matrix and weights of each action: one small solve per row."""
    def solve(batches):
        for pdf in batches:
            inv = [np.linalg.inv(np.asarray(m).reshape(width, width)) for m in pdf["matrix"]]
            theta = [i @ np.asarray(v) for i, v in zip(inv, pdf["vector"])]
            yield pdf[list(keys)].assign(inverse=[i.ravel() for i in inv], theta=theta)

    schema = T.StructType([statistics.schema[k] for k in keys] + [
        T.StructField("inverse", T.ArrayType(DOUBLE)), T.StructField("theta", T.ArrayType(DOUBLE))])
    return statistics.mapInPandas(solve, schema)


def bandit_choice(rows: DataFrame, solutions: DataFrame, actions: Sequence[str], on: Sequence[str] = ("stream_id",),
                  alpha: float = 0.75, width: int = CONTEXT) -> DataFrame:
    """Action with the highest upper confidence bound, after the guards; ties go to the earlier action.

    `rows` has `x`, capital, score, collapse_risk, mean_conf and risk_alert. Actions never seen count as the ridge prior.
    """
    packed = solutions.groupBy(*on).agg(F.map_from_entries(F.collect_list(F.struct(
        "action", F.struct("inverse", "theta")))).alias("_s"))
    j = rows.join(packed, list(on), "left")
    prior = F.sqrt(S.dot(F.col("x"), F.col("x")))
    scores = []
    for k, a in enumerate(actions):
        sol = F.col("_s")[a]
        row = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: S.dot(
            F.slice(sol["inverse"], i * width + 1, width), F.col("x")))
        known = S.dot(sol["theta"], F.col("x")) + alpha * F.sqrt(S.dot(F.col("x"), row))
        value = F.coalesce(known, alpha * prior)
        usable = (F.col("mean_conf") >= 0.74) if a == "adapt" else F.lit(True)
        scores.append(F.when(usable, F.struct(value.alias("s"), F.lit(-k).alias("k"), F.lit(a).alias("a"))))
    best = F.array_max(F.array_compact(F.array(*scores)))
    choice = (F.when((F.col("capital") >= 30) | (F.col("collapse_risk") >= 0.72), "reset")
              .when((F.col("score") < 0.90) & ~F.col("risk_alert"), "none").otherwise(best["a"]))
    return j.withColumn("choice", choice).withColumn("bound", best["s"]).drop("_s")


# ---- calibration -----------------------------------------------------------------------------

def calibration_path(batches: DataFrame, momentum: float = 0.25, low: float = 0.65, high: float = 1.35,
                     bias_momentum: float = 0.35, bias_limit: float = 1.25, rows: int | None = None) -> DataFrame:
    """Temperature and bias after each batch; `recalibrate` and `shift_labels` say which of them move."""
    def block(state, pdf):
        t, b = state
        out = np.empty((len(pdf), 2))
        for i, r in enumerate(pdf.itertuples(index=False)):
            if r.recalibrate:
                goal = min(max(1 - 1.4 * (r.ref_mean_conf - r.mean_conf), low), high)
                t = min(max((1 - momentum) * t + momentum * goal, low), high)
            if r.shift_labels:
                s, g = (min(max(v, 1e-4), 1 - 1e-4) for v in (r.ref_mean_p, r.mean_p))
                goal = math.log(g / (1 - g)) - math.log(s / (1 - s))
                b = (1 - bias_momentum) * b + bias_momentum * min(max(goal, -bias_limit), bias_limit)
            out[i] = t, b
        return np.array([t, b]), pd.DataFrame(out, columns=["temperature", "bias"])

    need = batches.select("stream_id", "step", "mean_conf", "ref_mean_conf", "mean_p", "ref_mean_p", "recalibrate", "shift_labels")
    fields = [T.StructField("temperature", DOUBLE), T.StructField("bias", DOUBLE)]
    return ordered_fold(need, ["stream_id"], "step", [1.0, 0.0], block, fields)


def running_statistics(batches: DataFrame, width: int, passes: int = 1, rows: int | None = None) -> DataFrame:
    """Running feature means and deviations, moved by the batches marked `refresh`, and the correction strength."""
    m = min(0.85, 0.20 + 0.10 * max(1, passes))

    def block(state, pdf):
        s, seen, mean, std = state[0], state[1], state[2:2 + width].copy(), state[2 + width:].copy()
        out = []
        for r in pdf.itertuples(index=False):
            if not seen:
                mean, std = np.asarray(r.ref_mean, dtype=float), np.maximum(np.sqrt(np.asarray(r.ref_var, dtype=float)), 1e-3)
                seen = 1.0
            if r.refresh:
                now = np.maximum(np.sqrt(np.asarray(r.f_var, dtype=float)), 1e-3)
                mean = (1 - m) * mean + m * np.asarray(r.f_mean, dtype=float)
                std = np.maximum((1 - m) * std + m * now, 1e-3)
                s = min(0.85, s + 0.18 * max(1, passes))
            out.append((list(mean), list(std), s))
        return np.concatenate([[s, seen], mean, std]), pd.DataFrame(out, columns=["run_mean", "run_std", "strength"])

    need = batches.select("stream_id", "step", "f_mean", "f_var", "ref_mean", "ref_var", "refresh")
    fields = [T.StructField("run_mean", T.ArrayType(DOUBLE)), T.StructField("run_std", T.ArrayType(DOUBLE)),
              T.StructField("strength", DOUBLE)]
    return ordered_fold(need, ["stream_id"], "step", [0.0] * (2 + 2 * width), block, fields)


def pseudo_label_step(rows: DataFrame, keys: Sequence[str], x: str, weight: float, bias: float, source_weight: float,
                      source_bias: float, rate: float, least_confidence: float, anchor: float, limit: float) -> DataFrame:
    """One bounded gradient step on confident rows per key; the gradient is one aggregation."""
    sure = S.confidence(F.col("p")) >= least_confidence
    error = F.when(sure, F.col("p") - (F.col("p") >= 0.5).cast("int"))
    g = rows.groupBy(*keys).agg(F.avg(error * F.col(x)).alias("_gw"), F.avg(error).alias("_gb"),
                                F.avg(sure.cast("double")).alias("selected"))

    def moved(value, grad, source):
        new = value - rate * (grad + anchor * (value - source))
        return F.when(F.col("selected") > 0, S.clip(new, source - limit, source + limit)).otherwise(value)

    return g.select(*keys, "selected", moved(weight, F.col("_gw"), source_weight).alias("weight"),
                    moved(bias, F.col("_gb"), source_bias).alias("bias"))


# ---- residual corrections --------------------------------------------------------------------
EXPERTS = ("recurring", "transition", "high_risk")


def expert_gates(known: Column, recurrence: Column, similarity: Column, novelty: Column, reward: Column, shift_delta: Column,
                 capital_ema: Column, reliability_ema: Column, stale: Column) -> Column:
    """Gates of the recurring, transition and high-risk expert, with and without a known regime."""
    zero, one = F.lit(0.0), F.lit(1.0)
    move = F.least(F.abs(shift_delta), one)
    doubt = F.greatest(zero, 1 - reliability_ema)
    with_regime = F.array(
        S.clip(0.60 * recurrence + 0.25 * similarity + 0.15 * F.greatest(zero, reward - 0.5), 0, 1),
        S.clip(0.50 * novelty + 0.30 * move + 0.20 * F.greatest(zero, 1 - similarity), 0, 1),
        S.clip(0.45 * capital_ema + 0.30 * doubt + 0.15 * stale + 0.10 * novelty, 0, 1))
    without = F.array(zero, S.clip(0.75 * move, 0, 1), S.clip(0.55 * capital_ema + 0.45 * doubt, 0, 1))
    return F.when(known, with_regime).otherwise(without)


def rank_gradient(rows: DataFrame, keys: Sequence[str], vector: str, width: int, positive_weight: Column) -> DataFrame:
    """Weighted residual gradient of each batch: the row part of the learning, as one aggregation."""
    w = F.when(F.col("y") >= 0.5, positive_weight).otherwise(1.0)
    r = w * (F.col("y") - S.clip(F.col("p"), 1e-5, 1 - 1e-5))
    aggs = [F.avg(F.col(vector)[i] * r).alias(f"_g{i}") for i in range(width)]
    got = rows.groupBy(*keys).agg(*aggs, F.avg(r).alias("rank_bias_gradient"))
    return got.select(*keys, F.array(*[f"_g{i}" for i in range(width)]).alias("rank_gradient"), "rank_bias_gradient")


def reveal_inputs(batches: DataFrame, delay: int, jitter: int, decay: float = 0.82, rows: int | None = None) -> DataFrame:
    """What the learner knows when the labels of each step come out, per stream and step.

    `batches` has n_steps, score, capital, reliability and ref_mean_conf. Shift delta, running capital, queue and its stale share are those of the step of the
    reveal; the running reliability starts at the reference's confidence and includes the step itself, as reveals keep the order of steps.
    """
    moved = bounded_windows(batches, ["stream_id"], "step", 1, lambda w: {"shift_delta": F.col("score") - F.coalesce(F.lag("score").over(w), F.lit(0.0))}, rows)
    new = lambda c: (1 - decay) * c
    state = clamped_scan(moved, ["stream_id"], "step", {
        "capital_ema": (F.lit(decay), new(F.least("capital", F.lit(25.0)) / 25.0), 0.0, 1.0, 1 / 25),
        "_reliability": (F.lit(decay), new(F.col("reliability")), 0.0, 1.0, 0.0)}, ["shift_delta", "ref_mean_conf"])
    # The part of the start that is left; a scan starts every key alike.
    state = settled(state.withColumn("reliability_ema", F.col("_reliability") + F.col("ref_mean_conf") * F.pow(F.lit(decay), F.col("step") + 1)))
    own = with_reveal_step(batches.select("stream_id", "step", "n_steps"), delay, jitter).join(state.select("stream_id", "step", "reliability_ema"), ["stream_id", "step"])
    then = state.select("stream_id", "step", "shift_delta", "capital_ema").join(pending_summary(batches, delay, jitter), ["stream_id", "step"]) \
        .withColumnRenamed("step", "reveal_step")
    return own.join(then, ["stream_id", "reveal_step"]).select(
        "stream_id", "step", "shift_delta", "capital_ema", "reliability_ema", "stale_share",
        delay_weight(F.col("reveal_step") - F.col("step"), F.col("pending"), F.col("stale_share")).alias("delay_weight"))


def residual_terms(reveals: DataFrame, threshold_rate: float = 0.04) -> DataFrame:
    """What each reveal moves the parameters by, as far as no earlier reveal matters: rates, residual mixes, and the pull of the regime."""
    c, one, zero = F.col, F.lit(1.0), F.lit(0.0)
    weight = S.clip(c("delay_weight"), 0.35, 1)
    gap = S.clip(c("label_rate") - c("mean_p"), -1, 1)
    return reveals.withColumns({
        "rate": 0.12 * weight, "threshold_rate": threshold_rate * weight,
        "rank_rate": F.when(c("learn_ranks"), 0.035 * weight * S.clip(one - 0.25 * c("stale_share"), 0.6, 1)).otherwise(zero),
        "rate_gap": gap, "short": S.clip(0.65 * c("mean_residual") + 0.35 * gap, -1, 1), "push": S.clip(-gap, -0.5, 0.5),
        "local_rate": 0.12 * weight * S.clip(0.50 + 0.35 * c("recurrence") + 0.15 * c("similarity"), 0.40, 1.15),
        "trust": S.clip(0.55 * c("recurrence") + 0.30 * c("similarity") + 0.15 * F.greatest(zero, c("reward") - 0.5), 0, 1),
        # Experts with a gate of 0.05 or less do not learn.
        "learning": F.transform("gates", lambda g: F.when(g > 0.05, g).otherwise(zero))})


def residual_path(reveals: DataFrame, context: int, rank: int, prototypes: int = 12, threshold_rate: float = 0.04,
                  rows: int | None = None) -> DataFrame:
    """Correction parameters after each reveal: delta, decision threshold and rank weights.

    `reveals` has, per stream and step in reveal order: x, mean_residual, label_rate, mean_p, delay_weight, stale_share, prototype (-1 for none),
    recurrence, similarity, reward, gates, rank_gradient, rank_bias_gradient and learn_ranks. `residual_terms` are columns; here they only add up.
    """
    # One row of weights, bias, recent bias and threshold for all batches, each expert and each prototype.
    owners, lines = 1 + len(EXPERTS) + prototypes, context + 3
    bias, recent, threshold = context, context + 1, context + 2
    bounds = np.full((owners, lines), 0.75)
    bounds[0, :context], bounds[1:4, :context], bounds[4:, :context] = np.inf, 0.60, 0.50
    bounds[:, threshold] = 0.15
    rank_bound = np.append(np.full(rank, 0.45), 0.35)

    def block(state, pdf):
        table, ranks = state[:owners * lines].reshape(owners, lines).copy(), state[owners * lines:].copy()
        out = []
        for r in pdf.itertuples(index=False):
            x, gates, learning = (np.asarray(v, dtype=float) for v in (r.x, r.gates, r.learning))
            ranks = np.clip(ranks + r.rank_rate * np.append(r.rank_gradient, r.rank_bias_gradient), -rank_bound, rank_bound)
            move = np.zeros((owners, lines))
            move[0] = [*(r.rate * r.mean_residual * x), r.rate * r.mean_residual, 0.0, r.threshold_rate * r.push]
            for e, g in enumerate(learning, 1):
                move[e] = [*(r.rate * g * r.short * x), r.rate * g * r.short, 0.0, r.threshold_rate * g * r.push]
            at = 4 + int(r.prototype) if r.prototype >= 0 else None
            if at is not None:
                move[at] = [*(r.local_rate * r.short * x), r.rate * r.rate_gap, 0.0, 1.15 * r.threshold_rate * r.push]
                table[at, recent] = 0.78 * table[at, recent] + 0.22 * r.short
            table[0, recent] = 0.82 * table[0, recent] + 0.18 * r.short
            table = np.clip(table + move, -bounds, bounds)
            own = table[:, :context] @ x + table[:, bias]
            delta = own[0] + table[0, recent] + gates @ own[1:4]
            shift = table[0, threshold] + gates @ table[1:4, threshold]
            if at is not None:
                delta += r.trust * own[at] + table[at, recent]
                shift += table[at, threshold]
            out.append((float(np.clip(delta, -0.95, 0.95)), float(np.clip(0.5 + np.clip(shift, -0.20, 0.20), 0.05, 0.95)), ranks[:-1].tolist(), float(ranks[-1])))
        return np.concatenate([table.ravel(), ranks]), pd.DataFrame(out, columns=["delta", "threshold", "rank_weights", "rank_bias"])

    fields = [T.StructField("delta", DOUBLE), T.StructField("threshold", DOUBLE),
              T.StructField("rank_weights", T.ArrayType(DOUBLE)), T.StructField("rank_bias", DOUBLE)]
    names = ["x", "mean_residual", "prototype", "gates", "learning", "rank_gradient", "rank_bias_gradient", "rate", "threshold_rate", "rank_rate", "rate_gap", "short",
             "push", "local_rate", "trust"]
    terms = residual_terms(reveals, threshold_rate).select("stream_id", "step", *names)
    return ordered_fold(terms, ["stream_id"], "step", [0.0] * (owners * lines + rank + 1), block, fields)


# ---- models ----------------------------------------------------------------------------------

def logistic_baseline(rows: DataFrame, features: Sequence[str], label: str = "y", reg: float = 0.01):
    """Logistic regression with balanced class weights, fitted by the ML library."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    n = {r[label]: r["count"] for r in rows.groupBy(label).count().collect()}
    total = sum(n.values())
    weight = F.coalesce(*[F.when(F.col(label) == k, F.lit(total / (len(n) * c))) for k, c in n.items()])
    stages = [VectorAssembler(inputCols=list(features), outputCol="_x"),
              LogisticRegression(featuresCol="_x", labelCol=label, weightCol="_w", regParam=reg, maxIter=50)]
    return Pipeline(stages=stages).fit(rows.withColumn("_w", weight))


def score_with_model(rows: DataFrame, model, name: str = "p") -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    out = model.transform(rows.withColumn("_w", F.lit(1.0)))
    return out.withColumn(name, vector_to_array("probability")[1]).drop(
        "_x", "_w", "rawPrediction", "probability", "prediction")


def score_with_function(rows: DataFrame, features: Sequence[str], predict: Callable[[np.ndarray], np.ndarray],
                        name: str = "p") -> DataFrame:
    """Scores by any function of a feature matrix, one Arrow batch at a time."""
    @F.pandas_udf("double")
    def scored(*cols: pd.Series) -> pd.Series:
        return pd.Series(np.asarray(predict(np.column_stack([c.to_numpy(float) for c in cols])), dtype=float))

    return rows.withColumn(name, scored(*[F.col(f) for f in features]))


def register_scorer(spark, name: str, predict: Callable[[np.ndarray], np.ndarray]) -> None:
    """Make a scoring function of a feature array callable from SQL."""
    @F.pandas_udf("double")
    def scored(x: pd.Series) -> pd.Series:
        return pd.Series(np.asarray(predict(np.vstack(x.to_numpy())), dtype=float))

    spark.udf.register(name, scored)

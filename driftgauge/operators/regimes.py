"""Recurring regimes: nearest and evolving prototypes, shared registry, support rows, specialist routing."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftgauge.functions import scalar as S
from driftgauge.operators.evidence import top_k
from driftgauge.operators.ordered import ordered_fold, row_index
from driftgauge.session import stored

# Fixed values of the prototype encoder.
MAX_PROTOTYPES, UPDATE_RATE, EMA, HORIZON = 12, 0.18, 0.84, 16
SIMILAR, FAMILIAR, REUSE, NOVEL, CREATE = 0.93, 0.58, 0.64, 0.28, 0.88
CLUSTERS, CLUSTER_DISTANCE = 6, 0.55


def nearest(rows: DataFrame, prototypes: DataFrame, on: str, vector: str, centroid: str, name: str) -> DataFrame:
    """Nearest fixed prototype of each row by Euclidean distance.

    A key has a bounded number of prototypes, which travel as one array, so rows join once and no
    row meets another row.
    """
    packed = prototypes.groupBy(on).agg(F.collect_list(F.struct(F.col(name).alias("n"), F.col(centroid).alias("c"))).alias("_p"))
    best = F.array_min(F.transform("_p", lambda p: F.struct(
        S.euclidean(F.col(vector), p["c"]).alias("d"), p["n"].alias("n"))))
    return rows.join(packed, on).withColumn("_b", best).withColumn("distance", F.col("_b.d")).withColumn(
        "nearest", F.col("_b.n")).drop("_p", "_b")


_REGIME_FIELDS = [T.StructField("prototype", T.IntegerType()), T.StructField("similarity", T.DoubleType()),
                  T.StructField("confidence", T.DoubleType()), T.StructField("novelty", T.DoubleType()),
                  T.StructField("familiar", T.BooleanType()), T.StructField("reuse_ready", T.BooleanType()),
                  T.StructField("prototype_reward", T.DoubleType()), T.StructField("prototype_count", T.IntegerType()),
                  T.StructField("prototypes", T.IntegerType()), T.StructField("successful", T.BooleanType())]
#: Decay of the running accuracy that a reveal is compared with, and its start.
ACCURACY_DECAY, ACCURACY_START = 0.82, 0.5


class _Prototypes:
    """The prototypes of one stream as columns, the decisions that wait for their labels, and the running accuracy."""

    def __init__(self, width: int, limit: int):
        self.limit = limit
        self.centres = np.zeros((0, width))
        # Columns of facts: count, reward, confidence, novelty, last step, label rate.
        self.facts = np.zeros((0, 6))
        self.waiting: dict[int, tuple[int, float, float]] = {}
        self.now, self.accuracy = 0, ACCURACY_START

    def match(self, e: np.ndarray) -> tuple[int, float, float, float]:
        """The most similar prototype, its similarity, the confidence that it came back, and the novelty; -1 if there is none."""
        if not len(self.facts):
            return -1, 0.0, 0.0, 1.0
        similar = self.centres @ e
        i = int(similar.argmax())
        count, reward, trust, novel, seen, _ = self.facts[i]
        terms = (0.60 * similar[i], 0.14 * min(1.0, count / 4), 0.10 * min(1.0, max(0.0, reward - 0.45) / 0.20),
                 0.10 * max(0.0, 1 - (self.now - seen) / HORIZON), 0.06 * trust)
        confidence = float(np.clip(sum(terms), 0, 1))
        novelty = max(0.0, 1 - similar[i]) + 0.18 * max(0.0, 0.60 - confidence) + 0.12 * novel
        return i, float(similar[i]), confidence, float(np.clip(novelty, 0, 1))

    def decided(self, step: int, e: np.ndarray) -> tuple:
        self.now = step
        e = e / n if (n := np.linalg.norm(e)) > 1e-8 else e
        i, similar, confidence, novelty = self.match(e)
        if i < 0 or similar < CREATE:
            fact = [1, max(0.45, self.facts[i, 1] if i >= 0 else 0.5), max(0.30, confidence), novelty, step, 0.5]
            if len(self.facts) < self.limit:
                self.centres, self.facts = np.vstack([self.centres, e]), np.vstack([self.facts, fact])
            else:
                count, reward, trust, novel, seen, _ = self.facts.T
                worth = (reward + 0.18 * trust + 0.10 * np.minimum(1, count / 4) + 0.06 * np.maximum(0, 1 - (step - seen) / HORIZON) - 0.10 * novel)
                weakest = int(worth.argmin())
                self.centres[weakest], self.facts[weakest] = e, fact
        else:
            centre = (1 - UPDATE_RATE) * self.centres[i] + UPDATE_RATE * e
            self.centres[i] = centre / np.linalg.norm(centre)
            f = self.facts[i]
            f[0], f[4] = f[0] + 1, step
            f[[2, 3]] = EMA * f[[2, 3]] + (1 - EMA) * np.array([confidence, novelty])
        i, similar, confidence, novelty = self.match(e)
        self.waiting[step] = i, confidence, novelty
        known = similar >= SIMILAR or confidence >= FAMILIAR
        return (i, similar, confidence, novelty, known, known and confidence >= REUSE and novelty <= NOVEL, float(self.facts[i, 1]), int(self.facts[i, 0]),
                len(self.facts), None)

    def revealed(self, step: int, reward: float, accuracy: float, label_rate: float) -> tuple:
        """The labels of a step reach the prototype that its decision named, with what was known then."""
        i, confidence, novelty = self.waiting.pop(step)
        self.accuracy = ACCURACY_DECAY * self.accuracy + (1 - ACCURACY_DECAY) * accuracy
        good = accuracy >= self.accuracy
        f = self.facts[i]
        goal = np.array([reward, min(max(confidence + (0.10 if good else -0.04), 0), 1), min(max(novelty * (0.65 if good else 1.10), 0), 1)])
        f[1:4] = EMA * f[1:4] + (1 - EMA) * goal
        f[4] = self.now
        f[5] = EMA * f[5] + (1 - EMA) * min(max(label_rate, 0), 1)
        return (i, None, float(f[2]), float(f[3]), None, None, float(f[1]), int(f[0]), len(self.facts), bool(good))


def feedback_events(batches: DataFrame, reveals: DataFrame, vector: str) -> DataFrame:
    """Decisions and reveals of each stream as one ordered stream: by time, a step's decision before the reveals of that time, these by step.

    reveals: stream_id, step, reveal_step, reward, batch_accuracy, label_rate. Steps without a reveal never come back.
    """
    none = F.lit(None).cast("double")
    d = batches.select("stream_id", F.col("step").alias("time"), F.lit(0).alias("kind"), "step", F.col(vector).alias("vector"), none.alias("reward"),
                       none.alias("accuracy"), none.alias("label_rate"))
    r = reveals.select("stream_id", F.col("reveal_step").alias("time"), F.lit(1).alias("kind"), "step", F.lit(None).cast(batches.schema[vector].dataType).alias("vector"),
                       "reward", F.col("batch_accuracy").alias("accuracy"), "label_rate")
    # Steps are below 2^30, so one number holds the order.
    return d.unionByName(r).withColumn("at", (2 * F.col("time") + F.col("kind")) * (1 << 30) + F.col("step"))


def assign_regimes(events: DataFrame, width: int, limit: int = MAX_PROTOTYPES) -> DataFrame:
    """One row per event of `feedback_events`: the prototype of each decision, and what each reveal made of it.

    A batch that is unlike all prototypes founds one; the weakest gives way when all are taken. A reveal is a success if its
    accuracy is at least the running accuracy, itself included.
    """
    def block(state, pdf):
        rows = [state.decided(int(r.step), np.array(r.vector, dtype=float)) if r.kind == 0 else
                state.revealed(int(r.step), r.reward, r.accuracy, r.label_rate) for r in pdf.itertuples(index=False)]
        return state, pd.DataFrame(rows, columns=[f.name for f in _REGIME_FIELDS]).astype({"familiar": "boolean", "reuse_ready": "boolean", "successful": "boolean"})

    need = events.select("stream_id", "at", "kind", "step", "vector", "reward", "accuracy", "label_rate")
    return ordered_fold(need, ["stream_id"], "at", lambda: _Prototypes(width, limit), block, _REGIME_FIELDS, ["kind", "step"]).drop("at")


def last_prototypes(events: DataFrame, width: int, limit: int = MAX_PROTOTYPES) -> DataFrame:
    """The prototypes of every stream after its last event: one row each with centroid, count, reward, confidence, novelty and last step."""
    schema = "stream_id string, prototype int, centroid array<double>, count int, reward double, confidence double, novelty double, last_seen_step long, label_rate double"
    fields = [T.StructField("rows", T.ArrayType(T.StructType([T.StructField("centroid", T.ArrayType(T.DoubleType())), *(T.StructField(n, T.DoubleType()) for n in (
        "count", "reward", "confidence", "novelty", "last_seen_step", "label_rate"))])))]

    def block(state, pdf):
        for r in pdf.itertuples(index=False):
            if r.kind == 0:
                state.decided(int(r.step), np.array(r.vector, dtype=float))
            else:
                state.revealed(int(r.step), r.reward, r.accuracy, r.label_rate)
        # Only the last row of a stream carries the table.
        table = [None] * len(pdf)
        if pdf["last"].iloc[-1]:
            table[-1] = [{"centroid": c.tolist(), **dict(zip(("count", "reward", "confidence", "novelty", "last_seen_step", "label_rate"), map(float, f)))}
                         for c, f in zip(state.centres, state.facts)]
        return state, pd.DataFrame({"rows": table})

    top = events.groupBy("stream_id").agg(F.max("at").alias("_top"))
    need = events.join(top, "stream_id").select("stream_id", "at", "kind", "step", "vector", "reward", "accuracy", "label_rate", (F.col("at") == F.col("_top")).alias("last"))
    out = ordered_fold(need, ["stream_id"], "at", lambda: _Prototypes(width, limit), block, fields).where("rows IS NOT NULL")
    each = out.select("stream_id", F.posexplode("rows").alias("prototype", "r")).select("stream_id", "prototype", "r.*")
    return each.select(*[F.col(f.split()[0]).cast(f.split()[1]) for f in schema.split(", ")])


def route_clusters(batches: DataFrame, vector: str, width: int, limit: int = CLUSTERS,
                   distance: float = CLUSTER_DISTANCE, rows: int | None = None) -> DataFrame:
    """Online clusters: a far batch founds a new one while there is room, others move their centroid's mean."""
    def block(state, pdf):
        n, counts = int(state[0]), state[1:1 + limit].copy()
        cents = state[1 + limit:].reshape(limit, width).copy()
        out = []
        for v in pdf[vector]:
            v = np.asarray(v, dtype=float)
            d = np.linalg.norm(cents[:n] - v, axis=1) if n else np.array([])
            i = int(np.argmin(d)) if n else 0
            if n == 0 or (d[i] > distance and n < limit):
                i, n = n, n + 1
                cents[i], counts[i] = v, 1
            else:
                cents[i] = (counts[i] * cents[i] + v) / (counts[i] + 1)
                counts[i] += 1
            out.append((i, n))
        return np.concatenate([[n], counts, cents.ravel()]), pd.DataFrame(out, columns=["cluster", "clusters"])

    fields = [T.StructField("cluster", T.IntegerType()), T.StructField("clusters", T.IntegerType())]
    start = [0.0] * (1 + limit + limit * width)
    return ordered_fold(batches.select("stream_id", "step", vector), ["stream_id"], "step", start, block, fields)


def regime_diagnostics(prototypes: DataFrame) -> DataFrame:
    return prototypes.groupBy("stream_id").agg(
        F.count(F.lit(1)).alias("prototype_count"), F.avg("reward").alias("mean_reward"),
        F.avg("confidence").alias("mean_confidence"), F.avg("novelty").alias("mean_novelty"))


def staleness(step: Column, last_seen: Column, horizon: int = HORIZON) -> Column:
    return F.greatest(F.lit(0.0), 1 - F.greatest(F.lit(0), step - last_seen) / horizon)


def retired(specialists: DataFrame, step: Column, after: int = 24, least_reward: float = 0.48,
            least_reuse: float = 0.02, reference_accuracy: float = 0.9) -> DataFrame:
    """Whether each specialist would be retired: stale, without future value, or worn out."""
    c = F.col
    unproven = (c("successful_reuses") == 0) & (c("shadow_wins") == 0)
    stale = ((step - c("last_used_step") >= after) & (c("reveal_count") >= 2) & (c("reward_ema") < least_reward)
             & (c("recurrence_reward_ema") < 0.08) & unproven)
    idle = ((c("probation_remaining") == 0) & (c("reveal_count") >= 1) & (c("future_reuse_ema") < least_reuse)
            & (c("support_quality_ema") < 0.05) & unproven)
    worn = ((c("successful_reuses") >= 3) & (c("reveal_count") >= 8) & (c("quality_ema") < 0.75)
            & (c("quality_ema") < reference_accuracy - 0.08))
    return specialists.withColumn("retired", stale | idle | worn)


# ---- registry --------------------------------------------------------------------------------

def registry_key(family: Column, width: Column) -> Column:
    return F.concat_ws(":", family, S.schema_fingerprint(width))


def pushed(prototypes: DataFrame, family: Column, vector: str, last: int = 20) -> DataFrame:
    """The best prototypes of each family and width, as the shared registry keeps them."""
    keyed = prototypes.withColumn("registry_key", registry_key(family, F.size(vector)))
    return top_k(keyed, ["registry_key"], [F.desc("reward"), F.col("stream_id"), F.col("prototype")], last)


def pulled(own: DataFrame, registry: DataFrame, family: Column, vector: str) -> DataFrame:
    """A stream's own prototypes and the registry's for its family and width; nothing is dropped."""
    wanted = own.select("stream_id", registry_key(family, F.size(vector)).alias("registry_key")).distinct()
    shared = registry.drop("stream_id").join(wanted, "registry_key").drop("registry_key").withColumn("shared", F.lit(True))
    return own.withColumn("shared", F.lit(False)).unionByName(shared)


# ---- support rows ----------------------------------------------------------------------------

def support_scores(rows_df: DataFrame, key: str, features: Sequence[str], worth: Column) -> DataFrame:
    """Score of each row: its worth plus 0.15 of its distance from the mean of its regime."""
    mean = stored(rows_df.groupBy(key).agg(*[F.avg(f).alias(f"_m_{f}") for f in features]))
    d = sum(((F.col(f) - F.col(f"_m_{f}")) * (F.col(f) - F.col(f"_m_{f}")) for f in features), F.lit(0.0))
    return rows_df.join(mean, key).withColumn("support_score", worth + 0.15 * F.sqrt(d)).drop(
        *[f"_m_{f}" for f in features])


def diverse_support(rows_df: DataFrame, key: str, features: Sequence[str], label: str, worth: Column, order: str,
                    size: int = 24, near: float = 1e-3, rows: int | None = None) -> DataFrame:
    """Up to `size` rows per regime by score, leaving out near copies with the first row's label.

    All rows are ranked and walked in order with the chosen ones as state, so any number of copies at
    the top is passed over exactly. Regimes that stay short are filled with their next rows.
    """
    k = len(features)
    scored = support_scores(rows_df, key, features, worth)
    ranked = row_index(scored, [key], [F.round("support_score", 9).desc(), F.col(order)], rows, index="rank")

    def block(state, pdf):
        n, first = int(state[0]), state[1]
        kept = state[2:].reshape(size, k).copy()
        x, y = pdf[list(features)].to_numpy(float), pdf[label].to_numpy(float)
        picked = np.zeros(len(pdf), dtype=bool)
        for i in range(len(pdf)):
            if n >= size:
                break
            far = n == 0 or np.linalg.norm(kept[:n] - x[i], axis=1).min() > near
            if far or y[i] != first:
                first = y[i] if n == 0 else first
                kept[n], picked[i], n = x[i], True, n + 1
        return np.concatenate([[n, first], kept.ravel()]), pd.DataFrame({"picked": picked})

    flags = ordered_fold(ranked.select(key, "rank", label, *features), [key], "rank", [0.0] * (2 + size * k), block,
                         [T.StructField("picked", T.BooleanType())])
    # Those picked and the first `size` hold every row that may be returned.
    out = ranked.join(stored(flags.where(F.col("picked") | (F.col("rank") < size))), [key, "rank"])
    return top_k(out, [key], [F.desc("picked"), F.col("rank")], size)


# ---- specialist routing ----------------------------------------------------------------------

def exchangeability(mean_gap: Column, var_gap: Column, rate_gap: Column) -> Column:
    """How well a batch fits a specialist's support rows; the label part is 0.5 without labels."""
    gap = mean_gap + 0.5 * var_gap
    feature = F.exp(-0.65 * F.least(gap, F.lit(6.0)))
    label = F.coalesce(F.exp(-4.0 * rate_gap), F.lit(0.5))
    return S.clip(0.70 * feature + 0.30 * label, 0, 1)


# Weight and floor of each bonus in the routing score.
ROUTE_BONUSES = {"reward_ema": (0.16, 0.45), "similarity_ema": (0.10, 0.75), "lift_ema": (0.12, 0.0),
                 "recurrence_reward_ema": (0.20, 0.0), "route_advantage_ema": (0.18, 0.0),
                 "future_reuse_ema": (0.16, 0.0), "support_quality_ema": (0.08, 0.0),
                 "regime_confidence_ema": (0.10, 0.55), "exchangeability_ema": (0.08, 0.55),
                 "cluster_quality": (0.14, 0.45), "coreset_quality": (0.10, 0.45)}


def route_score(distance: Column, similarity: Column, regime_similarity: Column, fit: Column, step: Column) -> Column:
    """Lower is better: distance less the bonuses of a specialist's record."""
    zero = F.lit(0.0)
    bonus = sum((w * F.greatest(zero, F.col(c) - floor) for c, (w, floor) in ROUTE_BONUSES.items()), zero)
    bonus = bonus + 0.18 * F.greatest(zero, regime_similarity - 0.80) + 0.18 * F.greatest(zero, fit - 0.65)
    one = F.lit(1.0)
    bonus = (bonus + 0.06 * F.least(one, F.col("usage_count") / 6.0) + 0.05 * F.least(one, F.col("successful_reuses") / 3.0)
             + 0.04 * F.least(one, F.col("shadow_wins") / 3.0)
             + F.when(step - F.col("last_used_step") <= 6, 0.05).otherwise(0.0)
             + F.when(F.col("reveal_count") >= 4, 0.12 * F.greatest(zero, F.col("quality_ema") - 0.65)).otherwise(0.0))
    return distance - 0.12 * similarity - bonus


def stale_rate(current: Column, created: Column, most: float = 0.15) -> Column:
    return F.coalesce(F.abs(current - created) > most, F.lit(False))


def route(batches: DataFrame, specialists: DataFrame, on: str = "stream_id") -> DataFrame:
    """Best specialist of each batch. A stream has few specialists, so each batch meets only those of its stream."""
    j = batches.join(specialists, on)
    at = F.element_at
    width = F.size("f_mean")
    idx = F.sequence(F.lit(1), width)
    mean_gap = S.mean_of(F.transform(idx, lambda i: F.abs(at("f_mean", i) - at("support_mean", i))
                                     / F.sqrt(at("support_var", i) + 1e-6)))
    var_gap = S.mean_of(F.transform(idx, lambda i: F.abs(at("f_var", i) - at("support_var", i))
                                    / (at("support_var", i) + 1e-6)))
    fit = exchangeability(mean_gap, var_gap, F.abs(F.col("label_rate") - F.col("support_rate")))
    j = (j.withColumn("fit", fit).withColumn("distance", S.euclidean(F.col("signature"), F.col("home")))
         .withColumn("similarity", S.cosine(F.col("signature"), F.col("home"))))
    j = j.withColumn("route_score", route_score(F.col("distance"), F.col("similarity"), F.col("similarity"), F.col("fit"),
                                                F.col("step")))
    best = j.groupBy(on, "step").agg(F.min(F.struct(
        "route_score", "specialist", "fit", "distance",
        stale_rate(F.col("label_rate"), F.col("support_rate")).alias("stale"))).alias("_b"))
    return best.select(on, "step", "_b.*")

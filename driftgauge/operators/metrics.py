"""Imbalance-aware quality of scored rows with labels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftgauge.operators.ordered import running_totals
from driftgauge.session import stored


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 when b is not positive."""
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def classification(outcomes: DataFrame, keys: Sequence[str], fp_cost: float = 1.0, fn_cost: float = 20.0) -> DataFrame:
    """Confusion counts per key and what follows from them."""
    y, h = F.col("y"), F.col("yhat")
    got = outcomes.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count_if((y == 1) & (h == 1)).alias("tp"),
        F.count_if((y == 0) & (h == 1)).alias("fp"), F.count_if((y == 1) & (h == 0)).alias("fn"),
        F.count_if((y == 0) & (h == 0)).alias("tn"))
    tp, fp, fn, tn, n = (F.col(c) for c in ("tp", "fp", "fn", "tn", "n"))
    pos, neg = tp + fn, fp + tn
    balanced = (F.when((pos > 0) & (neg > 0), (tp / pos + tn / neg) / 2)
                .when(pos > 0, tp / pos).when(neg > 0, tn / neg).otherwise(0.0))
    precision, recall = ratio(tp, tp + fp), ratio(tp, pos)
    f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)
    return got.select(
        *keys, "n", "tp", "fp", "fn", "tn", (pos / n).alias("positive_rate"), ((tp + tn) / n).alias("accuracy"),
        balanced.alias("balanced_accuracy"), precision.alias("precision"), recall.alias("recall"), f1.alias("f1"),
        ratio(fp, neg).alias("false_positive_rate"), ratio(fn, pos).alias("false_negative_rate"),
        ((fp_cost * fp + fn_cost * fn) / n).alias("cost_weighted_error"))


def score_groups(outcomes: DataFrame, keys: Sequence[str], rows: int | None = None) -> DataFrame:
    """Distinct scores with their label counts and running counts from the highest score down."""
    groups = outcomes.groupBy(*keys, "p").agg(
        F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") == 0).alias("neg"))
    return running_totals(groups, keys, [F.col("p").desc()], {"tp": F.col("pos"), "fp": F.col("neg")}, rows)


def ranking(outcomes: DataFrame, keys: Sequence[str], rows: int | None = None) -> DataFrame:
    """ROC-AUC with half ties and step-wise average precision; null with one class only."""
    g = score_groups(outcomes, keys, rows)
    totals = outcomes.groupBy(*keys).agg(
        F.count_if(F.col("y") == 1).alias("n_pos"), F.count_if(F.col("y") == 0).alias("n_neg"))
    j = g.join(totals, list(keys))
    below = F.col("n_neg") - F.col("fp")
    part = j.groupBy(*keys).agg(
        F.sum(F.col("pos") * (below + F.col("neg") / 2)).alias("_u"),
        F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("_ap"),
        F.first("n_pos").alias("n_pos"), F.first("n_neg").alias("n_neg"))
    both = (F.col("n_pos") > 0) & (F.col("n_neg") > 0)
    return part.select(*keys, "n_pos", "n_neg",
                       F.when(both, F.col("_u") / F.col("n_pos") / F.col("n_neg")).alias("roc_auc"),
                       F.when(both, F.col("_ap") / F.col("n_pos")).alias("pr_auc"))


def recall_at_precision(outcomes: DataFrame, keys: Sequence[str], order: Sequence[str], least: float = 0.80) -> DataFrame:
    """Best recall at a minimum precision, walking down the scores.

    The walk ends, after a first hit, at the first lower score whose row falls under the precision.
    Rows of one score are taken in `order`. Rows are reduced to score groups in one pass: running counts of the groups tell
    the first and the last row of each and bound those between, so only groups that the bounds leave open are walked by row.
    """
    keys, order = list(keys), list(order)
    hit = F.coalesce(F.col("y") == 1, F.lit(False))
    at = F.col(order[0]) if len(order) == 1 else F.struct(*order)
    counts = outcomes.groupBy(*keys, "p").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") == 0).alias("neg"),
        F.min_by(hit.cast("long"), at).alias("lead"))
    # Stored, so that the rows are read once.
    counts = stored(counts)
    groups = running_totals(counts, keys, [F.col("p").desc()], {"rank": F.col("n"), "tp": F.col("pos")})
    above, found = F.col("rank") - F.col("n"), F.col("tp") - F.col("pos")
    # No row of a group is more precise than its last positive would be if the positives came first.
    groups = groups.select(
        *keys, "p", "n", (above + 1).alias("first"), above.alias("above"), found.alias("found"), "tp",
        ((found + F.col("lead")) / (above + 1) >= least).alias("first_good"), (F.col("tp") / F.col("rank") >= least).alias("last_good"),
        F.coalesce(F.col("tp") / F.nullif(above + F.col("pos"), F.lit(0)) >= least, F.lit(False)).alias("may"))
    groups = stored(groups)
    known = groups.groupBy(*keys).agg(F.min(F.when(F.col("first_good") | F.col("last_good"), F.col("first"))).alias("_known"))
    # A group that begins under the precision after a known hit ends the walk, or an earlier one does.
    lower = ~F.col("first_good") & (F.col("first") > F.col("_known"))
    ends = groups.join(known, keys).groupBy(*keys).agg(F.min(F.when(lower, F.col("first"))).alias("_end"))
    unsure = groups.join(ends, keys).where(
        F.col("may") & ~F.col("last_good") & (F.col("_end").isNull() | (F.col("first") < F.col("_end"))))
    walked = _walked(outcomes, unsure, keys, order, least)
    same = [groups[k] == walked[k] for k in keys] + [groups["p"].eqNullSafe(walked["p"])]
    groups = groups.join(walked, same, "left").select(
        *[groups[k] for k in keys], "first", "first_good", F.when(F.col("last_good"), F.col("tp")).otherwise(F.col("_best")).alias("best"))
    start = groups.groupBy(*keys).agg(F.min(F.when(F.col("first_good") | F.col("best").isNotNull(), F.col("first"))).alias("_hit"))
    groups = groups.join(start, keys)
    stop = groups.groupBy(*keys).agg(
        F.min(F.when(~F.col("first_good") & (F.col("first") > F.col("_hit")), F.col("first"))).alias("_stop"))
    kept = groups.join(stop, keys).where(F.col("_stop").isNull() | (F.col("first") < F.col("_stop")))
    best = kept.groupBy(*keys).agg(F.max("best").alias("_tp"))
    totals = counts.groupBy(*keys).agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    value = F.when((F.col("_p") == 0) | (F.col("_n") == 0), F.lit(None)).otherwise(
        F.coalesce(F.col("_tp") / F.col("_p"), F.lit(0.0)))
    return totals.join(best, keys, "left").select(*keys, value.alias("recall_at_precision"))


def _walked(outcomes: DataFrame, groups: DataFrame, keys: list[str], order: list[str], least: float) -> DataFrame:
    """Most positives seen at a row that reaches the precision, in each of the given score groups that has such a row."""
    # Stored, so that few groups are broadcast and the outcomes are not dealt by score.
    few = stored(groups.select(*keys, "p", "above", "found", "n"))
    longest = few.agg(F.max("n").alias("m")).first()["m"]
    if longest is None:
        return few.select(*keys, "p", F.lit(None).cast("long").alias("_best"))
    few = few.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("p").alias("_p"), "above", "found")
    same = [F.col(k) == F.col(f"_k{i}") for i, k in enumerate(keys)] + [F.col("p").eqNullSafe(F.col("_p"))]
    inner = outcomes.select(*dict.fromkeys([*keys, "p", *order, "y"])).join(few, same)
    walk = running_totals(
        inner.select(*dict.fromkeys([*keys, "p", *order, "y", "above", "found"])), [*keys, "p"], [F.col(c) for c in order],
        {"_rank": F.lit(1).cast("long"), "_tp": F.coalesce(F.col("y") == 1, F.lit(False)).cast("long")}, longest)
    tp = F.col("found") + F.col("_tp")
    return stored(walk.where(tp / (F.col("above") + F.col("_rank")) >= least).groupBy(*keys, "p").agg(F.max(tp).alias("_best")))


def with_halves(outcomes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mark each row first or second by the middle step of its key."""
    # Stored, so that the few rows are broadcast and the outcomes are not dealt by key.
    mid = stored(outcomes.groupBy(*keys).agg(F.floor((F.min("step") + F.max("step") + 1) / 2).alias("_mid")))
    out = outcomes.join(mid, list(keys))
    return out.withColumn("half", F.when(F.col("step") < F.col("_mid"), "first").otherwise("second")).drop("_mid")


def half_deltas(outcomes: DataFrame, keys: Sequence[str], rows: int | None = None) -> DataFrame:
    """Second half minus first half for recall, balanced accuracy and average precision."""
    halves = with_halves(outcomes, keys)
    on = [*keys, "half"]
    m = classification(halves, on).join(ranking(halves, on, rows).select(*on, "pr_auc"), on)

    def at(half, c):
        return F.max(F.when(F.col("half") == half, F.col(c)))

    delta = {c: at("second", c) - at("first", c) for c in ("recall", "balanced_accuracy", "pr_auc")}
    return m.groupBy(*keys).agg(
        at("first", "recall").alias("first_recall"), at("second", "recall").alias("second_recall"),
        *[v.alias(f"{k}_delta") for k, v in delta.items()])


def metric_spreads(summary: DataFrame, keys: Sequence[str], metrics: Sequence[str], least: float = 0.005) -> DataFrame:
    """Range of each metric over strategies, and whether it can rank them."""
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics]))
    long = summary.select(*keys, pairs.alias("_m")).select(*keys, "_m.metric", "_m.v")
    got = long.groupBy(*keys, "metric").agg(
        F.when(F.count("v") >= 2, F.max("v") - F.min("v")).alias("spread"))
    return got.withColumn("rankable", F.coalesce(F.col("spread") >= least, F.lit(False)))


def headroom(summary: DataFrame, max_balanced: float = 0.95, min_rate: float = 0.001) -> DataFrame:
    """Whether the frozen model leaves room to improve, with the reasons when it does not."""
    why = F.concat_ws(
        "; ", F.when(F.col("positive_rate") < min_rate, "extreme_imbalance"),
        F.when(F.col("balanced_accuracy") >= max_balanced, "balanced_accuracy_already_high"),
        F.when(F.col("second_recall") >= F.col("first_recall") - 0.01, "no_late_degradation"))
    why = F.when(F.col("n") <= 0, "no_labelled_rows").otherwise(why)
    return summary.withColumn("reasons", why).withColumn("has_headroom", why == "")


def histogram_psi(rows: DataFrame, reference: DataFrame, keys: Sequence[str], value: str = "p", bins: int = 10,
                  floor: float = 1e-4) -> DataFrame:
    """Population stability index of each key's scores against the reference rows of its stream.

    `reference` has the first of the keys. All bins take part, empty ones with the floor share.
    """
    base = list(keys)[:1]
    b = F.least(F.floor(F.col(value) * bins), F.lit(bins - 1)).cast("int")

    def shares(df, by):
        n = df.groupBy(*by).agg(
            F.count(F.lit(1)).alias("_n"), *[F.count_if(b == i).alias(f"_b{i}") for i in range(bins)])
        return n.select(*by, F.array(*[
            F.greatest(F.col(f"_b{i}") / F.greatest(F.col("_n"), F.lit(1)), F.lit(floor)) for i in range(bins)
        ]).alias("_h"))

    j = shares(rows, list(keys)).join(shares(reference, base).withColumnRenamed("_h", "_r"), base)
    psi = F.aggregate(F.zip_with("_h", "_r", lambda c, r: (c - r) * F.log(c / r)), F.lit(0.0), lambda s, x: s + x)
    return j.select(*keys, psi.alias("psi"))


def outcomes_by_strategy(batched: DataFrame, variants: Mapping[str, tuple[Column, float]], keep: Sequence[str]
                         ) -> DataFrame:
    """Rows once per strategy, each with its own score and threshold. A map step, no shuffle."""
    items = [F.struct(F.lit(k).alias("strategy"), p.alias("p"), (p >= t).cast("int").alias("yhat"))
             for k, (p, t) in variants.items()]
    out = batched.select(*keep, "y", F.explode(F.array(*items)).alias("_s"))
    return out.select(*keep, "y", "_s.strategy", "_s.p", "_s.yhat")

"""Evidence that one strategy serves a stream better than another."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftgauge.functions import scalar as S
from driftgauge.operators.decisions import MUTATING, PASSIVE
from driftgauge.operators.labels import utility

KEY = ("stream_id", "strategy")


def steady(mean: Column) -> Column:
    """A mean rounded to 12 decimals, so that equal runs compare equal whatever the summation order."""
    return F.round(mean, 12)


def rate(cond: Column) -> Column:
    return F.avg(cond.cast("double"))


def surfaces(decisions: DataFrame, batched: DataFrame) -> DataFrame:
    """Decisions with the effect of their calibration on the rows and the outcome once labels are known.

    Rows meet the parameters of their batch in one join and leave it as one row per batch and strategy.
    """
    params = decisions.select("stream_id", "strategy", "step", "temperature", "bias")
    q = F.when((F.col("temperature") == 1) & (F.col("bias") == 0), F.col("p")).otherwise(
        S.calibrated(F.col("p"), F.col("temperature"), F.col("bias")))
    rows = batched.select("stream_id", "step", "p", "y").join(params, ["stream_id", "step"]).withColumn("q", q)
    delta = F.abs(F.col("q") - F.col("p"))
    got = rows.groupBy("stream_id", "strategy", "step").agg(
        F.avg(delta).alias("mean_abs_delta"), F.max(delta).alias("max_abs_delta"),
        F.count_if((F.col("q") >= 0.5) != (F.col("p") >= 0.5)).alias("flipped"),
        rate((F.col("q") >= 0.5).cast("int") == F.col("y")).alias("_acc"))
    out = decisions.join(got, ["stream_id", "strategy", "step"])
    out = out.withColumn("correction_applied", F.col("max_abs_delta") > 1e-6).withColumn(
        "accuracy", F.when(F.col("abstained"), 0.0).otherwise(F.col("_acc"))).drop("_acc")
    return out.withColumn("utility", utility(F.col("accuracy"), F.col("risk_alert"), F.col("parameter_drift"),
                                             F.col("abstained"), F.col("action_taken")))


def strategy_summary(s: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """One row per strategy with every replay measure."""
    taken, asked = F.col("action_taken"), F.col("recommended_action")
    acts, asks = ~taken.isin(*PASSIVE), ~asked.isin(*PASSIVE)
    done = asks & (asked == taken)
    return s.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("steps"), steady(F.avg("accuracy")).alias("mean_accuracy"),
        steady(F.avg("utility")).alias("mean_utility"), F.avg("capital").alias("mean_risk_capital"),
        F.avg("shift_score").alias("mean_shift_score"), F.avg("reliability").alias("mean_reliability"),
        F.avg("parameter_drift").alias("mean_parameter_drift"), rate(acts).alias("intervention_rate"),
        F.count_if(taken == "reset").alias("reset_count"), F.count_if("risk_alert").alias("risk_alert_count"),
        F.min(F.when(F.col("shift_score") >= 1.0, F.col("step"))).alias("first_drift_step"),
        rate(asks).alias("recommendation_rate"),
        (F.count_if(done) / F.greatest(F.count_if(asks), F.lit(1))).alias("recommendation_execution_rate"),
        (1000 * rate(taken.isin(*MUTATING))).alias("interventions_per_1000"),
        F.count_if("retrain_recommended").alias("retrain_count"),
        F.min(F.when(F.col("retrain_recommended"), F.col("step"))).alias("first_retrain_step"),
        F.count_if("budget_limited").alias("budget_limited_count"),
        rate(F.col("correction_applied")).alias("correction_applied_rate"),
        rate(F.col("correction_applied") & ~F.col("explicit_action")).alias("correction_only_rate"),
        F.avg("flipped").alias("mean_flipped"),
        (F.count_if(taken.isin(*MUTATING) & F.col("safety_ok"))
         / F.nullif(F.count_if(taken.isin(*MUTATING)), F.lit(0))).alias("safety_rate"))


def served_accuracy(outcomes: DataFrame) -> DataFrame:
    """Accuracy over all rows and over served rows, and coverage, per strategy and per regime of it."""
    hit = F.col("yhat") == F.col("y")
    served = ~F.col("abstained")
    got = outcomes.groupingSets([["strategy", "regime"], ["strategy"]], "strategy", "regime").agg(
        F.grouping("regime").alias("overall"), F.count(F.lit(1)).alias("n"),
        rate(hit & served).alias("accuracy"),
        (F.count_if(hit & served) / F.greatest(F.count_if(served), F.lit(1))).alias("served_accuracy"),
        rate(served).alias("coverage"))
    return got.withColumn("regime", F.when(F.col("overall") == 1, "*").otherwise(F.col("regime"))).drop("overall")


def action_counts(s: DataFrame) -> DataFrame:
    """How often each action was asked for and taken."""
    kinds = F.explode(F.array(
        F.struct(F.lit("taken").alias("kind"), F.col("action_taken").alias("action")),
        F.struct(F.lit("recommended").alias("kind"), F.col("recommended_action").alias("action"))))
    return s.select(*KEY, kinds.alias("_k")).select(*KEY, "_k.*").groupBy(*KEY, "kind", "action").agg(
        F.count(F.lit(1)).alias("n"))


def paired_by_step(s: DataFrame, baseline: str, columns: Sequence[str]) -> DataFrame:
    """Every strategy next to the baseline at the same step; steps only one of them has are left out."""
    base = s.where(F.col("strategy") == baseline).select(
        "stream_id", "step", *[F.col(c).alias(f"base_{c}") for c in columns])
    return s.select(*KEY, "step", *columns).join(base, ["stream_id", "step"])


def harmful_events(s: DataFrame, baseline: str = "frozen") -> DataFrame:
    p = paired_by_step(s, baseline, ["risk_alert", "retrain_recommended"])
    bad = F.col("base_risk_alert") | F.col("base_retrain_recommended")
    now = F.col("risk_alert") | F.col("retrain_recommended")
    return p.groupBy(*KEY).agg(F.count_if(bad & ~now).alias("events_avoided"))


def versus_baseline(summary: DataFrame, events: DataFrame, baseline: str = "frozen") -> DataFrame:
    """Utility gain, the best of three risk reductions, events avoided and retrain deferral."""
    cols = ["steps", "mean_accuracy", "mean_utility", "mean_risk_capital", "risk_alert_count", "retrain_count",
            "first_retrain_step"]
    base = summary.where(F.col("strategy") == baseline).select(
        "stream_id", *[F.col(c).alias(f"base_{c}") for c in cols])
    j = summary.where(F.col("strategy") != baseline).join(base, "stream_id").join(events, list(KEY))
    alerts, base_alerts = (F.col(f"{p}risk_alert_count") / F.greatest(F.lit(1), F.col(f"{p}steps")) for p in ("", "base_"))

    def cut(new, old):
        return F.when(old > 0, 1 - new / old)

    first, base_first = F.col("first_retrain_step"), F.col("base_first_retrain_step")
    deferral = (F.when(first.isNull() & base_first.isNull(), F.lit(0).cast("long"))
                .when(base_first.isNull(), F.lit(None))
                .when(first.isNull(), F.col("steps") - base_first).otherwise(first - base_first))
    j = j.withColumn("alert_rate", alerts).withColumn("base_alert_rate", base_alerts)
    return j.withColumn("utility_delta", F.col("mean_utility") - F.col("base_mean_utility")).withColumn(
        "risk_reduction", F.greatest(
            cut(F.col("mean_risk_capital"), F.col("base_mean_risk_capital")), cut(alerts, base_alerts),
            cut(F.col("retrain_count"), F.col("base_retrain_count")))).withColumn("retrain_deferral", deferral)


def buyer_kpis(versus: DataFrame, equal_within_pp: float = 1.0) -> DataFrame:
    """Operational measures with one headline sentence."""
    alerts = F.when(F.col("base_alert_rate") > 0, (1 - F.col("alert_rate") / F.col("base_alert_rate")) * 100).otherwise(
        F.when(F.col("alert_rate") == 0, 100.0).otherwise(0.0))
    exposure = F.when(F.col("base_mean_risk_capital") > 0, (
        1 - F.col("mean_risk_capital") / F.col("base_mean_risk_capital")) * 100).otherwise(0.0)
    pp = (F.col("mean_accuracy") - F.col("base_mean_accuracy")) * 100
    k = versus.withColumn("alert_reduction_pct", alerts).withColumn("exposure_reduction_pct", exposure).withColumn(
        "accuracy_delta_pp", pp)
    k = k.withColumn("accuracy_equivalent", F.coalesce(F.abs(pp) <= equal_within_pp, F.lit(False)))
    k = k.withColumn("material_reduction", (alerts >= 10) | (exposure >= 10))
    pct = lambda c: F.round(c, 0).cast("long").cast("string")
    headline = (
        F.when(alerts >= 50, F.concat(F.lit("Alarms cut by "), pct(F.col("alert_reduction_pct")), F.lit(" %")))
        .when(exposure >= 50, F.concat(F.lit("Risk exposure cut by "), pct(F.col("exposure_reduction_pct")), F.lit(" %")))
        .when(F.col("accuracy_delta_pp") > equal_within_pp, "Decision quality improved")
        .otherwise("Operational risk signals compared with the frozen model"))
    return k.withColumn("headline", headline)


def business_kpis(s: DataFrame, keys: Sequence[str] = KEY, retrain_cost: float = 0.08) -> DataFrame:
    """Mean business score and rates; the score also charges for retrain recommendations."""
    score = F.col("utility") - retrain_cost * F.col("retrain_recommended").cast("double")
    return s.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("steps"), F.avg(score).alias("mean_business_score"),
        rate(F.col("risk_alert")).alias("alert_rate"), rate(F.col("retrain_recommended")).alias("retrain_rate"),
        rate(F.col("explicit_action")).alias("intervention_rate"), F.avg("capital").alias("mean_risk_capital"))


# ---- source evidence -------------------------------------------------------------------------

@dataclass(frozen=True)
class Thresholds:
    min_rows: int = 400
    min_utility_delta: float = 0.0
    min_risk_reduction_pct: float = 5.0
    min_safety_rate: float = 0.85
    min_baseline_delta: float = 0.0
    stretch_utility: float = 0.02
    stretch_risk_pct: float = 15.0


def source_checks(versus: DataFrame, summary: DataFrame, sizes: DataFrame, controller: str,
                  baselines: Sequence[str], limits: Thresholds = Thresholds()) -> DataFrame:
    """Per stream: the checks as an array of (name, passed), the verdict and the stretch verdict."""
    mine = versus.where(F.col("strategy") == controller)
    u = summary.where(F.col("strategy").isin(*baselines)).groupBy("stream_id").pivot("strategy", list(baselines)).agg(
        F.first("mean_utility"))
    u = u.select("stream_id", *[F.col(b).alias(f"u_{b}") for b in baselines])
    j = mine.join(u, "stream_id", "left").join(sizes, "stream_id")
    pct = F.coalesce(F.col("risk_reduction"), F.lit(0.0)) * 100
    deltas = {b: F.col("mean_utility") - F.col(f"u_{b}") for b in baselines}

    def check(name, passed):
        return F.struct(F.lit(name).alias("name"), F.coalesce(passed, F.lit(False)).alias("passed"))

    win = (F.col("utility_delta") >= limits.min_utility_delta) | (
        F.col("risk_reduction").isNotNull() & (pct >= limits.min_risk_reduction_pct))
    waived = F.lit(False)
    if "scheduled_retrain" in deltas:
        waived = F.coalesce(deltas["scheduled_retrain"] >= limits.min_utility_delta, F.lit(False)) & (
            F.col("safety_rate") >= 0.65)
    active = ((F.col("intervention_rate") > 0) | (F.col("recommendation_execution_rate") > 0)
              | (F.col("recommendation_rate") > 0.05) | (F.col("correction_applied_rate") > 0.05)
              | (F.col("mean_flipped") > 0))
    checks = F.array_compact(F.array(
        check("stream_size", F.col("n_rows") >= limits.min_rows), check("economic_win", win),
        *[check(f"beat_{b}", d >= limits.min_baseline_delta) for b, d in deltas.items()],
        F.when(F.col("safety_rate").isNotNull(), check(
            "adaptation_safety", (F.col("safety_rate") >= limits.min_safety_rate) | waived)),
        check("policy_activity", active)))
    out = j.withColumn("checks", checks)
    stretch = F.coalesce((F.col("utility_delta") >= limits.stretch_utility) & (pct >= limits.stretch_risk_pct), F.lit(False))
    return out.withColumn("passed", F.forall("checks", lambda c: c["passed"])).withColumn("stretch_passed", stretch)


def suite_verdict(checks: DataFrame, least_core: int = 2) -> DataFrame:
    return checks.agg(F.count(F.lit(1)).alias("n_sources"), F.count_if("passed").alias("core_passing"),
                      F.bool_or("stretch_passed").alias("stretch_any")).withColumn(
        "suite_passed", F.col("core_passing") >= least_core)


def head_to_head(summary: DataFrame, strategies: Sequence[str], primary: str, other: str) -> DataFrame:
    p = summary.groupBy("stream_id").pivot("strategy", list(strategies)).agg(F.first("mean_utility"))
    return p.withColumn("delta", F.col(primary) - F.col(other))


# ---- failure analysis ------------------------------------------------------------------------

def driver_buckets(s: DataFrame) -> DataFrame:
    """Batches by what moved them: an action, a correction only, or nothing."""
    bucket = (F.when(F.col("explicit_action"), "explicit_action")
              .when(F.col("correction_applied"), "correction_only").otherwise("passive"))
    return s.withColumn("bucket", bucket).groupBy(*KEY, "bucket").agg(
        F.count(F.lit(1)).alias("n"), F.count("revealed_accuracy").alias("revealed"),
        steady(F.avg("revealed_accuracy")).alias("mean_accuracy"),
        steady(F.avg(F.when(F.col("revealed_accuracy").isNotNull(), F.col("utility")))).alias("mean_utility"),
        steady(F.avg("mean_abs_delta")).alias("mean_delta"), steady(F.avg("flipped")).alias("mean_flips"))


def revealed_alerts(s: DataFrame, threshold: float, baseline: str = "frozen") -> DataFrame:
    """Share and burden of revealed batches under a threshold, and events avoided or introduced against the
    baseline on the steps both have."""
    known = s.where(F.col("revealed_accuracy").isNotNull())
    own = known.groupBy(*KEY).agg(
        rate(F.col("revealed_accuracy") < threshold).alias("alert_rate"),
        F.avg(F.greatest(F.lit(0.0), threshold - F.col("revealed_accuracy"))).alias("burden"))
    p = paired_by_step(known, baseline, ["revealed_accuracy"])
    now, was = F.col("revealed_accuracy") < threshold, F.col("base_revealed_accuracy") < threshold
    pair = p.groupBy(*KEY).agg(
        F.count_if(was & ~now).alias("avoided"), F.count_if(now & ~was).alias("introduced"),
        F.avg(F.col("revealed_accuracy") - F.col("base_revealed_accuracy")).alias("mean_delta"))
    return own.join(pair, list(KEY), "left")


def common_steps(s: DataFrame, a: str, b: str) -> DataFrame:
    on = ["stream_id", "step"]
    return s.where(F.col("strategy") == a).select(*on).intersect(s.where(F.col("strategy") == b).select(*on))


def driver_label(correction_gain: Column, action_gain: Column) -> Column:
    c, a = correction_gain, action_gain
    return (F.when((c >= 0.005) & (c >= a * 1.25), "correction_dominant")
            .when((a >= 0.005) & (a >= c * 1.25), "action_dominant")
            .when((c >= 0.003) & (a >= 0.003), "mixed").otherwise("weak_or_unclear"))


@dataclass(frozen=True)
class Acceptance:
    min_vs_frozen: float = 0.0
    min_vs_scheduled: float = 0.0
    max_gap: float = 0.01
    max_worst_gap: float = 0.03
    min_within: int = 2
    max_action_rate: float = 0.05
    max_burden: float = 0.01


def acceptance(per_source: DataFrame, limits: Acceptance = Acceptance()) -> DataFrame:
    """Seven checks over all sources of a candidate.

    `per_source` has candidate, vs_frozen, vs_scheduled, gap, burden_delta and action_rate.
    """
    g = per_source.groupBy("candidate").agg(
        steady(F.avg("vs_frozen")).alias("vs_frozen"), steady(F.avg("vs_scheduled")).alias("vs_scheduled"),
        steady(F.avg("gap")).alias("mean_gap"), F.max("gap").alias("worst_gap"),
        F.count_if(F.col("gap") <= limits.max_worst_gap).alias("within"),
        F.avg("burden_delta").alias("burden"), F.avg("action_rate").alias("action_rate"))
    tests = {
        "mean_utility_vs_frozen": F.col("vs_frozen") >= limits.min_vs_frozen,
        "mean_utility_vs_scheduled": F.col("vs_scheduled") >= limits.min_vs_scheduled,
        "mean_gap_vs_full": F.col("mean_gap") <= limits.max_gap,
        "worst_gap_vs_full": F.col("worst_gap") <= limits.max_worst_gap,
        "source_coverage": F.col("within") >= limits.min_within,
        "mean_action_rate": F.col("action_rate") <= limits.max_action_rate,
        "mean_burden": F.col("burden").isNull() | (F.col("burden") <= limits.max_burden),
    }
    failed = F.array_compact(F.array(*[F.when(~c, F.lit(n)) for n, c in tests.items()]))
    return g.withColumn("failed", failed).withColumn("passed", F.size("failed") == 0)


# ---- across runs and benchmarks --------------------------------------------------------------

def unpivot_metrics(df: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"))
                                for m in metrics]))
    return df.select(*keys, pairs.alias("_m")).select(*keys, "_m.*")


def across_runs(long: DataFrame, run: str, runs: int | None = None) -> DataFrame:
    """Mean and population deviation of each metric over runs; a run without the metric counts as 0."""
    zero = F.lit(0.0)
    v = F.coalesce("value", zero)
    got = long.groupBy("strategy", "metric").agg(
        F.count_distinct(run).alias("_k"), F.sum(v).alias("_s"), F.sum(v * v).alias("_q"))
    n = F.lit(float(runs)) if runs else F.col("_k").cast("double")
    mean = F.col("_s") / n
    return got.select("strategy", "metric", mean.alias("mean"),
                      F.sqrt(F.greatest(zero, F.col("_q") / n - mean * mean)).alias("std"))


def wins(summary: DataFrame, benchmark: str, metrics: Mapping[str, str], baseline: str = "frozen") -> DataFrame:
    """Wins (ties within 1e-6 all win) and mean margin over the baseline across benchmarks."""
    best = summary.groupBy(benchmark).agg(
        *[F.max(c).alias(f"_b_{n}") for n, c in metrics.items()],
        *[F.coalesce(F.max(F.when(F.col("strategy") == baseline, F.col(c))), F.lit(0.0)).alias(f"_f_{n}")
          for n, c in metrics.items()])
    j = summary.join(best, benchmark)
    aggs = []
    for n, c in metrics.items():
        aggs += [F.count_if(F.col(c) >= F.col(f"_b_{n}") - 1e-6).alias(f"{n}_wins"),
                 F.avg(F.col(c) - F.col(f"_f_{n}")).alias(f"{n}_margin")]
    return j.groupBy("strategy").agg(*aggs)


def t_statistics(deltas: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """One-sample t of deltas against 0 for any number of groups at once."""
    g = deltas.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"),
                                  F.stddev_samp(value).alias("std"), F.count_if(F.col(value) > 0).alias("n_positive"))
    method = (F.when(F.col("n") < 2, "insufficient").when(F.col("n") == 2, "sign")
              .when(F.col("std") < 1e-10, "degenerate").otherwise("t"))
    g = g.withColumn("method", method)
    t = F.when(F.col("method") == "t", F.col("mean") / (F.col("std") / F.sqrt(F.col("n").cast("double"))))
    return g.withColumn("t", t)


def edge_accuracy(stats: DataFrame, keys: Sequence[str], last: Column, width: Column) -> DataFrame:
    """Mean accuracy of the first and of the last batches; steps count from 0 to `last`."""
    return stats.withColumn("_l", last).withColumn("_w", width).groupBy(*keys).agg(
        steady(F.avg(F.when(F.col("step") < F.col("_w"), F.col("accuracy")))).alias("early_accuracy"),
        steady(F.avg(F.when(F.col("step") > F.col("_l") - F.col("_w"), F.col("accuracy")))).alias("final_accuracy"))


def false_alarms(signals: DataFrame, share: int = 4, least: int = 5) -> DataFrame:
    """Alerts on the first quarter of each stream."""
    window = signals.where(F.col("step") < F.greatest(F.lit(least), F.floor(F.col("n_steps") / share)))
    return window.groupBy("stream_id").agg(
        F.count(F.lit(1)).alias("n"), rate(F.col("alert")).alias("false_alert_rate"),
        rate(F.col("severe")).alias("false_severe_rate"), F.avg("score").alias("mean_shift"),
        F.max("score").alias("max_shift"))


def detector_scores(alarms: DataFrame, trial: Sequence[str], group: Sequence[str]) -> DataFrame:
    """False-alarm rate before the onset, latency after it and missed detections, by group of trials.

    `alarms` has step, onset, first_step (end of the reference) and alarm.
    """
    before = (F.col("step") >= F.col("first_step")) & (F.col("step") < F.col("onset"))
    t = alarms.groupBy(*group, *trial).agg(
        (F.count_if(before & F.col("alarm")) / F.greatest(F.count_if(before), F.lit(1))).alias("far"),
        (F.min(F.when(F.col("alarm") & (F.col("step") >= F.col("onset")), F.col("step"))) - F.first("onset")).alias("latency"))
    return t.groupBy(*group).agg(
        F.count(F.lit(1)).alias("trials"), F.avg("far").alias("false_alarm_rate"),
        F.avg("latency").alias("mean_latency"), rate(F.col("latency").isNull()).alias("missed_rate"))


def group_statistics(rows: DataFrame, group: str, least: int) -> DataFrame:
    return rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"), rate(F.col("yhat") == F.col("y")).alias("accuracy")
                                   ).where(F.col("n") >= least)


def group_roles(groups: DataFrame, group: str) -> DataFrame:
    """Easy, hard and recurring group of one table of groups.

    The table holds one row per group; each pick is a single aggregation over it.
    """
    span = groups.agg(F.max("n").alias("_n"), F.min("accuracy").alias("_lo"), F.max("accuracy").alias("_hi")).first()
    top, low, high = (float(span[i] or 0) for i in range(3))
    share = F.col("n") / F.lit(max(top, 1.0))
    middle = 1 - F.abs(F.col("accuracy") - 0.5 * (low + high)) / max(1e-6, high - low)
    easy = groups.agg(F.max_by(group, F.struct("accuracy", share.alias("s"), "n", group))).first()[0]
    rest = groups.where(F.col(group) != easy)
    hard = rest.agg(F.min_by(group, F.struct("accuracy", (-share).alias("s"), (-F.col("n")).alias("m"), group))).first()[0]
    left = rest.where(F.col(group) != hard)
    again = left.agg(F.max_by(group, F.struct((0.65 * share + 0.35 * middle).alias("s"), "n", group))).first()[0]
    role = F.when(F.col(group) == easy, "easy").when(F.col(group) == hard, "hard").when(
        F.col(group) == again, "recurring")
    return groups.withColumn("role", role).where(F.col("role").isNotNull())


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """First k rows of each key. Spark keeps k rows per key and partition before it shuffles."""
    over = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_k", F.row_number().over(over)).where(F.col("_k") <= k).drop("_k")


def worst_batches(s: DataFrame, k: int = 3) -> DataFrame:
    """The k least accurate batches of each strategy, ties by step."""
    return top_k(s, KEY, [F.col("accuracy"), F.col("step")], k)


def top_episodes(episodes: DataFrame, k: int = 5) -> DataFrame:
    return top_k(episodes, KEY, [F.desc("peak_risk_capital"), F.desc("peak_shift_score"), F.col("start_step")], k)


def gauges(s: DataFrame) -> DataFrame:
    """Latest values of each stream and strategy, and its alert count."""
    return s.groupBy(*KEY).agg(
        F.max_by("shift_score", "step").alias("shift_score"), F.max_by("capital", "step").alias("capital"),
        F.max_by("accuracy", "step").alias("accuracy"), F.count_if("risk_alert").alias("alerts"))


def intervention_counter(s: DataFrame) -> DataFrame:
    return s.groupBy("action_taken", "effective_mode").agg(F.count(F.lit(1)).alias("n"))



"""Governed decisions per batch.

Everything that does not depend on earlier decisions is a column: signature, opportunity, allowed
actions, uncertainty action, guards. What feeds back (capital after resets and holds, cooldowns,
budget use, calibration parameters) is one ordered fold per stream and strategy.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftgauge.functions import scalar as S
from driftgauge.operators.drift import DECAY, MAX_CAPITAL, RISK_ALERT, shift_signature
from driftgauge.operators.ordered import ordered_fold

# ---- fixed values: actions, signatures and the table of bounded actions -----------------------
PASSIVE = ("none", "hold")
MUTATING = ("adapt", "reset", "bn_refresh", "covariate_refresh", "recalibrate", "label_shift")
BASE_ACTIONS = ("none", "hold", "bn_refresh", "bn_refresh_only", "covariate_refresh", "recalibrate",
                "cool_confidence", "label_shift", "bbse_label_shift", "latent_recenter")
HIGH_RISK = ("adapt", "reset", "abstain")
_NH = ("none", "hold")
_RC = ("none", "hold", "recalibrate", "cool_confidence")
_FULL_MIX = (*_NH, "bn_refresh", "covariate_refresh", "recalibrate", "cool_confidence")
BOUNDED_ACTIONS: Mapping[tuple[str, str], Sequence[str]] = {
    ("general", "stable"): BASE_ACTIONS,
    ("general", "covariate_drift"): (*_FULL_MIX, "latent_recenter"),
    ("general", "label_drift"): (*_RC, "label_shift", "bbse_label_shift"),
    ("general", "mixed_drift"): (*_FULL_MIX, "label_shift", "bbse_label_shift"),
    ("general", "collapse_risk"): (*_NH, "recalibrate"),
    ("general", "reference_break"): _NH,
    ("fraud", "stable"): BASE_ACTIONS,
    ("fraud", "covariate_drift"): (*_RC, "label_shift"),
    ("fraud", "label_drift"): (*_RC, "label_shift", "bbse_label_shift"),
    ("fraud", "mixed_drift"): (*_RC, "label_shift", "bbse_label_shift"),
    ("fraud", "collapse_risk"): (*_NH, "recalibrate", "label_shift"),
    ("fraud", "reference_break"): _NH,
    ("sensor", "stable"): BASE_ACTIONS,
    ("sensor", "covariate_drift"): (*_FULL_MIX, "latent_recenter"),
    ("sensor", "label_drift"): _RC,
    ("sensor", "mixed_drift"): _FULL_MIX,
    ("sensor", "collapse_risk"): (*_NH, "recalibrate"),
    ("sensor", "reference_break"): _NH,
    ("sensor_safe", "stable"): _NH,
    ("sensor_safe", "covariate_drift"): _NH,
    ("sensor_safe", "label_drift"): _RC,
    ("sensor_safe", "mixed_drift"): _NH,
    ("sensor_safe", "collapse_risk"): _NH,
    ("sensor_safe", "reference_break"): _NH,
}
STRUCTURAL_SHIFT = 1.75
STRATEGIES = ("frozen", "naive", "scheduled_retrain", "controller", "multi_action")


@dataclass(frozen=True)
class Rules:
    """Options of a run; the values are the defaults of the decision rules."""

    mode: str = "bounded_auto"
    base_actions: Sequence[str] = BASE_ACTIONS
    window: int = 24
    max_actions: int = 8
    max_resets: int = 1
    downgrade: bool = True
    block_on_loss: bool = True
    proactive: bool = False
    concentration_reset: bool = False
    use_saturation: bool = False
    retrain_interval: int = 6
    cooldown: int = 2
    # Further strategies by name: f(row, capital, risky, state) -> (action, reason).
    policies: Mapping[str, Callable] = field(default_factory=dict)


# ---- columns ---------------------------------------------------------------------------------

def saturated(profile: Column) -> Column:
    f, o = F.col("feature_score"), F.col("output_score")
    hit = (F.col("score") >= 8.0) | (f >= 6.0) | (F.col("severe") & (f >= 3.0) & (o >= 0.6))
    return profile.isin("sensor", "sensor_safe") & hit


def opportunity(profile: Column, signature: Column, is_saturated: Column) -> Column:
    f, o, c = F.col("feature_score"), F.col("output_score"), F.col("collapse_risk")
    cov, mix = signature == "covariate_drift", signature == "mixed_drift"
    raw = (
        F.when(profile == "sensor_safe", F.when(cov, 0.35 * f - 0.45 * o - 0.55 * c)
               .when(mix, 0.10 * f - 0.35 * o).otherwise(0.08 * o))
        .when(profile == "sensor", F.when(cov, 0.55 * f - 0.35 * o - 0.45 * c)
              .when(mix, 0.25 * f - 0.30 * o).otherwise(0.15 * o))
        .when(profile == "fraud", F.when(signature == "label_drift", 0.75 * o + 0.25 * c)
              .otherwise(0.25 * f + 0.20 * o))
        .otherwise(0.30 * f + 0.30 * o))
    return F.when(is_saturated, 0.0).otherwise(S.clip(raw, 0, 1))


def adjusted_opportunity(base: Column, gain: Column, hold: Column, uncertainty: Column) -> Column:
    x = S.clip(0.7 * base + 0.3 * gain, 0, 1)
    x = F.when(hold, F.least(x, F.lit(0.15))).otherwise(x)
    x = F.when(uncertainty == "tighten_abstention", F.least(x, F.lit(0.25))).otherwise(x)
    return F.when(base <= 0, base).otherwise(x)


def uncertainty_action(half_width: Column) -> Column:
    c = F.col("collapse_risk")
    structural = F.col("score") >= STRUCTURAL_SHIFT
    tight = (c >= F.when(structural, 0.62).otherwise(0.55)) | (
        half_width >= F.when(structural, 0.40).otherwise(0.35))
    relax = ((half_width <= 0.12) & ~structural) | (structural & (half_width <= 0.18) & (c < 0.50))
    return F.when(tight, "tighten_abstention").when(relax, "relax_abstention").otherwise("hold_threshold")


def allowed_actions(profile: Column, signature: Column, is_saturated: Column, chance: Column,
                    revealed_accuracy: Column, revealed_rate: Column, base: Sequence[str] = BASE_ACTIONS) -> Column:
    """Base actions cut down by profile and signature; only holding in stand-down or when all is well."""
    names = F.array(*[F.lit(a) for a in base])
    idle = F.array_intersect(names, F.array(*[F.lit(a) for a in _NH]))
    stand_down = ((profile == "sensor_safe") & (is_saturated | (chance < 0.35))) | (
        (profile == "sensor") & (is_saturated | (chance < 0.20)))
    benign = F.coalesce((revealed_accuracy > 0.92) & (revealed_rate <= F.col("ref_mean_p") + 0.05), F.lit(False))
    pairs = [x for (p, s), acts in BOUNDED_ACTIONS.items()
             for x in (F.lit(f"{p}/{s}"), F.array(*[F.lit(a) for a in acts]))]
    rows = F.create_map(*pairs)
    known = F.when(profile.isin("fraud", "sensor", "sensor_safe"), profile).otherwise(F.lit("general"))
    got = F.array_intersect(names, rows[F.concat_ws("/", known, signature)])
    return F.when(stand_down | benign, idle).otherwise(got)


def concentration_advice(concentration: Column) -> Column:
    """Reset or recalibrate when nearly the whole batch is predicted as one class; null otherwise."""
    c, high = F.col("collapse_risk"), F.col("score") >= STRUCTURAL_SHIFT
    reset = (concentration >= F.when(high, 0.92).otherwise(0.88)) & (c >= F.when(high, 0.42).otherwise(0.35))
    recal = (concentration >= F.when(high, 0.78).otherwise(0.72)) & (c >= F.when(high, 0.28).otherwise(0.22))
    return F.when(reset, "reset").when(recal, "recalibrate")


def mode_gate(mode: Column, recommended: Column, allowed: Column) -> tuple[Column, Column]:
    """Action and reason after the operating mode."""
    ok = F.array_contains(allowed, recommended)
    action = F.when(mode.isin("shadow", "recommend"), "none").when(ok, recommended).otherwise("none")
    reason = (F.when(mode == "shadow", "shadow_mode_no_mutation")
              .when(mode == "recommend", "recommend_mode_pending_approval")
              .when(ok, "allowed").otherwise(F.concat(F.lit("bounded_auto_blocked:"), recommended)))
    return action, reason


def trust_state(action: Column) -> Column:
    c, alert = F.col("collapse_risk"), F.col("alert")
    return (F.when((c >= 0.5) | (action == "reset"), "escalate")
            .when(alert & action.isin("adapt", "reset"), "caution").when(alert, "monitor").otherwise("normal"))


def reliability(capital: Column, action: Column) -> Column:
    base = 1 - 0.20 * F.col("feature_score") - 0.28 * F.col("output_score") - 0.32 * F.col("collapse_risk")
    risk = F.least(F.lit(0.45), 0.04 * F.greatest(F.lit(0.0), capital - 1))
    acted = F.when(action == "reset", 0.08).when(action == "abstain", 0.05).otherwise(0.0)
    return S.clip(base - risk - acted, 0, 1)


def scalar_reliability() -> Column:
    return S.clip(1 - 0.18 * F.col("feature_score") - 0.22 * F.col("output_score") - 0.35 * F.col("collapse_risk"), 0, 1)


def safety_verdict(mode: Column, action: Column, drift: Column, forced_shadow: bool = False) -> Column:
    """Whether a change of the model at this batch counts as safe."""
    c, s = F.col("collapse_risk"), F.col("score")
    structural = s >= STRUCTURAL_SHIFT
    bounded = action.isin("recalibrate", "label_shift", "bn_refresh", "hold", "adapt")
    gate = 0.65 + 0.10 * F.least(F.lit(1.0), F.greatest(F.lit(0.0), s - 1.2) / 1.2)
    risky = F.when(structural, (action == "reset") | ((action == "adapt") & (drift >= 1.5))).otherwise(c >= gate)
    exposed = risky & (mode == "bounded_auto") & F.lit(not forced_shadow)
    drifted = (drift >= F.when(structural, 1.85).otherwise(1.25)) & (c >= 0.45) & ~(
        structural & bounded & (drift < 1.35))
    return action.isin(*PASSIVE) | (structural & bounded & (drift < 1.5)) | ~(exposed | drifted)


def recalibrate_guard(recent_accuracy: Column) -> Column:
    return F.coalesce(recent_accuracy <= 0.85, F.lit(True))


def cool_guard() -> Column:
    return F.col("mean_conf") - F.col("ref_mean_conf") >= 0.04


def label_shift_guard(revealed_rate: Column) -> Column:
    rate = F.coalesce(revealed_rate, F.col("ref_mean_p"))
    return rate - F.col("ref_mean_p") >= 0.07


def decision_inputs(signals: DataFrame, profile: Column, rules: Rules = Rules()) -> DataFrame:
    """All columns a decision needs that no earlier decision can change.

    `signals` has the shift columns, `e_value`, the trend columns, the recent reveals, `alpha` and `gain`.
    """
    s = signals.withColumn("profile", profile)
    s = s.withColumn("signature", shift_signature(F.col("profile")))
    s = s.withColumn("saturated", saturated(F.col("profile")))
    s = s.withColumn("signature", F.when(F.col("saturated") & ~F.col("profile").isin("sensor", "sensor_safe"),
                                         "collapse_risk").otherwise(F.col("signature")))
    s = s.withColumn("half_width", S.interval_half_width(F.col("alpha"), F.col("mean_conf")))
    s = s.withColumn("uncertainty", uncertainty_action(F.col("half_width")))
    hold = F.col("proactive_hold") if rules.proactive else F.lit(False)
    s = s.withColumn("hold_first", hold).withColumn("opportunity", adjusted_opportunity(
        opportunity(F.col("profile"), F.col("signature"), F.col("saturated")), F.col("gain"), hold,
        F.col("uncertainty")))
    advice = concentration_advice(F.greatest(F.col("n_pred_pos"), F.col("n") - F.col("n_pred_pos")) / F.col("n"))
    s = s.withColumn("advice", advice if rules.concentration_reset else F.lit(None).cast("string"))
    return s.withColumn("allowed", allowed_actions(
        F.col("profile"), F.col("signature"), F.col("saturated"), F.col("opportunity"),
        F.col("revealed_accuracy"), F.col("revealed_rate"), rules.base_actions))


# ---- the fold --------------------------------------------------------------------------------
# Layout of the numeric state of one stream under one strategy.
_CAPITAL, _COOL, _SEVERE_RUN, _SINCE_RESET, _TICKS, _TEMP, _BIAS, _REFRACTORY, _ACTED, _RESETS, _BLOCKS = range(11)
# The last three are whole numbers of any size, so a budget window may have any length.
_START = [1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0, 0, 0]


def _propose(strategy: str, r, c: float, risky: bool, st: list, rules: Rules) -> tuple[str, str]:
    """What the strategy asks for; cooldowns and counters are updated in the state."""
    if strategy in rules.policies:
        return rules.policies[strategy](r, c, risky, st)
    if strategy == "frozen":
        return "none", "frozen_baseline"
    if strategy == "naive":
        if r.score < 1.0:
            return "none", "shift_below_threshold"
        return ("adapt", "naive_shift_trigger") if r.conf68 > 0 else ("hold", "no_confident_samples")
    if strategy == "scheduled_retrain":
        st[_TICKS] += 1
        if st[_TICKS] < rules.retrain_interval:
            return "none", "scheduled_retrain_wait"
        st[_TICKS] = 0
        return ("adapt", "scheduled_retrain_interval") if r.conf68 > 0 else (
            "recalibrate", "scheduled_retrain_recalibrate_fallback")
    confident = r.conf90 if r.severe or risky else r.conf80
    if strategy == "controller":
        if st[_COOL] > 0:
            st[_COOL] -= 1
            return "hold", "cooldown"
        if r.score < 1.0 and not risky:
            st[_SEVERE_RUN] = 0
            return "none", "shift_below_threshold"
        st[_SEVERE_RUN] = st[_SEVERE_RUN] + 1 if r.severe or risky or r.score >= 1.7 else 0
        if c >= 18.0 or st[_SEVERE_RUN] >= 3 or r.collapse_risk >= 0.55:
            st[_SEVERE_RUN], st[_COOL] = 0, rules.cooldown
            return "reset", "risk_or_severe_persistence"
        st[_COOL] = rules.cooldown if confident > 0 else 1
        return ("adapt", "controlled_shift_response") if confident > 0 else ("hold", "no_confident_samples")
    if strategy == "multi_action":
        st[_SINCE_RESET] = max(0.0, st[_SINCE_RESET] - 1)
        if st[_COOL] > 0:
            st[_COOL] -= 1
            return "hold", "cooldown"
        if c >= 25.0 or r.collapse_risk >= 0.70:
            if st[_SINCE_RESET] > 0:
                st[_COOL] = 1
                return "abstain", "persistent_high_risk"
            st[_COOL], st[_SINCE_RESET] = rules.cooldown, 3
            return "reset", "hard_risk_reset"
        if r.score < 0.95 and not risky:
            return "none", "shift_below_threshold"
        st[_COOL] = 1
        gap = r.ref_mean_conf - r.mean_conf
        if r.output_score > 0.18 and abs(r.mean_p - r.ref_mean_p) > 0.08 and r.feature_score < 0.95:
            return "label_shift", "posterior_mean_shift"
        if r.feature_score > 0.95 and r.output_score < 0.35 and r.mean_conf >= 0.78:
            return "bn_refresh", "feature_shift_without_output_instability"
        if abs(gap) > 0.05 and r.collapse_risk < 0.40 and r.feature_score < 1.55:
            return ("cool_confidence", "overconfidence_gap") if gap < 0 else ("recalibrate", "confidence_gap")
        if (r.score >= 1.55 or risky) and r.mean_conf < 0.72:
            return "abstain", "high_risk_low_confidence"
        if confident <= 0:
            return "hold", "no_confident_samples"
        st[_COOL] = rules.cooldown
        return "adapt", "adapter_head_update"
    raise ValueError(f"unknown strategy {strategy}")


def _overridden(action: str, reason: str, r, st: list) -> tuple[str, str]:
    """Profile, maintenance, concentration, uncertainty and proactive overrides, in this order."""
    first = action
    if (r.profile == "sensor" and r.signature == "covariate_drift" and not r.saturated and r.opportunity >= 0.35
            and action in ("bn_refresh", "adapt")):
        action, reason = "covariate_refresh", f"{reason};profile_covariate_refresh"
    if (r.profile in ("sensor", "sensor_safe") and r.signature in ("covariate_drift", "mixed_drift")
            and action in ("adapt", "bn_refresh")):
        action, reason = "latent_recenter", f"{reason};maintenance_latent_recenter"
    st[_REFRACTORY] = max(0.0, st[_REFRACTORY] - 1)
    if r.advice is not None and st[_REFRACTORY] == 0:
        if r.advice == "reset":
            st[_REFRACTORY] = 3
        if r.advice != action:
            action, reason = r.advice, f"{reason};concentration_{r.advice}"
    structural = r.score >= STRUCTURAL_SHIFT
    if r.uncertainty == "tighten_abstention":
        if action in ("adapt", "reset", "covariate_refresh") or (action == "bn_refresh" and not structural):
            action, reason = "hold", f"{reason};conformal_tighten_hold"
        elif action in PASSIVE and not structural and r.collapse_risk >= 0.45:
            action, reason = "abstain", f"{reason};conformal_tighten_abstain"
    elif r.uncertainty == "relax_abstention" and action in PASSIVE:
        low, wide = (0.30, 0.20) if structural else (0.25, 0.15)
        if r.collapse_risk >= low and r.half_width <= wide:
            action, reason = "recalibrate", f"{reason};conformal_relax_recalibrate"
    if r.hold_first and action not in ("none", "hold", "abstain"):
        action, reason = "hold", f"{reason};proactive_drift_hold"
    if action != first and action == "recalibrate" and r.recent_accuracy is not None and r.recent_accuracy > 0.85:
        action, reason = "hold", f"{reason};recalibrate_accuracy_not_degraded"
    return action, reason


def _calibrate(action: str, strategy: str, r, st: list) -> None:
    """Temperature and bias after the action that was really taken."""
    def toward(target_momentum, low, high):
        goal = min(max(1.0 - 1.4 * (r.ref_mean_conf - r.mean_conf), low), high)
        st[_TEMP] = min(max((1 - target_momentum) * st[_TEMP] + target_momentum * goal, low), high)

    if action == "recalibrate":
        toward(0.30, 0.70, 1.30) if strategy == "multi_action" else toward(0.25, 0.65, 1.35)
    elif action == "cool_confidence":
        toward(0.15, 0.80, 1.40)
    elif action == "label_shift":
        source, target = (min(max(x, 1e-4), 1 - 1e-4) for x in (r.ref_mean_p, r.mean_p))
        goal = math.log(target / (1 - target)) - math.log(source / (1 - source))
        st[_BIAS] = 0.65 * st[_BIAS] + 0.35 * min(max(goal, -1.10), 1.10)
    elif action == "reset":
        st[_TEMP], st[_BIAS] = 1.0, 0.0


def _count(mask: int) -> int:
    return mask.bit_count()


def fresh_state() -> list:
    """State of a stream before its first step."""
    return list(_START)


def counters(state: list) -> tuple[float, int, int]:
    """Cooldown that is left, actions and resets inside the budget window."""
    return state[_COOL], _count(state[_ACTED]), _count(state[_RESETS])


_OUT = [("recommended_action", "string"), ("action_taken", "string"), ("reason", "string"),
        ("effective_mode", "string"), ("capital", "double"), ("risk_alert", "boolean"),
        ("retrain_recommended", "boolean"), ("budget_limited", "boolean"), ("budget_reason", "string"),
        ("temperature", "double"), ("bias", "double"), ("parameter_drift", "double")]
DECISION_FIELDS = [T.StructField(n, T.StringType() if t == "string" else T.DoubleType() if t == "double"
                                 else T.BooleanType()) for n, t in _OUT]
_NEEDED = ["score", "feature_score", "output_score", "collapse_risk", "alert", "severe", "mean_p", "mean_conf",
           "ref_mean_p", "ref_mean_conf", "e_value", "conf68", "conf80", "conf90", "profile", "signature",
           "saturated", "opportunity", "uncertainty", "half_width", "hold_first", "advice", "recent_accuracy",
           "drift_score", "loss_block", "allowed"]


def decider(rules: Rules) -> Callable[[str, object, list], tuple]:
    """One step of a run: (strategy, row, state) -> the fields of a decision; the state moves on in place."""
    keep_bits = (1 << rules.window) - 1

    def one(strategy: str, r, st: list) -> tuple:
        c = min(MAX_CAPITAL, max(1.0, st[_CAPITAL] * DECAY * r.e_value))
        risky = c >= RISK_ALERT
        # Ages grow by one: bit a of each mask is an event a steps ago.
        for slot in (_ACTED, _RESETS, _BLOCKS):
            st[slot] = (st[slot] << 1) & keep_bits
        asked, reason = _overridden(*_propose(strategy, r, c, risky, st, rules), r, st)
        mode, limited, why = rules.mode, False, None
        if rules.mode == "shadow":
            taken, note = "none", "shadow_mode_no_mutation"
        elif rules.mode == "recommend":
            taken, note = "none", "recommend_mode_pending_approval"
        elif asked in r.allowed:
            taken, note = asked, reason
        else:
            taken, note = "none", f"bounded_auto_blocked:{asked}"
        if rules.mode == "bounded_auto" and taken not in PASSIVE:
            if 0 <= rules.max_actions <= _count(st[_ACTED]):
                why = "max_auto_actions_per_window"
            elif taken == "reset" and 0 <= rules.max_resets <= _count(st[_RESETS]):
                why = "max_resets_per_window"
            if why:
                st[_BLOCKS] = st[_BLOCKS] | 1
                word = "downgraded" if rules.downgrade else "blocked"
                taken, note, limited = "none", f"bounded_auto_budget_{word}:{why}:{asked}", True
                mode = "recommend" if rules.downgrade else mode
        if rules.block_on_loss and r.loss_block and taken not in PASSIVE:
            taken, note, limited, why = "none", f"{note};loss_slope_blocked", True, "loss_slope"
        alert_now = risky
        if taken == "reset":
            c, alert_now = 1.0, False
        elif strategy != "frozen" and taken in PASSIVE:
            if asked not in ("none", "hold", "abstain") and not r.severe:
                c = max(1.0, 1.0 + (c - 1.0) * 0.55)
            elif taken == "hold" and r.hold_first:
                c = max(1.0, 1.0 + (c - 1.0) * 0.4)
            alert_now = c >= RISK_ALERT
        _calibrate(taken, strategy, r, st)
        if strategy == "frozen":
            retrain = alert_now or r.alert or r.severe
        else:
            heavy = r.severe or r.collapse_risk >= 0.55 or c >= RISK_ALERT * 1.5
            retrain = (heavy and taken in ("none", "hold", "abstain")) or (rules.use_saturation and r.saturated) or (
                limited and (r.alert or alert_now) and _count(st[_BLOCKS]) >= 2) or (
                asked in ("adapt", "reset") and taken in PASSIVE and (alert_now or r.severe))
        retrain = bool(retrain or r.drift_score >= 0.75)
        if taken not in ("none", "hold", "abstain"):
            st[_ACTED] = st[_ACTED] | 1
            if taken == "reset":
                st[_RESETS] = st[_RESETS] | 1
        st[_CAPITAL] = c
        drift = abs(st[_TEMP] - 1.0) + abs(st[_BIAS])
        return (asked, taken, f"{reason};{note}", mode, c, bool(alert_now), retrain, limited, why,
                st[_TEMP], st[_BIAS], drift)

    return one


def _decide(rules: Rules):
    one = decider(rules)

    def block(state: list, pdf: pd.DataFrame) -> tuple[list, pd.DataFrame]:
        strategy = pdf["strategy"].iloc[0]
        recent = pdf["recent_accuracy"]
        pdf = pdf.assign(recent_accuracy=recent.astype(object).where(recent.notna(), None),
                         advice=pdf["advice"].astype(object).where(pdf["advice"].notna(), None))
        rows = [one(strategy, r, state) for r in pdf.itertuples(index=False)]
        return state, pd.DataFrame(rows, columns=[n for n, _ in _OUT])

    return block


def decide(inputs: DataFrame, strategies: Sequence[str] = STRATEGIES, rules: Rules = Rules(),
           keep: Sequence[str] = ()) -> DataFrame:
    """One decision per stream, strategy and batch; streams and strategies run side by side."""
    names = F.explode(F.array(*[F.lit(s) for s in strategies])).alias("strategy")
    fold_in = inputs.select("stream_id", "step", *sorted({*_NEEDED, *keep}), names)
    out = ordered_fold(fold_in, ["stream_id", "strategy"], "step", fresh_state, _decide(rules), DECISION_FIELDS,
                       [k for k in (*["score", "feature_score", "output_score", "collapse_risk", "alert", "severe",
                                      "profile", "signature"], *keep)])
    action = F.col("action_taken")
    return (
        out.withColumn("operating_mode", F.lit(rules.mode))
        .withColumn("abstained", (action == "abstain") | (F.col("recommended_action") == "abstain"))
        .withColumn("trust_state", trust_state(F.col("recommended_action")))
        .withColumn("reliability", reliability(F.col("capital"), F.col("recommended_action")))
        .withColumn("safety_ok", safety_verdict(F.col("effective_mode"), action, F.col("parameter_drift")))
        .withColumn("explicit_action", ~action.isin(*PASSIVE))
        .withColumn("needs_approval", (F.col("effective_mode") == "recommend")
                    & ~F.col("recommended_action").isin(*PASSIVE))
        .withColumnRenamed("score", "shift_score")
    )


# ---- the action table ------------------------------------------------------------------------

def action_table(spark: SparkSession, custom: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """Known actions with their risk tier, and further ones; a name may appear once only."""
    rows = [(a, "low") for a in BASE_ACTIONS] + [(a, "high") for a in HIGH_RISK] + list(custom)
    names = [a for a, _ in rows]
    if len(set(names)) != len(names):
        raise ValueError("an action is registered twice")
    if {t for _, t in rows} - {"low", "medium", "high"}:
        raise ValueError("tiers are low, medium and high")
    return spark.createDataFrame(rows, "action string, tier string")


def with_tier(decisions: DataFrame, actions: DataFrame, column: str = "recommended_action") -> DataFrame:
    return decisions.join(actions.withColumnRenamed("action", column), column, "left")


# ---- approvals and parameter versions --------------------------------------------------------

def approved(decisions: DataFrame, approvals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Approvals that match a pending recommendation become its action; the others are rejected."""
    on = ["stream_id", "step", "strategy"]
    open_ones = decisions.where("needs_approval").select(*on, "recommended_action")
    good = approvals.join(open_ones, on).select(
        *on, "recommended_action", F.col("approved_action").alias("action_taken"), "approver")
    return good, approvals.join(open_ones, on, "left_anti")


def latest_parameters(params: DataFrame) -> DataFrame:
    rest = [c for c in params.columns if c not in ("stream_id", "version")]
    top = params.groupBy("stream_id").agg(F.max("version").alias("version"),
                                          F.max_by(F.struct(*rest), "version").alias("_p"))
    return top.select("stream_id", "version", "_p.*")


def kept_versions(params: DataFrame, last: int) -> DataFrame:
    """The last versions of every stream; versions count up by one."""
    top = params.groupBy("stream_id").agg(F.max("version").alias("_top"))
    return params.join(top, "stream_id").where(F.col("version") > F.col("_top") - last).drop("_top")


def rolled_back(params: DataFrame, targets: DataFrame) -> DataFrame:
    """Old values as a new version, with the version they come from."""
    top = params.groupBy("stream_id").agg(F.max("version").alias("_top"))
    old = params.join(targets.withColumnRenamed("to_version", "version"), ["stream_id", "version"])
    new = old.join(top, "stream_id").withColumn("restored_from", F.col("version")).withColumn(
        "version", F.col("_top") + 1).drop("_top")
    return params.withColumn("restored_from", F.lit(None).cast(new.schema["restored_from"].dataType)).unionByName(new)

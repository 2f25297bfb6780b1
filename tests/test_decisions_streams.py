"""Governed decisions, folds against plain loops, and streams against the batch answer."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from driftgauge.operators import decisions as D
from driftgauge.operators import learning as M
from driftgauge.operators import regimes as G
from driftgauge.operators import windows as W
from driftgauge.streaming import live

QUIET = dict(score=0.5, feature_score=0.3, output_score=0.05, collapse_risk=0.0, alert=False, severe=False, mean_p=0.3, mean_conf=0.8,
             ref_mean_p=0.3, ref_mean_conf=0.8, e_value=0.6, conf68=0.9, conf80=0.7, conf90=0.5, profile="general", signature="stable",
             saturated=False, opportunity=0.5, uncertainty="hold_threshold", half_width=0.2, hold_first=False, advice=None,
             recent_accuracy=None, drift_score=0.0, loss_block=False, allowed=list(D.BASE_ACTIONS))


def inputs(spark, n, **change):
    rows = [{**QUIET, **{k: (v[i] if isinstance(v, list) and k != "allowed" else v) for k, v in change.items()},
             "stream_id": "s", "step": i} for i in range(n)]
    schema = ("stream_id string, step long, " + ", ".join(f"{k} double" for k in (
        "score feature_score output_score collapse_risk mean_p mean_conf ref_mean_p ref_mean_conf e_value conf68 conf80 conf90 "
        "opportunity half_width recent_accuracy drift_score").split()) + ", alert boolean, severe boolean, saturated boolean, "
        "hold_first boolean, loss_block boolean, profile string, signature string, uncertainty string, advice string, allowed array<string>")
    names = [c.split()[0] for c in schema.split(", ")]
    return spark.createDataFrame([tuple(r[c] for c in names) for r in rows], schema)


def run(spark, df, strategy, rules=D.Rules()):
    return D.decide(df, [strategy], rules).orderBy("step").toPandas()


def test_budget_blocks_and_downgrades(spark):
    bn = dict(score=1.3, feature_score=1.2, alert=True)
    got = run(spark, inputs(spark, 40, **bn), "multi_action", D.Rules(max_actions=3))
    assert (got["action_taken"] == "bn_refresh").sum() == 6
    blocked = got[got["budget_limited"]]
    assert set(blocked["effective_mode"]) == {"recommend"} and blocked["step"].min() == 6
    # Steps 0, 2, 4 act; the window of 24 steps opens again at step 24.
    assert got[got["action_taken"] == "bn_refresh"]["step"].tolist() == [0, 2, 4, 24, 26, 28]


def test_budget_window_longer_than_a_float_holds(spark):
    got = run(spark, inputs(spark, 130, score=1.3, feature_score=1.2, alert=True), "multi_action", D.Rules(max_actions=2, window=100))
    assert got[got["action_taken"] == "bn_refresh"]["step"].tolist() == [0, 2, 100, 102]


@pytest.mark.parametrize("mode", ["shadow", "recommend"])
def test_quiet_modes_take_nothing(spark, mode):
    got = run(spark, inputs(spark, 6, score=1.3, feature_score=1.2, alert=True), "multi_action", D.Rules(mode=mode))
    assert set(got["action_taken"]) == {"none"} and "bn_refresh" in set(got["recommended_action"])


def test_controller_cools_down_and_resets(spark):
    got = run(spark, inputs(spark, 9, score=2.0, severe=True, alert=True), "controller", D.Rules())
    assert got["recommended_action"].tolist() == ["adapt", "hold", "hold", "adapt", "hold", "hold", "reset", "hold", "hold"]
    assert set(got["action_taken"]) <= {"none", "hold"}


def test_scheduled_interval(spark):
    got = run(spark, inputs(spark, 12), "scheduled_retrain")
    assert got[got["recommended_action"] == "adapt"]["step"].tolist() == [5, 11]


def test_custom_policy(spark):
    rules = D.Rules(policies={"cooler": lambda r, c, risky, st: ("cool_confidence", "always")})
    assert set(run(spark, inputs(spark, 3), "cooler", rules)["action_taken"]) == {"cool_confidence"}


def test_actions_are_named_once(spark):
    with pytest.raises(ValueError):
        D.action_table(spark, [("reset", "low")])


def test_blocks_of_splits_find_the_first_cut(monkeypatch):
    monkeypatch.setattr(W.SplitSums, "SIZES", (4, 16))
    monkeypatch.setattr(W.SplitSums, "_tested", lambda self, a, b, log, real=W.SplitSums._tested: tried.append(b - a) or real(self, a, b, log))
    for seed in range(6):
        rng = np.random.default_rng(seed)
        values = np.concatenate([rng.random(150) * 0.5, rng.random(150) * 0.5 + 0.3, rng.normal(size=60), [np.nan, 0.1]])
        tried, window, state = [], [], W.SplitSums(np.empty(0))
        every = 0
        for x in values:
            window.append(x)
            state.add(x)
            n0 = np.arange(1, len(window))
            head, n1 = np.cumsum(window), len(window) - n0
            wide = np.abs(head[:-1] / n0 - (head[-1] - head[:-1]) / n1) >= np.sqrt(0.5 * (1 / n0 + 1 / n1) * np.log(2.0 * len(window) / 0.002))
            every += len(n0)
            cut = state.cut(0.002)
            assert cut == (int(np.argmax(wide)) + 1 if wide.any() else None)
            if cut:
                window, state = window[cut:], W.SplitSums(state.values[cut:state.n])
        assert sum(tried) < every / 2


def test_adaptive_window_finds_a_jump(spark):
    v = [0.1] * 200 + [0.9] * 200
    df = spark.createDataFrame([("s", i, x) for i, x in enumerate(v)], "stream_id string, step long, e double")
    got = W.adaptive_window(df, "e").toPandas()
    first = got[got["drift"]]["step"].min()
    assert 200 <= first < 240 and not got[got["step"] < 200]["drift"].any()


def test_bucketed_window_of_a_long_stream(spark):
    n = 100_000
    df = spark.range(n).select(F.lit("s").alias("stream_id"), F.col("id").alias("step"), F.when(F.col("id") < 60_000, 0.1).otherwise(0.3).alias("e"))
    got = W.bucketed_window(df, "e").toPandas().sort_values("step")
    first = got[got["drift"]]["step"].min()
    assert 60_000 <= first < 60_400 and got["buckets"].max() <= 5 * 17 and got["window_size"].iloc[-1] < 41_000
    assert not got[got["step"] < 60_000]["drift"].any()


def test_rolling_index_restarts(spark):
    h = [[48.0] + [0.0] * 9] * 5 + [[0.0] * 9 + [48.0]] * 12
    df = spark.createDataFrame([("s", i, x) for i, x in enumerate(h)], "stream_id string, step long, counts array<double>")
    got = W.rolling_psi(df).toPandas()
    assert got[got["drift"]]["step"].tolist() == [9, 14]


def test_bandit_against_numpy(spark):
    rng = np.random.default_rng(0)
    x, r, a = rng.normal(size=(50, 9)), rng.random(50), rng.choice(["none", "adapt"], 50)
    df = spark.createDataFrame([("s", str(k), [float(v) for v in row], float(w)) for k, row, w in zip(a, x, r)],
                               "stream_id string, action string, x array<double>, reward double")
    sol = M.bandit_solutions(M.bandit_statistics(df, ["stream_id", "action"]), ["stream_id", "action"]).toPandas().set_index("action")
    for k in ("none", "adapt"):
        m = np.eye(9) + x[a == k].T @ x[a == k]
        assert np.allclose(sol.loc[k, "theta"], np.linalg.solve(m, x[a == k].T @ r[a == k]))


def test_support_passes_over_copies(spark):
    # The copies score highest, so the first of them sets the label that near copies are compared with.
    rows = [("r", i, 5.0, 0.0, 1, 2.0) for i in range(60)] + [("r", 100 + i, float(i), 1.0, i % 2, 0.5) for i in range(6)]
    df = spark.createDataFrame(rows, "k string, id long, a double, b double, y int, w double")
    got = G.diverse_support(df, "k", ["a", "b"], "y", F.col("w"), "id", size=5).toPandas()
    assert len(got) == 5 and got["picked"].all() and (got["id"] < 100).sum() == 1


def regime_events(spark, vectors, reveals):
    d = spark.createDataFrame([("s", i, v) for i, v in enumerate(vectors)], "stream_id string, step long, e array<double>")
    r = spark.createDataFrame([("s", *x) for x in reveals], "stream_id string, step long, reveal_step long, reward double, batch_accuracy double, label_rate double")
    return G.feedback_events(d, r, "e")


def test_regimes_come_back(spark):
    events = regime_events(spark, [[1.0, 0.0] if (i // 5) % 2 == 0 else [0.0, 1.0] for i in range(20)], [])
    pdf = G.assign_regimes(events, 2).orderBy("step").toPandas()
    assert pdf["prototype"].tolist() == ([0] * 5 + [1] * 5) * 2 and pdf["prototypes"].max() == 2


def test_a_reveal_reaches_the_prototype_of_its_decision(spark):
    # Step 1 founds prototype 1; its labels come at step 4, while prototype 0 is at work.
    events = regime_events(spark, [[1.0, 0.0], [0.0, 1.0], [1.0, 0.0], [1.0, 0.0], [1.0, 0.0], [0.0, 1.0]], [(1, 4, 0.9, 0.95, 0.2), (0, 4, 0.1, 0.3, 0.2)])
    out = G.assign_regimes(events, 2).toPandas()
    first, second = (out[(out["kind"] == 1) & (out["step"] == s)].iloc[0] for s in (0, 1))
    # Step 0 is told first: 0.3 is below 0.82 * 0.5 + 0.18 * 0.3; then 0.95 is above its running mean.
    assert (first["prototype"], first["successful"], second["prototype"], second["successful"]) == (0, False, 1, True)
    assert abs(second["prototype_reward"] - (0.84 * 0.5 + 0.16 * 0.9)) < 1e-12 and abs(first["prototype_reward"] - (0.84 * 0.5 + 0.16 * 0.1)) < 1e-12
    later = out[(out["kind"] == 0) & (out["step"] == 5)].iloc[0]
    assert later["prototype"] == 1 and abs(later["prototype_reward"] - second["prototype_reward"]) < 1e-12
    last = {r["prototype"]: r for r in G.last_prototypes(events, 2).collect()}
    assert last[1]["last_seen_step"] == 5 and last[1]["count"] == 2 and abs(last[1]["reward"] - second["prototype_reward"]) < 1e-12


def test_the_weakest_prototype_gives_way(spark):
    axes = np.eye(4)
    events = regime_events(spark, [axes[0].tolist(), axes[1].tolist(), axes[2].tolist()], [(0, 1, 1.0, 0.9, 0.5)])
    out = G.assign_regimes(events, 4, limit=2).toPandas()
    assert out[(out["kind"] == 0) & (out["step"] == 2)].iloc[0]["prototype"] == 1


def test_unrevealed_decisions_come_out_after_the_watermark(spark, tmp_path):
    ts = pd.date_range("2024-01-01", periods=40, freq="h")
    far = pd.Timestamp("2024-02-01")
    d = pd.DataFrame({"event_id": range(41), "ts": [*ts, far]})
    r = pd.DataFrame({"event_id": [*range(0, 40, 2), 99], "label": 1, "reveal_ts": [*(ts[::2] + pd.Timedelta("5h")), far]})
    spark.createDataFrame(d).coalesce(1).write.parquet(str(tmp_path / "d"))
    spark.createDataFrame(r).coalesce(1).write.parquet(str(tmp_path / "r"))
    out = live.revealed(live.table_stream(spark, str(tmp_path), "d"), live.table_stream(spark, str(tmp_path), "r"),
                        ["event_id"], "24 HOURS")
    live.run_available(out, str(tmp_path / "o"), str(tmp_path / "c"))
    got = spark.read.parquet(str(tmp_path / "o")).toPandas()
    early = got[got["event_id"] < 40]
    assert sorted(early["event_id"]) == list(range(40))
    assert early[early["label"].notna()]["event_id"].tolist() and (early[early["label"].notna()]["event_id"] % 2 == 0).all()
    assert early["label"].notna().sum() == 20


def test_topic_options():
    o = live.TopicSource("h:9092", "events", "labels", security={"security.protocol": "SASL_SSL"}).options()
    assert o["subscribe"] == "events,labels" and o["startingOffsets"] == "earliest" and o["kafka.security.protocol"] == "SASL_SSL"


def test_inputs_of_residual_learning_are_those_of_the_reveal(spark):
    from driftgauge.operators import learning as M

    delay, jitter, n = 3, 1, 14
    score, capital, rel = ([((7 * i + k) % 10) / m for i in range(n)] for k, m in ((1, 10), (4, 0.3), (6, 10)))
    df = spark.createDataFrame([("s", i, n, score[i], capital[i], rel[i], 0.9) for i in range(n)],
                               "stream_id string, step long, n_steps long, score double, capital double, reliability double, ref_mean_conf double")
    got = {r["step"]: r for r in M.reveal_inputs(df, delay, jitter).collect()}
    cap, running, out, top = 1 / 25, [], [], -1
    for i in range(n):
        cap = 0.82 * cap + 0.18 * min(capital[i], 25) / 25
        running.append(cap)
        top = max(top, i + max(0, delay + (7 * i + delay) % (2 * jitter + 1) - jitter))
        out.append(min(top, n - 1))
    known = 0.9
    for i in range(n):
        known, t = 0.82 * known + 0.18 * rel[i], out[i]
        ages = [t - k for k in range(t) if out[k] >= t]
        stale = sum(a >= max(4, 2 * delay) for a in ages) / len(ages) if ages else 0.0
        weight = 1 / (1 + 0.06 * max(0, t - i - 1) + 0.03 * max(0, len(ages) - 1) + 0.35 * stale)
        want = (score[t] - (score[t - 1] if t else 0), running[t], known, stale, weight)
        assert all(abs(a - b) < 1e-9 for a, b in zip(got[i][2:], want)), (i, got[i], want)


def test_residual_learning_step_by_step(spark):
    rng = np.random.default_rng(9)
    n, width, rank = 60, 3, 2
    rows = []
    for i in range(n):
        rows.append(("s", i, rng.normal(size=width).tolist(), float(rng.uniform(-1, 1)), float(rng.random()), float(rng.random()), float(rng.uniform(0.2, 1.2)),
                     float(rng.random()), int(rng.integers(-1, 3)), float(rng.random()), float(rng.random()), float(rng.random()), (rng.random(3) * rng.integers(0, 2, 3)).tolist(),
                     (5 * rng.normal(size=rank)).tolist(), float(5 * rng.normal()), bool(i % 3)))
    df = spark.createDataFrame(rows, "stream_id string, step long, x array<double>, mean_residual double, label_rate double, mean_p double, delay_weight double, stale_share double, "
                               "prototype int, recurrence double, similarity double, reward double, gates array<double>, rank_gradient array<double>, rank_bias_gradient double, learn_ranks boolean")
    got = M.residual_path(df, width, rank).orderBy("step").collect()

    def clip(v, b):
        return float(np.clip(v, -b, b))

    gw, gb, gr, gt = np.zeros(width), 0.0, 0.0, 0.0
    ew, eb, et = np.zeros((3, width)), np.zeros(3), np.zeros(3)
    protos, rw, rb = {}, np.zeros(rank), 0.0
    for out, (_, _, x, res, rate, p, weight, stale, k, rec, sim, reward, gates, grad, bgrad, ranks) in zip(got, rows):
        x, grad, w = np.array(x), np.array(grad), min(max(weight, 0.35), 1)
        lr, tlr = 0.12 * w, 0.04 * w
        gap = clip(rate - p, 1)
        short, push = clip(0.65 * res + 0.35 * gap, 1), clip(-gap, 0.5)
        gw += lr * res * x
        gb, gr, gt = clip(gb + lr * res, 0.75), clip(0.82 * gr + 0.18 * short, 0.75), clip(gt + tlr * push, 0.15)
        if ranks:
            step = 0.035 * w * min(max(1 - 0.25 * stale, 0.6), 1)
            rw, rb = np.clip(rw + step * grad, -0.45, 0.45), clip(rb + step * bgrad, 0.35)
        for e, g in enumerate(gates):
            if g > 0.05:
                ew[e] = np.clip(ew[e] + lr * g * short * x, -0.6, 0.6)
                eb[e], et[e] = clip(eb[e] + lr * g * short, 0.75), clip(et[e] + tlr * g * push, 0.15)
        delta, shift = gw @ x + gb + gr, gt
        if k >= 0:
            pw, pb, pr, pt = protos.get(k, (np.zeros(width), 0.0, 0.0, 0.0))
            local = lr * min(max(0.5 + 0.35 * rec + 0.15 * sim, 0.4), 1.15)
            protos[k] = pw, pb, pr, pt = (np.clip(pw + local * short * x, -0.5, 0.5), clip(pb + lr * gap, 0.75), clip(0.78 * pr + 0.22 * short, 0.75),
                                          clip(pt + 1.15 * tlr * push, 0.15))
            trust = min(max(0.55 * rec + 0.3 * sim + 0.15 * max(0, reward - 0.5), 0), 1)
            delta, shift = delta + trust * (pw @ x + pb) + pr, shift + pt
        delta += sum(g * (ew[e] @ x + eb[e]) for e, g in enumerate(gates))
        shift += sum(g * et[e] for e, g in enumerate(gates))
        assert abs(out["delta"] - clip(delta, 0.95)) < 1e-9 and abs(out["threshold"] - min(max(0.5 + clip(shift, 0.2), 0.05), 0.95)) < 1e-9
        assert np.allclose(out["rank_weights"], rw) and abs(out["rank_bias"] - rb) < 1e-9

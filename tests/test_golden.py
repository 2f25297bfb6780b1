"""Hand-computed cases."""

import math

import pytest
from pyspark.sql import functions as F

from driftgauge.operators import drift as D
from driftgauge.operators import evidence as E
from driftgauge.operators import labels as L
from driftgauge.operators import metrics as M
from driftgauge.operators import prepare as P


def outcomes(spark, y, h, steps):
    return spark.createDataFrame([("s", a, b, float(b), s, i) for i, (a, b, s) in enumerate(zip(y, h, steps))],
                                 "k string, y int, yhat int, p double, step long, rid long")


def test_temporal_split(spark):
    df = spark.createDataFrame([(t,) for t in (10, 20, 30, 40, 50, 60)], "t long")
    got = {r["t"]: r["part"] for r in P.temporal_split(df, [F.col("t")], 0.5).collect()}
    assert [t for t, p in got.items() if p == "train"] == [10, 20, 30]


def test_recent_tail(spark):
    df = spark.createDataFrame(list(zip(range(1, 7), (0, 0, 0, 1, 1, 1))), "t long, y int")
    assert sorted(r["t"] for r in P.recent_tail(df, [F.col("t")], 0.5).collect()) == [4, 5, 6]


def test_balanced_accuracy_of_one_class(spark):
    o = outcomes(spark, (0, 0, 0, 0, 1, 1), (0,) * 6, (0, 0, 1, 1, 2, 2))
    h = M.classification(M.with_halves(o, ["k"]), ["k", "half"]).collect()
    assert {r["half"]: r["balanced_accuracy"] for r in h} == {"first": 1.0, "second": 0.5}


def test_half_recall_falls(spark):
    o = outcomes(spark, (1, 1, 0, 0, 1, 1, 0, 0), (1, 1, 0, 0, 0, 0, 0, 0), (0, 0, 1, 1, 2, 2, 3, 3))
    r = M.half_deltas(o, ["k"]).first()
    assert (r["first_recall"], r["second_recall"], r["recall_delta"]) == (1.0, 0.0, -1.0)


def test_cost_rises(spark):
    o = outcomes(spark, (1, 0, 1, 0), (0, 0, 1, 1), (0,) * 4)
    assert [M.classification(o, ["k"], 1.0, c).first()["cost_weighted_error"] for c in (1.0, 20.0)] == [0.5, 5.25]


def test_events_avoided_and_risk_reduction(spark):
    rows = [("s", st, i, cap, bad, bad) for st, cap, bad in (("frozen", 10.0, True), ("controller", 8.0, False)) for i in range(4)]
    s = spark.createDataFrame(rows, "stream_id string, strategy string, step long, capital double, risk_alert boolean, retrain_recommended boolean")
    s = (s.withColumns({c: F.lit(0.5) for c in ("accuracy", "utility", "shift_score", "reliability")})
         .withColumns({c: F.lit(0.0) for c in ("parameter_drift", "flipped")})
         .withColumns({c: F.lit(False) for c in ("correction_applied", "explicit_action", "budget_limited")})
         .withColumns({c: F.lit("none") for c in ("action_taken", "recommended_action")}).withColumn("safety_ok", F.lit(True)))
    v = E.versus_baseline(E.strategy_summary(s), E.harmful_events(s)).first()
    assert v["events_avoided"] == 4 and v["risk_reduction"] == 1.0 and v["retrain_deferral"] == 4


def test_concentration(spark):
    r = spark.range(1).select(D.concentration(F.lit(1), F.lit(21)).alias("c")).first()
    assert r["c"] == 20 / 21


def test_label_warnings(spark):
    rows = [("odd", v) for v in (0.0, 1.0, 2.0, -1.0, 0.0)] + [("nan", math.nan), ("nan", 1.0)]
    rows += [("zero", 0.0)] * 3 + [("one", 1.0)] * 3 + [("empty", None)] + [("rare", 0.0)] * 199 + [("rare", 1.0)]
    got = {r["k"]: r["warnings"] for r in P.label_warnings(spark.createDataFrame(rows, "k string, y double"), ["k"], "y").collect()}
    assert got == {"odd": ["out_of_range_labels"], "nan": ["non_finite_labels"], "zero": ["all_negative_labels"],
                   "one": ["all_positive_labels"], "empty": ["empty_label_array"], "rare": ["extreme_class_imbalance_low"]}


def test_second_reveal_is_rejected(spark):
    r = spark.createDataFrame([("b", 1, 0), ("b", 2, 1), ("c", 3, 1)], "batch string, at long, y int")
    good, bad = L.first_reveals(r, ["batch"], "at")
    assert sorted(x["at"] for x in good.collect()) == [1, 3] and [x["at"] for x in bad.collect()] == [2]


@pytest.mark.parametrize("delay,jitter", [(12, 6), (3, 5), (1, 0), (0, 0)])
def test_visible_at_is_the_queue(spark, delay, jitter):
    n, queue, want = 60, [], {}
    for t in range(n):
        d = max(0, delay + ((t * 7 + delay) % (2 * jitter + 1)) - jitter) if jitter and delay else delay
        queue.append((t, d))
        while queue and t - queue[0][0] >= queue[0][1]:
            want[queue.pop(0)[0]] = t
    got = {r["id"]: r["v"] for r in spark.range(n).select("id", L.visible_at(F.col("id"), delay, jitter).alias("v")).collect()}
    assert {k: v for k, v in got.items() if v < n} == want


def test_infinite_and_missing_values(spark):
    df = spark.createDataFrame([(1.0,), (3.0,), (math.inf,), (math.nan,), (None,)], "x double")
    assert sorted(r["x"] for r in P.filled(df, ["x"], P.medians(df, ["x"])).collect()) == [1.0, 2.0, 2.0, 2.0, 3.0]


def test_malformed_batch_messages_come_out_with_an_error(spark):
    from driftgauge.sources import payloads

    texts = ['{"batch_id":"a","features":[[1,2],[3,4]],"labels":[0,1]}', "not json", '{"features":[[1]]}', '{"batch_id":"b","features":[1,2]}',
             '{"batch_id":"c","features":[[1],[2]],"labels":[1]}']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "n long, value string")
    got = {}
    for r in payloads.parse_batches(df).collect():
        got.setdefault(r["n"], []).append((r["row"], r["label"], r["error"]))
    assert sorted(got[0]) == [(0, 0, None), (1, 1, None)]
    assert {n: [x[2] for x in v] for n, v in got.items() if n} == {
        1: ["bad_message"], 2: ["missing_id"], 3: ["features_not_a_matrix"], 4: ["labels_length"]}
    labels = {r["n"]: r["error"] for r in payloads.parse_labels(df).collect()}
    assert labels == {0: None, 1: "bad_message", 2: "bad_message", 3: "labels_not_array", 4: None}

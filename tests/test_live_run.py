"""The live run: gaps, repetitions, a full queue, versions of the reference, state carried over, and the audit log and repairs of late labels."""

from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from driftgauge.operators import decisions as D
from driftgauge.plans.live_queries import FAR
from driftgauge.streaming import governed as G
from driftgauge.streaming import live

DAY = datetime(2024, 1, 1)
ROW = dict(score=0.5, feature_score=0.3, output_score=0.05, collapse_risk=0.0, alert=False, severe=False, mean_p=0.3, mean_conf=0.8, ref_mean_p=0.3,
           ref_mean_conf=0.8, positive_rate=0.3, conf68=0.9, conf80=0.7, conf90=0.5, profile="general", signature="stable", saturated=False, opportunity=0.5,
           uncertainty="hold_threshold", half_width=0.2)


def steps(spark, numbers, hour=None, e=1.2):
    rows = [("s", n, DAY + timedelta(hours=n if hour is None else hour), e + n / 100, 1.0, 0.9) for n in numbers]
    df = spark.createDataFrame(rows, "stream_id string, step long, closed_at timestamp, e_value double, miss double, batch_accuracy double")
    return df.withColumns({**{k: F.lit(v) for k, v in ROW.items()}, "advice": F.lit(None).cast("string"), "recent_accuracy": F.lit(None).cast("double"),
                           "allowed": F.array(*[F.lit(a) for a in D.BASE_ACTIONS])})


def run(spark, path, parts, late="1 hour", name="a", **options):
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(f"{path}/in-{name}")
    stream = live.table_stream(spark, str(path), f"in-{name}", files_per_trigger=1).withWatermark("closed_at", late)
    live.run_available(G.governed(stream, **options), f"{path}/out-{name}", f"{path}/ck-{name}")
    return spark.read.parquet(f"{path}/out-{name}").toPandas()


def capitals(numbers, e=1.2):
    c, out = 1.0, {}
    for n in numbers:
        c = min(100.0, max(1.0, c * 0.92 * (e + n / 100)))
        out[n] = c
    return out


def test_a_gap_is_passed_over_after_its_time(spark, tmp_path):
    got = run(spark, tmp_path, [steps(spark, [0, 1, 3, 4]), steps(spark, [6]), steps(spark, [20])], patience="2 hours")
    done = got[got["status"] == "decided"].set_index("step")
    # The watermark of the last file is 19:00: steps 3, 4 and 6 are due, step 20 still waits for 7 to 19.
    assert done["skipped"].to_dict() == {0: 0, 1: 0, 3: 1, 4: 0, 6: 1}
    want = capitals([0, 1, 3, 4, 6])
    assert all(abs(done["capital"][n] - c) < 1e-12 for n, c in want.items())


def test_repeated_late_and_rejected_steps(spark, tmp_path):
    got = run(spark, tmp_path, [steps(spark, [0, 1, 2, 3]), steps(spark, [0, 2, 5, 6, 7], hour=9, e=9.0), steps(spark, [4, 6], hour=9)], late="30 days", limit=2, remember=2)
    seen = sorted(zip(got["step"], got["status"]))
    assert seen == [(0, "decided"), (0, "late"), (1, "decided"), (2, "decided"), (2, "repeated"), (3, "decided"), (4, "decided"), (5, "decided"), (6, "decided"),
                    (6, "repeated"), (7, "rejected")]
    two = got[got["step"] == 2].sort_values("status")
    assert two["capital"].nunique() == 1 and two["action_taken"].nunique() == 1


def test_state_is_saved_and_taken_over(spark, tmp_path):
    whole = run(spark, tmp_path, [steps(spark, range(30))], name="whole").set_index("step")
    one = run(spark, tmp_path, [steps(spark, [*range(12), 14, 15])], name="one")
    state = G.saved_state(spark, str(tmp_path / "ck-one"))
    assert [(r["stream_id"], r["position"]) for r in state.collect()] == [("s", 12)]
    with pytest.raises(Exception):
        G.load_state(spark, str(tmp_path / "store"))
    G.save_state(state, str(tmp_path / "store"), 1)
    # A version that was written but not listed is not loaded.
    state.withColumn("position", F.lit(99).cast("long")).write.parquet(str(tmp_path / "store/states/version=2"))
    two = run(spark, tmp_path, [steps(spark, [16, 17, 12]), steps(spark, [13, *range(18, 30)])], name="two", late="30 days", initial=G.load_state(spark, str(tmp_path / "store")))
    both = pd.concat([one, two]).query("status == 'decided'").set_index("step").sort_index()
    assert both.index.tolist() == list(range(30))
    for c in ("capital", "alpha", "shift_mean", "capital_mean", "accuracy_mean", "cooldown", "actions_used", "action_taken"):
        assert both[c].tolist() == whole.sort_index()[c].tolist()
    with pytest.raises(ValueError):
        G.load_state(spark, str(tmp_path / "store"), 7)


def test_governed_runs_in_a_session_with_the_default_store(spark, tmp_path):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    default = "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"
    spark.conf.set(name, default)
    try:
        steps(spark, [0, 1, 2]).coalesce(1).write.parquet(f"{tmp_path}/in")
        stream = live.table_stream(spark, str(tmp_path), "in").withWatermark("closed_at", "1 hour")
        live.run_available(G.governed(stream), f"{tmp_path}/out", f"{tmp_path}/ck", keyed=True)
        assert spark.conf.get(name) == default
        assert G.saved_state(spark, f"{tmp_path}/ck").first()["position"] == 3
        assert spark.read.parquet(f"{tmp_path}/out").where("status = 'decided'").count() == 3
    finally:
        spark.conf.set(name, before)


def test_state_of_long_budget_windows(spark, tmp_path):
    rules = D.Rules(window=100, max_actions=2)
    shift = [steps(spark, range(i, i + 26)).withColumns({"score": F.lit(1.3), "feature_score": F.lit(1.2), "alert": F.lit(True), "e_value": F.lit(0.6)}) for i in (0, 26, 52, 78, 104)]
    got = run(spark, tmp_path, shift, late="300 days", rules=rules)
    assert sorted(got[got["action_taken"] == "bn_refresh"]["step"]) == [0, 2, 100, 102]


def test_the_reference_version_in_force(spark, tmp_path):
    rows = [("s", n, DAY + timedelta(hours=n), 10 * n + i, (n * 7 + i) % 10 / 10, i % 2, float(n)) for n in range(8) for i in range(4)]
    rows.append(("", None, datetime.fromisoformat(FAR), None, None, None, None))
    df = spark.createDataFrame(rows, "stream_id string, step long, closed_at timestamp, event_id long, p double, y int, f0 double")
    df.coalesce(1).write.parquet(str(tmp_path / "rows"))
    from driftgauge.operators import batches as B
    stats = B.batch_stats(df.where("step IS NOT NULL").withColumn("n_steps", F.lit(8)), ["f0"])
    first = G.reference_versions(stats, 1)
    change = F.lit(DAY + timedelta(hours=4)).cast("timestamp")
    versions = G.next_version(first, G.reference_versions(stats.withColumn("n_steps", F.lit(24)), 1), change)
    assert sorted((r["version"], r["valid_from"] is None, r["valid_to"] is None) for r in versions.collect()) == [(1, True, False), (2, False, True)]
    out = G.live_signals(live.table_stream(spark, str(tmp_path), "rows"), ["f0"], versions, "1 day")
    live.run_available(out, str(tmp_path / "out"), str(tmp_path / "ck"))
    got = {r["step"]: (r["reference_version"], r["ref_batches"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {n: (1, 2) if n < 4 else (2, 6) for n in range(8)}


def test_trends_match_the_windows(spark):
    import numpy as np

    from driftgauge.operators import windows as W

    rng = np.random.default_rng(2)
    rows = [("s", i, *map(float, rng.random(5))) for i in range(50)]
    names = "positive_rate mean_conf output_score score collapse_risk"
    df = spark.createDataFrame(rows, "stream_id string, step long, " + ", ".join(f"{n} double" for n in names.split()))
    for r in W.trend_columns(df).collect():
        past = [tuple(x[2:]) for x in rows[max(0, r["step"] - 31):r["step"] + 1]]
        assert np.allclose(G.trend_of(past), (r["drift_score"], r["shift_slope"], r["loss_slope"]))


# ---- audit log and repairs -------------------------------------------------------------------

def records(spark, ids, day):
    names = "record_id stream_id step strategy".split()
    return spark.createDataFrame([(f"r{i}", "s", i, "x", datetime(2024, 1, day, 12)) for i in ids], "record_id string, stream_id string, step long, strategy string, recorded_at timestamp") \
        .select(*names, "recorded_at")


def files(path):
    return {str(p.relative_to(path)): p.stat().st_mtime_ns for p in path.rglob("*.parquet")}


def test_a_repeated_micro_batch_changes_nothing(spark, tmp_path):
    log = tmp_path / "log"
    write = live.audit_writer(str(log))
    write(records(spark, range(5), 1).unionByName(records(spark, [3], 1)), 0)
    write(records(spark, range(3, 8), 1).unionByName(records(spark, [20], 2)), 1)
    before = sorted(r["record_id"] for r in spark.read.parquet(str(log)).collect())
    assert before == sorted([*(f"r{i}" for i in range(8)), "r20"])
    kept = files(log)
    write(records(spark, range(3, 8), 1).unionByName(records(spark, [20], 2)), 1)
    assert sorted(r["record_id"] for r in spark.read.parquet(str(log)).collect()) == before
    now = files(log)
    assert {k: v for k, v in kept.items() if "epoch=0" in k} == {k: v for k, v in now.items() if "epoch=0" in k}


def test_the_log_is_read_for_the_days_at_hand(spark, tmp_path, monkeypatch):
    from driftgauge.sources import sinks

    log, plans = tmp_path / "log", []
    sinks.append_audit(records(spark, range(5), 1).unionByName(records(spark, range(50, 60), 2)), str(log), 0)
    real = sinks.replace_partitions
    monkeypatch.setattr(sinks, "replace_partitions", lambda df, path, parts: (plans.append(df._jdf.queryExecution().executedPlan().toString()), real(df, path, parts))[1])
    sinks.append_audit(records(spark, range(50, 62), 2), str(log), 7)
    assert "PartitionFilters" in plans[0] and "2024-01-02" in plans[0] and "2024-01-01" not in plans[0]
    assert spark.read.parquet(str(log)).count() == 17


def test_repair_rewrites_only_the_days_that_late_labels_touch(spark, tmp_path):
    from driftgauge.streaming import repair

    decided = spark.createDataFrame([(f"2024-01-0{1 + i // 10}", "s", i // 5, i, 0.9) for i in range(40)], "day string, stream_id string, step int, event_id int, p double") \
        .withColumn("day", F.to_date("day"))
    labels = spark.createDataFrame([(i, i % 2, datetime(2024, 1, 5)) for i in range(40)], "event_id int, label int, reveal_ts timestamp")
    timely = labels.where("event_id % 10 < 7")
    table, side = tmp_path / "table", tmp_path / "side"
    from driftgauge.sources import sinks
    sinks.replace_partitions(repair.outcomes(decided, timely), str(table), ["day"])
    before = files(table)
    late = labels.where("event_id % 10 >= 7 AND event_id BETWEEN 10 AND 29")
    for _ in range(2):  # a repeated epoch and a repeated job change nothing
        repair.keep_late(late, decided, str(side), 3)
        assert len(repair.repair(decided, timely, spark.read.parquet(str(side)), str(table))) == 2
    after = files(table)
    same = {k for k in before if after.get(k) == before[k]}
    assert {k.split("/")[0] for k in same} == {"day=2024-01-01", "day=2024-01-04"} and len(same) == len([k for k in before if k[:14] in ("day=2024-01-01", "day=2024-01-04")])
    got = {r["step"]: (r["revealed"], r["batch_accuracy"]) for r in spark.read.parquet(str(table)).collect()}
    assert got[2][0] == got[3][0] == got[4][0] == got[5][0] == 5 and got[1][0] == 2 and got[7][0] == 2
    assert got[3][1] == 0.6 and got[0][1] == 0.4


def test_ranks_come_from_blocks_of_the_reference(spark):
    scores = [0.0, 0.4, 0.4, 0.8, 0.8, 0.8, 2.0, 2.8, 2.8, 3.6, 6.0]
    rows = spark.createDataFrame([("a", n, DAY + timedelta(hours=n), 0.1 + 0.1 * n, n % 2, 1.0 * n, n) for n in range(10)] + [("b", 0, DAY, 0.5, 1, 1.0, 0)],
                                 "stream_id string, step long, closed_at timestamp, p double, y int, f0 double, event_id long")
    one = spark.createDataFrame([("a", 4, [1.0], [1.0], 0.5, 0.5, 0.5, 0.5, 1, scores), ("b", 4, [1.0], [1.0], 0.5, 0.5, 0.5, 0.5, 1, [])],
                                "stream_id string, ref_batches long, ref_mean array<double>, ref_var array<double>, ref_mean_entropy double, ref_mean_p double, ref_positive_rate double, "
                                "ref_mean_conf double, version int, ref_scores array<double>").withColumns({c: F.lit(None).cast("timestamp") for c in ("valid_from", "valid_to")})
    out = G.live_signals(rows, ["f0"], one, "1 hour")
    got = out.collect()
    assert len(got) == 11 and all(r["tail_count"] == (sum(s >= r["raw_risk"] for s in scores) if r["stream_id"] == "a" else 0) for r in got)
    assert len({r["tail_count"] for r in got}) > 2 and not [c for c in out.columns if c.startswith("_") or c == "ref_scores"]


def test_keyed_state_is_bounded(spark):
    names = [f"spark.sql.streaming.stateStore.rocksdb.{n}" for n in ("boundedMemoryUsage", "maxMemoryUsageMB")]
    before = [spark.conf.get(n, None) for n in names]
    with live.keyed_store(spark):
        assert spark.conf.get(names[0]) == "true" and int(spark.conf.get(names[1])) == live.STORE_MB
    assert [spark.conf.get(n, None) for n in names] == before


def test_answers_come_in_frames_of_bounded_size():
    run = G.GovernedRun("multi_action", D.Rules(), 0, 10, 10)
    made = ({"step": n, "status": "late"} for n in range(2 * G.ROWS_AT_ONCE + 1))
    assert [len(f) for f in run._frames(("s",), made)] == [G.ROWS_AT_ONCE, G.ROWS_AT_ONCE, 1]

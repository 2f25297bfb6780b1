"""Terms, their weights and their reduction against plain Python and numpy."""

import math
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from driftgauge.operators import text as X


def test_terms_and_weights(spark):
    rng = random.Random(3)
    texts = [None, "", "a", "b b-b", "Zoë and the zoë"] + [" ".join(rng.choice("red blue green the x of_1 élan".split()) for _ in range(rng.randrange(40))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = X.terms(df, "doc_id", "text", ["the"])
    want = {}
    for i, t in enumerate(texts):
        words = [w for w in re.split(r"\W+", (t or "").lower()) if len(w) >= 2 and w != "the"]
        for term, n in Counter(words + [f"{a} {b}" for a, b in zip(words, words[1:])]).items():
            want[i, term] = n
    assert {(r["doc_id"], r["term"]): r["tf"] for r in found.collect()} == want
    vocab = X.vocabulary(found, len(texts), 2, 12)
    df_of, total = Counter(t for _, t in want), Counter()
    for (_, t), n in want.items():
        total[t] += n
    kept = sorted((t for t in df_of if df_of[t] >= 2), key=lambda t: (-total[t], t))[:12]
    got = {r["term"]: r for r in vocab.collect()}
    assert set(got) == set(kept) and all(got[t]["df"] == df_of[t] and got[t]["total"] == total[t] for t in kept)
    idf = {t: math.log((1 + len(texts)) / (1 + df_of[t])) + 1 for t in kept}
    for r in X.weighted_terms(found, vocab, "doc_id").collect():
        size = math.sqrt(sum((n * idf[t]) ** 2 for (i, t), n in want.items() if i == r["doc_id"] and t in idf))
        assert abs(r["weight"] - want[r["doc_id"], r["term"]] * idf[r["term"]] / size) < 1e-12


def test_terms_are_not_written_and_keys_may_repeat(spark, monkeypatch):
    written = []
    monkeypatch.setattr(X, "settled", lambda df, real=X.settled: written.append(df.columns) or real(df))
    df = spark.createDataFrame([(1, "red blue"), (1, "red"), (None, "red red")], "doc_id long, text string")
    found = X.terms(df, "doc_id", "text")
    assert {(r["doc_id"], r["term"]): r["tf"] for r in found.collect()} == {(1, "red"): 2, (1, "blue"): 1, (1, "red blue"): 1, (None, "red"): 2, (None, "red red"): 1}
    assert not written


def test_products_of_blocks(spark):
    rng = np.random.default_rng(4)
    w, basis = rng.random((60, 9)) * (rng.random((60, 9)) < 0.3), rng.normal(size=(9, 3))
    rows = spark.createDataFrame([([int(j) for j in np.flatnonzero(r)], [float(r[j]) for j in np.flatnonzero(r)]) for r in w], "i array<long>, x array<double>")
    assert np.allclose(X._blocks(rows, basis), w.T @ (w @ basis))


def test_axes_are_those_of_the_whole_matrix(spark):
    rng = np.random.default_rng(1)
    w = rng.random((200, 40)) * (rng.random((200, 40)) < 0.2)
    df = spark.createDataFrame([(int(i), int(j), float(w[i, j])) for i, j in zip(*np.nonzero(w))], "doc_id long, term_id long, weight double")
    axes, values, residual = X.axes_of(df, "doc_id", 40, 5)
    _, s, v = np.linalg.svd(w)
    assert np.allclose(values, s[:5] ** 2) and residual.max() <= 1e-7
    assert np.allclose(np.abs((axes.T * v[:5]).sum(1)), 1)
    out = X.reduced(df, "doc_id", 40, 5)
    assert out.count() == (w.any(1)).sum() and abs(out.agg(F.stddev_pop("d0")).first()[0] - 1) < 1e-6


def test_axes_of_few_terms(spark):
    df = spark.createDataFrame([(1, 0, 1.0), (2, 1, 1.0), (3, 0, 1.0)], "doc_id long, term_id long, weight double")
    axes, values, _ = X.axes_of(df, "doc_id", 2, 2)
    assert np.allclose(values, [2, 1]) and np.allclose(np.abs(axes), np.eye(2))


def test_keys_over_several_batches_are_counted_once(spark, monkeypatch):
    """Keys that repeat, null ones too, in Arrow batches of a few rows and steps of a few words, against plain counts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        rng = random.Random(8)
        rows = [(None if i % 7 == 0 else i % 9, " ".join(rng.choice("red blue green grey up down".split()) for _ in range(rng.randrange(12)))) for i in range(80)]
        want = Counter()
        for k, t in rows:
            w = t.split()
            want.update((k, x) for x in w + [f"{a} {b}" for a, b in zip(w, w[1:])])
        df = spark.createDataFrame(rows, "doc_id long, text string")
        found = X.terms(df, "doc_id", "text")
        got = found.collect()
        assert len(got) == len(want) and {(r["doc_id"], r["term"]): r["tf"] for r in got} == want
        vocab = X.vocabulary(found, 10, 2, 20)
        kept = {r["term"]: r for r in vocab.collect()}
        df_of, total = Counter(t for _, t in want), Counter()
        for (_, t), n in want.items():
            total[t] += n
        assert all(kept[t]["df"] == df_of[t] and kept[t]["total"] == total[t] for t in kept) and any(" " in t for t in kept)
        size = Counter()
        for (k, t), n in want.items():
            if t in kept:
                size[k] += (n * kept[t]["idf"]) ** 2
        weights = {(r["doc_id"], r["term"]): r["weight"] for r in X.weighted_terms(found, vocab, "doc_id").collect()}
        assert set(weights) == {x for x in want if x[1] in kept}
        assert all(abs(w - want[x] * kept[x[1]]["idf"] / math.sqrt(size[x[0]])) < 1e-12 for x, w in weights.items())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_steps_of_few_words(monkeypatch):
    import pyarrow as pa
    words = [["a", "b"], ["b"], ["a", "a", "b"], None, ["c"], ["b", "c"]]
    keys = [1, 1, 2, 3, None, None]
    batches = [pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(words, pa.list_(pa.string()))], names=["k", "w"])] * 2
    for most in (1, 3, 100):
        monkeypatch.setattr(X, "WORDS_AT_ONCE", most)
        got = pa.Table.from_batches(X._listed(True)(iter(batches))).to_pydict()
        once = {(1, "a"): 1, (1, "b"): 2, (1, "a b"): 1, (2, "a"): 2, (2, "b"): 1, (2, "a a"): 1, (2, "a b"): 1, (None, "c"): 2, (None, "b"): 1, (None, "b c"): 1}
        rows = list(zip(got["key"], got["term"], got["tf"]))
        assert Counter({(k, t): 0 for k, t in once}) + Counter() == Counter() and sorted(rows, key=str) == sorted([(*x, n) for x, n in once.items()] * 2, key=str)


def test_text_rows_are_not_shuffled_as_terms(spark):
    df = spark.createDataFrame([(i, "red blue green " * 50) for i in range(40)], "doc_id long, text string")
    found = X.terms(df, "doc_id", "text")
    plan = X.vocabulary(found, 40)._jdf.queryExecution().executedPlan().toString()
    assert "Generate explode" not in plan and plan.count("MapInArrow") == 1

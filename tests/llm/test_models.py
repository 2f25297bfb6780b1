"""Quality field and toxicity chain: recursions against enumeration, held-out accuracy, defined cases; the pipeline against its stages."""

import itertools
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from driftgauge.llm import mixing, nearcopies, quality, queries, suffix, toxicity
from driftgauge.llm.training import fold, labelled

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return {t: queries.table(spark, FOLDER, t) for t in ("documents", "labels")}


# ---- quality -----------------------------------------------------------------------------------

def test_marginals_by_enumeration():
    rng = np.random.default_rng(0)
    counts, tie = np.array([1, 4, 2, 6]), rng.normal(size=(2, 2))
    score = rng.normal(size=counts.sum())
    want = []
    for at, n in zip(np.cumsum(counts) - counts, counts):
        total = np.zeros(n + 1)
        for y in itertools.product((0, 1), repeat=n):
            w = np.exp(sum(s for s, v in zip(score[at:at + n], y) if v) + sum(tie[a, b] for a, b in zip(y, y[1:])))
            total += w * np.array([*y, 1])
        want += (total[:n] / total[n]).tolist()
    assert np.allclose(quality.marginals(score, counts, tie), want)


def test_fit_follows_the_likelihood():
    rng = np.random.default_rng(1)
    counts, y = rng.integers(1, 6, 40), rng.integers(0, 2, 40)
    x = np.column_stack([np.repeat(y, counts) + rng.normal(size=counts.sum()), np.ones(counts.sum())])
    w, tie = quality.fit(x, counts, y, rounds=300)
    good = quality.marginals(x @ w, counts, tie)
    assert ((good > 0.5) == np.repeat(y, counts)).mean() > 0.9


def test_line_features():
    data, offsets = b"AB cd!!\n\nx x x|" + b"" + b"Q", np.array([0, 15, 15, 16])
    x, length, counts = quality.lines(np.frombuffer(data, np.uint8), offsets)
    assert counts.tolist() == [3, 1, 1] and length.tolist() == [7, 0, 6, 0, 1]
    assert x[0, 0] == pytest.approx(0.5) and x[2, 3] == pytest.approx(1 / 3) and x[3, 12] == 1  # capitals, repeated words, no word
    assert np.allclose(x[1, 13:26], x[0, :13]) and np.allclose(x[1, 26:39], x[2, :13])  # the neighbours' features


def test_quality_held_out(spark, tables):
    model = quality.train(tables["documents"], tables["labels"])
    got = quality.score(tables["documents"], model).withColumn("fold", fold()).join(tables["labels"], "doc_id").filter("fold = 0").toPandas()
    assert (got["predicted"] == got["quality"]).mean() > 0.95 and got["score"].between(0, 1).all()
    odd = spark.createDataFrame([(1, None, 3), (2, "", 3), (2, "", 3), (3, "\n" * 5000, 3), (4, "word " * 30_000, 3)], "doc_id long, text string, score int")
    rows = quality.score(odd, model).collect()
    assert len(rows) == 5 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)


def test_quality_without_labels(spark, tables):
    none = quality.train(tables["documents"], tables["labels"].filter("doc_id < 0"))
    assert {r["score"] for r in quality.score(tables["documents"].limit(5), none).collect()} == {0.5}
    one = quality.train(tables["documents"], tables["labels"].filter("quality = 1"))
    assert {r["score"] for r in quality.score(tables["documents"].limit(5), one).collect()} == {1.0}


# ---- toxicity ----------------------------------------------------------------------------------

def test_toxicity_held_out(spark, tables):
    chain = toxicity.train(tables["documents"], tables["labels"])
    got = toxicity.score(tables["documents"], chain).withColumn("fold", fold()).join(tables["labels"], "doc_id").toPandas()
    clean = got[got["toxic"] == 0]
    assert (clean["predicted"] == 0).mean() > 0.98
    toxic = got[(got["toxic"] == 1) & (got["quality"] == 1)]  # junk labelled toxic holds nothing toxic
    assert (toxic["predicted"] == 1).mean() > 0.9
    odd = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "!!! 123", "x"), (4, "you worthless moron", "x")], "doc_id long, text string, predicted string")
    assert {r["doc_id"]: r["predicted"] for r in toxicity.score(odd, chain).collect()} == {1: 0, 2: 0, 3: 0, 4: 1}
    assert toxicity.score(odd.filter("doc_id < 0"), chain).collect() == []


def test_toxicity_without_labels(spark, tables):
    chain = toxicity.train(tables["documents"], tables["labels"].filter("toxic = 0"))
    assert {r["p_toxic"] for r in toxicity.score(tables["documents"].limit(3), chain).collect()} == {0.0}


def test_sample_leaves_out_held_out_and_contradictions(spark):
    docs = spark.createDataFrame([(i, "t") for i in range(50)] + [(None, "t")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)] + [(1, 0), (None, 1), (2, None), (99, 1)], "doc_id long, toxic int")
    got = labelled(docs, labels, "toxic", 1000).withColumn("fold", fold())
    ids = {r["doc_id"] for r in got.collect()}
    assert got.filter(F.col("fold") == 0).count() == 0 and 1 not in ids and 99 not in ids
    assert labelled(docs, labels, "toxic", 7).count() == 7


# ---- pipeline ----------------------------------------------------------------------------------

def test_pipeline_stages_do_what_their_operators_say(spark, tables):
    docs = tables["documents"]
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, FOLDER)
        assert out.columns == columns
        rows = out.toPandas()
        if name == "toxicity":
            chain = toxicity.train(docs, tables["labels"])
            assert sorted(rows["doc_id"]) == sorted(r[0] for r in toxicity.score(docs, chain).filter("predicted = 0").select("doc_id").collect())
        elif name == "simhash":
            # By brute force: no two documents of 0.8 and more stay, and each that goes is a copy of one that stays.
            sets = {r["doc_id"]: set(nearcopies.shingle_hashes((r["text"] or "").encode()).tolist()) for r in docs.collect()}
            kept = set(rows["doc_id"])

            def alike(a, b):
                return 1.0 if not sets[a] and not sets[b] else len(sets[a] & sets[b]) / len(sets[a] | sets[b])

            assert all(any(alike(i, j) >= 0.8 for j in kept) for i in sets if i not in kept)
            both = sum(alike(i, j) >= 0.8 for i in kept for j in kept if i < j)
            assert both <= 0.02 * (len(sets) - len(kept))
        elif name == "suffix_array":
            assert len(rows) == docs.count()
            cut = {r["doc_id"]: r for r in suffix.dedup(docs).collect()}
            assert all(len(t.encode()) <= cut[i]["n_bytes"] - cut[i]["n_removed"] for i, t in zip(rows["doc_id"], rows["text"]))
        elif name == "mixing":
            copies = {r["doc_id"]: r["mix_copies"] for r in mixing.mix(docs, whole=True).collect()}
            assert rows.groupby("doc_id").size().to_dict() == {i: n for i, n in copies.items() if n}
        docs = spark.createDataFrame(rows, docs.schema)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
    assert last.count() == docs.count() and last.filter("n_tokens != size(ids)").count() == 0


def test_pipeline_runs_whole_and_on_odd_rows(spark):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", None, 0), (1, "", "en", None, 0), (2, "hello there", "en", "s", 11)],
                                "doc_id long, text string, lang string, source string, n_chars long")
    for frame in (odd, odd.filter("doc_id < 0")):
        docs = frame
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, "/root/testdata/sf0.001")
        assert docs.count() == 0 or frame is odd


def test_a_labelled_document_is_one_row_of_the_sample(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(1, 9)] + [(1, "text 1")] * 500 + [(2, "text")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(1, 9)], "doc_id long, quality int")
    rows = sorted(map(tuple, labelled(docs, labels, "quality", 100).collect()))
    want = {i for i in range(1, 9) if zlib.crc32(str(i).encode()) % 5}
    assert rows == [(i, "text" if i == 2 else f"text {i}", 1) for i in sorted(want)]


def test_lines_are_sampled_over_the_whole_document():
    for count in (1, 255, 256, 257, 300, 10_000):
        kept = np.flatnonzero(quality._sampled(np.arange(count), np.full(count, count)))
        assert len(kept) == min(count, quality.LINES) and kept[0] == 0 and kept[-1] == count - 1

"""Cover tree, token counts, sharding, mixing and search against brute force; nulls, ties, repeated rows, empty tables, clashing columns."""

import random
from collections import Counter
from math import log

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from driftgauge.llm import covertree, mixing, search, sharding, tokencounts
from driftgauge.llm.components import components

R = random.Random(5)


# ---- components --------------------------------------------------------------------------------

def test_components_of_a_long_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(100, 140)]
    star = [(500, i) for i in range(501, 560)]
    got = dict(components(spark.createDataFrame(path + star + [(9, 9)], "a long, b long")).collect())
    assert {got[i] for i in range(100, 141)} == {100} and {got[i] for i in range(500, 560)} == {500} and 9 not in got


# ---- cover tree --------------------------------------------------------------------------------

def vectors():
    rng = np.random.default_rng(1)
    rows = []
    for label in (0, 1, None):
        centres = rng.normal(size=(6, 8))
        for _ in range(90):
            rows.append((label, (centres[rng.integers(6)] + rng.normal(size=8) * rng.choice([0.05, 0.3, 1])).astype(np.float32).tolist()))
    hot = rng.normal(size=8).astype(np.float32).tolist()
    rows += [(0, hot)] * 40 + [(0, [2 * x for x in hot]), (1, hot), (0, None), (0, []), (0, [0.0] * 8), (0, [float("nan")] + hot[1:]), (0, [None] + hot[1:]),
                               (0, hot[:4]), (0, hot[:4])]
    return [(i, e, y, "x") for i, (y, e) in enumerate(rows)]


@pytest.mark.parametrize("block", [2048, 50])
def test_cover_tree(spark, block):
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, n_links string")
    got = {r["vec_id"]: r for r in covertree.near_duplicates(df, block=block).collect()}

    def usable(e, y):
        return y is not None and e is not None and len(e) > 0 and None not in e and np.isfinite(e).all() and np.any(e)

    def linked(a, b):
        (_, e, y, _), (_, f, z, _) = rows[a], rows[b]
        if a == b or not usable(e, y) or not usable(f, z) or y != z or len(e) != len(f):
            return False
        e, f = np.array(e, float), np.array(f, float)
        return e @ f / np.linalg.norm(e) / np.linalg.norm(f) >= 0.93

    near = [[b for b in range(len(rows)) if linked(a, b)] for a in range(len(rows))]
    least = list(range(len(rows)))
    while True:
        new = [min([least[a], *(least[b] for b in near[a])]) for a in range(len(rows))]
        if new == least:
            break
        least = new
    assert [got[i]["n_links"] for i in range(len(rows))] == [len(x) for x in near]
    assert [got[i]["component_id"] for i in range(len(rows))] == least
    assert [got[i]["kept"] for i in range(len(rows))] == [least[i] == i for i in range(len(rows))]


def test_cover_tree_of_nothing(spark):
    assert covertree.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).collect() == []


def test_cover_tree_of_scaled_copies(spark):
    rng = np.random.default_rng(3)
    one = rng.normal(size=64)
    scaled = [(one * s).astype(np.float32).tolist() for s in rng.uniform(0.1, 10, 100)]
    far = [(-one).astype(np.float32).tolist()]
    df = spark.createDataFrame([(i, v, 1) for i, v in enumerate(scaled + far)], "vec_id long, embedding array<float>, label int")
    got = sorted(map(tuple, covertree.near_duplicates(df).select("vec_id", "n_links", "component_id").collect()))
    assert got == [(i, 99, 0) for i in range(100)] + [(100, 0, 100)]


def test_cover_tree_levels_are_nested():
    x = np.random.default_rng(2).normal(size=(300, 3))
    x /= np.linalg.norm(x, axis=1)[:, None]

    def walk(node):
        if node.children is None:
            found = node.members.tolist()
        else:
            assert node.children[0].centre == node.centre
            found = [i for c in node.children for i in walk(c)]
        assert np.linalg.norm(x[found] - x[node.centre], axis=1).max() <= node.reach + 1e-7
        return found

    assert sorted(walk(covertree.build(x))) == list(range(300))


# ---- token counts ------------------------------------------------------------------------------

def test_separator_scan_stitches_blocks_and_stretches(spark):
    rows, want = [], []
    for f in range(12):
        pool = [9, 1, 2, 3] if f % 3 else [1, 2, 3, 4] * 10 + [9]
        ids = [R.choice(pool) for _ in range(R.choice([0, 1, 5, 50, 300]))]
        n = ordinal = 0
        for x in ids:
            if x == 9:
                want.append((f"f{f}", ordinal, n))
                ordinal, n = ordinal + 1, 0
            else:
                n += 1
        if n:
            want.append((f"f{f}", ordinal, n))
        rows += [(f"f{f}", b // 7, np.array(ids[b:b + 7], "<u2").tobytes()) for b in range(0, len(ids), 7)]
    blocks = spark.createDataFrame(rows, "file string, block long, ids binary")
    assert sorted(map(tuple, tokencounts.counts(blocks, 9, stretch=3).collect())) == sorted(want)


def test_binary_files(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(np.array([1, 2, 9, 9, 3], "<u2").tobytes())
    (tmp_path / "b.bin").write_bytes(b"")
    got = tokencounts.counts(tokencounts.blocks_of_files(spark, str(tmp_path), block=2), 9).orderBy("ordinal").collect()
    assert [(r["ordinal"], r["n_tokens"]) for r in got] == [(0, 2), (1, 0), (2, 1)]


def test_token_files_are_flat_and_read_by_ranges(spark, tmp_path):
    path, folder = public_tokenizers.path("byte_bpe_50k.tiktoken"), str(tmp_path / "flat")
    df = spark.createDataFrame([(i, "x y " * 9000) for i in range(3)], "doc_id long, text string").coalesce(1)
    tokencounts.pack(df, path, 50_256, folder).collect()
    (name,) = tmp_path.glob("flat/*.bin")
    ids = tokencounts._encoding(path).encode_ordinary("x y " * 9000)
    assert name.read_bytes() == np.array([*ids, 50_256] * 3, "<u2").tobytes()
    blocks = tokencounts.blocks_of_files(spark, folder, block=1000)
    assert blocks.select(F.spark_partition_id()).distinct().count() > 1
    assert [r["n_tokens"] for r in tokencounts.counts(blocks, 50_256, stretch=4).collect()] == [len(ids)] * 3


def test_document_counts(spark):
    texts = ["", None, "Hello world", "a" * 3000, "x y " * 70_000, "Hello world"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(2, "Hello world")], "doc_id long, text string")
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    got = sorted(map(tuple, tokencounts.document_counts(df, path, 50_256).collect()))
    encoding = tokencounts._encoding(path)
    assert got == sorted([(i, len(encoding.encode_ordinary(t or ""))) for i, t in enumerate(texts)] + [(2, 2)])
    assert tokencounts.document_counts(df.filter("doc_id < 0"), path, 50_256).collect() == []


# ---- sharding ----------------------------------------------------------------------------------

@pytest.mark.parametrize("folder", ["sf0.01", "sf0.1"])
def test_equal_texts_stay_together(spark, folder):
    docs = spark.read.parquet(f"/root/testdata/{folder}/documents.parquet").select("doc_id", "text")
    out = sharding.shard(docs).groupBy("text").agg(F.sum("size").alias("b"), F.countDistinct("shard").alias("k")).cache()
    total = out.agg(F.sum("b")).first()[0]
    assert out.filter(F.col("k") > 1).agg(F.min("b")).first()[0] is None or out.filter(F.col("k") > 1).agg(F.min("b")).first()[0] > 0.02 * total / 40
    sizes = [r[0] for r in sharding.shard(docs).groupBy("shard").agg(F.sum("size")).select("sum(size)").collect()]
    longest = docs.agg(F.max(F.octet_length("text"))).first()[0] + 16
    assert len(sizes) == 40 and max(abs(x - total / 40) for x in sizes) <= max(longest, 0.05 * total / 40)


def test_names_that_operators_use_inside_pass_through(spark):
    names = ["at_left", "mix_times", "_part", "_a", "_b", "at_key", "plan", "upto"]
    df = spark.createDataFrame([(i, f"a b {i % 7}", "s", *names) for i in range(50)], "doc_id long, text string, source string, " + ", ".join(f"{n} string" for n in names))
    for out, gone in ((mixing.mix(df), {"mix_times"}), (sharding.shard(df, shards=3), set())):
        row = out.first().asDict()
        assert all(row.get(n) == n for n in names if n not in gone) and out.count() == 50


def test_histogram_sort_shards(spark):
    texts = ["hot text"] * 300 + [None] * 5 + [""] * 5 + ["w" * R.randint(1, 300) for _ in range(400)]
    df = spark.createDataFrame([(i, t, "keep") for i, t in enumerate(texts)] + [(0, "hot text", "keep")], "doc_id long, text string, slot string")
    got = sharding.shard(df, shards=5, parts=4).collect()
    assert len(got) == len(texts) + 1 and all(r["size"] == len((r["text"] or "").encode()) + 16 for r in got)
    by = {s: [r for r in got if r["shard"] == s] for s in range(5)}
    for rows in by.values():
        assert sorted(r["slot"] for r in rows) == list(range(len(rows)))
    total = sum(r["size"] for r in got)
    assert all(abs(sum(r["size"] for r in rows) - total / 5) <= 0.02 * total for rows in by.values())
    assert sharding.shard(df.filter("doc_id < 0"), shards=3).collect() == []


# ---- mixing ------------------------------------------------------------------------------------

def poured(sizes, share=1.5, epochs=2.0):
    """Round by round: sources above their cap are clamped, the rest share what is left."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, budget, out = set(order), share * sum(sizes.values()), {}
    while left:
        level = budget / sum(weight[s] for s in left)
        full = {s for s in left if weight[s] * level > epochs * sizes[s]}
        if not full:
            return out | {s: weight[s] * level for s in left}
        out |= {s: epochs * sizes[s] for s in full}
        budget -= sum(out[s] for s in full)
        left -= full
    return out


def test_mixing(spark):
    rows = [(i, "w " * R.randint(0, 40), R.choice(["b", "a", "Z", "é", None] + ["hot"] * 5)) for i in range(600)]
    rows += [(None, "some words here", "a"), (None, "some words here", "a"), (3, None, "a"), (3, None, "a"), (5, "", "empty source")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, mix_taken int")
    got = mixing.mix(df).collect()
    size = Counter()
    for _, t, s in rows:
        size[s] += len((t or "").split())
    want = poured({s: size[s] for s in {r[2] for r in rows}})
    taken = Counter()
    for r in got:
        assert r["mix_source_size"] == size[r["source"]] and r["mix_target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["mix_taken"] <= 2 * r["mix_size"]
        taken[r["source"]] += r["mix_taken"]
    assert all(abs(taken[s] - want[s]) <= 2 for s in want)
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.mix(df.repartition(7)).collect()))  # reruns agree
    whole = mixing.mix(df, whole=True).collect()
    assert all(r["mix_taken"] == r["mix_copies"] * r["mix_size"] for r in whole)
    assert mixing.mix(df.filter("doc_id < 0")).collect() == []


def test_mixing_is_native(spark, capsys):
    mixing.mix(spark.createDataFrame([(1, "a b", "s")], "doc_id long, text string, source string")).explain()
    assert not any(x in capsys.readouterr().out for x in ("Python", "Pandas", "Arrow"))


# ---- search ------------------------------------------------------------------------------------

def bm25(docs, query, k=10):
    tf = [Counter(search.TERM.findall((t or "").lower().encode())) for _, t in docs]
    mean = sum(sum(c.values()) for c in tf) / len(tf)
    df = Counter(t for c in tf for t in c)
    out = []
    for (key, _), c in zip(docs, tf):
        s = sum(n * log(1 + (len(docs) - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean))
                for t, n in query.items() if t in c)
        if s:
            out.append((-round(s, 9), key))
    return sorted(out)[:k]


@pytest.mark.parametrize("sizes", [(32_768, 4096), (60, 7)])  # the second: several shards and query groups
def test_search_is_exact(spark, sizes, monkeypatch):
    monkeypatch.setattr(search, "BLOCK", 8)
    monkeypatch.setattr(search, "STRIDE", 2)
    words = [f"w{i}" for i in range(50)]
    docs = [(i, " ".join(R.choices(words, [1 / (j + 1) for j in range(50)], k=R.randint(0, 40)))) for i in range(300)]
    docs += [(300, None), (301, ""), (302, docs[0][1]), (303, docs[0][1]), (320, "never seen Wörter, W1!"), (340, "w1 " * 2000)]
    df = spark.createDataFrame(docs, "id long, text string")
    got = search.top_k(df, F.col("id") % 20 == 0, ["id"], shard=sizes[0], block=sizes[1]).collect()
    for key, text in docs:
        if key % 20 == 0:
            want = bm25(docs, Counter(search.TERM.findall((text or "").lower().encode())))
            mine = sorted((r["rank"], r["id"], r["score"]) for r in got if r["q_id"] == key)
            assert [m[1] for m in mine] == [w[1] for w in want], key
            assert np.allclose([m[2] for m in mine], [-w[0] for w in want])
    assert {r["q_id"] for r in got} <= {d[0] for d in docs if d[0] % 20 == 0}
    assert search.top_k(df.filter("id < 0"), F.col("id") % 20 == 0, ["id"]).collect() == []


def test_search_reads_only_blocks_that_can_matter():
    import pyarrow as pa
    rng = np.random.default_rng(3)
    n = 4000
    texts = [sorted(set(rng.integers(0, 40, 6).tolist())) + ([1000] if i % 900 == 0 else []) for i in range(n)]
    rows = pa.table({"row": pa.array(range(n)), "terms": pa.array(texts, pa.list_(pa.int64())), "tf": pa.array([[1] * len(t) for t in texts], pa.list_(pa.int32())),
                     "dl": pa.array([len(t) for t in texts], pa.int32())})
    shard = search.Shard(rows, 6.0)
    read, scored = [], shard._scored

    def counted(pivots, *rest):
        read.append(len(pivots))
        return scored(pivots, *rest)

    shard._scored = counted
    places, scores = shard.top(np.array([1000, 3]), np.array([8.0, 0.1]), 3)
    want = sorted(((-round(sum(w * 2.2 / (1 + 1.2 * (0.25 + 0.75 * len(t) / 6.0)) for x, w in ((1000, 8.0), (3, 0.1)) if x in t), 9), i) for i, t in enumerate(texts)))[:3]
    assert [(-s, i) for i, s in zip(shard.id[places].tolist(), scores.tolist())] == [(w, i) for w, i in want] and sum(read) <= search.STRIDE


def test_search_takes_keys_of_any_name_and_bounds_postings(spark, monkeypatch):
    docs = [(i, f"a{i % 3} b{i % 5} same", "x") for i in range(60)]
    df = spark.createDataFrame(docs, "row long, text string, terms string")
    whole = search.top_k(df, F.col("row") % 20 == 0, ["row"]).collect()
    monkeypatch.setattr(search, "POSTINGS", 20)
    assert sorted(search.top_k(df, F.col("row") % 20 == 0, ["row"]).collect()) == sorted(whole) and len(whole) == 30

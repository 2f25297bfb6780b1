"""Nearest neighbours, whitening and fill-in-middle against brute force; nulls, ties, repeated rows, empty tables, long texts, clashing columns."""

import hashlib
import math
import random
import re

import numpy as np
import pytest

from driftgauge.llm import fim, nearest, proximity, whitening
from driftgauge.llm.queries import op11_nearest, op12_whitening, op13_fim

SF = "/root/testdata/sf0.01"


# ---- nearest neighbours ------------------------------------------------------------------------

def test_prune_keeps_diverse_edges():
    # Vertex 0 at the origin; 1 and 2 lie behind each other, 3 elsewhere.
    points = np.array([[0, 0], [1, 0], [2, 0], [0, 1.5], [1, 0.01]], np.float32)
    got = proximity.robust_prune(points, np.array([0]), np.array([[3, 2, 1, 4, 1, 0, -1]]), 3, 1.2)
    assert got.tolist() == [[1, 3, -1]]


def test_a_graph_finds_its_own_points():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(30, 16))
    points = (centres[rng.integers(30, size=3000)] + 0.2 * rng.normal(size=(3000, 16))).astype(np.float32)
    graph = proximity.build(points)
    ids, far, _, visits = proximity.beam_search(graph, points[::10], 128)
    assert np.mean([i in row for i, row in zip(range(0, 3000, 10), ids)]) > 0.99
    assert sum(map(len, visits)) / 300 < 200  # vertices visited of 3,000
    assert (graph.edges >= 0).sum(1).max() <= 60


def neighbours(rows, every, k=10):
    """Brute force: {query row number: [(score, key)]}."""
    def ok(e):
        return e is not None and len(e) > 0 and None not in e and np.isfinite(e).all() and np.any(e)

    used = [(i, key, np.array(e, float)) for i, (key, e) in enumerate(rows) if ok(e)]
    out = {}
    for i, key, e in used:
        if key is not None and key % every == 0:
            near = [(float(np.sqrt(((e - f) ** 2).sum())), other is None, -1 if other is None else other) for j, other, f in used if j != i and len(e) == len(f)]
            out[i] = sorted(near)[:k]
    return out


def edge_vectors():
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(60)]
    hot = rows[3][1]
    rows += [(100 + i, hot) for i in range(40)]
    rows += [(20, rows[20][1])] * 2 + [(None, rows[20][1]), (40, None), (40, []), (0, [0.0] * 8), (60, [float("inf")] + hot[1:]), (60, [None] + hot[1:]),
             (80, hot[:3]), (81, hot[:3]), (82, [-0.0, 1.0, 2.0]), (83, [0.0, 1.0, 2.0])]
    return rows


@pytest.mark.parametrize("shard", [16_384, 20])
def test_nearest_with_ties_nulls_and_copies(spark, shard):
    rows = edge_vectors()
    df = spark.createDataFrame([(k, e, "x", 1) for k, e in rows], "vec_id long, embedding array<float>, code string, shard int")
    got = nearest.search(nearest.build_index(df, shard=shard), df.filter("vec_id % 20 = 0")).collect()
    want = [(rows[i][0], n + 1, None if far[1] else far[2], far[0]) for i, found in neighbours(rows, 20).items() for n, far in enumerate(found)]

    def key(r):
        return (r[0], r[1], r[3], -1 if r[2] is None else r[2])

    assert sorted(((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in got), key=key) == \
        sorted(((a, b, c, round(d, 9)) for a, b, c, d in want), key=key)


def test_nearest_of_extreme_lengths(spark):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(size=4) * 10.0 ** (i % 5 * 150 - 300)).tolist()) for i in range(50)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = nearest.search(nearest.build_index(df), df.filter("vec_id % 10 = 0"))
    assert got.count() == 50 and got.filter("score = 0 or isnan(score) or score = double('Infinity')").count() == 0


def test_nearest_of_nothing(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    some = spark.createDataFrame([(100, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert nearest.search(nearest.build_index(none), some).collect() == []
    assert nearest.search(nearest.build_index(some), none).collect() == []
    assert nearest.search(nearest.build_index(some), some).collect() == []


def test_nearest_text_keys(spark):
    df = spark.createDataFrame([(f"k{i}", [float(i), 1.0]) for i in range(30)], "vec_id string, embedding array<double>")
    got = nearest.search(nearest.build_index(df, k=2), df.filter("vec_id = 'k7'"), k=2).collect()
    assert [(r["rank"], r["vec_id"], r["score"]) for r in got] == [(1, "k6", 1.0), (2, "k8", 1.0)]


def test_nearest_query_recall(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()]
    got = {}
    for r in op11_nearest(spark, SF).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], round(r["score"], 9), r["vec_id"]))
    want = neighbours(rows, 100)
    hits = total = 0
    for i, found in want.items():
        ranked = sorted(got[rows[i][0]])
        assert [r for r, _, _ in ranked] == list(range(1, 11)) and [s for _, s, _ in ranked] == sorted(s for _, s, _ in ranked)
        hits += len({v for _, _, v in ranked} & {v for _, _, v in found})
        total += len(found)
    assert hits / total >= 0.95


# ---- whitening ---------------------------------------------------------------------------------

def white(rows):
    """Brute force by a singular value decomposition of all centred rows."""
    x = np.array([[math.floor(1024 * c) + 100_000 for c in e] for e in rows], object)
    n, s = len(x), x.sum(0)
    deviation = ((n * x - s) ** 2).sum(1)
    centred = np.array([[float(v) - float(t) / n for v, t in zip(r, s)] for r in x])
    _, sigma, v = np.linalg.svd(centred, full_matrices=False)
    return n, deviation, centred, sigma ** 2 / n, v


def test_whitening_query(spark):
    vectors = {r[0]: r[1] for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()}
    n, deviation, centred, e, v = white(list(vectors.values()))
    place = {k: i for i, k in enumerate(vectors)}
    got = op12_whitening(spark, SF).collect()
    assert len(got) == 8 * n and {r["component"] for r in got} == set(range(1, 9))
    signs = {}
    for r in got:
        i, k = place[r["vec_id"]], r["component"] - 1
        want = centred[i] @ v[k] / math.sqrt(e[k])
        if abs(want) > 1e-3:
            signs.setdefault(k, set()).add(math.copysign(1, want * r["whitened"]))
        assert abs(abs(r["whitened"]) - abs(want)) < 1e-8
        assert r["n"] == n and r["deviation"] == deviation[i]
        assert abs(r["explained"] - e[k] / e.sum()) < 1e-10 and 0 <= r["identity_error"] < 1e-9
    assert all(len(s) == 1 for s in signs.values())


def frame(spark, rows, kind="double"):
    return spark.createDataFrame([(i, e, "x") for i, e in enumerate(rows)], f"vec_id long, embedding array<{kind}>, n string")


def test_whitening_is_stable_for_an_ill_conditioned_table(spark):
    rng = np.random.default_rng(3)
    rows = (rng.normal(size=(400, 6)) * np.array([1e6, 1e4, 100, 5, 1, 0.01])) @ np.linalg.qr(rng.normal(size=(6, 6)))[0]
    df = frame(spark, rows.tolist())
    model = whitening.fit(df)
    _, _, centred, e, v = white(rows.tolist())
    assert np.allclose(model.eigenvalues, e, rtol=1e-6)
    assert np.allclose(np.abs((model.components * v).sum(1)), 1, atol=1e-9)
    assert whitening.identity_error(df, model) < 1e-6


def test_whitening_edges(spark):
    rng = np.random.default_rng(5)
    good = rng.normal(size=(30, 3))
    good[:, 2] = 7.0  # no variance
    rows = good.tolist() + [None, [], [1.0, None, 2.0], [float("nan"), 0.0, 0.0], [float("inf"), 0.0, 0.0], [1e30, 0.0, 0.0], [1.0, 2.0]] + [good[0].tolist()] * 5
    df = frame(spark, rows)
    model = whitening.fit(df)
    got = {r["vec_id"]: r for r in whitening.apply(df, model).collect()}
    kept = list(range(30)) + list(range(37, 42))
    n, deviation, centred, e, v = white([rows[i] for i in kept])
    assert sorted(got) == kept and model.n == n == 35
    for i, k in enumerate(kept):
        assert got[k]["deviation"] == deviation[i] and got[k]["n"] == 35
        assert np.allclose(np.abs(got[k]["whitened"][:2]), np.abs(centred[i] @ v[:2].T / np.sqrt(e[:2])))
        assert got[k]["whitened"][2] is None
    assert model.explained[2] == 0 and whitening.identity_error(df, model) < 1e-9


def test_whitening_of_nothing_and_of_one_value(spark):
    none = frame(spark, [None, []])
    assert whitening.fit(none) is None and whitening.apply(none, None).collect() == []
    same = frame(spark, [[1.5, 2.5]] * 4, "float")
    model = whitening.fit(same)
    assert [(r["deviation"], r["whitened"]) for r in whitening.apply(same, model).collect()] == [(0, [None, None])] * 4
    assert model.explained == [None, None]


def test_deviations_beyond_64_bits():
    x = np.array([[2 ** 50, 0], [0, 0], [5, 1]])
    sums = (2 ** 50 + 5, 1)
    assert whitening.deviations(x, 3, sums)[0] is None
    assert whitening.deviations(x[1:], 3, (10 ** 9, 1)) == [10 ** 18 + 1, (15 - 10 ** 9) ** 2 + 4]
    assert whitening.deviations(np.array([[2 ** 49]]), 2 ** 20, (2 ** 69 + 7,)) == [49]


# ---- fill in the middle ------------------------------------------------------------------------

def middle(doc_id, text):
    """Brute force from the definition."""
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    hexes = hashlib.sha256(f"7:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(hexes[8 * i:8 * i + 8], 16) for i in range(4))
    n = len(units)
    if not text or any(s in text for s in fim.SENTINELS):
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 50:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fim_against_the_definition(spark):
    rng = random.Random(8)
    texts = [None, "", "\n", "\n\n\n", "one", "one\n", "é\nü𝄞\n語", "<P>", "a<M>b\nc", "<\nS>\n<P\n>", "a\r\nb\x0bc\n", "x\n" * 200_000, "y" * 1_000_000]
    texts += ["".join(rng.choice("ab\n<>PSMé語") for _ in range(rng.randrange(60))) for _ in range(300)]
    rows = [(i, t, "z", i) for i, t in enumerate(texts)] + [(None, "p\nq\nr", None, None), (None, None, "z", 1), (4, "one", "z", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, draw_0 string, n long")
    got = fim.restore(fim.transform(df)).collect()
    assert len(got) == len(rows)
    want = sorted(((r[0] is None, r[0] or 0, r[2] or "") + tuple(map(str, middle(r[0], r[1]))) + (r[1] or "",) for r in rows))
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["draw_0"] or "") + tuple(str(r[c]) for c in ("n", "form", "prefix_chars", "middle_chars", "output"))
                  + (r["restored"],) for r in got) == want


def test_rotation_in_place():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a, b, c = np.sort(rng.integers(0, 40, 3)).tolist()
        view = rng.integers(0, 255, 40).astype(np.uint8)
        want = view[:a].tolist() + view[b:c].tolist() + view[a:b].tolist() + view[c:].tolist()
        fim.rotate(view, a, b, c)
        assert view.tolist() == want


def test_fim_rates_and_sentinels(spark):
    df = spark.createDataFrame([(i, "a\nb\nc\n") for i in range(400)], "doc_id long, text string")
    forms = [r["form"] for r in fim.transform(df, rate=40, spm=100).collect()]
    assert set(forms) == {"plain", "spm"} and 120 < forms.count("spm") < 200
    assert fim.transform(df.limit(0)).collect() == []
    for bad in (("<P>", "<P>", "<M>"), ("ab", "bc", "x"), ("a", "ba", "c"), ("", "a", "b")):
        with pytest.raises(ValueError):
            fim.transform(df, sentinels=bad)


def test_fim_query(spark):
    texts = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: tuple(r)[1:] for r in op13_fim(spark, SF).collect()}
    for doc_id, text in map(tuple, texts):
        *front, output = middle(doc_id, text)
        assert got[doc_id] == (*front, hashlib.sha256(output.encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())

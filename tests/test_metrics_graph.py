"""Metrics and graph measures against brute force, with copies and skew."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftgauge.operators import graph as G
from driftgauge.operators import metrics as M


def test_ranking_against_pairs(spread):
    rng = np.random.default_rng(5)
    p, y = np.round(rng.random(200), 1), rng.integers(0, 2, 200)
    df = spread.createDataFrame([("s", float(a), int(b)) for a, b in zip(p, y)], "k string, p double, y int")
    r = M.ranking(df, ["k"]).first()
    d = p[y == 1][:, None] - p[y == 0][None, :]
    assert np.isclose(r["roc_auc"], (d > 0).mean() + 0.5 * (d == 0).mean())
    ap, tp, fp = 0.0, 0, 0
    for v in sorted(set(p), reverse=True):
        pos = int(((p == v) & (y == 1)).sum())
        tp, fp = tp + pos, fp + int(((p == v) & (y == 0)).sum())
        ap += pos / (y == 1).sum() * tp / (tp + fp)
    assert np.isclose(r["pr_auc"], ap)


def test_one_class_has_no_ranking(spark):
    df = spark.createDataFrame([("s", 0.1, 1), ("s", 0.2, 1)], "k string, p double, y int")
    r = M.ranking(df, ["k"]).first()
    assert r["roc_auc"] is None and r["pr_auc"] is None


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_recall_at_precision_walk(spread, seed):
    rng = np.random.default_rng(seed)
    p = np.round(rng.random(120), 1)
    y = (rng.random(120) < p).astype(int)
    df = spread.createDataFrame([("s", float(a), int(b), i) for i, (a, b) in enumerate(zip(p, y))], "k string, p double, y int, rid long")
    order = sorted(range(120), key=lambda i: (-p[i], i))
    best, found, tp = 0.0, False, 0
    for n, i in enumerate(order):
        tp += y[i]
        if tp / (n + 1) >= 0.8:
            best, found = max(best, tp / y.sum()), True
        elif found and p[i] < p[order[n - 1]]:
            break
    assert np.isclose(M.recall_at_precision(df, ["k"], ["rid"], 0.8).first()["recall_at_precision"], best)


def copies(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(14, 8))
    x = np.vstack([base, np.repeat(base[:1], 9, axis=0), base[1:3] + 0.01])
    rows = [(0, i, [float(v) for v in r], int(r[0] > 0), float(1 / (1 + np.exp(-r[1])))) for i, r in enumerate(x)]
    n = spark.createDataFrame(rows, "step long, id long, v array<double>, yhat int, p double")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    adj = ((u @ u.T) > 0.3).astype(float)
    np.fill_diagonal(adj, 0)
    return G.unit_vectors(n, "v"), adj, rows


def test_graph_measures_with_copies(spark, monkeypatch):
    n, adj, rows = copies(spark)
    v = G.vertices(n)
    pairs = G.similar_pairs(v, 0.3)
    size = len(rows)
    edges = {(r["src"], r["dst"]) for r in G.node_edges(n, pairs).collect()}
    assert edges == {(i, j) for i in range(size) for j in range(i + 1, size) if adj[i, j]}
    deg = adj.sum(axis=1)
    d = G.degree_statistics(v, pairs).first()
    assert np.isclose(d["edge_density"], adj.sum() / size / (size - 1)) and np.isclose(d["degree_std"], deg.std())
    local = [0.0 if deg[i] < 2 else adj[np.ix_(adj[i] > 0, adj[i] > 0)].sum() / deg[i] / (deg[i] - 1) for i in range(size)]
    assert np.isclose(G.clustering(v, pairs).first()["clustering"], np.mean(local))
    h = np.array([r[3] for r in rows])
    same = np.mean([h[i] == h[j] for i, j in edges])
    assert np.isclose(G.homophily(n, pairs, "yhat").first()["homophily"], same)
    p = np.array([r[4] for r in rows])
    near = {r["id"]: r["near_p"] for r in G.neighbour_means(n, pairs, ["p"]).collect()}
    assert np.allclose([near[i] for i in range(size)], adj @ p / (deg + 1e-6))
    e = np.sort(np.linalg.eigvalsh(adj))[::-1]
    low = np.sort(np.linalg.eigvalsh(np.diag(deg) - adj))[1]
    s = G.spectra(v, pairs).first()
    assert np.isclose(s["spectral_gap"], e[0] - e[1]) and np.isclose(s["fiedler"], low)


def test_measures_by_tiles_write_no_pairs(spark, monkeypatch):
    monkeypatch.setattr(G, "TILE", 6)
    monkeypatch.setattr(G, "CORNER_TILE", 6)
    monkeypatch.setattr(G, "ROWS", 2)
    n, adj, rows = copies(spark)
    n = n.unionByName(n.limit(1).withColumns({"id": F.lit(99).cast("long"), "u": F.lit(None).cast("array<double>"), "vid": F.lit(1).cast("long")}))
    v, size, deg = G.settled(G.vertices(n)), len(rows) + 1, np.append(adj.sum(axis=1), 0)
    edges = [(i, j) for i in range(len(rows)) for j in range(i + 1, len(rows)) if adj[i, j]]
    assert sorted((r["src"], r["dst"]) for r in G.node_edges(n, G.similar_pairs(v, 0.3)).collect()) == edges
    monkeypatch.setattr(G, "both_ways", None)
    d = G.degree_statistics(v, 0.3).first()
    assert d["n"] == size and np.isclose(d["mean_degree"], deg.mean()) and np.isclose(d["degree_std"], deg.std())
    local = [0.0 if deg[i] < 2 else adj[np.ix_(adj[i] > 0, adj[i] > 0)].sum() / deg[i] / (deg[i] - 1) for i in range(len(rows))]
    assert np.isclose(G.clustering(v, 0.3).first()["clustering"], sum(local) / size)
    h, p = np.array([r[3] for r in rows]), np.array([r[4] for r in rows])
    assert np.isclose(G.homophily(n, 0.3, "yhat").first()["homophily"], np.mean([h[i] == h[j] for i, j in edges]))
    near = {r["id"]: r["near_p"] for r in G.neighbour_means(n.where("u IS NOT NULL"), 0.3, ["p"]).collect()}
    assert np.allclose([near[i] for i in range(len(rows))], adj @ p / (deg[:-1] + 1e-6))


def test_iterated_spectra(spark):
    rows = [(0, i, [math.cos(a), math.sin(a)]) for i, a in enumerate((0.0, 0.5, 1.0, 1.0, 1.6))] + [(1, 9, [1.0, 1.0])]
    v = G.settled(G.vertices(G.unit_vectors(spark.createDataFrame(rows, "step long, id long, v array<double>"), "v", 2)))
    near = v.alias("a").join(v.alias("b"), F.expr("a.step = b.step AND a.vid < b.vid AND aggregate(zip_with(a.u, b.u, (x, y) -> x * y), 0D, (x, y) -> x + y) > 0.7"))
    pairs = G.settled(near.select("a.step", F.col("a.vid").alias("a"), F.col("b.vid").alias("b")))
    with pytest.raises(RuntimeError, match="not converged after 2 rounds"):
        G.spectra(v, pairs, G.SMALL_GRAPH + 1, rounds=2)
    got = {(r["step"], r["vid"]): r for r in G.spectra(v, pairs, G.SMALL_GRAPH + 1).collect()}
    want = {(r["step"], r["vid"]): r for r in G.spectra(v, pairs).collect()}
    assert got.keys() == want.keys()
    for k, r in got.items():
        assert np.allclose(r[2:], want[k][2:], atol=1e-6)


def test_large_steps_converge_in_few_rounds_without_pairs(spark, monkeypatch):
    """Steps above the limit are iterated in blocks by tiles, small ones beside them solved densely; no list of pairs is made for the large ones."""
    monkeypatch.setattr(G, "SMALL_GRAPH", 500)
    monkeypatch.setattr(G, "SPECTRUM_TILE", 500)
    u = np.random.default_rng(5).normal(size=(840, 8))
    rows = [(int(i >= 800), i, [float(x) for x in v]) for i, v in enumerate(u)]
    n = G.unit_vectors(spark.createDataFrame(rows, "step long, id long, v array<double>"), "v")
    v = G.settled(G.vertices(n))
    got = n.select("step", "id", "vid").join(G.spectra(v, 0.5, rounds=60), ["step", "vid"]).toPandas().sort_values("id")
    unit = u / (np.linalg.norm(u, axis=1)[:, None] + 1e-8)
    for step, part in got.groupby("step"):
        x = unit[part["id"]]
        adj = (x @ x.T > 0.5).astype(float)
        np.fill_diagonal(adj, 0)
        values, vectors = np.linalg.eigh(adj)
        low = np.linalg.eigvalsh(np.diag(adj.sum(axis=1)) - adj)[1]
        main = np.abs(vectors[:, -1])
        assert len(x) == (800, 40)[step]
        assert np.allclose(part["spectral_gap"], values[-1] - values[-2], atol=1e-6) and np.allclose(part["fiedler"], low, atol=1e-6)
        assert np.allclose(part["weight"], main / (main.max() + 1e-8), atol=1e-5)


def test_recall_at_precision_walks_open_groups_only(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows, want = [], {}
    for k, shift in (("a", 0.0), ("b", 0.35), ("c", -0.3), ("d", 0.15)):
        p = np.round(rng.random(300), 1)
        y = (rng.random(300) < np.clip(p + shift, 0, 1)).astype(int)
        score = [None if i % 37 == 0 else float(v) for i, v in enumerate(p)]
        rows += [(k, s, int(b), i) for i, (s, b) in enumerate(zip(score, y))]
        walk = sorted(range(300), key=lambda i: (score[i] is None, -(score[i] or 0.0), i))
        best, found, tp = 0.0, False, 0
        for n, i in enumerate(walk):
            tp += y[i]
            if tp / (n + 1) >= 0.6:
                best, found = max(best, tp / y.sum()), True
            elif found and score[i] != score[walk[n - 1]]:
                break
        want[k] = best
    walked = []
    totals = M.running_totals

    def counted(df, *args):
        walked.append(df.count())
        return totals(df, *args)

    monkeypatch.setattr(M, "running_totals", counted)
    df = spark.createDataFrame(rows, "k string, p double, y int, rid long")
    got = {r["k"]: r["recall_at_precision"] for r in M.recall_at_precision(df, ["k"], ["rid"], 0.6).collect()}
    assert got == pytest.approx(want)
    assert sum(walked) < len(rows) / 2


def test_links_are_tested_in_blocks_of_a_cache():
    """The same links as by whole rows, limits included, without products of all columns at once."""
    import tracemalloc

    import numpy as np

    from driftgauge.operators import graph
    rng = np.random.default_rng(2)
    u = rng.normal(size=(4_096, 8))
    u /= np.linalg.norm(u, axis=1)[:, None]
    u[7], u[4_000] = np.eye(8)[0], 0.7 * np.eye(8)[0] + np.sqrt(1 - 0.49) * np.eye(8)[1]
    u[9] = np.nan
    left = u[:graph.ROWS]
    want = ~(left @ u.T <= 0.7)
    want[np.arange(len(left)), np.arange(len(left))] = False
    exact = sum((left[7, d] * u[4_000, d] for d in range(8)), 0.0)
    want[7, 4_000] = exact > 0.7
    tracemalloc.start()
    got = graph._linked(left, u, 0.7, 0)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (got == want).all() and most < len(left) * len(u) * 8

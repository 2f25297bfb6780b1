"""Near copies against brute force: recall of all pairs at 0.8, nothing else dropped; rounds of large components; nulls, ties, clashing names."""

import random

import numpy as np
import pytest

from driftgauge.llm import nearcopies as N

SF = "/root/testdata/sf0.01"


def sets(texts):
    return [set(N.shingle_hashes((t or "").encode()).tolist()) for t in texts]


def alike(a, b):
    return 1.0 if not a and not b else len(a & b) / len(a | b)


def corpus(seed, n, base_words, edits):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(800)]
    rows = []
    for _ in range(n):
        base = [rng.choice(vocabulary) for _ in range(base_words)]
        rows.append(base)
        for k in edits:
            copy = list(base)
            for _ in range(k):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append(copy)
    rng.shuffle(rows)
    return [" ".join(r) for r in rows]


def checked(texts, out):
    """Every row that goes is a copy of its leader, which stays; returns the share of true pairs of which one goes."""
    s, kept, leader = sets(texts), {r["doc_id"]: r["keeper"] for r in out}, {r["doc_id"]: r["leader_id"] for r in out}
    for i in kept:
        if not kept[i]:
            assert kept[leader[i]] and alike(s[i], s[leader[i]]) >= 0.8
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if alike(s[i], s[j]) >= 0.8]
    return len(pairs), sum(not (kept[i] and kept[j]) for i, j in pairs) / max(1, len(pairs))


@pytest.mark.parametrize("few,leaders", [(4_000_000, 32), (600, 8)])
def test_near_copies_against_brute_force(spark, few, leaders):
    texts = corpus(1, 40, 160, [1, 2, 3, 5, 9]) + corpus(2, 1, 200, [1] * 60) + ["", None, "  ", "one two", "One  two", "one two three"]
    df = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in enumerate(texts)], "doc_id long, text string, same_ string, row_ int, keeper string")
    out = N.near_copies(df, few=few, leaders=leaders).collect()
    assert len(out) == len(texts) and {r["same_"] for r in out} == {"x"} and {r["row_"] for r in out} == {1}
    n, recall = checked(texts, out)
    assert n > 1800 and recall >= 0.97
    kept = {r["doc_id"] for r in out if r["keeper"]}
    assert {len(texts) - 6, len(texts) - 3, len(texts) - 1} <= kept and not {len(texts) - 5, len(texts) - 4, len(texts) - 2} & kept


def test_near_copies_edge_rows(spark):
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (None, "A b c d e f"), (None, "q r s t u v"), (None, "q r s t u v")]
    out = [(r["doc_id"], r["leader_id"], r["keeper"]) for r in N.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sum(k for *_, k in out) == 2 and sorted(k for d, _, k in out if d is None) == [False, False, True] and {x for d, x, _ in out if d == 5} == {5}
    assert N.near_copies(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_recall_on_the_given_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    ids = sorted(rows)
    texts = [rows[i] for i in ids]
    place = {d: i for i, d in enumerate(ids)}
    out = [{"doc_id": place[r["doc_id"]], "leader_id": place[r["leader_id"]], "keeper": r["keeper"]} for r in N.near_copies(docs).collect()]
    n, recall = checked(texts, out)
    assert n > 20 and recall >= 0.95


def test_sets_in_order_of_leaders():
    a = np.arange(10, dtype=np.int64)
    assert N.led([a, a[:9], a[:2], np.empty(0, np.int64), a[:3], np.empty(0, np.int64)], 0.8) == [0, 0, 2, 3, 4, 3]


@pytest.mark.parametrize("strip", [256, 8])
def test_tiles_linked_twice_give_the_same_components(spark, monkeypatch, strip):
    from driftgauge.llm import simhash
    from driftgauge.llm.components import components

    monkeypatch.setattr(simhash, "STRIP", strip)
    rng = np.random.default_rng(7)
    base = rng.integers(0, 2 ** 63, 6)
    rows = [(i, int(base[i % 6]) ^ (1 << int(rng.integers(63))) ^ (1 << int(rng.integers(63))), int(base[(i + 1) % 6])) for i in range(400)]
    df = spark.createDataFrame([*rows, (1000, 5, 6)], "v long, low long, high long")
    once, twice = (simhash.links(df, 6, ("low", "high"), "v", twice=t).collect() for t in (False, True))
    found = [sorted(map(tuple, components(spark.createDataFrame(x, "a long, b long")).collect())) for x in (once, twice)]
    assert found[0] == found[1] and len(found[0]) == 400 and len(twice) < 400 + 60 * 60


def test_leaders_against_all_pairs():
    rng = np.random.default_rng(11)
    base = [rng.choice(10_000, 60, replace=False) for _ in range(5)]
    sets = []
    for _ in range(300):
        s = base[rng.integers(5)].copy()
        k = rng.integers(0, 12)
        s[rng.choice(60, k, replace=False)] = rng.choice(10_000, k) + 20_000
        sets.append(np.unique(s[:rng.integers(40, 61)]).astype(np.int64))
    want, leaders = [], []
    for i, s in enumerate(sets):
        j = next((j for j in leaders if N.jaccard(s, sets[j]) >= 0.8), i)
        leaders += [i] if j == i else []
        want.append(j)
    assert N.led(sets, 0.8) == want and 5 < len(leaders) < 300


def _fingerprints(n, seed):
    """Groups of three with up to 15 bits changed in each."""
    rng = np.random.default_rng(seed)
    x = np.repeat(rng.integers(0, 2 ** 63, (n // 3, 2), dtype=np.uint64), 3, axis=0)
    for row in range(len(x)):
        for bit in rng.choice(128, rng.integers(16), replace=False):
            x[row, bit // 64] ^= np.uint64(1 << int(bit % 64))
    return x


def test_quarters_find_all_pairs():
    from driftgauge.llm import simhash
    x, y = _fingerprints(3000, 1), _fingerprints(900, 2)
    y[:300] = x[:300]

    def pairs(a, b):
        return {(i, j) for i in range(len(a)) for j in np.flatnonzero(np.bitwise_count(a[i] ^ b).sum(1) <= 27).tolist()}

    def found(it):
        return {p for i, j in it for p in zip(i.tolist(), j.tolist())}

    want = pairs(y, x)
    assert found(simhash.near(y, x, 27, parts=[(k, s, 3) for k in range(8) for s in range(3)])) == want
    assert found(simhash.near(y, x, 27)) == want
    own = {p for p in pairs(y, y) if p[0] < p[1]}
    for parts in (None, [(k, 0, 1) for k in range(8)]):
        assert {(min(p), max(p)) for p in found(simhash.near(y, y, 27, True, parts)) if p[0] != p[1]} == own


def test_quarters_test_few_of_the_pairs(monkeypatch):
    from driftgauge.llm import simhash
    x, tested = np.random.default_rng(3).integers(0, 2 ** 63, (60_000, 2), dtype=np.uint64), []
    monkeypatch.setattr(simhash, "_apart", lambda a, b: tested.append(len(a) * len(b)) or np.full((len(a), len(b)), 99, np.uint8))
    assert not list(simhash.near(x, x, 27, True)) and sum(tested) < 0.25 * len(x) ** 2


@pytest.mark.parametrize("most, bucket", [(200, 1), (10 ** 6, 1), (200, 8)])
def test_wide_tiles_give_the_same_components(spark, monkeypatch, most, bucket):
    from driftgauge.llm import simhash
    from driftgauge.llm.components import components
    x = _fingerprints(600, 5).view(np.int64)
    df = spark.createDataFrame([(i, int(a), int(b)) for i, (a, b) in enumerate(x)], "v long, low long, high long")
    want = sorted(map(tuple, components(simhash.links(df, 27, ("low", "high"), "v")).collect()))
    monkeypatch.setattr(simhash, "WIDE_MOST", most)
    monkeypatch.setattr(simhash, "IN_BUCKET", bucket)
    monkeypatch.setattr(simhash, "tested", lambda size, radius, quarters: 0.1 if bucket == 1 else 0.9)
    assert sorted(map(tuple, components(simhash.links(df, 27, ("low", "high"), "v", twice=True)).collect())) == want and len(want) > 500

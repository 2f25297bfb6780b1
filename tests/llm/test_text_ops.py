"""Suffix dedup, BPE and SimHash against brute force; nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from driftgauge.llm import bpe, simhash, suffix
from driftgauge.llm.suffixsort import suffix_arrays

R = random.Random(11)
WORDS = ["".join(R.choice("abcdeé ñ") for _ in range(R.randint(1, 9))) for _ in range(60)]


def prose(n):
    return " ".join(R.choice(WORDS) for _ in range(n))


def frame(spark, texts):
    """Extra columns carry names that the operators use themselves."""
    rows = [(i, t, "x", i) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, digest string, kept long")


def corpus():
    shared, base = [prose(60) for _ in range(3)], prose(300)
    texts = [prose(R.randint(0, 80)) + R.choice(shared) + prose(R.randint(0, 80)) for _ in range(60)]
    for _ in range(40):
        words = base.split(" ")
        for _ in range(R.randint(1, 6)):
            words[R.randrange(len(words))] = R.choice(WORDS)
        texts.append(" ".join(words))
    return texts + ["", None, "x" * 199, "y" * 200, "z" * 201, "ab" * 700, texts[0], texts[0], "q" * 150 + prose(20) + "q" * 500, prose(9000)]


# ---- suffix arrays -----------------------------------------------------------------------------

def test_suffix_arrays_of_many_collections():
    for _ in range(150):
        letters = R.choice([1, 2, 3, 5])
        groups = [[[R.randrange(letters) for _ in range(R.randint(0, 25))] for _ in range(R.randint(0, 4))] for _ in range(R.randint(1, 6))]
        symbols, owner = [], []
        for g, strings in enumerate(groups):
            for s in strings:
                symbols += [-1, *s]
                owner += [g] * (len(s) + 1)
        symbols, owner = np.array([*symbols, -1]), np.array([*owner, len(groups) - 1])

        def suffix_at(i, symbols=symbols, owner=owner):
            end = i
            while symbols[end] >= 0:
                end += 1
            return owner[i], symbols[i:end].tolist()

        order = suffix_arrays(symbols, owner)
        keys = [suffix_at(i) for i in order]
        assert keys == sorted(keys) and sorted(order) == np.flatnonzero(symbols >= 0).tolist()


def removed(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i:i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i:i + length]] > 1:
                gone[i:i + length] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(b), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    return out


@pytest.mark.parametrize("core_runs", [suffix.CORE_RUNS, 4])  # the second cuts every crowded core into narrower blocks
def test_suffix_dedup(spark, core_runs):
    texts = corpus()
    got = suffix.dedup(frame(spark, texts), core_runs=core_runs)
    assert {"doc_id", "text", "n_bytes", "kept"} <= set(got.columns)
    rows = sorted(got.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())
    assert [tuple(r)[1:] for r in rows] == removed(texts, 200)


def test_suffix_dedup_after_skewed_joins(spark):
    """Joins that split large partitions must not part the runs of a core."""
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
                "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.1"}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        texts = corpus()
        rows = sorted(suffix.dedup(frame(spark, texts), core_runs=4).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())
        assert [tuple(r)[1:] for r in rows] == removed(texts, 200)
    finally:
        for k in settings:
            spark.conf.unset(k)


def test_suffix_dedup_keeps_valid_text(spark):
    text = "é" * 150  # a cut inside a character leaves no broken piece
    rows = suffix.dedup(frame(spark, ["a" + text, "b" + text, "short"]), keep="text").orderBy("doc_id").collect()
    assert [r["kept"] for r in rows] == ["a", "b", "short"]


def test_suffix_dedup_of_nothing(spark):
    assert suffix.dedup(frame(spark, [])).collect() == []
    rows = suffix.dedup(frame(spark, [None, "", None])).collect()
    assert {(r["n_bytes"], r["n_removed"], r["n_spans"]) for r in rows} == {(0, 0, 0)}


# ---- BPE ---------------------------------------------------------------------------------------

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_bpe_is_the_library(spark):
    own = Tokenizer.from_file(PATH)
    own.no_truncation()
    own.no_padding()
    texts = corpus()[:20] + ["", None, "ΣΑΣ Σ", "a\x1cb\x85c d​e　f", "<|endoftext|> hi <|STARTOFTEXT|> <|startoftext|>", "é İ ﬁ Ⅷ ² ½ 12345",
                             "don't we'll I'VE x'd 's'd", "a" * 5000 + "!" * 300, "ha" * 3000, "😀 日本語 \x00\x01 한국어", "ͅ ʼn ǰ ẞ"]
    texts += ["".join(R.choice("aabbcde'stre ,.!1é\nAT") for _ in range(R.randint(1, 60))) for _ in range(300)]
    got = {r["doc_id"]: r for r in bpe.encode(frame(spark, texts), PATH).collect()}
    for i, text in enumerate(texts):
        ids = own.encode(text or "", add_special_tokens=False).ids
        decoded = own.decode(ids, skip_special_tokens=False)
        assert got[i]["ids"] == ids and got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()
        assert bpe.decode(np.array(ids, np.int32), PATH) == decoded
    assert bpe.encode(frame(spark, []), PATH).collect() == []


# ---- SimHash -----------------------------------------------------------------------------------

def reference_fingerprint(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i:i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_components(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILES_LEAST", 8)
    monkeypatch.setattr(simhash, "STRIP", 16)
    texts = corpus() + ["One two", "one TWO", " \t\n", "a b c d e", "a b c d e"]
    got = {r["doc_id"]: r for r in simhash.near_duplicates(frame(spark, texts)).collect()}
    fp = [reference_fingerprint(t) for t in texts]
    least = list(range(len(texts)))
    for _ in texts:  # minima spread over links until nothing changes
        new = [min(least[j] for j in range(len(texts)) if (fp[i] ^ fp[j]).bit_count() <= 4) for i in range(len(texts))]
        if new == least:
            break
        least = new
    assert [got[i]["fingerprint"] for i in range(len(texts))] == [f"{x:016x}" for x in fp]
    assert [got[i]["component_id"] for i in range(len(texts))] == least
    assert [got[i]["keeper"] for i in range(len(texts))] == [least[i] == i for i in range(len(texts))]


def test_simhash_null_ids_and_repeated_rows(spark):
    rows = [(None, "a b c d e"), (7, "a b c d e"), (7, "a b c d e"), (None, "other words stand here now"), (None, "other words stand here now")]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["component_id"] or -1, r["keeper"]) for r in got) == [(-1, False), (-1, True), (7, False), (7, False), (7, True)]
    assert simhash.near_duplicates(frame(spark, [])).collect() == []
    alone = simhash.near_duplicates(frame(spark, ["just one"])).select(F.col("component_id")).collect()
    assert [r[0] for r in alone] == [0]

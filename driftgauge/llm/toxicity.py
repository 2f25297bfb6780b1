"""Toxicity by a classifier chain over categories.

Features of a text are the lower-case words it holds and the first bytes of longer words, as hashes; only presence counts. The sample's document counts
by label are summed by Spark; the features that speak for toxic most clearly are kept.

The labels say toxic or not. The chain's categories are read from the labelled sample: `plain` (toxic, with a whole word that the sample ties to toxic
texts), `stem` (toxic, with a word beginning of that kind), `severe` (toxic, with several of them), and last `toxic`, the label itself.
Each category has a linear model over the features and over the probabilities of the categories before it. Those probabilities
are out of fold while training: each row's come from models that did not see it.

Bounds: at most `SAMPLE` labelled rows and `FEATURES` features reach the driver; everything else is scored on the executors.

Defined cases: a null or empty text has no features and the score of the intercepts; without toxic or without clean labels every score is the share
of toxic labels; extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftgauge.llm.common import flat, steps
from driftgauge.llm.rolling import Rolling, mix
from driftgauge.llm.training import labelled

SAMPLE = 8_000
FEATURES = 3_000
STEMS = (4, 5, 6, 7, 8)
CATEGORIES = ("plain", "stem", "severe", "toxic")
SEVERE = 4
CHAIN_FOLDS = 3
THRESHOLD = 0.5
LETTER = np.zeros(256, bool)
LETTER[ord("a"):ord("z") + 1] = True
LETTER[0x80:] = True
STEP = 1_000_000


def features(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first text, end, document, hash, kind) for steps of texts; kind 0: whole words, else the stem's length. Words repeat."""
    texts = pc.utf8_lower(pc.fill_null(texts, ""))
    data, offsets = flat(texts)
    for i, j in steps(offsets, STEP):
        piece, inner = data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]
        letter = LETTER[piece]
        first = letter.copy()
        first[1:] &= ~letter[:-1]
        heads = inner[:-1][inner[:-1] < len(piece)]
        first[heads] = letter[heads]
        start = np.flatnonzero(first)
        stop = np.flatnonzero(np.append(~letter | first, True))
        end = stop[np.searchsorted(stop, start, side="right")] if len(start) else start
        doc = np.searchsorted(inner, start, side="right") - 1
        if not len(start):
            yield i, j, *(np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64))
            continue
        rolling = Rolling(piece)
        docs, hashes, kinds = [doc], [mix(rolling.raw(start, end))], [np.zeros(len(doc), np.int64)]
        for k in STEMS:
            long_ = end - start > k
            docs.append(doc[long_])
            hashes.append(mix(rolling.raw(start[long_], start[long_] + k) + np.uint64(k)))
            kinds.append(np.full(len(docs[-1]), k))
        yield i, j, np.concatenate(docs), np.concatenate(hashes), np.concatenate(kinds)


def _presence(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    for i, j, doc, h, kind in features(texts):
        by = np.lexsort((h, doc))
        doc, h, kind = doc[by], h[by], kind[by]
        new = np.append(True, (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])) if len(doc) else np.empty(0, bool)
        yield i, j, doc[new], h[new], kind[new]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        y = batch.column(1).to_numpy()
        for i, _, doc, h, kind in _presence(batch.column(0)):
            names, at = np.unique(h, return_inverse=True)
            bad = np.bincount(at, weights=y[doc + i], minlength=len(names)).astype(np.int64)
            every = np.bincount(at, minlength=len(names))
            kinds = np.zeros(len(names), np.int64)
            kinds[at] = kind
            yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(kinds), pa.array(bad), pa.array(every)], ["h", "kind", "bad", "n"])


def _known(names: np.ndarray):
    """Rows (id, y, places of the known features)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, doc, h, _ in _presence(batch.column(1)):
                at = np.minimum(np.searchsorted(names, h), len(names) - 1)
                hit = names[at] == h
                ends = np.concatenate([[0], np.cumsum(np.bincount(doc[hit], minlength=j - i))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i),
                                                  pa.ListArray.from_arrays(pa.array(ends), pa.array(at[hit].astype(np.int32)))], ["doc_id", "y", "at"])

    return run


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Rows:
    """Presence of features in rows: row[i] holds feature at[i]."""

    row: np.ndarray
    at: np.ndarray
    n: int

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=w[self.at], minlength=self.n)

    def only(self, keep: np.ndarray) -> Rows:
        inside = keep[self.row]
        return Rows((np.cumsum(keep) - 1)[self.row[inside]], self.at[inside], int(keep.sum()))


def fit(rows: Rows, extra: np.ndarray, y: np.ndarray, width: int, rounds: int = 150, l2: float = 1e-4) -> np.ndarray:
    """Logistic regression by gradient steps with momentum and scaling: weights of the features, of `extra` (earlier categories), and the intercept."""
    w = np.zeros(width + extra.shape[1] + 1)
    w[-1] = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    first, second = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        p = _sigmoid(rows.times(w[:width]) + extra @ w[width:-1] + w[-1])
        off = (p - y) / len(y)
        g = np.concatenate([np.bincount(rows.at, weights=off[rows.row], minlength=width), extra.T @ off, [off.sum()]])
        g[:-1] += l2 * w[:-1]
        first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
        w -= 0.15 * (first / (1 - 0.9 ** t)) / (np.sqrt(second / (1 - 0.99 ** t)) + 1e-8)
    return w


def predict(rows: Rows, extra: np.ndarray, w: np.ndarray, width: int) -> np.ndarray:
    return _sigmoid(rows.times(w[:width]) + extra @ w[width:-1] + w[-1])


@dataclass
class Chain:
    names: np.ndarray  # hashes of the features, ascending
    models: list[np.ndarray]  # one per category
    share: float  # of toxic labels, the score when nothing can be learned

    def score(self, rows: Rows) -> np.ndarray:
        """Probabilities of all categories, in the order of the chain."""
        if not self.models:
            return np.full((rows.n, len(CATEGORIES)), self.share)
        out = np.empty((rows.n, 0))
        for w in self.models:
            out = np.column_stack([out, predict(rows, out, w, len(self.names))])
        return out


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Chain:
    sample = labelled(docs, labels, "toxic", most)
    counts = sample.select("text", "y").mapInArrow(_counts, "h long, kind long, bad long, n long") \
        .groupBy("h", "kind").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"))
    total = sample.agg(F.count("*").alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("bad")).first()
    bad, good = total["bad"], total["n"] - total["bad"]
    if not bad or not good:
        return Chain(np.empty(0, np.uint64), [], bad / total["n"] if total["n"] else 0.0)
    odds = F.log((F.col("bad") + 0.1) / (bad + 0.2)) - F.log((F.col("n") - F.col("bad") + 0.1) / (good + 0.2))
    # Evidence for toxic only, log odds times what stands behind them: a long clean text must not outweigh what stands in it.
    best = counts.withColumn("odds", odds).filter("n > 1 AND odds > 1").orderBy((F.col("odds") * F.sqrt("bad")).desc(), "h").limit(FEATURES).toPandas()
    best["u"] = best["h"].to_numpy().view(np.uint64)
    best = best.sort_values("u").reset_index(drop=True)
    names = best["u"].to_numpy()
    if not len(names):
        return Chain(names, [], bad / total["n"])
    table = sample.select("doc_id", "text", "y").mapInArrow(_known(names), "doc_id long, y int, at array<int>").toPandas().sort_values("doc_id", kind="stable")
    y, at = table["y"].to_numpy().astype(float), [np.asarray(x, np.int64) for x in table["at"]]
    rows = Rows(np.repeat(np.arange(len(at)), [len(x) for x in at]), np.concatenate(at) if at else np.empty(0, np.int64), len(at))
    telling = (best["odds"] > 2).to_numpy() & (best["bad"] > 0.9 * best["n"]).to_numpy()
    whole = (best["kind"] == 0).to_numpy()
    words = rows.times((telling & whole).astype(float))
    stems = rows.times((telling & ~whole).astype(float))
    targets = {"plain": y * (words > 0), "stem": y * (stems > 0), "severe": y * (words + stems >= SEVERE), "toxic": y}
    part = np.arange(rows.n) % CHAIN_FOLDS
    models, earlier = [], np.empty((rows.n, 0))
    for category in CATEGORIES:
        goal = targets[category]
        models.append(fit(rows, earlier, goal, len(names)))
        if category != CATEGORIES[-1]:
            unseen = np.zeros(rows.n)
            for k in range(CHAIN_FOLDS):
                seen = part != k
                if seen.all() or not seen.any():
                    continue
                w = fit(rows.only(seen), earlier[seen], goal[seen], len(names))
                unseen[~seen] = predict(rows.only(~seen), earlier[~seen], w, len(names))
            earlier = np.column_stack([earlier, unseen])
    return Chain(names, models, bad / total["n"])


def score(docs: DataFrame, chain: Chain) -> DataFrame:
    """docs with p_<category> of every category and `predicted` (1: toxic)."""
    columns = [f"p_{c}" for c in CATEGORIES]
    docs = docs.drop(*columns, "predicted")
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, doc, h, _ in features(batch.column(at)):
                if len(chain.names):
                    place = np.minimum(np.searchsorted(chain.names, h), len(chain.names) - 1)
                    hit = chain.names[place] == h
                    pairs = np.unique(doc[hit] * len(chain.names) + place[hit])
                    rows = Rows(pairs // len(chain.names), pairs % len(chain.names), j - i)
                else:
                    rows = Rows(np.empty(0, np.int64), np.empty(0, np.int64), j - i)
                p = chain.score(rows)
                part = batch.slice(i, j - i)
                for k, name in enumerate(columns):
                    part = part.append_column(name, pa.array(p[:, k]))
                yield part.append_column("predicted", pa.array((p[:, -1] >= THRESHOLD).astype(np.int32)))

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *(T.StructField(c, T.DoubleType()) for c in columns),
                                              T.StructField("predicted", T.IntegerType())]))

"""Document quality from line labels of a linear-chain conditional random field.

Every line of a text is good or bad. A line's features are shares of its bytes and words (capitals, punctuation, digits, repeated words and marks, bars) and the same
shares of the lines before and after it; a transition weight ties neighbouring labels. The field is trained on lines of a bounded sample of labelled
documents, each line carrying its document's label, by gradient steps on the exact conditional likelihood. A document's score is the
mean over its lines of the forward-backward marginal of `good`, weighted by line length, and then bent so that the cut that is
best on the sample's documents lies at the threshold.

Features are computed for whole texts in flat byte buffers; the recursions run over all documents of a batch at once.

Bounds: at most `SAMPLE` labelled documents and `LINES` lines of each reach the driver in training. Scoring has no bounds.

Defined cases: a null or empty text is one empty line and gets a score; without both labels in the sample every score is the share of good ones (0.5 without any);
texts of any length and any number of lines are scored whole; extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from driftgauge.llm.common import flat, steps
from driftgauge.llm.rolling import Rolling
from driftgauge.llm.training import labelled

SAMPLE = 4_000
LINES = 256
CHAIN = 64
THRESHOLD = 0.3
STEP = 1_000_000
_BYTE = np.arange(256)
UPPER = (_BYTE >= 65) & (_BYTE <= 90)
LETTER = UPPER | ((_BYTE >= 97) & (_BYTE <= 122)) | (_BYTE >= 128)
DIGIT = (_BYTE >= 48) & (_BYTE <= 57)
SPACE = ((_BYTE >= 9) & (_BYTE <= 13)) | (_BYTE == 32)
PUNCT = ~(LETTER | DIGIT | SPACE)
BASIC = 13
WIDTH = 3 * BASIC + 1


def lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features (WIDTH columns) and byte length of every line, and the number of lines of each text."""
    n = len(data)
    breaks = np.flatnonzero(data == 10)
    doc = np.searchsorted(offsets, breaks, side="right") - 1
    counts = 1 + np.bincount(doc, minlength=len(offsets) - 1)
    docs = np.arange(len(offsets) - 1)
    start = np.concatenate([offsets[:-1], breaks + 1])
    start = start[np.lexsort((start, np.concatenate([docs, doc])))]
    end = np.concatenate([breaks, offsets[1:]])
    end = end[np.lexsort((end, np.concatenate([doc, docs])))]

    def share(flags: np.ndarray) -> np.ndarray:
        total = np.zeros(n + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return (total[end] - total[start]).astype(np.float64)

    space, punct = SPACE[data], PUNCT[data]
    letter, upper = share(LETTER[data]), share(UPPER[data])
    marks, digits, black = share(punct), share(DIGIT[data]), share(~space)
    bars = share(data == ord("|"))
    twice = np.zeros(n, bool)
    twice[1:] = punct[1:] & (data[1:] == data[:-1])
    doubled = share(twice)
    # words, across the whole buffer; a text starts a new word
    first = ~space
    first[1:] &= space[:-1]
    heads = offsets[:-1][offsets[:-1] < n]
    first[heads] = ~space[heads]
    at = np.flatnonzero(first)
    again, ended = np.zeros(n, bool), np.zeros(n, bool)
    if len(at):
        stop = np.flatnonzero(np.append(space | first, True))
        to = stop[np.searchsorted(stop, at, side="right")]
        name = Rolling(data).raw(at, to)
        of = np.searchsorted(offsets, at, side="right")
        for back in (1, 2):
            same = (name[back:] == name[:-back]) & (of[back:] == of[:-back])
            again[at[back:][same]] = True
        ended[at] = punct[to - 1]
    words, repeated, closed = share(first), share(again), share(ended)
    some, any_word = np.maximum(black, 1), np.maximum(words, 1)
    capital, mark, repeat = upper / np.maximum(letter, 1), marks / some, repeated / any_word
    basic = np.column_stack([capital, mark, digits / some, repeat, doubled / some, np.minimum(black / any_word / 10, 3), np.log1p(end - start) / 10,
                             bars / any_word, closed / any_word, capital > 0.5, mark > 0.2, repeat > 0.25, words == 0]).astype(np.float64)
    owner = np.repeat(docs, counts)
    before, after = np.zeros_like(basic), np.zeros_like(basic)
    if len(basic) > 1:
        joined = (owner[1:] == owner[:-1])[:, None]
        before[1:] = basic[:-1] * joined
        after[:-1] = basic[1:] * joined
    return np.column_stack([basic, before, after, np.ones(len(basic))]), (end - start).astype(np.float64), counts


def _padded(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    out = np.zeros((len(counts), int(counts.max(initial=0))))
    out[np.arange(out.shape[1]) < counts[:, None]] = values
    return out


def _recursions(score: np.ndarray, counts: np.ndarray, tie: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log messages from the left (with the line's own score) and from the right, [chain, line, state], and the log partition."""
    n, most = score.shape
    local = np.stack([np.zeros_like(score), score], axis=2)
    ahead, behind = np.zeros((n, most, 2)), np.zeros((n, most, 2))
    ahead[:, 0] = local[:, 0]
    for t in range(1, most):
        live = counts > t
        ahead[live, t] = np.logaddexp(ahead[live, t - 1, :1] + tie[0], ahead[live, t - 1, 1:] + tie[1]) + local[live, t]
    for t in range(most - 2, -1, -1):
        live = counts > t + 1
        nxt = behind[live, t + 1] + local[live, t + 1]
        behind[live, t] = np.logaddexp(nxt[:, :1] + tie[:, 0], nxt[:, 1:] + tie[:, 1])
    last = ahead[np.arange(n), counts - 1]
    return ahead, behind, np.logaddexp(last[:, 0], last[:, 1])


def marginals(score: np.ndarray, counts: np.ndarray, tie: np.ndarray) -> np.ndarray:
    """Probability that each line is good; lines one after the other, counts of each chain. Chains of like length share their steps."""
    out, starts = np.empty(len(score)), np.cumsum(counts) - counts
    by = np.argsort(counts, kind="stable")
    at = 0
    while at < len(by):
        to = int(np.searchsorted(counts[by], max(8, 2 * counts[by[at]]), side="right"))
        size = counts[by[at:to]]
        cells = np.repeat(starts[by[at:to]] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        ahead, behind, total = _recursions(_padded(score[cells], size), size, tie)
        out[cells] = np.exp(ahead[:, :, 1] + behind[:, :, 1] - total[:, None])[np.arange(size.max()) < size[:, None]]
        at = to
    return np.clip(out, 0, 1)


@dataclass
class Field:
    weights: np.ndarray  # of the features, for good against bad
    tie: np.ndarray  # 2 x 2: label before, label
    cut: float  # the best cut on the sample
    share: float | None = None  # of good labels, when nothing can be learned

    def documents(self, x: np.ndarray, length: np.ndarray, counts: np.ndarray) -> np.ndarray:
        if self.share is not None:
            return np.full(len(counts), self.share)
        raw = self.raw(x, length, counts)
        return np.where(raw <= self.cut, THRESHOLD * raw / self.cut, THRESHOLD + (1 - THRESHOLD) * (raw - self.cut) / (1 - self.cut))

    def raw(self, x: np.ndarray, length: np.ndarray, counts: np.ndarray) -> np.ndarray:
        good = marginals(x @ self.weights, counts, self.tie)
        heads = np.cumsum(counts) - counts
        return np.clip(np.add.reduceat(good * (length + 1), heads) / np.add.reduceat(length + 1, heads), 0, 1)


def fit(x: np.ndarray, counts: np.ndarray, y: np.ndarray, rounds: int = 120, l2: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ties of chains whose lines all carry the chain's label, by gradient steps with momentum and scaling."""
    w = np.zeros(x.shape[1] + 4)
    first, second = np.zeros_like(w), np.zeros_like(w)
    inside = np.arange(counts.max()) < counts[:, None]
    target = np.repeat(y, counts)
    pairs = np.bincount(3 * y.astype(int), weights=counts - 1, minlength=4)  # bad-bad and good-good
    for t in range(1, rounds + 1):
        score, tie = x @ w[:-4], w[-4:].reshape(2, 2)
        ahead, behind, total = _recursions(_padded(score, counts), counts, tie)
        good = np.exp(np.minimum(0, ahead[:, :, 1] + behind[:, :, 1] - total[:, None]))[inside]
        local = np.stack([np.zeros_like(ahead[:, :, 0]), _padded(score, counts)], axis=2)
        joint = ahead[:, :-1, :, None] + tie + (local + behind)[:, 1:, None, :] - total[:, None, None, None]
        expected = np.where(inside[:, 1:, None, None], np.exp(np.minimum(0, joint)), 0).sum((0, 1)).ravel()
        g = np.concatenate([x.T @ (good - target), expected - pairs]) / len(target) + l2 * w
        first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
        w -= 0.2 * (first / (1 - 0.9 ** t)) / (np.sqrt(second / (1 - 0.99 ** t)) + 1e-8)
    return w[:-4], w[-4:].reshape(2, 2)


def _sampled(place: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Which lines are learned from, by place in a text of `count` lines: all of LINES lines, else LINES / CHAIN chains spread evenly over the whole text."""
    # Chain k of a long text starts at the k-th even step between the first line and the last chain's start.
    chains = LINES // CHAIN
    room = np.maximum(count - CHAIN, 0)
    starts = room[:, None] * np.arange(chains) // (chains - 1)
    return (count <= LINES) | ((place[:, None] >= starts) & (place[:, None] < starts + CHAIN)).any(1)


def _lines_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, y) -> (y, lines of the text, features and lengths of at most LINES of them)."""
    for batch in batches:
        data, offsets = flat(batch.column(0))
        for i, j in steps(offsets, STEP):
            x, length, counts = lines(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
            place = np.arange(len(x)) - np.repeat(np.cumsum(counts) - counts, counts)
            keep = _sampled(place, np.repeat(counts, counts))
            ends = np.concatenate([[0], np.cumsum(np.minimum(counts, LINES))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(1).slice(i, j - i), pa.ListArray.from_arrays(pa.array(ends), pa.array(length[keep])),
                 pa.ListArray.from_arrays(pa.array(ends * WIDTH), pa.array(x[keep].ravel()))], ["y", "length", "x"])


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Field:
    sample = labelled(docs, labels, "quality", most).orderBy("doc_id").select("text", "y") \
        .mapInArrow(_lines_of, "y int, length array<double>, x array<double>").toArrow()
    y = sample.column("y").to_numpy().astype(float)
    if not len(y) or y.min() == y.max():
        return Field(np.zeros(WIDTH), np.zeros((2, 2)), 0.5, float(y.mean()) if len(y) else 0.5)
    length = [np.asarray(v) for v in sample.column("length").to_pylist()]
    x = np.concatenate([np.asarray(v) for v in sample.column("x").to_pylist()]).reshape(-1, WIDTH)
    counts = np.array([len(v) for v in length])
    # Long documents are several chains in training.
    pieces = [[min(CHAIN, c - k) for k in range(0, c, CHAIN)] for c in counts]
    weights, tie = fit(x, np.array([p for ps in pieces for p in ps]), np.repeat(y, [len(ps) for ps in pieces]))
    raw = Field(weights, tie, 0.5).raw(x, np.concatenate(length), counts)
    cuts = np.linspace(0.02, 0.98, 97)
    errors = [((raw >= c) & (y == 0)).sum() / (y == 0).sum() + ((raw < c) & (y == 1)).sum() / (y == 1).sum() for c in cuts]
    best = np.flatnonzero(np.array(errors) <= min(errors) + 1e-12)
    return Field(weights, tie, float(cuts[best].mean()))


def score(docs: DataFrame, field: Field) -> DataFrame:
    """docs with score (0 to 1, higher: good) and predicted (1: good)."""
    docs = docs.drop("score", "predicted")
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column(at))
            for i, j in steps(offsets, STEP):
                s = field.documents(*lines(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]))
                part = batch.slice(i, j - i).append_column("score", pa.array(s))
                yield part.append_column("predicted", pa.array((s >= THRESHOLD).astype(np.int32)))

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))

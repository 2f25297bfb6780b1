"""Embedding whitening by shifted CholeskyQR.

The centred rows X (n rows, d columns) are factored as Q R without ever being gathered: each pass over the rows sums a Gram matrix (d x d) per task, the
sums meet row by row of the matrix in a shuffle, and the driver takes a Cholesky factor of it. The first Gram matrix is shifted by a multiple of its
norm, so that its factor exists whatever the condition; the next pass solves the triangle for every row and sums the Gram matrix of what comes out, which
is nearly orthogonal; the third makes it orthogonal to double precision. R is the product of the three factors, and the singular values and right vectors of
R (d x d) are those of X: eigenvalues are their squares over n.

A pass reads the rows and sends one d x d matrix per task; rows travel nowhere, so skew of any kind has no effect. The driver holds matrices of d x d.

Entries are taken as whole numbers x = floor(scale * c) + offset, so the sums S and the deviation (sum over dimensions of (n*x - S)^2) are exact.

Defined cases: a vector that is null, empty, or holds null or non-finite entries is left out, as is one with an entry beyond 2^40 (its x would not be exact); of
vectors with different numbers of dimensions those of the most frequent number stay (ties: the larger number); a null key stays; repeated rows count
each time; a component without variance keeps its rows with a null `whitened` and 0 in `explained` (null if nothing varies at all) and is no part of
`identity_error`; a deviation beyond 64 bits is null; no rows, no results; extra columns pass through, and columns named like the results are replaced.
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

SCALE, OFFSET = 1024, 100_000
#: Larger entries are not whole numbers that a double holds exactly after scaling.
LARGEST = float(2 ** 40)
#: Singular values below this share of the largest are no variance but rounding.
NOTHING = 1e-10
RESULTS = [T.StructField("n", T.LongType()), T.StructField("deviation", T.LongType()), T.StructField("whitened", T.ArrayType(T.DoubleType()))]


@dataclass(frozen=True)
class Whitening:
    """A fitted model. components: one unit vector per row, by falling eigenvalue; sums are exact integers."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float

    @property
    def mean(self) -> np.ndarray:
        # n and S may be beyond 2^53; Python divides integers correctly rounded.
        return np.array([s / self.n for s in self.sums])

    @property
    def explained(self) -> list[float | None]:
        return [float(e / self.trace) if self.trace > 0 else None for e in self.eigenvalues]


def _dense(column: pa.Array, dimensions: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Positions of usable vectors and their entries, one row each; dimensions None: positions and lengths only."""
    lengths = np.array([-1 if v is None else v for v in pc.list_value_length(column).to_pylist()])
    values = column.flatten()
    ok = lengths > 0
    plain = values.to_numpy(zero_copy_only=False).astype(np.float64)  # null becomes NaN
    bad = ~(np.abs(plain) <= LARGEST)
    ends = np.cumsum(np.maximum(lengths, 0))
    wrong = np.concatenate([[0], np.cumsum(bad)])
    starts = ends - np.maximum(lengths, 0)
    ok &= wrong[ends] == wrong[starts]
    if dimensions is None:
        return np.flatnonzero(ok), lengths[ok]
    at = np.flatnonzero(ok & (lengths == dimensions))
    return at, plain[starts[at][:, None] + np.arange(dimensions)] if len(at) else np.empty((0, dimensions))


def whole(entries: np.ndarray) -> np.ndarray:
    return np.floor(SCALE * entries).astype(np.int64) + OFFSET


def _sums(vector: int):
    """Per task: each number of dimensions with its count of vectors and the exact sum of each dimension, as text of any length."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, int] = {}
        totals: dict[int, list[int]] = {}
        for batch in batches:
            _, lengths = _dense(batch.column(vector))
            for d in np.unique(lengths).tolist():
                _, entries = _dense(batch.column(vector), d)
                x = whole(entries)
                # 2^50 times the rows of a batch stay in 64 bits.
                part = [int(v) for i in range(0, len(x), 4096) for v in x[i:i + 4096].sum(0)]
                part = [sum(part[j::d]) for j in range(d)]
                counts[d] = counts.get(d, 0) + len(x)
                totals[d] = [a + b for a, b in zip(totals[d], part)] if d in totals else part
        for d, count in counts.items():
            yield pa.RecordBatch.from_pydict({"d": pa.array([d] * d, pa.int32()), "i": pa.array(range(d), pa.int32()), "n": pa.array([count] * d, pa.int64()),
                                              "s": pa.array([str(v) for v in totals[d]])})

    return run


def _gram(vector: int, mean: np.ndarray, factors: list[np.ndarray]):
    """Per task: the Gram matrix of its centred rows, each solved against the factors so far."""
    d = len(mean)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram = np.zeros((d, d))
        for batch in batches:
            _, entries = _dense(batch.column(vector), d)
            rows = (whole(entries) - mean).T
            for r in factors:  # q R = x  for every row x
                rows = np.linalg.solve(r.T, rows)
            gram += rows @ rows.T
        yield pa.RecordBatch.from_pydict({"i": pa.array(range(d), pa.int32()), "row": pa.array(list(gram), pa.list_(pa.float64()))})

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the vectors of each i; one vector per i is held."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for i, row in zip(batch.column(0).to_pylist(), batch.column(1)):
            v = row.values.to_numpy()
            total[i] = total[i] + v if i in total else v.copy()
    yield pa.RecordBatch.from_pydict({"i": pa.array(list(total), pa.int32()), "row": pa.array(list(total.values()), pa.list_(pa.float64()))})


def gathered(parts: DataFrame, d: int) -> np.ndarray:
    """The sum over tasks of matrices given as rows (i, row)."""
    out = np.zeros((d, d))
    for r in parts.repartition("i").mapInArrow(_added, "i int, row array<double>").collect():
        out[r["i"]] += np.array(r["row"])
    return out


def factor(gram: np.ndarray, shift: float) -> np.ndarray:
    """The upper Cholesky factor of a shifted Gram matrix; the shift grows until there is one (directions without variance)."""
    size = max(float(np.trace(gram)), np.finfo(float).tiny)
    step = len(gram) * np.finfo(float).eps * size
    while True:
        try:
            return np.linalg.cholesky(gram + shift * np.eye(len(gram))).T
        except np.linalg.LinAlgError:
            shift = max(step, 10 * shift)


def fit(vectors: DataFrame, vector: str = "embedding") -> Whitening | None:
    """Means and components of all usable vectors; None if there is none."""
    rows = vectors.select(vector)
    sums = rows.mapInArrow(_sums(0), "d int, i int, n long, s string") \
        .groupBy("d", "i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    found = sums.withColumn("most", F.struct("n", "d"))
    top = found.agg(F.max("most").alias("top")).first()["top"]
    if top is None:
        return None
    n, d = int(top["n"]), int(top["d"])
    exact = {r["i"]: int(r["s"]) for r in sums.filter(F.col("d") == d).collect()}
    totals = tuple(exact[i] for i in range(d))
    mean = np.array([s / n for s in totals])
    r, factors = np.eye(d), []
    for turn in range(3):
        gram = gathered(rows.mapInArrow(_gram(0, mean, factors), "i int, row array<double>"), d)
        gram = (gram + gram.T) / 2
        # The shift of the published method: 11 (n d + d (d + 1)) rounding units of the squared norm.
        shift = 11 * (n * d + d * (d + 1)) * np.finfo(float).eps / 2 * float(np.linalg.norm(gram, 2)) if turn == 0 else 0.0
        factors.append(factor(gram, min(shift, float(np.trace(gram)) or 1.0)))
        r = factors[-1] @ r
    _, singular, components = np.linalg.svd(r)
    largest = singular[0] if len(singular) else 0.0
    # A spread that rounding of the mean alone can make is none.
    noise = max(NOTHING * largest, 4 * np.finfo(float).eps * float(np.abs(mean).max()) * np.sqrt(n))
    singular = np.where(singular > noise, singular, 0.0)
    sign = np.sign(components[np.arange(d), np.abs(components).argmax(1)])
    eigenvalues = singular ** 2 / n
    return Whitening(n, totals, components * sign[:, None], eigenvalues, float(eigenvalues.sum()))


def _project(x: np.ndarray, model: Whitening, most: int) -> np.ndarray:
    scale = np.array([1 / np.sqrt(e) if e > 0 else np.nan for e in model.eigenvalues[:most]])
    return (x - model.mean) @ model.components[:most].T * scale


def deviations(x: np.ndarray, n: int, sums: tuple[int, ...]) -> list[int | None]:
    """Sum over dimensions of (n*x - S)^2, exactly; None if it needs more than 64 bits."""
    far = max((abs(n * int(v) - s) for edge in (x.min(0), x.max(0)) for v, s in zip(edge, sums)), default=0) if len(x) else 0
    if far * far * max(x.shape[1], 1) < 2 ** 63:
        # Then every step fits: n*x and S are within `far` of each other, and wrapping sums of 64 bits are exact modulo 2^64.
        apart = np.int64(n) * x - np.array([((s + 2 ** 63) % 2 ** 64) - 2 ** 63 for s in sums], np.int64)
        return (apart * apart).sum(1).tolist()
    exact = [sum((n * v - s) ** 2 for v, s in zip(row, sums)) for row in x.tolist()]
    return [v if v < 2 ** 63 else None for v in exact]


def apply(vectors: DataFrame, model: Whitening | None, most: int = 8, vector: str = "embedding") -> DataFrame:
    """The usable rows of vectors with n, deviation and whitened (one entry per component, `most` at most)."""
    kept = [c for c in vectors.columns if c not in {f.name for f in RESULTS}]
    schema = T.StructType([*(vectors.schema[c] for c in kept), *RESULTS])
    at_vector, names = kept.index(vector), schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if model is None:
                continue
            at, entries = _dense(batch.column(at_vector), len(model.sums))
            x = whole(entries)
            made = _project(x, model, most)
            shown = pa.array(made.ravel(), pa.float64(), from_pandas=True)  # NaN: no variance
            offsets = pa.array(np.arange(len(at) + 1) * made.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*(c.take(pa.array(at)) for c in batch.columns), pa.array([model.n] * len(at), pa.int64()),
                 pa.array(deviations(x, model.n, model.sums), pa.int64()), pa.ListArray.from_arrays(offsets, shown)], names=names)

    return vectors.select(*kept).mapInArrow(run, schema)


def identity_error(vectors: DataFrame, model: Whitening, most: int = 8, vector: str = "embedding") -> float:
    """Measured over all rows: the largest absolute entry of the whitened rows' covariance minus the identity."""
    live = [k for k in range(min(most, len(model.sums))) if model.eigenvalues[k] > 0]
    if not live:
        return 0.0
    d = len(live) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram = np.zeros((d, d))
        for batch in batches:
            w = _project(whole(_dense(batch.column(0), len(model.sums))[1]), model, most)[:, live]
            w = np.column_stack([w, np.ones(len(w))])
            gram += w.T @ w
        yield pa.RecordBatch.from_pydict({"i": pa.array(range(d), pa.int32()), "row": pa.array(list(gram), pa.list_(pa.float64()))})

    gram = gathered(vectors.select(vector).mapInArrow(run, "i int, row array<double>"), d) / model.n
    spread = gram[:-1, :-1] - np.outer(gram[:-1, -1], gram[:-1, -1])
    return float(np.abs(spread - np.eye(d - 1)).max())

"""Weighted terms of whole texts and their reduction to a few dimensions."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftgauge.operators.ordered import row_index
from driftgauge.operators.prepare import StandardScale
from driftgauge.session import settled, stored

WORD_BREAK = r"[^\p{L}\p{N}_]+"
#: Words whose terms are counted at once, and weights that are multiplied at once.
WORDS_AT_ONCE, WEIGHTS_AT_ONCE = 2_000_000, 200_000


class Rows:
    """A frame with one row per term, which is only made if it is read as such; functions here read the denser form it comes from."""

    def __init__(self, rows: DataFrame):
        self.rows = rows

    def __getattr__(self, name: str):
        if name == "rows":
            raise AttributeError(name)
        return getattr(self.rows, name)

    def __getitem__(self, name):
        return self.rows[name]


class Terms(Rows):
    """(key, term, tf). words: the key and `_w`, the words of each text, with equal keys side by side in one task."""

    def __init__(self, words: DataFrame, key: str, pairs: bool):
        self.words, self.key, self.pairs = words, key, pairs
        super().__init__(words.mapInArrow(_listed(pairs), f"`{key}` {words.schema[key].dataType.simpleString()}, term string, tf long"))


class Weights(Rows):
    """(key, term, term_id, weight). packed: the key with its term ids `i` and weights `x`."""

    def __init__(self, rows: DataFrame, packed: DataFrame):
        super().__init__(rows)
        self.packed = packed


@dataclass(frozen=True)
class Counts:
    """Counts of the terms of some keys: `at` is the place of a count's key, `one` and `two` are words of the dictionary; `two` is -1 for single words."""

    keys: pa.Array
    words: pa.Array
    at: np.ndarray
    one: np.ndarray
    two: np.ndarray
    tf: np.ndarray

    def spelled(self, one: np.ndarray, two: np.ndarray) -> pa.Array:
        single, paired = np.flatnonzero(two < 0), np.flatnonzero(two >= 0)
        names = pa.concat_arrays([self.words.take(pa.array(one[single])), pc.binary_join_element_wise(
            self.words.take(pa.array(one[paired])), self.words.take(pa.array(two[paired])), pa.scalar(" ", self.words.type))])
        return names.take(pa.array(np.argsort(np.concatenate([single, paired]))))

    def of(self, kept: np.ndarray) -> Counts:
        return Counts(self.keys, self.words, self.at[kept], self.one[kept], self.two[kept], self.tf[kept])


def _sorted_counts(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(codes, return_counts=True)


def _count(keys: pa.Array, lists: pa.ListArray, place: np.ndarray, pairs: bool) -> Counts:
    """place: of the key of each text."""
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    code, width = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), max(1, len(coded.dictionary))
    at = np.repeat(place, sizes)
    found, tf = _sorted_counts(at * width + code)
    whose, one, two = found // width, found % width, np.full(len(found), -1)
    if pairs and len(code) > 1:
        text = np.repeat(np.arange(len(sizes)), sizes)
        near = text[1:] == text[:-1]
        first, second = code[:-1][near], code[1:][near]
        if len(keys) * width * width < 2**62:
            both, more = _sorted_counts((at[1:][near] * width + first) * width + second)
            left, right = both // width, both % width
        else:  # numbers of the pairs in place of the pairs
            listed, number = np.unique(first * width + second, return_inverse=True)
            both, more = _sorted_counts(at[1:][near] * len(listed) + number)
            left, right = (both // len(listed)) * width + listed[both % len(listed)] // width, listed[both % len(listed)] % width
        whose, one, two, tf = (np.concatenate(x) for x in ((whose, left // width), (one, left % width), (two, right), (tf, more)))
    return Counts(keys, coded.dictionary, whose, one, two, tf)


def _counts(batches: Iterator[pa.RecordBatch], pairs: bool) -> Iterator[Counts]:
    """Counts of all terms, each key once: the last key of a batch is held until its end is seen."""
    held_key, held = None, None

    def closed() -> Counts:
        words = pa.array(list(held), pa.string())
        return Counts(held_key, words, np.zeros(len(held), np.int64), np.arange(len(held)), np.full(len(held), -1), np.array(list(held.values()), np.int64))

    for batch in batches:
        keys, lists = batch.column(0), batch.column(1)
        if not len(keys):
            continue
        same = pa.concat_arrays([keys[:1] if held_key is None else held_key, keys]).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        starts = same[1:] != same[:-1]
        goes_on = held_key is not None and not starts[0]
        starts[0] = True
        first = np.flatnonzero(starts)
        ends = np.append(first[1:], len(keys))
        words = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)])
        i = 0
        while i < len(first):
            j = max(i + 1, int(np.searchsorted(words[ends], words[first[i]] + WORDS_AT_ONCE, side="right")))
            j = min(j, len(first))
            low, high = int(first[i]), int(ends[j - 1])
            got = _count(keys.take(pa.array(first[i:j])), lists.slice(low, high - low), np.repeat(np.arange(j - i), ends[i:j] - first[i:j]), pairs)
            out = np.ones(len(got.at), bool)
            if i == 0 and goes_on:
                out &= got.at != 0
                part = got.of(got.at == 0)
                for name, n in zip(part.spelled(part.one, part.two).to_pylist(), part.tf.tolist()):
                    held[name] = held.get(name, 0) + n
            if j == len(first) and not (goes_on and len(first) == 1):
                if held is not None:
                    yield closed()
                last = got.at == j - i - 1
                out &= ~last
                part = got.of(last)
                held_key, held = keys[int(first[-1]):int(first[-1]) + 1], dict(zip(part.spelled(part.one, part.two).to_pylist(), part.tf.tolist()))
            yield got.of(out)
            i = j
    if held is not None:
        yield closed()


def _listed(pairs: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in _counts(batches, pairs):
            yield pa.RecordBatch.from_arrays([c.keys.take(pa.array(c.at)), c.spelled(c.one, c.two), pa.array(c.tf, pa.int64())], names=["key", "term", "tf"])

    return run


def _summed(pairs: bool):
    """Texts and occurrences of each term, summed over the keys that are counted together."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in _counts(batches, pairs):
            code = c.one * (len(c.words) + 1) + c.two + 1
            order = np.argsort(code, kind="stable")
            first = np.flatnonzero(np.diff(code[order], prepend=-1))
            if len(first):
                total = np.add.reduceat(c.tf[order], first)
                df = np.diff(np.append(first, len(order)))
                at = order[first]
                yield pa.RecordBatch.from_arrays([c.spelled(c.one[at], c.two[at]), pa.array(df, pa.int64()), pa.array(total, pa.int64())], names=["term", "df", "total"])

    return run


def _weighed(pairs: bool, vocab: list[tuple[str, int, float]]):
    """tf * idf at unit length of the terms that the vocabulary has; keys without one are left out."""
    singles = [v for v in vocab if " " not in v[0]]
    doubles = [(v[0].split(" "), *v[1:]) for v in vocab if " " in v[0]]
    parts = sorted({w for v in doubles for w in v[0]})
    place = {w: i for i, w in enumerate(parts)}
    doubles = sorted((place[a] * len(parts) + place[b], i, idf) for (a, b), i, idf in doubles)
    wide = np.array([d[0] for d in doubles], np.int64)
    ids = np.array([v[1] for v in singles] + [d[1] for d in doubles] + [0], np.int64)
    idfs = np.array([v[2] for v in singles] + [d[2] for d in doubles] + [0.0])

    def known(words: pa.Array, names: list[str]) -> np.ndarray:
        return pc.index_in(words, value_set=pa.array(names, words.type)).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in _counts(batches, pairs):
            if not len(c.at):
                continue
            if len(c.two) and c.two.max() < 0 and pairs:  # a held key has its pairs spelled
                names = [v[0] for v in singles] + [f"{parts[d[0] // len(parts)]} {parts[d[0] % len(parts)]}" for d in doubles]
                found = known(c.words, names)[c.one]
            else:
                single, part = known(c.words, [v[0] for v in singles]), known(c.words, parts)
                found = single[c.one]
                two = np.flatnonzero(c.two >= 0)
                a, b = part[c.one[two]], part[c.two[two]]
                code = np.where((a < 0) | (b < 0), -1, a * len(parts) + b)
                spot = np.searchsorted(wide, code)
                hit = (spot < len(wide)) & (code >= 0)
                hit[hit] = wide[spot[hit]] == code[hit]
                found[two] = np.where(hit, spot + len(singles), -1)
            kept = np.flatnonzero(found >= 0)
            kept = kept[np.argsort(c.at[kept], kind="stable")]
            if not len(kept):
                continue
            at, found = c.at[kept], found[kept]
            x = c.tf[kept] * idfs[found]
            first = np.flatnonzero(np.diff(at, prepend=-1))
            sizes = np.diff(np.append(first, len(at)))
            x = x / np.repeat(np.sqrt(np.add.reduceat(x * x, first)), sizes)
            ends = pa.array(np.append(first, len(at)), pa.int32())
            yield pa.RecordBatch.from_arrays([c.keys.take(pa.array(at[first])), pa.ListArray.from_arrays(ends, pa.array(ids[found])),
                                              pa.ListArray.from_arrays(ends, pa.array(x))], names=["key", "i", "x"])

    return run


def terms(texts: DataFrame, key: str, text: str, stop_words: Sequence[str] = (), pairs: bool = True) -> Terms:
    """(key, term, tf): the words of two and more characters without stop words, and pairs of neighbours, with their counts.

    Texts are dealt by key, so that occurrences are counted where they lie: no occurrence is shuffled. The terms are many times as large
    as the texts, so they are not written; each reader splits the texts again and counts numbered words in Arrow batches.
    """
    words = F.filter(F.split(F.lower(F.col(text)), WORD_BREAK), lambda w: F.length(w) >= 2)
    if stop_words:
        words = F.filter(words, lambda w: ~w.isin(*stop_words))
    return Terms(texts.select(key, text).repartition(key).sortWithinPartitions(key).select(key, words.alias("_w")), key, pairs)


def vocabulary(found: Terms | DataFrame, documents: int, least_df: int = 2, most: int = 4000) -> DataFrame:
    """The most frequent terms found in enough texts, with smoothed inverse frequency and a dense index.

    Texts and occurrences of a term are summed over the texts of an Arrow batch first, then in one shuffle by term.
    """
    if isinstance(found, Terms):
        some = found.words.mapInArrow(_summed(found.pairs), "term string, df long, total long")
    else:
        some = found.select("term", F.lit(1).alias("df"), F.col("tf").alias("total"))
    df = some.groupBy("term").agg(F.sum("df").alias("df"), F.sum("total").alias("total")).where(F.col("df") >= least_df)
    top = df.orderBy(F.desc("total"), "term").limit(most)
    top = row_index(top, [], [F.col("term")], most, index="term_id")
    return top.withColumn("idf", F.log((1.0 + documents) / (1.0 + F.col("df"))) + 1.0)


def weighted_terms(found: Terms | DataFrame, vocab: DataFrame, key: str) -> Weights | DataFrame:
    """tf * idf at unit length per text. The vocabulary, `most` rows at most, goes to the texts; only terms it knows leave them."""
    if isinstance(found, Terms):
        known = [(r["term"], int(r["term_id"]), float(r["idf"])) for r in vocab.select("term", "term_id", "idf").collect()]
        kind = found.words.schema[key].dataType.simpleString()
        packed = found.words.mapInArrow(_weighed(found.pairs, known), f"`{key}` {kind}, i array<long>, x array<double>")
        rows = packed.select(key, F.explode(F.arrays_zip("i", "x")).alias("_e")).select(key, F.col("_e.i").alias("term_id"), F.col("_e.x").alias("weight"))
        return Weights(rows.join(F.broadcast(vocab.select("term_id", "term")), "term_id").select(key, "term", "term_id", "weight"), packed)
    known = found.join(F.broadcast(vocab.select("term", "term_id", "idf")), "term")
    w = known.withColumn("_x", F.col("tf") * F.col("idf"))
    size = F.sqrt(F.sum(F.col("_x") * F.col("_x")).over(Window.partitionBy(key)))
    return w.select(key, "term", "term_id", (F.col("_x") / size).alias("weight"))


def _packed(weights: Weights | DataFrame, key: str) -> Weights:
    """The weights of each key in one row, written once."""
    packed = weights.packed if isinstance(weights, Weights) else weights.groupBy(key).agg(F.collect_list(F.struct("term_id", "weight")).alias("v")).select(
        key, F.transform("v", lambda x: x["term_id"].cast("long")).alias("i"), F.transform("v", lambda x: x["weight"].cast("double")).alias("x"))
    return Weights(weights, stored(packed))


def _pieces(ids: pa.ListArray, weights: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int, int]]:
    """Term ids, weights, weights per row and rows from and to, for some rows at a time."""
    sizes = ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    at, x = ids.flatten().to_numpy(zero_copy_only=False), weights.flatten().to_numpy(zero_copy_only=False)
    i = 0
    while i < len(sizes):
        j = min(len(sizes), max(i + 1, int(np.searchsorted(ends, ends[i] + WEIGHTS_AT_ONCE, side="right")) - 1))
        yield at[ends[i]:ends[j]], x[ends[i]:ends[j]], sizes[i:j], i, j
        i = j


def _projected(at: np.ndarray, x: np.ndarray, sizes: np.ndarray, basis: np.ndarray) -> np.ndarray:
    out = np.zeros((len(sizes), basis.shape[1]))
    full = sizes > 0
    if len(at):
        out[full] = np.add.reduceat(x[:, None] * basis[at], (np.cumsum(sizes) - sizes)[full])
    return out


def _blocks(rows: DataFrame, basis: np.ndarray) -> np.ndarray:
    """W^T (W B) for the sparse rows W of all texts: one sum per task, added by row of the result."""
    width, k = basis.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, k))
        for batch in batches:
            for at, x, sizes, _, _ in _pieces(batch.column(0), batch.column(1)):
                if len(at):
                    y = _projected(at, x, sizes, basis)
                    order = np.argsort(at, kind="stable")
                    terms_at, starts = np.unique(at[order], return_index=True)
                    total[terms_at] += np.add.reduceat((x[:, None] * np.repeat(y, sizes, axis=0))[order], starts)
        yield pa.RecordBatch.from_pydict({"i": pa.array(range(width), pa.int64()), "row": pa.array(list(total), pa.list_(pa.float64()))})

    sums = rows.mapInArrow(run, "i long, row array<double>").groupBy("i").agg(*[F.sum(F.col("row")[j]).alias(f"s{j}") for j in range(k)]).collect()
    made = np.zeros((width, k))
    for r in sums:
        made[r["i"]] = r[1:]
    return made


def axes_of(weights: Weights | DataFrame, key: str, width: int, dims: int, tolerance: float = 1e-7, rounds: int = 30, seed: int = 5, packed: DataFrame | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The leading right singular vectors of the weights (width x dims), their squared singular values, and their residuals |W^T W v - s v| / s.

    Randomised range finder by blocks: a few random directions are multiplied by W^T W, one pass over the rows in Arrow blocks, and each product, made
    orthogonal to all before it, is the next block, so the space grows by what the last pass found. It ends when the residuals, of real products, are within
    `tolerance`, and raises an error if they are not after `rounds` passes. The driver holds width x (rounds + 1) (dims + 4) numbers at most.
    """
    k = min(width, dims + 4)
    rows = _packed(weights, key).packed.select("i", "x") if packed is None else packed.select("i", "x")
    block = np.linalg.qr(np.random.default_rng(seed).normal(size=(width, k)))[0]
    space, images = np.zeros((width, 0)), np.zeros((width, 0))
    for _ in range(rounds):
        moved = _blocks(rows, block)
        space, images = np.hstack([space, block]), np.hstack([images, moved])
        values, turn = np.linalg.eigh(space.T @ images + images.T @ space)
        values, turn = values[::-1][:dims] / 2, turn[:, ::-1][:, :dims]
        vectors = space @ turn
        residual = np.linalg.norm(images @ turn - vectors * values, axis=0) / np.maximum(values, 1e-300)
        live = values > 1e-12 * max(values[0], 1e-300)
        if not live.any() or residual[live].max() <= tolerance or space.shape[1] >= width:
            return vectors, values, np.where(live, residual, 0.0)
        for _ in range(2):  # twice, as once leaves rounding along the space
            moved = moved - space @ (space.T @ moved)
        block = np.linalg.qr(moved)[0]
        block = block - space @ (space.T @ block)
        block = np.linalg.qr(block)[0][:, :width - space.shape[1]]
    raise RuntimeError(f"axes of the terms are not converged after {rounds} passes: residual {residual.max():.3g}")


def reduced(weights: Weights | DataFrame, key: str, width: int, dims: int) -> DataFrame:
    """Truncated singular value decomposition of the weights, then scaling to unit deviation."""
    packed = _packed(weights, key).packed
    axes, _, _ = axes_of(weights, key, width, dims, packed=packed)
    # An axis may point either way; its largest entry is made positive.
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), range(axes.shape[1])])
    names = [f"d{i}" for i in range(axes.shape[1])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x, sizes, i, j in _pieces(batch.column(1), batch.column(2)):
                y = _projected(at, x, sizes, axes)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *(pa.array(y[:, d]) for d in range(len(names)))], names=[key, *names])

    kind = packed.schema[key].dataType.simpleString()
    out = settled(packed.select(key, "i", "x").mapInArrow(run, f"`{key}` {kind}, " + ", ".join(f"{n} double" for n in names)))
    return StandardScale.fit(out, names).apply(out)

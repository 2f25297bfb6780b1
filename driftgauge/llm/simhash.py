"""SimHash fingerprints and near-duplicates by tiled exact comparison.

Fingerprints: XXH64 of every word shingle, bit by bit majority, in Arrow batches.

Links: equal fingerprints are one vertex. Distinct fingerprints are laid into tiles: first by population count, then into blocks of a bounded number of
fingerprints. Two fingerprints within the radius have population counts within the radius, so tile pairs further apart are never made. Each pair of
tiles that is left is one group of a shuffle, compared whole by exclusive-or and bit counts; inside it, rows are ordered by the counts of
their four quarters, and strips whose quarter counts differ by more than the radius together are skipped too. A tile pair
returns a spanning forest of its links, never all pairs.

Large tiles are compared by quarters of 16 bits: two fingerprints within the radius have a quarter within its share of it, so only fingerprints whose values of
one quarter are that near are compared at all, and every quarter is tried.

Defined cases: a null or empty text, or one of white space only, has fingerprint zero and is linked like any other; fewer words than a
shingle: the whole sequence; equal rows link; rows with a null doc_id keep their fingerprint and component but are never the smallest doc_id unless
all are null; extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftgauge.llm.common import flat, written
from driftgauge.llm.components import components
from driftgauge.llm.unionfind import forest
from driftgauge.session import settled

#: Most fingerprints in a tile: a pair of tiles is one group of at most twice this many. Smaller tables get smaller tiles, so that the pairs fill a cluster.
TILE_MOST = 65_536
TILES_LEAST = 48
STRIP = 256
#: The same for radii that reach over all population counts; pairs of such tiles are split by quarters into tasks, PARTS_LEAST at least.
WIDE_MOST = 524_288
PARTS_LEAST = 24
#: Fingerprints for each value of a quarter that are wanted, and the most pairs compared at once.
IN_BUCKET, AT_ONCE = 8, 1_000_000
#: Links that a task holds before it folds them into a spanning forest.
LINKS_HELD = 1_000_000
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: bytes, words: int = 4, seed: int = 42) -> int:
    """A bit is 1 if it is set in over half of the shingles' hashes. bytes.split() splits at the six ASCII white-space bytes."""
    parts = text.translate(LOWER).split()
    if not parts:
        return 0
    hashed = xxhash.xxh64_intdigest
    if len(parts) <= words:
        return hashed(b" ".join(parts), seed)
    joined = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts])
    starts = np.concatenate([[0], ends[:-words]]).tolist()
    h = np.array([hashed(joined[a:b], seed) for a, b in zip(starts, (ends[words - 1:] - 1).tolist())], np.uint64)
    total = np.zeros(64, np.int64)
    for i in range(0, len(h), 8192):
        total += np.unpackbits(h[i:i + 8192].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > len(h), bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, words: int = 4, seed: int = 42) -> DataFrame:
    """docs with `fp`, the fingerprint's 64 bits as a long. The text leaves the frame after this step if no one asks for it."""
    docs = docs.drop("fp")
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column(at))
            data = data.tobytes()
            fps = np.array([fingerprint(data[a:b], words, seed) for a, b in zip(offsets, offsets[1:])], np.uint64)
            yield batch.append_column("fp", pa.array(fps.view(np.int64)))

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("fp", T.LongType())]))


def _quarters(fp: np.ndarray) -> np.ndarray:
    return np.bitwise_count(np.ascontiguousarray(fp).view(np.uint16).reshape(len(fp), -1)).astype(np.int16)


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of all pairs; a fingerprint is a row of one or more words."""
    total = np.bitwise_count(a[:, None, 0] ^ b[None, :, 0])
    for i in range(1, a.shape[1]):
        total = total + np.bitwise_count(a[:, None, i] ^ b[None, :, i])
    return total


def shares(radius: int, quarters: int) -> list[int]:
    """How far apart each quarter may be: two fingerprints within the radius are within the share of one quarter at least; -1: never needed."""
    return [(radius + 1) // quarters - 1 + (k < (radius + 1) % quarters) for k in range(quarters)]


def _ball(bits: int, share: int) -> np.ndarray:
    values = np.arange(1 << bits, dtype=np.uint32)
    return values[np.bitwise_count(values) <= share].astype(np.int64)


def _bits(size: int) -> int:
    """Bits of a quarter that tell fingerprints apart, so that some share a value."""
    return int(np.clip(np.log2(max(1, size / IN_BUCKET)), 1, 16))


def tested(size: int, radius: int, quarters: int) -> float:
    """Share of all pairs that quarters leave over, if quarters are like random ones."""
    w = _bits(size)
    return float(sum(len(_ball(w, t)) for t in shares(radius, quarters) if t >= 0)) / (1 << w)


def near(a: np.ndarray, b: np.ndarray, radius: int, same: bool = False, parts: list[tuple[int, int, int]] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All index pairs with at most `radius` differing bits, some more than once. a, b: one number or one row of numbers each.

    same: b is a, and a pair may come in one order only. parts: quarters to look at, and which of how many of its values; those of all parts together are all pairs.
    """
    a, b = (x.reshape(len(x), -1) for x in (a, b))
    quarters = 4 * a.shape[1]
    if parts is None and tested(len(b), radius, quarters) < 0.5:
        parts = [(k, 0, 1) for k in range(quarters)]
    if parts is None:
        yield from _near_by_strips(a, b, radius, same)
    else:
        for k, part, of in parts:
            yield from _near_by_quarter(a, b, radius, same, k, part, of)


def _near_by_quarter(a: np.ndarray, b: np.ndarray, radius: int, same: bool, k: int, part: int, of: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs whose quarter `k` is within its share of the radius, of the values of `a` that are `part` modulo `of`."""
    share = shares(radius, 4 * a.shape[1])[k]
    if share < 0:
        return
    w = _bits(len(b))
    va, vb = ((np.ascontiguousarray(x).view(np.uint16).reshape(len(x), -1)[:, k] >> (16 - w)).astype(np.int64) for x in (a, b))
    oa, ob = (np.argsort(v, kind="stable") for v in (va, vb))
    a, b, va = a[oa], b[ob], va[oa]
    counts = np.bincount(vb, minlength=1 << w)
    ends = np.cumsum(counts)
    ball = _ball(w, share)
    values, first = np.unique(va, return_index=True)
    for v, low, high in zip(values.tolist(), first.tolist(), [*first[1:].tolist(), len(a)]):
        if v % of != part:
            continue
        by = ball ^ v
        if same:
            by = by[by >= v]
        n = counts[by]
        by, n = by[n > 0], n[n > 0]
        at = np.arange(n.sum()) + np.repeat(ends[by] - np.cumsum(n), n)
        for i in range(low, high, STRIP):
            rows = a[i:min(high, i + STRIP)]
            step = max(1, AT_ONCE // len(rows))
            for j in range(0, len(at), step):
                some = at[j:j + step]
                x, y = np.nonzero(_apart(rows, b[some]) <= radius)
                if len(x):
                    yield oa[x + i], ob[some[y]]


def _near_by_strips(a: np.ndarray, b: np.ndarray, radius: int, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    qa, qb = _quarters(a), _quarters(b)
    oa, ob = (np.lexsort(q.T) for q in (qa, qb))
    a, b, qa, qb = a[oa], b[ob], qa[oa], qb[ob]
    cuts = np.arange(0, len(b), STRIP)
    low, high = np.minimum.reduceat(qb, cuts, axis=0), np.maximum.reduceat(qb, cuts, axis=0)
    for i in range(0, len(a), STRIP):
        la, ha = qa[i:i + STRIP].min(0), qa[i:i + STRIP].max(0)
        gap = np.maximum(0, np.maximum(low - ha, la - high)).sum(1)
        for j in cuts[(gap <= radius) & (cuts >= (i if same else 0))]:
            x, y = np.nonzero(_apart(a[i:i + STRIP], b[j:j + STRIP]) <= radius)
            if len(x):
                yield oa[x + i], ob[y + j]


def _tile_links(radius: int, parts: list[str], name: str, rooted: bool = False, slices: int = 0):
    """Links of a pair of tiles. rooted: vertices stand for the smallest one that their own tile links them to, so a pair links few of them.

    slices: the third key is a quarter times `slices` and a slice of its values, and only these are looked at; 0: all.
    """
    def run(key: tuple, table: pa.Table) -> pa.Table:
        fp, second = np.column_stack([table.column(c).to_numpy().view(np.uint64) for c in parts]), table.column("second").to_numpy()
        ids = table.column(name).to_numpy()
        a = np.flatnonzero(~second)
        same = key[0].as_py() == key[1].as_py()
        b = a if same else np.flatnonzero(second)
        some = [(*divmod(key[2].as_py(), slices), slices)] if slices else None
        root, held, n_held = np.arange(len(fp)), [], 0
        if rooted:  # rows of one tile with one root are linked already
            _, first, group = np.unique(np.column_stack([table.column("root").to_numpy(), second]), axis=0, return_index=True, return_inverse=True)
            root = first[group.ravel()]
        if len(a) and len(b):
            for x, y in near(fp[a], fp[b], radius, same, some):
                held.append((a[x], b[y]))
                n_held += len(x)
                if n_held > LINKS_HELD:
                    root, held, n_held = _fold(root, held), [], 0
        root = _fold(root, held)
        if rooted:
            known = table.column("root").to_numpy()
            found = np.unique(np.column_stack([known, known[root]]), axis=0)
            found = found[found[:, 0] != found[:, 1]]
            return pa.table({"a": pa.array(found[:, 0]), "b": pa.array(found[:, 1])})
        child = np.flatnonzero(root != np.arange(len(fp)))
        return pa.table({"a": pa.array(ids[child]), "b": pa.array(ids[root[child]])})

    return run


def _fold(root: np.ndarray, held: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    everyone = np.arange(len(root))
    x, y = (np.concatenate([first, *(h[i] for h in held)]) for i, first in enumerate((everyone, root)))
    return forest(len(root), x, y)


def _joined(key: tuple, table: pa.Table) -> pa.Table:
    """A spanning forest of the links of a tile that several tasks have found."""
    ids, at = np.unique(np.concatenate([table.column("a").to_numpy(), table.column("b").to_numpy()]), return_inverse=True)
    root = forest(len(ids), *np.split(at.ravel(), 2))
    child = np.flatnonzero(root != np.arange(len(ids)))
    return pa.table({"a": pa.array(ids[child]), "b": pa.array(ids[root[child]])})


def _wide_links(fps: DataFrame, radius: int, parts: tuple[str, ...], name: str) -> DataFrame:
    """Links for a radius that reaches over all population counts: few tiles, each linked inside first, then every pair of them."""
    total, quarters = fps.count(), 4 * len(parts)
    tiles = max(1, -(-total // WIDE_MOST))
    # Quarters pay where a tile has many fingerprints; their tasks share the work of a pair of tiles.
    slices = -(-PARTS_LEAST // (quarters * tiles * (tiles + 1) // 2)) if tested(total // tiles, radius, quarters) < 0.5 else 0
    if not slices:
        tiles = min(12, max(1, total // (4 * STRIP)))
    part = F.explode(F.sequence(F.lit(0), F.lit(max(1, quarters * slices) - 1))).alias("part")
    keys = ["t1", "t2", "part"]
    tiled = written(fps.select(*dict.fromkeys([name, *parts])).withColumn("tile", F.pmod(F.xxhash64(name), F.lit(tiles)).cast("int")))
    alone = tiled.select(name, *[p for p in parts if p != name], F.col("tile").alias("t1"), F.col("tile").alias("t2"), F.lit(False).alias("second"), part)
    inside = alone.groupBy(*keys).applyInArrow(_tile_links(radius, list(parts), name, slices=slices), "a long, b long")
    if slices:
        tile = F.pmod(F.xxhash64("a"), F.lit(tiles)).cast("int")
        inside = inside.groupBy(tile.alias("tile")).applyInArrow(_joined, "a long, b long")
    inside = written(inside)
    if tiles == 1:
        return inside
    rooted = tiled.join(inside.withColumnRenamed("a", name), name, "left").withColumn("root", F.coalesce("b", name)).drop("b")
    kept = [*dict.fromkeys([name, *parts]), "root"]
    first = rooted.where(F.col("tile") < tiles - 1).select(*kept, F.col("tile").alias("t1"), F.explode(F.sequence(F.col("tile") + 1, F.lit(tiles - 1))).alias("t2"), F.lit(False).alias("second"))
    second = rooted.where("tile > 0").select(*kept, F.explode(F.sequence(F.lit(0), F.col("tile") - 1)).alias("t1"), F.col("tile").alias("t2"), F.lit(True).alias("second"))
    between = first.unionByName(second).select("*", part).groupBy(*keys).applyInArrow(_tile_links(radius, list(parts), name, True, slices), "a long, b long")
    return inside.unionByName(between)


def links(fps: DataFrame, radius: int = 4, parts: tuple[str, ...] = ("fp",), name: str = "fp", twice: bool = False) -> DataFrame:
    """Vertices (`name`, a long, and the words of their fingerprints, `parts`) -> spanning links (a, b) of all pairs within the radius.

    twice: for wide radii. Tiles are first linked inside, and pairs of tiles then link what is left of them. A large group of near fingerprints lies in all tiles; its links
    are then as many as its vertices, and not as many for each tile.
    """
    if twice:
        return _wide_links(fps, radius, parts, name)
    counted = fps.withColumn("pop", sum((F.bit_count(c).cast("int") for c in parts), F.lit(0)))
    counts = {r["pop"]: r["n"] for r in counted.groupBy("pop").agg(F.count("*").alias("n")).collect()}  # a row per possible count at most
    if not counts:
        return fps.select(F.col(name).alias("a"), F.col(name).alias("b"))
    tile = min(TILE_MOST, max(STRIP, sum(counts.values()) // TILES_LEAST))
    blocks = {p: -(-n // tile) for p, n in counts.items()}
    # Tiles are numbered in the order of their population count.
    first, total = {}, 0
    for pop in sorted(blocks):
        first[pop], total = total, total + blocks[pop]
    spans = {p: (first[p], max(first[x] + blocks[x] for x in blocks if p <= x <= p + radius)) for p in blocks}
    bottoms = {p: min(first[x] for x in blocks if p - radius <= x <= p) for p in blocks}

    def lookup(d: dict[int, int]):
        return F.element_at(F.array(*[F.lit(d.get(p, 0)) for p in range(64 * len(parts) + 1)]), F.col("pop") + 1)

    tiled = counted.withColumn("tile", lookup(first) + F.pmod(F.xxhash64(name), F.greatest(lookup(blocks), F.lit(1))).cast("int"))
    # A tile meets itself, the later tiles of its own count, and all tiles of counts up to the radius above.
    kept = list(dict.fromkeys([name, *parts]))
    as_first = tiled.select(*kept, F.explode(F.sequence("tile", lookup({p: s[1] for p, s in spans.items()}) - 1)).alias("t2"), F.col("tile").alias("t1"),
                            F.lit(False).alias("second"))
    as_second = tiled.select(*kept, F.col("tile").alias("t2"), F.explode(F.sequence(lookup(bottoms), "tile")).alias("t1"), F.lit(True).alias("second")) \
        .filter("t1 < t2")
    pairs = as_first.select("t1", "t2", *kept, "second").unionByName(as_second)
    return pairs.groupBy("t1", "t2").applyInArrow(_tile_links(radius, list(parts), name), "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 4, seed: int = 42, radius: int = 4, with_text: bool = True) -> DataFrame:
    """docs with fingerprint (16 hex digits), component_id (the smallest doc_id reachable over links) and keeper (true for one row of each component).

    Texts are hashed once: fingerprints are written, with the text only if it is wanted.
    """
    docs = docs.drop("fingerprint", "component_id", "keeper")
    marked = with_fingerprints(docs, words, seed).withColumn("row_", F.monotonically_increasing_id())
    marked = written(marked if with_text else marked.drop("text"))
    # Null ids come last; the row tells rows with one doc_id apart.
    first = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row_")
    vertices = settled(marked.groupBy("fp").agg(F.min(first).alias("least")))
    found = components(links(vertices.select("fp"), radius))
    # The smallest doc_id of a component is not that of its smallest fingerprint.
    grouped = vertices.join(found.withColumnRenamed("id", "fp"), "fp", "left").withColumn("root", F.coalesce("component_id", "fp"))
    smallest = grouped.groupBy("root").agg(F.min("least").alias("first_"))
    named = settled(grouped.select("fp", "root").join(smallest, "root")
                    .select("fp", F.col("first_.doc_id").alias("component_id"), F.col("first_.row_").alias("keeper_row_")))
    return marked.join(named, "fp").withColumns({
        "fingerprint": F.lower(F.lpad(F.hex("fp"), 16, "0")), "keeper": F.col("row_") == F.col("keeper_row_")}).drop("fp", "row_", "keeper_row_")

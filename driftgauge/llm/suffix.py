"""Suffix-array dedup: removes every byte covered by a string of `length` bytes that also starts anywhere else.

Suffixes that share `length` bytes must meet in one task, so strings are routed by their content. Every window of `length` bytes picks
its anchor, the k-gram with the smallest hash (the rightmost of equals); equal windows pick it at the same offset. Consecutive windows with one
anchor and one block of offsets form a run; they share a core, the bytes common to all windows of the block. Only windows
with equal cores can be equal, so cores that occur once are out, and a run is a left edge, its core and a right edge.
The runs of a core are one collection of strings (left edge, core as one symbol, right edge) in a suffix array built by linear grouping (`suffixsort`);
a window repeats exactly if it shares its whole length with a neighbour in suffix order, or if its run itself occurs twice.

Equal texts are one text with a count; equal runs are one run with a count, so copies never meet in a task. A core with more than `CORE_RUNS`
different runs (a passage with many surroundings) is cut into narrower blocks of offsets with longer cores, at last single windows, which
need no order at all; no run is left out.

Defined cases: a null text is empty; texts shorter than `length` keep all bytes; a text that occurs in two rows is
removed whole if it has `length` bytes; a null doc_id is a document like any other; kept text, unlike kept bytes, leaves out pieces of characters
that a cut has split; extra columns pass through.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftgauge.llm.common import flat, steps, written
from driftgauge.llm.rolling import Rolling, mix
from driftgauge.llm.suffixsort import suffix_arrays
from driftgauge.session import checkpoint_folder, settled

GRAM = 16
#: Offsets of a block at most, as a run's windows are bits of a long.
BLOCK_MOST = 62
#: Different runs of one core that are sorted together; more are cut into narrower blocks.
CORE_RUNS = 128
NARROWER = (8, 1)
#: Symbols that one suffix sort takes at once.
SORT_SYMBOLS = 600_000
CORE = 256
PLACE_BITS = 31
#: Bytes of text whose runs are worked out at once.
RUN_BYTES = 1_000_000


def blocks(length: int) -> int:
    return -(-(length - GRAM + 1) // BLOCK_MOST)


def block_width(length: int) -> int:
    return -(-(length - GRAM + 1) // blocks(length))


class Runs:
    """Runs of one buffer: first and last window, document, where the core starts, and a hash of the core."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, length: int):
        n, spread, width = len(data), length - GRAM + 1, block_width(length)
        self.core_size = length - width + 1
        if n < length:
            self.start = self.end = self.doc = self.core_at = np.empty(0, np.int64)
            self.core = np.empty(0, np.uint64)
            return
        hashes = Rolling(data)
        grams = n - GRAM + 1
        bits, last = np.uint64(PLACE_BITS), np.uint64((1 << PLACE_BITS) - 1)
        # hash above, place below: the smallest hash, the rightmost place; the same for every buffer, as anchors must not depend on it
        least = (hashes.grams(GRAM) >> bits << bits) | (last - np.arange(grams, dtype=np.uint64))
        span = 1
        while span * 2 <= spread:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < spread:
            least = np.minimum(least[:len(least) - (spread - span)], least[spread - span:])
        anchor = (last - (least & last)).astype(np.int64)
        windows = len(anchor)
        doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        inside = doc[:windows] == doc[length - 1:length - 1 + windows]
        name = anchor * blocks(length) + (anchor - np.arange(windows)) // width
        new = np.append(True, (name[1:] != name[:-1]) | (inside[1:] != inside[:-1]) | (doc[1:windows] != doc[:windows - 1]))
        start = np.flatnonzero(new)
        end = np.append(start[1:], windows)
        keep = inside[start]
        self.start, self.end = start[keep], end[keep]
        at = anchor[self.start]
        block = (at - self.start) // width
        self.doc, self.core_at = doc[self.start], at - block * width
        self.core = mix(hashes.raw(self.core_at, self.core_at + self.core_size) + block.astype(np.uint64))


def _with_cores(length: int, schema: T.StructType, at: int):
    """Adds the cores of each text, one that repeats in the text twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column(at))
            for i, j in steps(offsets, RUN_BYTES):
                runs = Runs(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], length)
                by = np.lexsort((runs.core, runs.doc))
                core, doc = runs.core[by], runs.doc[by]
                same = np.zeros(len(core), bool)
                same[2:] = (core[2:] == core[:-2]) & (doc[2:] == doc[:-2])
                core, doc = core[~same], doc[~same]
                ends = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=j - i))]).astype(np.int32)
                cores = pa.ListArray.from_arrays(pa.array(ends), pa.array(core.view(np.int64)))
                yield pa.RecordBatch.from_arrays([*batch.slice(i, j - i).columns, cores], names=schema.names)

    return run


MEMBER = "digest binary, first int, run binary, core binary, left binary, right binary"


def _members(length: int, names: list[str]):
    """Rows for the runs whose core is one of the candidates; edges only where a task sees a run for the first time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest128, seen = xxhash.xxh3_128_digest, set()
        for batch in batches:
            data, offsets = flat(batch.column(names.index("text")))
            digests, wanted = batch.column(names.index("digest")).to_pylist(), batch.column(names.index("found"))
            for i, j in steps(offsets, RUN_BYTES):
                piece, inner = data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]
                runs, raw = Runs(piece, inner, length), piece.tobytes()
                hit = np.flatnonzero(np.isin(runs.core, np.unique(wanted.slice(i, j - i).flatten().to_numpy()).view(np.uint64)))
                out: list[list] = [[] for _ in range(6)]
                for doc, a, b, c in zip(runs.doc[hit].tolist(), runs.start[hit].tolist(), runs.end[hit].tolist(), runs.core_at[hit].tolist()):
                    d = c + runs.core_size
                    core, left, right = digest128(raw[c:d]), raw[a:c], raw[d:b - 1 + length]
                    name = digest128(core + bytes((len(left), len(right))) + left + right)
                    known = name in seen
                    if not known:
                        if len(seen) > 300_000:
                            seen.clear()
                        seen.add(name)
                    for column, value in zip(out, (digests[i + doc], a - int(inner[doc]), name, *((None,) * 3 if known else (core, left, right)))):
                        column.append(value)
                if out[0]:
                    kinds = (pa.binary(), pa.int32(), *[pa.binary()] * 4)
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds)], MEMBER.replace(" binary", "").replace(" int", "").split(", "))

    return run


def _sort_and_mark(rows: list[tuple], picked: list[int], owner: list[int], width: int, masks: list[int]) -> None:
    """Suffix-sorts the runs of several cores together and sets the bits of windows that equal a neighbour."""
    sizes = np.array([len(rows[i][2]) + len(rows[i][3]) + 2 for i in picked])
    ends = np.cumsum(sizes)
    heads = ends - sizes  # a separator, then the first window
    left = np.array([len(rows[i][2]) for i in picked])
    symbols = np.frombuffer(b"".join(b"\0" + rows[i][2] + b"\0" + rows[i][3] for i in picked) + b"\0", np.uint8).astype(np.int16)
    symbols[heads], symbols[heads + left + 1], symbols[-1] = -1, CORE, -1
    of = np.repeat(np.arange(len(picked)), sizes)
    order = suffix_arrays(symbols, np.append(np.array(owner)[of], owner[-1]))
    run = of[order]
    order = order[order - heads[run] - 1 < sizes[run] - 1 - width + 1]  # only places where a whole window starts
    run = of[order]
    offset = order - heads[run] - 1
    before = left[run] - offset
    own = np.array(owner)[run]
    close = np.flatnonzero((own[1:] == own[:-1]) & (before[1:] == before[:-1]))
    if not len(close):
        return
    view = np.lib.stride_tricks.sliding_window_view(symbols, width)
    hit = np.zeros(len(order), bool)
    for at in range(0, len(close), 100_000):
        c = close[at:at + 100_000]
        same = c[(view[order[c]] == view[order[c + 1]]).all(1)]
        hit[same] = hit[same + 1] = True
    hit = np.flatnonzero(hit)
    by = hit[np.argsort(run[hit], kind="stable")]
    bits = np.uint64(1) << offset[by].astype(np.uint64)
    cut = np.flatnonzero(np.append(True, run[by][1:] != run[by][:-1])) if len(by) else by
    for r, mask in zip(run[by][cut].tolist(), np.bitwise_or.reduceat(bits, cut).tolist() if len(by) else []):
        masks[picked[r]] |= mask


def _repeats(rows: list[tuple], width: int) -> Iterator[tuple[bytes, int]]:
    """(core, run, left, right, n), cores complete -> (run, mask) of runs with a repeated window; bit i stands for the run's window i."""
    by_core: dict[bytes, list[int]] = {}
    for i, r in enumerate(rows):
        by_core.setdefault(r[0], []).append(i)
    size = [len(r[2]) + len(r[3]) for r in rows]
    masks = [(1 << (x - width + 2)) - 1 if r[4] > 1 else 0 for r, x in zip(rows, size)]
    # Collections of like size share their steps; a core with one run has no neighbours.
    groups = sorted(((sum(size[i] for i in g), g) for g in by_core.values() if len(g) > 1), key=lambda x: x[0])
    picked: list[int] = []
    owner: list[int] = []
    total = least = 0
    for k, (cells, g) in enumerate(groups):
        if picked and (total + cells > SORT_SYMBOLS or cells > 4 * least + 1000):
            _sort_and_mark(rows, picked, owner, width, masks)
            picked, owner, total = [], [], 0
        if not picked:
            least = cells
        picked += g
        owner += [k] * len(g)
        total += cells
    if picked:
        _sort_and_mark(rows, picked, owner, width, masks)
    for r, mask in zip(rows, masks):
        if mask:
            yield r[1], mask


def _sorted_runs(width: int):
    """Runs sorted by core, whole cores at a time, in bounded memory."""

    def out(found: list[tuple[bytes, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.binary()), pa.array([f[1] for f in found], pa.int64())], ["run", "mask"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        cells = 0
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for row in zip(*columns):
                if cells > 2 * SORT_SYMBOLS and row[0] != rows[-1][0]:
                    yield out(list(_repeats(rows, width)))
                    rows, cells = [], 0
                rows.append(row)
                cells += len(row[2]) + len(row[3])
        if rows:
            yield out(list(_repeats(rows, width)))

    return run


def _narrowed(width: int, narrow: int):
    """Cuts each run into blocks of `narrow` offsets: bytes of the edges that all windows of a block share join its core."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest128 = xxhash.xxh3_128_digest
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for core, name, left, right, n in zip(*(c.to_pylist() for c in batch.columns)):
                windows = len(left) + len(right) - width + 2
                at = 0
                while at < windows:
                    block = (len(left) - at) // narrow
                    lo = min(block * narrow, width - narrow)  # bytes left of the core in all windows of the block
                    hi = lo + narrow - 1
                    stop = min(windows, len(left) - block * narrow + 1)
                    inner_l, inner_r = left[len(left) - lo:], right[:width - 1 - hi]
                    fresh = digest128(core + bytes((block, narrow)) + inner_l + b"|" + inner_r)
                    l2, r2 = left[at:len(left) - lo], right[width - 1 - hi:width - 1 - (len(left) - stop + 1)]
                    for column, value in zip(out, (fresh, digest128(fresh + bytes((len(l2), len(r2))) + l2 + r2), l2, r2, n, name, at)):
                        column.append(value)
                    at = stop
            kinds = (*[pa.binary()] * 4, pa.int64(), pa.binary(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds)], ["core", "run", "left", "right", "n", "origin", "shift"])

    return run


def _masks(runs: DataFrame, width: int, core_runs: int, narrower: tuple[int, ...]) -> DataFrame:
    """(core, run, left, right, n) -> (run, mask), for runs with a repeated window."""
    crowded = None
    if narrower:
        found = settled(runs.groupBy("core").agg(F.count("*").alias("runs")).filter(F.col("runs") > core_runs).select("core"))
        crowded = None if found.isEmpty() else found
    plain = runs if crowded is None else runs.join(crowded, "core", "left_anti")
    # Dealt by an expression of its own: a plain repartition by core is dropped after a join by core, and a skewed join splits a core.
    done = plain.select("core", "run", "left", "right", "n").repartition(F.xxhash64("core")).sortWithinPartitions("core") \
        .mapInArrow(_sorted_runs(width), "run binary, mask long")
    if crowded is None:
        return done
    cut = written(runs.join(crowded, "core", "left_semi").select("core", "run", "left", "right", "n")
                  .mapInArrow(_narrowed(width, narrower[0]), "core binary, run binary, left binary, right binary, n long, origin binary, shift int"))
    inner = written(cut.groupBy("run").agg(F.first("core").alias("core"), F.first("left").alias("left"), F.first("right").alias("right"),
                                           F.sum("n").alias("n")))
    marks = _masks(inner, narrower[0], core_runs, narrower[1:])
    back = cut.join(marks, "run").groupBy("origin").agg(F.bit_or(F.expr("shiftleft(mask, shift)")).alias("mask"))
    return done.union(back.select(F.col("origin").alias("run"), "mask"))


RESULT = [T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()),
          T.StructField("kept_sha256", T.StringType())]
KEPT = {"none": [], "bytes": [T.StructField("kept", T.BinaryType())], "text": [T.StructField("kept", T.StringType())]}


def _cut(length: int, keep: str):
    """Removes what the marked windows cover."""
    names = ["digest", *(f.name for f in RESULT + KEPT[keep])]

    def one(text: bytes, copies: int, digest: bytes, marks: list[dict] | None) -> tuple:
        if copies > 1 and len(text) >= length:
            return len(text), len(text), 1, b""
        edge = np.zeros(len(text) + 1, np.int32)
        for m in marks or ():
            if m["digest"] == digest:
                at = np.flatnonzero(np.unpackbits(np.array([m["mask"]], "<i8").view(np.uint8), bitorder="little")) + m["first"]
                edge[at] += 1
                edge[at + length] -= 1
        gone = np.cumsum(edge[:-1]) > 0
        if not gone.any():
            return len(text), 0, 0, text
        spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
        return len(text), int(gone.sum()), spans, np.frombuffer(text, np.uint8)[~gone].tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offsets = flat(batch.column(1))
            for i, j in steps(offsets):
                part = batch.slice(i, j - i)
                texts = [(x or "").encode("utf-8") for x in part.column(1).to_pylist()]
                rows = [one(t, n, d, m) for t, n, d, m in zip(texts, *(part.column(k).to_pylist() for k in (2, 0, 3)))]
                columns = [part.column(0), *(pa.array([r[k] for r in rows], pa.int64()) for k in range(3)),
                           pa.array([sha256(r[3]).hexdigest() for r in rows], pa.string())]
                if keep == "bytes":
                    columns.append(pa.array([r[3] for r in rows], pa.binary()))
                elif keep == "text":  # pieces of characters that a cut has left are dropped
                    columns.append(pa.array([r[3].decode("utf-8", "ignore") for r in rows], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def _bucketed(df: DataFrame, key: str) -> DataFrame:
    """The frame as a table in the shared folder, in buckets of the key, so that joins by it move the other side only."""
    spark = df.sparkSession
    name = f"texts_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(buckets, key).option("path", f"{checkpoint_folder(spark).rstrip('/')}/{name}").option("compression", "zstd").saveAsTable(name)
    return spark.table(name)


def dedup(docs: DataFrame, length: int = 200, core_runs: int = CORE_RUNS, keep: str = "bytes") -> DataFrame:
    """docs with n_bytes, n_removed, n_spans, kept_sha256 and kept, what remains (keep: "bytes", "text" or "none")."""
    fields = RESULT + KEPT[keep]
    width = block_width(length)
    digest = F.substring(F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)), 1, 16)
    docs = docs.drop(*[f.name for f in RESULT], "kept", "digest", "digest_")
    keyed = docs.withColumn("digest_", digest)
    texts = keyed.groupBy(F.col("digest_").alias("digest")).agg(F.first(F.coalesce("text", F.lit(""))).alias("text"), F.count("*").alias("copies"))
    cored = T.StructType([*texts.schema.fields, T.StructField("cores", T.ArrayType(T.LongType()))])
    table = _bucketed(texts.mapInArrow(_with_cores(length, cored, 1), cored), "digest")

    places = table.select("digest", F.explode("cores").alias("core"))
    often = table.select(F.explode("cores").alias("core")).groupBy("core").agg(F.count("*").alias("n")).filter("n > 1").select("core")
    wanted = places.join(often, "core").groupBy("digest").agg(F.collect_set("core").alias("found"))
    members = written(table.select("digest", "text").join(wanted.hint("shuffle_hash"), "digest")
                      .mapInArrow(_members(length, ["digest", "text", "found"]), MEMBER))
    runs = written(members.groupBy("run").agg(*(F.max(c).alias(c) for c in ("core", "left", "right")), F.count("*").alias("n")))
    marks = _masks(runs, width, core_runs, NARROWER)
    marked = members.select("digest", "first", "run").join(marks, "run") \
        .groupBy("digest").agg(F.collect_list(F.struct("digest", "first", "mask")).alias("marks"))
    result = table.select("digest", "text", "copies").join(marked.hint("shuffle_hash"), "digest", "left") \
        .select("digest", "text", "copies", "marks").mapInArrow(_cut(length, keep), T.StructType([T.StructField("digest", T.BinaryType()), *fields]))
    return keyed.join(result, keyed["digest_"] == result["digest"]).drop("digest", "digest_")

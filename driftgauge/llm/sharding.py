"""Sharding by histogram sort: near-equal bytes per shard, copies of one text side by side.

Rows are ordered by a two-part key: a hash of the text, then a hash of doc_id. Splitters are found without moving rows: each round counts
the bytes and rows below a set of probes, exactly and in all partitions, and keeps for every splitter the two probes around its target; the
next round puts new probes between them. A splitter is done when the bytes below it are within the tolerance, or no key lies
between its probes. The driver holds a few probes per splitter, never keys of rows. Rows are then exchanged once, by the part between two splitters;
each shard is `parts` parts long, so no task gets a whole shard, and the counts of the parts before give the first slot.

Equal texts have one first half of the key, so they share a shard unless they weigh more than the tolerance allows; then the second
half splits them.

Defined cases: a null text weighs the fixed 16 bytes; null doc_ids are hashed as such; rows with the same doc_id and text stay in one part; an empty table
gives no rows; extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftgauge.llm.common import shielded, written

Probe = tuple[int, int]
LOW: Probe = (-(1 << 63), -(1 << 63))
HIGH: Probe = ((1 << 63) - 1, (1 << 63) - 1)


def sizes(text: str = "text") -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long")


def keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumns({"_a": F.xxhash64("text", F.col("text").isNull()), "_b": F.xxhash64("doc_id", F.col("doc_id").isNull()), "size": sizes()})


def _rank(a: np.ndarray, b: np.ndarray, probes: list[Probe]) -> np.ndarray:
    """How many probes are at most each (a, b)."""
    pa_, pb_ = np.array([p[0] for p in probes], np.int64), np.array([p[1] for p in probes], np.int64)
    out = np.searchsorted(pa_, a, side="left")
    on = np.isin(a, pa_)
    for first in np.unique(a[on]):  # keys on the first half of a probe: the second half decides
        same, lo, hi = a == first, np.searchsorted(pa_, first, side="left"), np.searchsorted(pa_, first, side="right")
        out[same] = lo + np.searchsorted(pb_[lo:hi], b[same], side="right")
    return out


def histogram(keys: DataFrame, probes: list[Probe]) -> dict[int, tuple[int, int]]:
    """Exact bytes and rows between consecutive probes; each task sums its own rows first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, len(probes) + 1), np.int64)
        for batch in batches:
            a, b, size = (batch.column(i).to_numpy() for i in range(3))
            at = _rank(a, b, probes)
            np.add.at(total[0], at, size)
            total[1] += np.bincount(at, minlength=len(probes) + 1)
        at = np.flatnonzero(total[1])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[0][at]), pa.array(total[1][at])], ["bin", "bytes", "rows"])

    counted = keys.mapInArrow(count, "bin long, bytes long, rows long").groupBy("bin").agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"))
    return {r["bin"]: (r["bytes"], r["rows"]) for r in counted.collect()}  # one row per probe at most


def _between(lo: Probe, hi: Probe, n: int) -> list[Probe]:
    """Probes inside (lo, hi): over the first half while it has room, then over the second."""
    if hi[0] - lo[0] > 1:
        width = hi[0] - lo[0]
        return sorted({(lo[0] + width * i // (n + 1), LOW[1]) for i in range(1, n + 1)} - {lo, hi})
    # one first half is left: from lo to (lo[0], HIGH), then (hi[0], LOW)
    out: set[Probe] = set()
    for first, x, y in ((lo[0], lo[1], HIGH[1] if hi[0] > lo[0] else hi[1]), (hi[0], LOW[1], hi[1])):
        if y - x > 1:
            out |= {(first, x + (y - x) * i // (n + 1)) for i in range(1, n + 1)}
    return sorted(p for p in out | {(hi[0], LOW[1])} if lo < p < hi)


def splitters(keys: DataFrame, parts: int, tolerance: float = 0.02, probes_each: int = 24, rounds: int = 40, border: int = 1) -> tuple[list[Probe], list[int]]:
    """parts - 1 splitters with near-equal bytes between them, and the rows of every part.

    tolerance: of one part's bytes; the rounds end earlier when nothing is left to refine. Every `border`-th splitter parts groups of equal first halves only where a
    group is larger than the tolerance of `border` parts; the others lie between these.
    """
    probes = _between(LOW, HIGH, 8 * parts)
    known: dict[Probe, tuple[int, int]] = {LOW: (0, 0)}  # bytes and rows below a probe
    targets: list[float] = []
    for _ in range(rounds):
        below_b = below_r = 0
        table = sorted(set(probes) | set(known) - {LOW, HIGH})
        found = histogram(keys, table)
        for i in range(len(table) + 1):
            x = found.get(i, (0, 0))
            below_b, below_r = below_b + x[0], below_r + x[1]
            known[table[i] if i < len(table) else HIGH] = (below_b, below_r)
        targets = [below_b * (i + 1) / parts for i in range(parts - 1)]
        places = sorted(known)
        bytes_ = np.array([known[p][0] for p in places])
        chosen, probes, most = [], [], tolerance * below_b / parts
        keep = {LOW, HIGH}
        ends = [p for p in places if p[1] == LOW[1] or p == HIGH]  # probes between groups
        end_bytes = np.array([known[p][0] for p in ends])
        for i, t in enumerate(targets):
            if (i + 1) % border == 0:
                hi = int(np.searchsorted(end_bytes, t, side="left"))
                lo = max(0, hi - 1)
                best = min((lo, hi), key=lambda k: abs(end_bytes[k] - t))
                keep |= {ends[lo], ends[hi]}
                if abs(end_bytes[best] - t) <= most * border:
                    chosen.append(ends[best])
                    continue
                if ends[hi][0] - ends[lo][0] > 1:
                    chosen.append(ends[best])
                    probes += _between(ends[lo], ends[hi], probes_each)
                    continue
            hi = int(np.searchsorted(bytes_, t, side="left"))
            lo = max(0, hi - 1)
            best = min((lo, hi), key=lambda i: abs(bytes_[i] - t))
            chosen.append(places[best])
            keep |= {places[lo], places[hi]}
            if abs(bytes_[best] - t) > most and known[places[hi]][1] - known[places[lo]][1] > 1:
                probes += _between(places[lo], places[hi], probes_each)
        known = {p: known[p] for p in keep | set(chosen)}
        if not probes:
            break
    for i in range(len(chosen)):  # parts stay inside their borders
        if (i + 1) % border:
            low = chosen[i - (i + 1) % border] if i >= border - 1 and i - (i + 1) % border >= 0 else LOW
            top = i + border - (i + 1) % border
            chosen[i] = max(low, min(chosen[i], chosen[top] if top < len(chosen) else HIGH))
    chosen = sorted(chosen)
    edges = [known[p][1] for p in chosen] + [known[HIGH][1]]
    return chosen, [b - a for a, b in zip([0, *edges], edges)]


def shard(docs: DataFrame, shards: int = 40, parts: int = 16, tolerance: float = 0.02) -> DataFrame:
    """docs with size, shard and slot (gapless from 0 in each shard, in the order of the key). Columns of these names are replaced, others pass through.

    Rows of one text stay in one shard unless they outweigh the tolerance of a shard's bytes together.
    """
    docs, own = shielded(docs, ("doc_id", "text"), ("size", "shard", "slot"))
    keys = written(keyed(docs).select("_a", "_b", "size"))
    cuts, rows = splitters(keys, shards * parts, tolerance, border=parts)
    first = [sum(rows[i // parts * parts:i]) for i in range(len(rows))]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = _rank(batch.column("_a").to_numpy(), batch.column("_b").to_numpy(), cuts)
            yield batch.append_column("_part", pa.array(at.astype(np.int32)))

    moved = keyed(docs)
    placed = moved.mapInArrow(place, T.StructType([*moved.schema.fields, T.StructField("_part", T.IntegerType())]))
    order = Window.partitionBy("_part").orderBy("_a", "_b", "size")
    starts = F.array(*[F.lit(x).cast("long") for x in first])
    return (placed.withColumn("slot", F.row_number().over(order) - 1 + F.element_at(starts, F.col("_part") + 1))
            .withColumn("shard", F.floor(F.col("_part") / parts).cast("int")).select(*own, "size", "slot", "shard"))

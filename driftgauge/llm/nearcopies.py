"""Near copies by wide SimHash fingerprints and an exact check: of documents whose word shingles overlap by a Jaccard of `least` or more, one stays.

Texts whose words agree are one vertex with a count of copies. Two 64-bit SimHash words of the five-word shingles make a 128-bit fingerprint; tiles of fingerprints
are compared as in `simhash.py` with a radius that holds nearly all pairs at the wanted similarity: at 0.8, 19 of 128 bits differ on average with a deviation of 4,
so 27 keep 98 of 100, while two unrelated texts differ by 64 with a deviation of 6.
Components of these candidates hold all candidate pairs; nothing is dropped on the word of a fingerprint.

Inside a component, leaders are chosen in the order of doc_id and compared by exact Jaccard of shingle hashes (64 bits): a document at `least` or more of a
leader is its copy and goes; the others go on. A component of at most `FEW` shingles is finished in one task; a larger one passes
rounds in which its first `LEADERS` vertices lead and meet all the others, so the one list that is sent to a component's members is bounded. Every document that goes is
a copy of one that stays, and no two that stay and were candidates are copies.

Defined cases: a null or empty text, or one of white space only, has no words: all such rows are copies of each other; fewer words than a shingle: the whole sequence;
equal rows are copies, and one stays; a null doc_id comes after all others; no rows, no results; extra columns pass through, and columns named like the results
are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftgauge.llm.common import flat, unused, written
from driftgauge.llm.components import components
from driftgauge.llm.simhash import LOWER, links
from driftgauge.session import settled

WORDS, LEAST, RADIUS = 5, 0.8, 27
SEEDS = (42, 43)
#: Shingles of a component that one task finishes (32 MB of hashes), and leaders of a round.
FEW, LEADERS = 4_000_000, 32


def shingle_hashes(text: bytes, words: int = WORDS, seed: int = SEEDS[0]) -> np.ndarray:
    """XXH64 of every shingle of lower-cased words, repeats included."""
    parts = text.translate(LOWER).split()
    if not parts:
        return np.empty(0, np.uint64)
    joined = b" ".join(parts)
    if len(parts) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    ends = np.cumsum([len(p) + 1 for p in parts])
    starts = np.concatenate([[0], ends[:-words]]).tolist()
    return np.array([xxhash.xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts, (ends[words - 1:] - 1).tolist())], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half of the hashes."""
    total = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 8192):
        total += np.unpackbits(hashes[i:i + 8192].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view("<u8")[0])


def remixed(hashes: np.ndarray) -> np.ndarray:
    """A second family of hashes from the first, so that shingles are read once."""
    h = hashes * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def _marks(text: int, words: int, names: list[str], keep: int):
    """Adds the digest of a text's words and its two fingerprint words; the first `keep` columns stay."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column(text))
            data = data.tobytes()
            same, low, high = [], [], []
            for a, b in zip(offsets.tolist(), offsets.tolist()[1:]):
                whole = data[a:b]
                h = np.unique(shingle_hashes(whole, words))
                same.append(xxhash.xxh3_128_digest(b" ".join(whole.translate(LOWER).split())))
                low.append(majority(h) if len(h) else 0)
                high.append(majority(remixed(h)) if len(h) else 0)
            marks = [pa.array(same, pa.binary()), *(pa.array(np.array(x, np.uint64).view(np.int64)) for x in (low, high))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:keep], *marks], names=names)

    return run


def _shingles(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column("text"))
            data = data.tobytes()
            sets = [np.unique(shingle_hashes(data[a:b], words)).view(np.int64) for a, b in zip(offsets.tolist(), offsets.tolist()[1:])]
            ends = np.cumsum([0, *(len(x) for x in sets)])
            lists = pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), pa.array(np.concatenate([np.empty(0, np.int64), *sets])))
            yield pa.RecordBatch.from_arrays([batch.column("group"), batch.column("vertex"), batch.column("place"), lists.cast(pa.list_(pa.int64()))],
                                             names=["group", "vertex", "place", "set"])

    return run


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 1.0 if not len(a) and not len(b) else both / (len(a) + len(b) - both)


def led(sets: list[np.ndarray], least: float) -> list[int]:
    """For sets in order: the first leader at `least` or more of each, or itself, which then leads.

    Two sets this alike share one of their rarest few members (all but ceil(least * size) - 1 of them), so only leaders with one of a set's rarest in common are compared.
    """
    _, place, count = np.unique(np.concatenate([np.empty(0, np.int64), *sets]), return_inverse=True, return_counts=True)
    rarity = np.empty(len(count), np.int64)
    rarity[np.argsort(count, kind="stable")] = np.arange(len(count))
    ends = np.cumsum([0, *(len(s) for s in sets)])
    sets = [np.sort(rarity[place[a:b]]) for a, b in zip(ends, ends[1:])]
    holders: dict[int, list[int]] = {}
    empty, out = None, []
    for i, s in enumerate(sets):
        if not len(s):
            empty = i if empty is None else empty
            out.append(empty)
            continue
        rare = s[:len(s) - int(np.ceil(least * len(s) - 1e-9)) + 1].tolist()
        near = sorted({j for x in rare for j in holders.get(x, ())})
        # Sizes alone bound the Jaccard.
        found = next((j for j in near if min(len(s), len(sets[j])) >= least * max(len(s), len(sets[j])) and jaccard(s, sets[j]) >= least), i)
        if found == i:
            for x in rare:
                holders.setdefault(x, []).append(i)
        out.append(found)
    return out


def _finish(least: float):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        leader = led([v.values.to_numpy() for v in table.column("set")], least)
        ids = table.column("vertex").to_numpy()
        return pa.table({"vertex": ids, "leader": ids[np.array(leader, np.int64)]})

    return run


def _copies(members: DataFrame, least: float, few: int, leaders: int) -> DataFrame:
    """members: group, vertex, place (order inside all vertices), set -> vertex, leader."""
    done = None
    small = Window.partitionBy("group")
    while True:
        sizes = settled(members.groupBy("group").agg(F.sum(F.size("set") + 1).alias("n")))
        last = members.join(sizes.filter(F.col("n") <= few), "group").drop("n").groupBy("group").applyInArrow(_finish(least), "vertex long, leader long")
        done = last if done is None else done.unionByName(last)
        large = sizes.filter(F.col("n") > few)
        if large.isEmpty():
            return done
        open_ = members.join(large, "group").drop("n")
        # The first vertices of every large component, found by the row-number limit.
        first = written(open_.withColumn("nth", F.row_number().over(small.orderBy("place"))).filter(F.col("nth") <= leaders).drop("nth"))
        heads = written(first.groupBy("group").applyInArrow(_finish(least), "vertex long, leader long"))
        chosen = first.join(heads.filter("vertex = leader"), "vertex")
        lists = chosen.groupBy("group").agg(F.sort_array(F.collect_list(F.struct("place", "vertex", "set"))).alias("heads"))
        rest = open_.join(heads.select("vertex"), "vertex", "left_anti")
        # Large components are few next to their members; their lists are small tables, so a hot component is split by a skewed join.
        met = rest.join(lists, "group")
        size = F.size("set")

        def alike(h):
            both = F.size(F.array_intersect(F.col("set"), h["set"]))
            bounded = F.least(size, F.size(h["set"])) >= least * F.greatest(size, F.size(h["set"]))
            return bounded & (F.when((size == 0) & (F.size(h["set"]) == 0), 1.0).otherwise(both / (size + F.size(h["set"]) - both)) >= least)

        told = written(met.withColumn("leader", F.get(F.filter("heads", alike), 0)["vertex"]).drop("heads"))
        done = settled(done.unionByName(heads).unionByName(told.filter("leader IS NOT NULL").select("vertex", "leader")))
        members = told.filter("leader IS NULL").drop("leader")


def near_copies(docs: DataFrame, words: int = WORDS, least: float = LEAST, radius: int = RADIUS, few: int = FEW, leaders: int = LEADERS) -> DataFrame:
    """docs with leader_id (doc_id of the document that a row is a copy of, or its own) and keeper (true for rows that stay)."""
    docs = docs.drop("leader_id", "keeper")
    same, low, high, row = (unused(n, docs.columns) for n in ("same_", "low_", "high_", "row_"))
    added = [T.StructField(same, T.BinaryType()), T.StructField(low, T.LongType()), T.StructField(high, T.LongType())]
    schema = T.StructType([*docs.schema.fields, *added])
    marked = written(docs.mapInArrow(_marks(docs.columns.index("text"), words, schema.names, len(docs.columns)), schema).withColumn(row, F.monotonically_increasing_id()))
    first = F.struct(F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id").alias("doc_id"), F.col(row).alias("row"))
    vertices = marked.groupBy(F.col(same).alias("code")).agg(F.min(first).alias("first"), F.first(low).alias("low"), F.first(high).alias("high")) \
        .withColumn("vertex", F.col("first.row"))
    vertices = written(vertices)
    groups = components(links(vertices.select("vertex", "low", "high"), radius, ("low", "high"), "vertex", twice=True))
    # Vertices with candidates, with the text of one of their rows, and their order by doc_id.
    placed = vertices.join(groups.select(F.col("id").alias("vertex"), F.col("component_id").alias("group")), "vertex").select("vertex", "group", F.col("first").alias("place"))
    texts = marked.select(F.col(row).alias("vertex"), "text").join(placed, "vertex")
    place = placed.schema["place"].dataType.simpleString()
    members = written(texts.select("group", "vertex", "place", F.col("text")).mapInArrow(_shingles(words), f"group long, vertex long, place {place}, set array<long>"))
    told = _copies(members, least, few, leaders)
    named = told.join(vertices.select(F.col("vertex").alias("leader"), F.col("first.doc_id").alias("leader_id")), "leader").select("vertex", "leader", "leader_id")
    by_code = settled(vertices.join(named, "vertex", "left").select("code", F.coalesce("leader", "vertex").alias("lead"),
                                                                  F.when(F.col("leader").isNull(), F.col("first.doc_id")).otherwise(F.col("leader_id")).alias("leader_id")))
    return marked.join(by_code, marked[same] == by_code["code"]).withColumn("keeper", F.col(row) == F.col("lead")).select(*docs.columns, "leader_id", "keeper")

"""Exact top-k BM25 search: an inverted index per shard, block-max WAND, exact merge.

Statistics (documents, mean length, document frequencies) are global, so a score is the same in every shard. A shard is a bounded number of documents and of postings. Its
postings lie in term order, cut into blocks of documents; every (term, block) has the largest impact inside and the place of its postings. For a query, the sums of these
maxima bound every block. The blocks with the highest bounds are scored first and give a threshold, the k-th best score. Then pivots are taken in document order: the
next pivot is the next block whose bound reaches the threshold, and the postings of every term before it are skipped unread. The threshold rises after each run of pivots,
so later blocks fall away. A skipped block cannot hold a result. Shards return k results each; the merge takes the k best of all.

A task reads the rows of its shard, builds the index once, and answers the queries as they stream in behind it.

Scores are compared rounded to nine decimals, then by the order of the row keys, so that results do not depend on the order of sums or on the sharding.

Defined cases: a null or empty text has no terms: it is found by no query and finds nothing; a document needs one term of the query to be found; equal rows
are each found; a query finds itself if it is in the index; queries with fewer than k matches have fewer results; empty tables give no rows; null keys come
last; extra columns are not returned, and keys may have any names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftgauge.llm.common import written
from driftgauge.session import settled

K1, B = 1.2, 0.75
#: Documents and postings of a shard (on average), documents of a block, queries that meet a shard in one task.
SHARD = 32_768
POSTINGS = 2_000_000
BLOCK = 128
QUERIES = 65_536
#: Blocks that give the first threshold; the first run of pivots has as many, each later one twice as many.
STRIDE = 32
#: A term in at least one of so many documents of a shard is frequent.
DENSE = 12
#: A term is a run of ASCII letters and digits and of other characters beyond ASCII, in lower case.
TERM = re.compile(rb"[a-z0-9\x80-\xff]+")


def with_terms(rows: DataFrame) -> DataFrame:
    """rows with `terms` (64-bit hashes, each once), `tf` (how often each occurs) and `dl` (all of them)."""
    rows = rows.drop("terms", "tf", "dl")
    at = rows.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for batch in batches:
            terms, tf, dl = [], [], []
            for text in pc.utf8_lower(pc.fill_null(batch.column(at), "")).to_pylist():
                counted = Counter(TERM.findall(text.encode("utf-8")))
                if len(known) > 500_000:
                    known.clear()
                for t in counted:
                    if t not in known:
                        known[t] = xxhash.xxh64_intdigest(t) - (1 << 63)
                terms.append([known[t] for t in counted])
                tf.append(list(counted.values()))
                dl.append(sum(counted.values()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(terms, pa.list_(pa.int64())), pa.array(tf, pa.list_(pa.int32())), pa.array(dl, pa.int32())],
                                             [*batch.schema.names, "terms", "tf", "dl"])

    added = T.StructType.fromDDL("terms array<long>, tf array<int>, dl int")
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, *added.fields]))


class Shard:
    def __init__(self, rows: pa.Table, mean: float):
        """rows: in key order, as it decides ties."""
        n = rows.num_rows
        dl = rows.column("dl").to_numpy().astype(np.float64)
        size = pc.list_value_length(rows.column("terms")).to_numpy()
        term, tf = (pc.list_flatten(rows.column(c)).to_numpy() for c in ("terms", "tf"))
        doc = np.repeat(np.arange(n), size)
        names, at = np.unique(term, return_inverse=True)
        df = np.bincount(at, minlength=len(names))
        # Documents that share their most frequent term lie side by side, so that blocks of another kind have low bounds.
        kind = np.full(n, -1)
        np.maximum.at(kind, doc, df[at])
        first = np.full(n, len(names))
        common = df[at] == kind[doc]
        np.minimum.at(first, doc[common], at[common])
        self.rank = np.lexsort((np.arange(n), first, -kind))  # place -> key order
        place = np.empty(n, np.int64)
        place[self.rank] = np.arange(n)
        self.id = rows.column("row").to_numpy()[self.rank]
        by = np.lexsort((place[doc], at))
        at, tf, self.doc = at[by], tf[by].astype(np.float64), place[doc][by]
        self.impact = tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl[self.rank][self.doc] / mean))
        self.names, self.blocks = names, -(-n // BLOCK)
        self.start = np.append(0, np.cumsum(df))
        # Impacts of frequent terms stand in a row for all documents, of the others in lists.
        self.dense = np.full(len(names), -1)
        frequent = np.flatnonzero(df * DENSE >= n)
        self.dense[frequent] = np.arange(len(frequent))
        self.row = np.zeros((len(frequent), self.blocks, BLOCK))
        inside = self.dense[at] >= 0
        self.row[self.dense[at[inside]], self.doc[inside] // BLOCK, self.doc[inside] % BLOCK] = self.impact[inside]
        self.row_most = self.row.max(2)
        block = self.doc // BLOCK
        cut = np.flatnonzero(np.append(True, (at[1:] != at[:-1]) | (block[1:] != block[:-1]))) if len(at) else np.empty(0, np.int64)
        self.block, self.most = block[cut], np.maximum.reduceat(self.impact, cut) if len(cut) else np.empty(0)
        self.cut = np.append(cut, len(at))
        self.first = np.append(np.searchsorted(at[cut], np.arange(len(names))), len(cut))

    def top(self, terms: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the k best documents."""
        at = np.minimum(np.searchsorted(self.names, terms), max(0, len(self.names) - 1))
        known = self.names[at] == terms if len(self.names) else np.zeros(len(terms), bool)
        at, weights = at[known], weights[known]
        row = self.dense[at]
        frequent = row[row >= 0], weights[row >= 0]
        entries, weight = _ranges(self.first[at[row < 0]], self.first[at[row < 0] + 1], weights[row < 0])
        listed = entries, weight, self.block[entries]
        bound = frequent[1] @ self.row_most[frequent[0]] + np.bincount(listed[2], weights=weight * self.most[entries], minlength=self.blocks)
        high = np.argpartition(-bound, STRIDE)[:STRIDE] if self.blocks > STRIDE else np.arange(self.blocks)
        best, found = self._scored(np.sort(high[bound[high] > 0]), frequent, listed, -np.inf, k)
        ahead = bound > 0
        ahead[high] = False
        ahead, size = np.flatnonzero(ahead), STRIDE
        while True:
            floor = found[-1] if len(found) == k else -np.inf
            ahead = ahead[bound[ahead] >= floor - 1e-8]
            if not len(ahead):
                return best, found
            more = self._scored(ahead[:size], frequent, listed, floor, k)
            best, found = self._best(np.concatenate([best, more[0]]), np.concatenate([found, more[1]]), k)
            ahead, size = ahead[size:], size * 2

    def _best(self, places: np.ndarray, values: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        keep = np.lexsort((self.rank[places], -values))[:k]
        return places[keep], values[keep]

    def _scored(self, pivots: np.ndarray, frequent: tuple, listed: tuple, floor: float, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best of some blocks, in ascending order: only postings inside them are read."""
        entries, weight, block = listed
        at = np.full(self.blocks, -1)
        at[pivots] = np.arange(len(pivots))
        inside = at[block] >= 0
        postings, weight = _ranges(self.cut[entries[inside]], self.cut[entries[inside] + 1], weight[inside])
        doc = self.doc[postings]
        score = np.bincount(at[doc // BLOCK] * BLOCK + doc % BLOCK, weights=weight * self.impact[postings], minlength=len(pivots) * BLOCK).astype(np.float64)
        part, room = score.reshape(-1, BLOCK), np.empty((len(pivots), BLOCK))
        for r, w in zip(frequent[0].tolist(), frequent[1].tolist()):
            np.take(self.row[r], pivots, axis=0, out=room, mode="clip")
            room *= w
            part += room
        high = np.flatnonzero(score > max(0.0, floor - 1e-8))
        if len(high) > 8 * k:
            reached = score[high]
            high = high[reached >= np.partition(reached, len(high) - k)[len(high) - k] - 1e-8]
        return self._best(pivots[high // BLOCK] * BLOCK + high % BLOCK, np.round(score[high], 9), k)


def _ranges(start: np.ndarray, end: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of the ranges, and each one's weight."""
    size = end - start
    return np.arange(size.sum()) + np.repeat(start - (np.cumsum(size) - size), size), np.repeat(weights, size)


def _answers(k: int, mean: float, keys: list[str]):
    """Rows come sorted by (shard, group), the documents of a shard before the queries (query is null for a document)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, parts, shard = None, [], None
        for batch in batches:
            asks = batch.column("query").is_valid().to_numpy(zero_copy_only=False)
            names = np.array([batch.column("shard").to_numpy(), batch.column("group").to_numpy(), asks])
            cuts = np.flatnonzero((names[:, 1:] != names[:, :-1]).any(0)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(batch)]):
                if a == b:
                    continue
                if tuple(names[:2, a].tolist()) != current:
                    current, parts, shard = tuple(names[:2, a].tolist()), [], None
                rows = batch.slice(a, b - a)
                if not asks[a]:
                    parts.append(rows.select([*keys, "row", "terms", "tf", "dl"]))
                    continue
                if shard is None:
                    if not parts:  # no documents here
                        continue
                    shard, parts = Shard(pa.Table.from_batches(parts).sort_by([(c, "ascending") for c in [*keys, "row"]]), mean), []
                found = [shard.top(t.values.to_numpy(), w.values.to_numpy(), k) for t, w in zip(rows.column("terms"), rows.column("weights"))]
                asked = np.repeat(rows.column("query").to_numpy(), [len(places) for places, _ in found])
                yield pa.RecordBatch.from_pydict({"query": pa.array(asked), "row": pa.array(shard.id[np.concatenate([places for places, _ in found])]),
                                                  "score": pa.array(np.concatenate([scores for _, scores in found]))})

    return run


def top_k(rows: DataFrame, is_query, keys: list[str], k: int = 10, shard: int = SHARD, block: int = QUERIES) -> DataFrame:
    """For every row where `is_query` holds: its keys as q_<key>, rank from 1, keys of the row found, score.

    rows: keys (numbers) and text. Queries weigh a term by how often they hold it.
    """
    inner = [f"key{i}" for i in range(len(keys))]
    named = rows.select(*[F.col(f"`{c}`").alias(i) for c, i in zip(keys, inner)], "text", F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = written(with_terms(named.withColumn("row", F.monotonically_increasing_id())).drop("text"))
    total = rows.agg(F.count("*").alias("n"), F.avg("dl").alias("mean"), F.count(F.when(F.col("asks"), 1)).alias("asks"), F.sum(F.size("terms")).alias("postings")).first()
    n, groups = total["n"], max(1, -(-total["asks"] // block))
    shards = max(1, -(-n // shard), -(-(total["postings"] or 0) // POSTINGS))
    frequency = rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    queries = rows.filter("asks").select(F.col("row").alias("query"), F.explode(F.arrays_zip(F.col("terms").alias("term"), F.col("tf").alias("tf"))).alias("x")) \
        .select("query", F.col("x.term").alias("term"), F.col("x.tf").alias("tf")).join(frequency, "term") \
        .groupBy("query").agg(F.collect_list(F.struct("term", (idf * F.col("tf")).alias("weight"))).alias("x")) \
        .select("query", F.col("x.term").alias("terms"), F.col("x.weight").alias("weights"))
    asked = settled(queries).withColumn("group", F.pmod(F.xxhash64("query"), F.lit(groups)).cast("int")) \
        .withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    # A copy of a shard serves 65,536 queries, so the copies together are fewer rows than the queries that are sent.
    index = rows.select(*inner, "row", "terms", "tf", "dl", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int").alias("shard")) \
        .withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    streamed = index.unionByName(asked, allowMissingColumns=True).repartition(2 * shards * groups, "shard", "group") \
        .sortWithinPartitions("shard", "group", F.col("query").asc_nulls_first())
    found = streamed.mapInArrow(_answers(k, total["mean"] or 1.0, inner), "query long, row long, score double")
    names = rows.select("row", *inner)
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), *[F.col(c).asc_nulls_last() for c in inner], "row")
    return found.join(names, "row").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k) \
        .join(names.select(F.col("row").alias("query"), *[F.col(c).alias(f"q_{c}") for c in inner]), "query") \
        .select(*[F.col(f"q_{i}").alias(f"q_{c}") for c, i in zip(keys, inner)], "rank", *[F.col(i).alias(c) for c, i in zip(keys, inner)], "score")

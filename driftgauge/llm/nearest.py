"""Approximate nearest neighbours by robust-pruned directed graphs, one per shard, merged exactly.

Equal vectors are one vertex that keeps its smallest keys. Vertices are dealt by a hash of their bytes into shards of a bounded number of vertices, and
`build_index` makes each shard a graph (`proximity.py`): a table with one row per vertex (shard, node, keys, vector, edges), fit to be
written and searched many times. `search` sends the distinct query vectors to every shard, behind the shard's rows: a task streams over its sorted rows,
loads one graph, answers the queries in batches as they pass, and forgets the graph, so it holds one shard and one batch whatever the number of queries. A
beam search on the graph proposes vertices, their distances are taken anew in double precision on the original vectors, and the
answers of all shards meet by query, where the row-number limit keeps the nearest before and after the shuffle.

The work of a search grows with queries times shards; of building, with vectors. Nothing is collected, and the only group that is held is a shard.

Defined cases: a vector that is null, empty, zero or holds null or non-finite components takes no part, neither as a query nor as a candidate; candidates have as
many dimensions as the query; equal distances go to the smaller key, a null key last; a null key is no query; rows that repeat key and
vector are rows of their own: each is a query, and each finds the others; a query with fewer candidates returns them all, one
with none returns nothing; empty tables give no rows; extra columns are not looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftgauge.llm import proximity
from driftgauge.llm.common import written
from driftgauge.session import settled

#: Vertices of a shard, about.
SHARD = 16_384
#: Most different numbers of dimensions whose sizes are sent to every task.
BROADCAST_DIMENSIONS = 10_000
#: Out-edges of a vertex, vertices held by a search while building and while answering, and the factor of the relaxed pruning.
DEGREE, BUILD_WIDTH, BEAM, RELAXED = 40, 64, 128, 1.2


def usable(vector: Column) -> Column:
    big = F.lit(float("inf"))
    return vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != big)) \
        & F.exists(vector, lambda c: c != 0)


def _rows(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, vector, code) of the vectors that take part; code tells vectors apart by 256 bits. Minus zero is zero."""
    kind = vectors.schema[vector].dataType.elementType
    rows = vectors.select(F.col(key).alias("id"), F.col(vector).alias("vector")).filter(usable(F.col("vector")))
    rows = rows.withColumn("vector", F.transform("vector", lambda c: (c + F.lit(0.0)).cast(kind)))
    return rows.withColumn("code", F.unhex(F.sha2(F.to_json(F.struct("vector")), 256)))


def _vertices(rows: DataFrame, k: int) -> DataFrame:
    """One row per distinct vector, with its k + 1 smallest keys; a hot vector is cut to these before it is shuffled."""
    nth = F.row_number().over(Window.partitionBy("code").orderBy(F.col("id").asc_nulls_last()))
    few = rows.withColumn("nth", nth).filter(F.col("nth") <= k + 1)
    return few.groupBy("code").agg(F.first("vector").alias("vector"), F.sort_array(F.collect_list(F.struct("nth", "id"))).alias("keys")) \
        .withColumn("keys", F.transform("keys", lambda x: x["id"]))


def _beside(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """Rows with what is known of their number of dimensions; nearly all rows have the same, so the few sizes go to the rows."""
    return rows.join(F.broadcast(sizes) if sizes.count() <= BROADCAST_DIMENSIONS else sizes, "dimensions")


INDEX = "shard int, dimensions int, node int, keys array<{key}>, vector array<{kind}>, edges array<int>"


def _graphs(degree: int, width: int, slack: float):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("code")  # equal input gives equal graphs
        points = _matrix(table.column("vector").combine_chunks())
        graph = proximity.build(_scaled(points), degree, width, slack)
        filled = graph.edges >= 0
        offsets = np.concatenate([[0], np.cumsum(filled.sum(1))]).astype(np.int32)
        edges = pa.ListArray.from_arrays(pa.array(offsets), pa.array(graph.edges[filled], pa.int32()))
        # The entry goes first: a search starts at node 0.
        n = len(points)
        place = np.arange(n)
        if n:
            place[[0, graph.entry]] = place[[graph.entry, 0]]
            edges = pa.ListArray.from_arrays(edges.offsets, pa.array(place[edges.values.to_numpy()].astype(np.int32)))
        return pa.table({"shard": pa.array([key[0].as_py()] * n, pa.int32()), "dimensions": pa.array([key[1].as_py()] * n, pa.int32()),
                         "node": pa.array(place, pa.int32()), "keys": table.column("keys"), "vector": table.column("vector"), "edges": edges})

    return run


def _matrix(lists: pa.ListArray) -> np.ndarray:
    values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(lists), -1) if len(lists) else np.empty((0, 0))


def _scaled(points: np.ndarray) -> np.ndarray:
    """For walking only: single precision, brought near 1, so that squares neither overflow nor vanish."""
    top = np.abs(points).max(initial=0)
    return (points / (top or 1)).astype(np.float32)


def build_index(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 10, shard: int = SHARD, degree: int = DEGREE,
                width: int = BUILD_WIDTH, slack: float = RELAXED) -> DataFrame:
    """The graphs of all shards as a table in the checkpoint folder, one row per distinct vector; answers of up to k rows can be taken from it."""
    vertices = written(_vertices(_rows(vectors, key, vector), k).withColumn("dimensions", F.size("vector")))
    shards = F.ceil(F.count("*") / shard).cast("int")
    sizes = vertices.groupBy("dimensions").agg(shards.alias("shards"))
    total = sizes.agg(F.sum("shards")).first()[0] or 1
    placed = _beside(vertices, settled(sizes)).withColumn("shard", F.pmod(F.xxhash64("code"), F.col("shards")).cast("int")) \
        .select("shard", "dimensions", "code", "keys", "vector")
    # Twice as many tasks as shards: the work of a shard is long, its data small.
    dealt = placed.repartition(2 * int(total), "shard", "dimensions")
    schema = INDEX.format(key=vectors.schema[key].dataType.simpleString(), kind=vectors.schema[vector].dataType.elementType.simpleString())
    return written(dealt.groupBy("shard", "dimensions").applyInArrow(_graphs(degree, width, slack), schema))


class _Shard:
    """One graph as its rows arrive, and the answers to queries."""

    def __init__(self, beam: int, k: int):
        self.beam, self.k, self.parts, self.graph = beam, k, [], None

    def add(self, rows: pa.RecordBatch) -> None:
        self.parts.append(rows)

    def ready(self) -> None:
        table = pa.Table.from_batches(self.parts).sort_by("node")
        self.parts = []
        self.keys = table.column("keys").combine_chunks()
        self.points = _matrix(table.column("vector").combine_chunks())
        lists = table.column("edges").combine_chunks()
        count = lists.value_lengths().to_numpy()
        edges = np.full((len(lists), int(count.max(initial=1)) or 1), -1, np.int32)
        edges[np.repeat(np.arange(len(lists)), count), np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)] = lists.flatten().to_numpy()
        self.top = np.abs(self.points).max(initial=0) or 1.0
        self.graph = proximity.Graph(np.ascontiguousarray(self.points / self.top, np.float32), edges, 0)

    def answer(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, node, distance) of the k + 1 nearest vertices found for each query, and those that tie with the last."""
        found, nodes, distances = [], [], []
        for i in range(0, len(queries), proximity.GROUP):
            part = queries[i:i + proximity.GROUP]
            walked = np.clip(part / self.top, -1e18, 1e18).astype(np.float32)
            ids, _, _, _ = proximity.beam_search(self.graph, walked, self.beam)
            row, col = np.nonzero(ids >= 0)
            node = ids[row, col]
            apart = self.points[node] - part[row]
            # The largest difference is taken out before squaring, so that nothing overflows or vanishes.
            top = np.abs(apart).max(1)
            safe = np.where(top > 0, top, 1)
            far = np.where((top > 1e-100) & (top < 1e100), np.sqrt((apart * apart).sum(1)), top * np.sqrt(((apart / safe[:, None]) ** 2).sum(1)))
            order = np.lexsort((far, row))
            row, node, far = row[order], node[order], far[order]
            start = np.searchsorted(row, row, side="left")
            last = np.minimum(start + self.k, np.searchsorted(row, row, side="right") - 1)
            near = far <= far[last]
            found.append(row[near] + i)
            nodes.append(node[near])
            distances.append(far[near])
        return np.concatenate(found), np.concatenate(nodes), np.concatenate(distances)


def _answers(beam: int, k: int, key_type: pa.DataType):
    """Rows come sorted by (shard, dimensions), the vertices of a shard before the queries (code is null for a vertex)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, shard = None, None
        for batch in batches:
            names = np.array([batch.column("shard").to_numpy(), batch.column("dimensions").to_numpy(), batch.column("code").is_valid().to_numpy(zero_copy_only=False)])
            cuts = np.flatnonzero((names[:, 1:] != names[:, :-1]).any(0)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(batch)]):
                if a == b:
                    continue
                at, rows = tuple(names[:2, a].tolist()), batch.slice(a, b - a)
                if at != current:
                    current, shard = at, _Shard(beam, k)
                if not names[2, a]:
                    shard.add(rows)
                    continue
                if not shard.parts and shard.graph is None:  # no vectors of these dimensions here
                    continue
                if shard.graph is None:
                    shard.ready()
                query, node, far = shard.answer(_matrix(rows.column("vector")))
                keys = shard.keys.take(pa.array(node))
                where = pc.list_parent_indices(keys).to_numpy()
                yield pa.RecordBatch.from_pydict({"code": rows.column("code").take(pa.array(query[where])), "id": keys.flatten().cast(key_type),
                                                  "score": pa.array(far[where])})

    return run


def search(index: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 10, beam: int = BEAM) -> DataFrame:
    """(query_id, rank, <key>, score): the k nearest found for each row of queries, without the query's own row if the index holds it.

    Rows of the index hold their vertices' k + 1 smallest keys, so k may not exceed the k that the index was built for.
    """
    asked = written(_rows(queries.filter(F.col(key).isNotNull()), key, vector).groupBy("code", "id").agg(F.first("vector").alias("vector"), F.count("*").alias("times")))
    distinct = asked.groupBy("code").agg(F.first("vector").alias("vector")).withColumn("dimensions", F.size("vector"))
    sizes = settled(index.groupBy("dimensions").agg((F.max("shard") + 1).alias("shards")))
    total = sizes.agg(F.sum("shards")).first()[0] or 1
    sent = _beside(distinct, sizes).withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
    key_type, kind = index.schema["keys"].dataType.elementType, index.schema["vector"].dataType
    rows = index.select("shard", "dimensions", F.lit(None).cast("binary").alias("code"), "node", "keys", "vector", "edges").unionByName(
        sent.select("shard", "dimensions", "code", F.lit(None).cast("int").alias("node"), F.lit(None).cast(T.ArrayType(key_type)).alias("keys"),
                    F.col("vector").cast(kind).alias("vector"), F.lit(None).cast("array<int>").alias("edges")))
    streamed = rows.repartition(2 * int(total), "shard", "dimensions").sortWithinPartitions("shard", "dimensions", F.col("code").asc_nulls_first())
    arrow_key = pa.string() if isinstance(key_type, T.StringType) else pa.int32() if isinstance(key_type, T.IntegerType) else pa.int64()
    out = T.StructType([T.StructField("code", T.BinaryType()), T.StructField("id", key_type), T.StructField("score", T.DoubleType())])
    found = streamed.mapInArrow(_answers(beam, k, arrow_key), out)
    nearest = Window.partitionBy("code").orderBy("score", F.col("id").asc_nulls_last())
    best = found.withColumn("place", F.row_number().over(nearest)).filter(F.col("place") <= k + 1)
    lists = best.groupBy("code").agg(F.sort_array(F.collect_list(F.struct("place", "id", "score"))).alias("best"))
    # A query's own row is one row with its key at distance 0: the first of them goes, or, if none is here, the last place.
    own = F.filter("best", lambda x: (x["score"] == 0) & x["id"].eqNullSafe(F.col("asker")))
    named = asked.select("code", F.col("id").alias("asker"), "times").join(lists, "code") \
        .withColumn("skip", F.array_min(F.transform(own, lambda x: x["place"]))) \
        .withColumn("left", F.slice(F.filter("best", lambda x: ~x["place"].eqNullSafe(F.col("skip"))), 1, k))
    each = named.select("asker", F.explode(F.array_repeat(F.col("left"), F.col("times").cast("int"))).alias("left"))
    return each.select("asker", F.posexplode("left").alias("at", "row")).select(
        F.col("asker").alias("query_id"), (F.col("at") + 1).cast("int").alias("rank"), F.col("row.id").alias(key), F.col("row.score").alias("score"))

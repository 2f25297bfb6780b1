"""Embedding near-duplicates by dual traversal of cover trees.

Vectors are compared only inside a class: equal label and equal number of dimensions. Equal vectors are one vertex with a count. A class is dealt into blocks of a
bounded number of vertices, and every pair of blocks of a class is one group of a shuffle. Inside, each block becomes a cover tree: levels are
nested (a node's centre is its first child's centre), radii halve from level to level, and every node knows how far its vectors really reach. Both trees
are walked together; a pair of nodes is dropped when the distance of their centres less both reaches exceeds the
threshold's distance, so all pairs that are left at the bottom are tested in double precision and none is missed.

A group returns a link count for each vertex (copies counted) and a spanning forest of its links, never all pairs.

Defined cases: a null label, a null or empty vector, a zero vector, one with null or non-finite components: no links, a component of its own; vectors of one label
with different dimensions do not link; equal rows link with each other; a null vec_id takes part, but is smallest only among nulls; extra columns
pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftgauge.llm.common import written
from driftgauge.llm.components import components
from driftgauge.llm.unionfind import forest
from driftgauge.session import settled

#: Vertices of a block. Two blocks are one group.
BLOCK = 2048
#: A node with at most so many vectors is not divided further.
LEAF = 24
#: Two reaches of nearly equal vectors, each of which rounding of the dot product can make too small by 5e-8.
SLACK = 2e-7


class Node:
    """Vectors within `reach` of a centre; children, or members if it is a leaf."""

    __slots__ = ("centre", "reach", "children", "members")

    def __init__(self, centre: int, reach: float, children: list[Node] | None, members: np.ndarray):
        self.centre, self.reach, self.children, self.members = centre, reach, children, members


def build(points: np.ndarray) -> Node:
    """A cover tree over unit vectors; the root's radius is 2, as no two are further apart."""
    squared = 2 - 2 * np.clip(points @ points.T, -1, 1)

    def node(members: np.ndarray, radius: float) -> Node:
        centre = members[0]
        reach = float(np.sqrt(squared[centre, members].max()))
        if len(members) <= LEAF or reach == 0:
            return Node(int(centre), reach, None, members)
        while radius >= reach and radius > 1e-6:
            radius /= 2
        if radius >= reach:  # the centre's radius holds every member, so no split would divide them
            return Node(int(centre), reach, None, members)
        children, left = [], members
        while len(left):
            near = squared[left[0], left] <= radius * radius
            children.append(node(left[near], radius) if near.sum() > 1 else Node(int(left[0]), 0.0, None, left[:1]))
            left = left[~near]
        return Node(int(centre), reach, children, members)

    return node(np.arange(len(points)), 2.0)


def _parts(node: Node) -> tuple[list[Node] | None, np.ndarray, np.ndarray]:
    """What a node is compared by: its children's centres and reaches, or its vectors."""
    if node.children is None:
        return None, node.members, np.zeros(len(node.members))
    return node.children, np.array([c.centre for c in node.children]), np.array([c.reach for c in node.children])


def dual(a: Node, b: Node, x: np.ndarray, y: np.ndarray, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All index pairs with a cosine of at least `cosine`, in pieces; x and y hold the unit vectors of the two trees."""
    far = np.sqrt(2 - 2 * cosine)
    stack = [(a, b)]
    while stack:
        p, q = stack.pop()
        (cp, ip, rp), (cq, iq, rq) = _parts(p), _parts(q)
        near = x[ip] @ y[iq].T
        if cp is None and cq is None:
            i, j = np.nonzero(near >= cosine)
            if len(i):
                yield ip[i], iq[j]
            continue
        apart = np.sqrt(np.maximum(0, 2 - 2 * near))
        i, j = np.nonzero(apart - rp[:, None] - rq[None, :] <= far + SLACK)
        single = ((rp[i] == 0) if cp is None else np.array([cp[k].children is None and len(cp[k].members) == 1 for k in i], bool)) \
            & ((rq[j] == 0) if cq is None else np.array([cq[k].children is None and len(cq[k].members) == 1 for k in j], bool))
        hit = single & (near[i, j] >= cosine)
        if hit.any():
            yield ip[i[hit]], iq[j[hit]]
        for k, m in zip(i[~single].tolist(), j[~single].tolist()):
            stack.append((Node(int(ip[k]), 0.0, None, ip[k:k + 1]) if cp is None else cp[k], Node(int(iq[m]), 0.0, None, iq[m:m + 1]) if cq is None else cq[m]))


def _units(values: list[bytes], wide: bool) -> np.ndarray:
    x = np.stack([np.frombuffer(v, np.float64 if wide else np.float32) for v in values]).astype(np.float64)
    return x / np.sqrt((x * x).sum(1))[:, None]


def _keys(schema: T.StructType, vector: int, label: int, wide: bool):
    """Adds the key of each usable vector (null for others), its bytes and its class."""
    kind = np.float64 if wide else np.float32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, data, groups = [], [], []
            for v, y in zip(batch.column(vector), batch.column(label).to_pylist()):
                x = v.values
                values = None if x is None or y is None or not len(x) or x.null_count else x.to_numpy(zero_copy_only=False).astype(kind) + kind(0)
                ok = values is not None and np.isfinite(values).all() and (values != 0).any()
                raw = values.tobytes() if ok else None
                group = f"{len(raw)}:{y}" if ok else None
                keys.append(xxhash.xxh3_128_digest(group.encode() + b"|" + raw) if ok else None)
                data.append(raw)
                groups.append(group)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.binary()), pa.array(data, pa.binary()), pa.array(groups, pa.string())],
                                             names=schema.names)

    return run


def _pair_links(cosine: float, wide: bool):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        ids, copies, second = (table.column(c).to_numpy() for c in ("id", "copies", "second"))
        units = _units(table.column("data").to_pylist(), wide)
        a = np.flatnonzero(~second)
        same = key[1].as_py() == key[2].as_py()
        b = a if same else np.flatnonzero(second)
        count, root = np.zeros(len(ids), np.int64), np.arange(len(ids))
        if len(a) and len(b):
            x, y = units[a], units[b]
            tree = build(x)
            for i, j in dual(tree, tree if same else build(y), x, y, cosine):
                i, j = a[i], b[j]
                if same:  # each link of a block with itself comes from both ends
                    apart = i != j
                    i, j = i[apart], j[apart]
                np.add.at(count, i, copies[j])
                if not same:
                    np.add.at(count, j, copies[i])
                root = forest(len(ids), np.concatenate([np.arange(len(ids)), i]), np.concatenate([root, j]))
        child = np.flatnonzero(root != np.arange(len(ids)))
        linked = np.flatnonzero(count)
        return pa.table({"a": pa.array(np.concatenate([ids[child], ids[linked]])),
                         "b": pa.array(np.concatenate([ids[root[child]], ids[linked]])),
                         "n": pa.array(np.concatenate([np.zeros(len(child), np.int64), count[linked]]))})

    return run


def near_duplicates(vectors: DataFrame, cosine: float = 0.93, block: int = BLOCK) -> DataFrame:
    """vectors with n_links, component_id (smallest vec_id reachable) and kept (vec_id = component_id)."""
    vectors = vectors.drop("n_links", "component_id", "kept", "key_", "data_", "class_", "row_")
    wide = vectors.schema["embedding"].dataType.elementType == T.DoubleType()
    keyed = T.StructType([*vectors.schema.fields, T.StructField("key_", T.BinaryType()), T.StructField("data_", T.BinaryType()), T.StructField("class_", T.StringType())])
    rows = written(vectors.mapInArrow(_keys(keyed, vectors.columns.index("embedding"), vectors.columns.index("label"), wide), keyed))
    vertices = written(rows.filter("key_ IS NOT NULL").groupBy("key_").agg(
        F.first("class_").alias("class"), F.first("data_").alias("data"), F.count("*").alias("copies"), F.min("vec_id").alias("least"))
        .withColumn("id", F.monotonically_increasing_id()))
    classes = settled(vertices.groupBy("class").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")))
    placed = vertices.join(classes, "class").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")) \
        .select("class", "id", "data", "copies", "block", "blocks")
    first = placed.select("class", F.col("block").alias("b1"), F.explode(F.sequence("block", F.col("blocks") - 1)).alias("b2"), "id", "data", "copies",
                          F.lit(False).alias("second"))
    second = placed.filter("block > 0").select("class", F.explode(F.sequence(F.lit(0), F.col("block") - 1)).alias("b1"), F.col("block").alias("b2"), "id", "data",
                                               "copies", F.lit(True).alias("second"))
    found = written(first.unionByName(second).groupBy("class", "b1", "b2").applyInArrow(_pair_links(cosine, wide), "a long, b long, n long"))
    counts = found.filter("a = b").groupBy("a").agg(F.sum("n").alias("n"))
    linked = components(found.filter("a != b").select("a", "b"))
    grouped = vertices.select("id", "key_", "copies", "least").join(linked, "id", "left").withColumn("root", F.coalesce("component_id", "id")).drop("component_id") \
        .join(counts, F.col("id") == F.col("a"), "left")
    smallest = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    named = settled(grouped.join(smallest, "root").select(F.col("key_").alias("k"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"))
    return rows.join(named, rows["key_"] == named["k"], "left").withColumns({
        "n_links": F.coalesce("n_links", F.lit(0)).cast("long"), "component_id": F.coalesce("component_id", "vec_id")}) \
        .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))).select(*vectors.columns, "n_links", "component_id", "kept")

"""Token counts of documents in flat, unindexed token files, by a scan for the end-of-document id.

A token file is a run of fixed-width little-endian ids; documents are told apart by nothing but the separator after each. Files are read as byte ranges of bounded size, by
every executor on its own, from a folder that all of them reach through pyarrow.
Each block is searched in one vectorised comparison; it yields how many separators it holds, the tokens before the first, between them,
and after the last. A prefix scan over blocks stitches the rest: separators before a block give the number of its first
document, and tokens left open before it are added to its first count. The scan is two-level, so that a file of any length is many tasks:
blocks inside a stretch of blocks, then stretches.

Defined cases: adjacent separators are a document of no tokens; tokens after a file's last separator are one more document; a document may span any number of
blocks; an empty file has no documents; files that hold half an id at the end are refused.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftgauge.llm.common import written
from driftgauge.session import checkpoint_folder

#: Ids in a block.
BLOCK = 65_536
#: Bytes of token files that one task reads, block by block.
TASK_BYTES = 16_000_000
#: Blocks in a stretch of the two-level scan.
STRETCH = 1024
SCAN = "file string, block long, seps long, size long, tail long, inner array<int>"


def _store(uri: str):
    """The file system of a URI or local path, and the path in it. Executors reach it without Spark."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


def blocks(files: DataFrame, width: int = 2, block: int = BLOCK) -> DataFrame:
    """(file, block, ids) of files given as (file, length in bytes). Each task seeks the blocks dealt to it, so one file is many tasks and none is held whole."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, k, size in zip(*(c.to_pylist() for c in batch.columns)):
                store, path = _store(name)
                with store.open_input_file(path) as f:
                    data = f.read_at(size, k * block * width)
                if len(data) != size or size % width:
                    raise ValueError(f"{name} holds a part of an id" if size % width else f"{name} is shorter than it was")
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([k], pa.int64()), pa.array([data], pa.binary())], ["file", "block", "ids"])

    step = block * width
    total = files.agg(F.sum("length")).first()[0] or 0
    tasks = max(files.sparkSession.sparkContext.defaultParallelism, -(-total // TASK_BYTES))
    ranges = files.filter("length > 0").select("file", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / step))).alias("block")) \
        .select("file", "block", F.least(F.lit(step), F.col("length") - F.col("block") * step).alias("size"))
    return ranges.repartition(tasks, "file", "block").mapInArrow(read, "file string, block long, ids binary")


def blocks_of_files(spark: SparkSession, path: str, width: int = 2, block: int = BLOCK) -> DataFrame:
    """(file, block, ids) of the binary files of a folder, whose lengths alone are listed by Spark."""
    return blocks(spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "length"), width, block)


def scan(blocks: DataFrame, separator: int, width: int = 2) -> DataFrame:
    """One row per block: separators, ids, tokens after the last separator (all of them without one), counts that the block alone can tell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(4)]
            for value in batch.column(2):
                ids = np.frombuffer(value.as_buffer(), f"<u{width}")
                at = np.flatnonzero(ids == separator)
                first = at[:1]
                for column, x in zip(out, (len(at), len(ids), len(ids) - at[-1] - 1 if len(at) else len(ids),
                                           np.concatenate([first, np.diff(at) - 1]).astype(np.int32))):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(x, pa.int64()) for x in out[:3]), pa.array(out[3], pa.list_(pa.int32()))],
                                             ["file", "block", "seps", "size", "tail", "inner"])

    return blocks.select("file", "block", "ids").mapInArrow(run, SCAN)


def _stitched(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    """Adds, for rows in order: separators before (`docs`), tokens before (`sum`), and those before the last separator (`base`, null without one)."""
    before = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("docs", F.coalesce(F.sum("seps").over(before), F.lit(0))).withColumn("sum", F.coalesce(F.sum("tail").over(before), F.lit(0))) \
        .withColumn("base", F.max(F.when(F.col("seps") > 0, F.col("sum"))).over(before))


def counts(blocks: DataFrame, separator: int, width: int = 2, stretch: int = STRETCH) -> DataFrame:
    """(file, ordinal, n_tokens) of every document of every file."""
    scanned = written(scan(blocks, separator, width).withColumn("stretch", F.floor(F.col("block") / stretch)))
    local = _stitched(scanned, ["file", "stretch"], "block")
    whole = local.groupBy("file", "stretch").agg(
        F.sum("seps").alias("seps"), (F.sum("tail") - F.coalesce(F.max(F.when(F.col("seps") > 0, F.col("sum"))), F.lit(0))).alias("tail"))
    outer = _stitched(whole, ["file"], "stretch").select(
        "file", "stretch", F.col("docs").alias("docs_before"), (F.col("sum") - F.coalesce("base", F.lit(0))).alias("open_before"))
    joined = local.join(outer, ["file", "stretch"])
    # Tokens of the document that is open where the block starts.
    carried = F.when(F.col("base").isNull(), F.col("open_before") + F.col("sum")).otherwise(F.col("sum") - F.col("base"))
    closed = joined.filter("seps > 0").select("file", (F.col("docs_before") + F.col("docs")).alias("first"), carried.alias("carried"),
                                              F.posexplode("inner").alias("k", "n")) \
        .select("file", (F.col("first") + F.col("k")).alias("ordinal"), (F.col("n") + F.when(F.col("k") == 0, F.col("carried")).otherwise(0)).cast("long").alias("n_tokens"))
    ends = _stitched(whole, ["file"], "stretch").withColumn("open", F.when(F.col("seps") > 0, F.col("tail")).otherwise(
        F.col("sum") - F.coalesce("base", F.lit(0)) + F.col("tail"))).withColumn("upto", F.col("docs") + F.col("seps"))
    last = ends.groupBy("file").agg(F.max_by("open", "stretch").alias("n_tokens"), F.max("upto").alias("ordinal")).filter("n_tokens > 0")
    return closed.unionByName(last.select("file", "ordinal", "n_tokens"))


@lru_cache(maxsize=2)
def _encoding(path: str):
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("flat", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def pack(docs: DataFrame, vocabulary: str, separator: int, folder: str) -> DataFrame:
    """Writes one flat file of 16-bit ids per task into `folder`. Returns the files, as (file, length), and the order of their documents, as (file, ordinal, doc_id).

    A file's name holds the attempt that wrote it, and only attempts that Spark accepts return rows, so files of failed attempts are never read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, task = _encoding(vocabulary), TaskContext.get()
        name = f"{folder}/part-{task.partitionId():05d}-{task.taskAttemptId()}.bin"
        names, ordinal, length = ["file", "length", "ordinal", "doc_id"], 0, 0
        store, path = _store(name)
        with store.open_output_stream(path) as out:
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    part = batch.slice(at, 256)
                    for ids in encoding.encode_ordinary_batch([x or "" for x in part.column(1).to_pylist()], num_threads=1):
                        raw = np.array([*ids, separator], "<u2").tobytes()
                        out.write(raw)
                        length += len(raw)
                    n = part.num_rows
                    yield pa.RecordBatch.from_arrays([pa.array([name] * n), pa.nulls(n, pa.int64()), pa.array(np.arange(ordinal, ordinal + n)), part.column(0)], names)
                    ordinal += n
        if length:
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([length], pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64())], names)

    store, path = _store(folder)
    store.create_dir(path)
    kinds = T.StructType.fromDDL("file string, length long, ordinal long, doc_id long")
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, kinds)


def document_counts(docs: DataFrame, vocabulary: str, separator: int) -> DataFrame:
    """(doc_id, n_tokens): documents are written as flat token files, which are then read without any index; the order written beside them names the documents."""
    folder = f"{checkpoint_folder(docs.sparkSession).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    files = written(pack(docs, vocabulary, separator, folder))
    found = counts(blocks(files.filter("length IS NOT NULL").select("file", "length")), separator)
    order = files.filter("length IS NULL").select("file", "ordinal", "doc_id")
    return order.join(found, ["file", "ordinal"]).select("doc_id", "n_tokens")

"""Helpers of the training-data operators: flat text buffers, scratch tables, word patterns."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftgauge.session import checkpoint_folder

WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that one vectorised step takes; a longer text is a step of its own.
STEP_BYTES = 4_000_000


def unused(name: str, columns: Iterable[str]) -> str:
    """The name, lengthened until no column has it (names differ by more than case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def shielded(df: DataFrame, needed: Iterable[str], replaced: Iterable[str]) -> tuple[DataFrame, list[Column]]:
    """The frame with its other columns under names that no operator uses, and the columns that give all of them their own names back.

    Columns named like the results (`replaced`) are left out.
    """
    needed, replaced = set(needed), {c.lower() for c in replaced}
    kept = [c for c in df.columns if c.lower() not in replaced]
    inside = {c: c if c in needed else f"shielded{i}__" for i, c in enumerate(kept)}
    return df.select(*[F.col(f"`{c}`").alias(n) for c, n in inside.items()]), [F.col(n).alias(c) for c, n in inside.items()]


def written(df: DataFrame) -> DataFrame:
    """The frame as a Parquet table in the shared checkpoint folder: cuts lineage, survives lost executors."""
    path = f"{checkpoint_folder(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def flat(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column in one array, and where each text starts and ends (null: empty)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, b"" if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type) else "")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)
    offsets = offsets[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def steps(offsets: np.ndarray, most: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `most` bytes together, one text at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)

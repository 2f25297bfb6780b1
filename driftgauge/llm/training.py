"""Bounded, seeded samples of labelled documents for models that are trained on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of one fifth, by crc32 of doc_id as text, are never learned from.
FOLDS = 5


def fold(doc_id: str = "doc_id") -> Column:
    return (F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % FOLDS).cast("int")


def labelled(docs: DataFrame, labels: DataFrame, target: str, most: int, seed: int = 7) -> DataFrame:
    """(doc_id, text, y) of at most `most` labelled documents outside the held-out fold, in the order of a seeded digest.

    Labels that are null, contradict each other or belong to no document are left out. A doc_id that repeats is one row, with its smallest text. The sample has a proven bound, so it is broadcast.
    """
    clean = labels.filter(F.col("doc_id").isNotNull() & F.col(target).isNotNull() & (fold() != 0)) \
        .groupBy("doc_id").agg(F.min(target).cast("int").alias("y"), F.max(target).cast("int").alias("y_")).filter("y = y_")
    sample = clean.select("doc_id", "y").orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")))).limit(most)
    named = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id")
    return named.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y"))

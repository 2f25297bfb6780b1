"""Corpus pipeline: toxic documents go, one document of each near-duplicate group stays, repeated passages are cut, sources are mixed, texts become tokens.

Every stage takes all rows its predecessor kept. Null or empty texts are copies of each other, so one of them stays, and pass through otherwise; rows that repeat
doc_id are rows of their own until the near-copy stage, where equal texts become one row; ties go to the smaller doc_id, a null one last; empty tables give
empty tables; extra columns are kept until the last stage, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftgauge.llm import bpe, mixing, nearcopies, queries, suffix, toxicity
from driftgauge.llm.common import written


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain rejects go."""
    chain = toxicity.train(docs, queries.table(spark, sf_dir, "labels"))
    return toxicity.score(docs, chain).filter("predicted = 0").select(*docs.columns)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with a Jaccard of 0.8 or more over five-word shingles, found by wide SimHash fingerprints, the one with the smallest doc_id stays."""
    return nearcopies.near_copies(docs).filter("keeper").select(*docs.columns)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 200 bytes that also start elsewhere are cut out of the texts; documents stay, even when little is left."""
    cut = suffix.dedup(docs, keep="text").withColumn("text", F.col("kept"))
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.length("text").cast("long"))
    return cut.select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document appears as often as the mix takes it, whole."""
    rows = mixing.mix(docs, whole=True)
    return rows.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), F.col("mix_copies")))).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of the ids and of what they decode to."""
    return bpe.encode(docs, queries.vocabulary()).select("doc_id", "source", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [("toxicity", clean), ("simhash", distinct), ("suffix_array", without_repeats), ("mixing", mixed), ("bpe", tokens)]

#: Trained models, fingerprints and tokens cannot be said in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = written(docs)
    return docs

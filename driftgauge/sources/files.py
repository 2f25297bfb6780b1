"""File scans with fixed schemas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftgauge.operators.ordered import row_index
from driftgauge.sources.resolve import feature_columns


def replay_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Parquet or headed CSV, chosen by suffix."""
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    if path.endswith(".csv"):
        reader = spark.read.option("header", True)
        return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)
    raise ValueError(f"replay tables are .parquet or .csv: {path}")


def event_table_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Event-contract CSV: missing ids become row numbers, missing regime `live`, NaN labels null."""
    reader = spark.read.option("header", True)
    df = (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)
    names = feature_columns(df, ("feature_",), ("label", "event_id"))
    if "event_id" not in df.columns:
        # Order of the file: split, then position in the split.
        marked = df.withColumn("_file", F.input_file_name()).withColumn("_pos", F.monotonically_increasing_id())
        df = row_index(marked, [], [F.col("_pos")], index="event_id").drop("_file", "_pos")
    label = F.col("label").cast("double") if "label" in df.columns else F.lit(None).cast("double")
    ts = F.col("timestamp").cast("string") if "timestamp" in df.columns else F.current_timestamp().cast("string")
    regime = F.col("regime_id") if "regime_id" in df.columns else F.lit("live")
    return df.select(
        F.col("event_id").cast("string").alias("event_id"), ts.alias("timestamp"),
        F.array(*[F.col(c).cast("double") for c in names]).alias("features"),
        F.when(~F.isnan(label), label).cast("int").alias("label"), regime.cast("string").alias("regime_id"))


EVENT_LINES = T.StructType([
    T.StructField("event_id", T.StringType()), T.StructField("timestamp", T.StringType()),
    T.StructField("features", T.ArrayType(T.DoubleType())), T.StructField("label", T.IntegerType()),
    T.StructField("regime_id", T.StringType()), T.StructField("metadata", T.MapType(T.StringType(), T.StringType()))])


def event_lines(spark: SparkSession, path: str) -> DataFrame:
    """Event-contract JSON lines; blank lines are skipped by the reader."""
    df = spark.read.schema(EVENT_LINES).json(path)
    return df.withColumn("regime_id", F.coalesce("regime_id", F.lit("live"))).withColumn(
        "timestamp", F.coalesce("timestamp", F.current_timestamp().cast("string")))


def positional_text(spark: SparkSession, path: str, columns: Sequence[tuple[str, str]]) -> DataFrame:
    """Whitespace-delimited text with fixed positions; further columns are dropped."""
    parts = F.split(F.trim("value"), r"\s+")
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(*[F.get(parts, i).cast(t).alias(n) for i, (n, t) in enumerate(columns)])


def sparse_text(spark: SparkSession, path: str, target: int | None = None) -> DataFrame:
    """`label idx:value ...` lines as long rows; the file stem names the batch."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    parts = F.split(F.trim("value"), r"\s+")
    stem = F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.[^./]*)?$", 1)
    raw = F.get(parts, 0).cast("double").cast("int")
    label = (raw == target).cast("int") if target is not None else raw
    pairs = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: F.split(x, ":"))
    features = F.map_from_entries(F.transform(pairs, lambda x: F.struct(
        x[0].cast("int").alias("k"), x[1].cast("double").alias("v"))))
    return lines.select(stem.alias("batch_name"), label.alias("label"), features.alias("features"))


def headless_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("header", False).csv(path)


def reference_rows(spark: SparkSession, path: str) -> DataFrame:
    """Reference batches `{features, labels, regime}` as one row per sample."""
    schema = "features array<array<double>>, labels array<int>, regime string"
    df = spark.read.parquet(path) if path.endswith(".parquet") else spark.read.schema(schema).json(path)
    zipped = F.arrays_zip("features", "labels")
    out = df.select("regime", F.posexplode(zipped).alias("row", "z"))
    return out.select("regime", "row", F.col("z.features").alias("features"), F.col("z.labels").alias("label"))

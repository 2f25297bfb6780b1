"""JSON messages to typed rows, with the rejected ones kept apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# `features` and `labels` stay text here, because their shape decides the kind of message.
_FIELDS = ("event_id string, batch_id string, timestamp string, features string, label int, labels string, "
           "regime_id string, regime string, metadata map<string,string>")


def _opened(df: DataFrame, value: str) -> DataFrame:
    out = df.withColumn("_m", F.from_json(F.col(value), _FIELDS))
    flat = F.regexp_replace("_m.features", r"\s", "")
    return (out.withColumn("_nested", flat.startswith("[["))
            .withColumn("_vector", F.from_json("_m.features", "array<double>"))
            .withColumn("_matrix", F.from_json("_m.features", "array<array<double>>"))
            .withColumn("_labels", F.from_json("_m.labels", "array<int>")))


def _regime() -> Column:
    return F.coalesce("_m.regime_id", "_m.regime", F.lit("live"))


def is_batch(df: DataFrame, value: str) -> DataFrame:
    """Add `is_batch`: features are a matrix with more than one row."""
    o = _opened(df, value)
    return o.withColumn("is_batch", F.coalesce(F.col("_nested") & (F.size("_matrix") > 1), F.lit(False))).select(
        *df.columns, "is_batch")


def parse_events(df: DataFrame, value: str = "value") -> DataFrame:
    """Single-event messages. `error` is null for accepted rows."""
    o = _opened(df, value)
    key = F.coalesce("_m.event_id", "_m.batch_id")
    one_row = F.when(F.col("_nested"), F.when(F.size("_matrix") == 1, F.col("_matrix")[0])).otherwise(F.col("_vector"))
    label = F.coalesce("_m.label", F.when(F.size("_labels") == 1, F.col("_labels")[0]))
    error = (F.when(F.col("_m").isNull() | (key.isNull() & F.col("_m.features").isNull()), "bad_message")
             .when(key.isNull(), "missing_id").when(F.col("_m.features").isNull(), "missing_features")
             .when(F.col("_nested") & (F.size("_matrix") > 1), "matrix_in_event")
             .when(one_row.isNull() | F.exists(one_row, lambda x: x.isNull()), "not_numeric"))
    return o.select(
        *[c for c in df.columns if c != value], F.col(value).alias("raw"), key.alias("event_id"),
        F.col("_m.timestamp").alias("timestamp"), one_row.alias("features"), label.alias("label"),
        _regime().alias("regime_id"), F.col("_m.metadata").alias("metadata"), error.alias("error"))


def parse_batches(df: DataFrame, value: str = "value") -> DataFrame:
    """Batch messages to one row per sample; a malformed message is one row without a sample that carries its `error`."""
    o = _opened(df, value)
    key = F.coalesce("_m.batch_id", "_m.event_id")
    error = (F.when(F.col("_m").isNull() | (key.isNull() & F.col("_m.features").isNull()), "bad_message").when(key.isNull(), "missing_id")
             .when(~F.coalesce("_nested", F.lit(False)) | F.col("_matrix").isNull(), "features_not_a_matrix")
             .when(F.col("_labels").isNotNull() & (F.size("_labels") != F.size("_matrix")), "labels_length"))
    keep = [c for c in df.columns if c != value]
    out = o.select(*keep, key.alias("batch_id"), _regime().alias("regime_id"), "_labels", error.alias("error"), "_matrix").select(
        *keep, "batch_id", "regime_id", "_labels", "error", F.posexplode_outer(F.when(F.col("error").isNull(), F.col("_matrix"))).alias("row", "features"))
    label = F.when(F.col("error").isNull(), F.get("_labels", F.col("row")))
    return out.select(*keep, "batch_id", "regime_id", "row", "features", label.alias("label"), "error")


def parse_labels(df: DataFrame, value: str = "value") -> DataFrame:
    """Label messages, with an `error` where no batch is named or no labels are carried."""
    o = _opened(df, value)
    key = F.coalesce("_m.batch_id", "_m.event_id")
    error = (F.when(F.col("_m").isNull() | (key.isNull() & F.col("_labels").isNull()), "bad_message").when(key.isNull(), "missing_id")
             .when(F.col("_labels").isNull(), "labels_not_array"))
    return o.select(*[c for c in df.columns if c != value], key.alias("batch_id"), F.col("_labels").alias("labels"), error.alias("error"))


def validated(df: DataFrame, value: str = "value", max_rows: int = 4096, max_width: int = 512) -> DataFrame:
    """Add `errors`, the broken rules of a batch message; empty means valid."""
    o = _opened(df, value)
    raw = F.col("_m.features")
    flat = F.regexp_replace(raw, r"\s", "")
    matrix = F.when(F.col("_nested"), F.col("_matrix")).when(F.col("_vector").isNotNull(), F.array("_vector"))
    rows = F.coalesce(F.size(matrix), F.lit(0))
    widths = F.transform(matrix, lambda r: F.size(r))
    holes = F.exists(matrix, lambda r: r.isNull() | F.exists(r, lambda x: x.isNull()))
    given = F.col("_m.labels").isNotNull()
    codes = F.array_compact(F.array(
        F.when(F.col("_m").isNull(), "not_an_object"),
        F.when(F.col("_m").isNotNull() & raw.isNull(), "features_required"),
        F.when(raw.isNotNull() & ~flat.startswith("["), "features_not_array"),
        F.when(flat == "[]", "features_empty"),
        F.when(flat.startswith("[[["), "features_not_1d_or_2d"),
        F.when(flat.startswith("[") & ~flat.startswith("[[[") & (matrix.isNull() | holes), "features_not_numeric"),
        F.when(F.array_max(widths) != F.array_min(widths), "features_ragged"),
        F.when(rows > max_rows, "too_many_rows"),
        F.when(F.array_max(widths) > max_width, "too_many_features"),
        F.when(given & F.col("_labels").isNull(), "labels_not_array"),
        F.when(F.exists("_labels", lambda x: x.isNull()), "labels_not_integer"),
        F.when(given & (F.size("_labels") != rows), "labels_length"),
    ))
    return o.select(*df.columns, rows.alias("n_rows"), codes.alias("errors"))


def split_valid(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid rows and the quarantine."""
    good = F.size("errors") == 0
    return checked.where(good).drop("errors"), checked.where(~good)

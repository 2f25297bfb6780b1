"""Table preparation: labels, splits, scaling, fills, regimes, drift injection, validation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftgauge.operators.ordered import exact_quantiles, row_index

# Names and thresholds the replay tables use.
WEDGE_PROFILES = {"fraud_risk": "fraud", "predictive_maintenance": "sensor"}
FAILURE_HORIZON = 30
MISSING_CODE = -999.0
MAX_LIST, FLOAT_LIST = 16, 5


# ---- records and labels ----------------------------------------------------------------------

def record_metadata(columns: Mapping[str, Column]) -> Column:
    """Metadata map of the given columns as text; null entries are left out."""
    pairs = [x for name, c in columns.items() for x in (F.lit(name), c.cast("string"))]
    return F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull())


def controller_profile(explicit: Column, wedge: Column) -> Column:
    chain = F.lit("general")
    for name, profile in WEDGE_PROFILES.items():
        chain = F.when(wedge == name, profile).otherwise(chain)
    return F.coalesce(explicit, chain)


def class_label(code: Column, positive: str = "1", negative: str = "2") -> Column:
    return F.when(code.cast("string") == positive, 1).when(code.cast("string") == negative, 0)


def class_label_or_unknown(code: Column, positive: str = "1", negative: str = "2") -> Column:
    return F.coalesce(class_label(code, positive, negative), F.lit(-1))


def remaining_life(df: DataFrame, unit: str, cycle: str, horizon: int = FAILURE_HORIZON) -> DataFrame:
    """Cycles left until the unit's last one, and the failure label."""
    last = df.groupBy(unit).agg(F.max(cycle).alias("_last"))
    out = df.join(last, unit).withColumn("rul", F.col("_last") - F.col(cycle)).drop("_last")
    return out.withColumn("label", (F.col("rul") <= horizon).cast("int"))


def primary_group(flags: Mapping[str, Column], none: str = "none") -> Column:
    """Name of the first active flag in the given order."""
    return F.coalesce(*[F.when(c, F.lit(name)) for name, c in flags.items()], F.lit(none))


def regime_of_batch(batched: DataFrame, keys: Sequence[str] = ("stream_id", "step")) -> DataFrame:
    """Last regime in each batch that is not null, else `replay_step_<k>`."""
    known = F.max_by("regime", F.when(F.col("regime").isNotNull(), F.col("idx")))
    return batched.groupBy(*keys).agg(known.alias("_r")).select(
        *keys, F.coalesce("_r", F.concat(F.lit("replay_step_"), F.col("step").cast("string"))).alias("regime"))


def quarter_regime(step: Column, steps: Column) -> Column:
    return (F.when(step < F.floor(steps / 4), "stable").when(step < F.floor(steps / 2), "covariate_drift")
            .when(step < F.floor(3 * steps / 4), "label_shift").otherwise("abrupt_shift"))


def progress_regime(first: Column, last: Column, total: Column) -> Column:
    """Quarter of the test stream that holds the middle of the rows [first, last)."""
    mid = (first + last) / 2.0 / total
    return (F.when(mid < 0.25, "early_test").when(mid < 0.50, "mid_test")
            .when(mid < 0.75, "late_test").otherwise("terminal"))


def rate_regime(rate: Column) -> Column:
    return F.when(rate < 0.05, "clean").when(rate < 0.20, "emerging").otherwise("high")


def phase_schedule(progress: Column, start: float, end: float, recovery: float, magnitude: float
                   ) -> tuple[Column, Column]:
    """Phase name and feature multiplier of a shock with a linear ramp up and down."""
    name = (F.when(progress < start, "pre_shock").when(progress < end, "macro_shock")
            .when(progress < recovery, "recovery").otherwise("new_normal"))
    up = (progress - start) / (end - start)
    down = (progress - end) / (recovery - end)
    factor = (F.when(progress < start, F.lit(1.0))
              .when(progress < end, 1.0 + (magnitude - 1.0) * F.least(F.lit(1.0), up * 1.5))
              .when(progress < recovery, magnitude - (magnitude - 1.0) * down).otherwise(F.lit(1.05)))
    return name, factor


def injected(features: Column, regime: Column, step: Column, noise: float = 0.0, seed: int = 0) -> Column:
    """Known drift on a feature array, by regime; `noise` adds normal noise to each value."""
    strength = F.least(F.lit(1.0), step / 12.0)

    def move(x, i):
        covariate = F.when(i < 8, x * (1.0 + 0.35 * strength)).otherwise(x)
        label = F.when(i < 6, x * 1.2).otherwise(x)
        abrupt = F.when(i < 10, F.tanh(1.5 * x)).otherwise(x)
        return (F.when(regime == "stable", x).when(regime == "covariate_drift", covariate)
                .when(regime == "label_shift", label).when(regime == "abrupt_shift", abrupt)
                .otherwise(x * 1.1))

    moved = F.transform(features, move)
    if noise:
        moved = F.transform(moved, lambda x: x + noise * F.randn(seed))
    return moved


# ---- splits ----------------------------------------------------------------------------------

def with_position(df: DataFrame, order: Sequence[Column], rows: int | None = None) -> DataFrame:
    """Global row position `idx` and row count `n` in chronological order."""
    return row_index(df, [], order, rows, total="n")


def temporal_split(df: DataFrame, order: Sequence[Column], test_fraction: float,
                   rows: int | None = None) -> DataFrame:
    """`part` is train for the first rows in time and test for the rest; both get at least one row."""
    n = F.col("n")
    cut = F.greatest(F.lit(1), F.floor(n * (1.0 - test_fraction)))
    cut = F.when(cut >= n, n - 1).otherwise(cut)
    out = with_position(df, order, rows)
    return out.withColumn("part", F.when(F.col("idx") < cut, "train").otherwise("test"))


def hashed_split(df: DataFrame, keys: Sequence[str], test_fraction: float, seed: int = 0) -> DataFrame:
    """Random split that depends on a digest of the keys only, not on partitioning or engine."""
    return df.withColumn("part", F.when(share(keys, seed) < test_fraction, "test").otherwise("train"))


def share(keys: Sequence[str], seed: int) -> Column:
    """A seeded number in [0, 1) from the first eight digits of the keys' digest."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / float(1 << 32)


def banded_split(df: DataFrame, order: Sequence[Column], train: float = 0.55, valid: float = 0.75,
                 rows: int | None = None) -> DataFrame:
    out = with_position(df, order, rows)
    n = F.col("n")
    return out.withColumn("part", F.when(F.col("idx") < F.floor(n * train), "train")
                          .when(F.col("idx") < F.floor(n * valid), "validation").otherwise("test"))


def customer_split(df: DataFrame, order: Sequence[Column], rows: int | None = None) -> DataFrame:
    """Half, a quarter and the rest, with minimum sizes; a validation part under two rows is taken
    from the end instead, where it overlaps the test part."""
    out = with_position(df, order, rows)
    n, i = F.col("n"), F.col("idx")
    a = F.greatest(F.lit(4), F.floor(0.5 * n))
    b = F.least(F.greatest(a + 2, F.floor(0.75 * n)), n - 1)
    short = b - a < 2
    tail = F.greatest(F.lit(2), F.floor(n / 4))
    return (out.withColumn("part", F.when(i < a, "train").when(i < b, "validation").otherwise("test"))
            .withColumn("validates", F.when(short, i >= n - tail).otherwise((i >= a) & (i < b))))


def recent_tail(df: DataFrame, order: Sequence[Column], fraction: float, rows: int | None = None) -> DataFrame:
    """The most recent share of rows; shares are kept in [0.05, 1] and 0.999 means all."""
    fraction = min(1.0, max(0.05, fraction))
    if fraction >= 0.999:
        return df
    out = with_position(df, order, rows)
    return out.where(F.col("idx") >= F.floor(F.col("n") * (1.0 - fraction))).drop("idx", "n")


def rebalanced(df: DataFrame, order: Sequence[Column], label: str, max_rows: int,
               rows: int | None = None) -> DataFrame:
    """First half, then every positive of the tail and as many of its first negatives as still fit."""
    out = with_position(df, order, rows)
    half = max_rows // 2
    head = out.where((F.col("idx") < half) | (F.col("n") <= max_rows))
    tail = out.where((F.col("idx") >= half) & (F.col("n") > max_rows))
    positives = tail.where(F.col(label) == 1)
    room = max(0, half - positives.count())
    negatives = row_index(tail.where(F.col(label) == 0), [], [F.col("idx")], rows, index="_k")
    negatives = negatives.where(F.col("_k") < room).drop("_k")
    return head.unionByName(positives).unionByName(negatives)


def entity_split(df: DataFrame, unit: str, cycle: str, train_fraction: float = 0.6) -> DataFrame:
    """First share of the sorted units trains. A table with one unit is split by cycle."""
    units = row_index(df.select(unit).distinct(), [], [F.col(unit)], index="_u", total="_units")
    marked = df.join(units, unit)
    last = df.groupBy(unit).agg(F.max(cycle).alias("_last"))
    marked = marked.join(last, unit)
    by_unit = F.col("_u") < F.greatest(F.lit(1), F.floor(F.col("_units") * train_fraction))
    by_cycle = F.col(cycle) <= F.floor(F.col("_last") * train_fraction)
    train = F.when(F.col("_units") == 1, by_cycle).otherwise(by_unit)
    return marked.withColumn("part", F.when(train, "train").otherwise("test")).drop("_u", "_units", "_last")


def entity_folds(df: DataFrame, unit: str, folds: int, train_fraction: float = 0.6, seed: int = 0) -> DataFrame:
    """Unit assignment of each fold: units in hash order, first share trains. A fold without a test unit is left out."""
    units = df.select(unit).distinct().select(
        unit, F.explode(F.sequence(F.lit(0), F.lit(folds - 1))).alias("fold"))
    units = units.withColumn("_h", share([unit, "fold"], seed))
    out = row_index(units, ["fold"], [F.col("_h"), F.col(unit)], index="_i", total="_n")
    cut = F.greatest(F.lit(1), F.floor(F.col("_n") * train_fraction))
    out = out.where(F.col("_n") > cut)
    return out.select("fold", unit, F.when(F.col("_i") < cut, "train").otherwise("test").alias("part"))


def cyclic_replay(pool: DataFrame, order: Sequence[Column], steps: int, batch_size: int, cycles: int = 1,
                  rows: int | None = None) -> DataFrame:
    """Read a chronological pool round and round for `steps * cycles` batches."""
    total = steps * cycles * batch_size
    indexed = with_position(pool, order, rows)
    # Row i of the pool is wanted at i, i + n, i + 2n, ...
    n = F.col("n")
    copies = F.when(F.col("idx") < total, F.sequence(F.lit(0).cast("long"), F.floor((total - 1 - F.col("idx")) / n)))
    out = indexed.where(F.col("idx") < total).withColumn("_k", F.explode(copies))
    out = out.withColumn("pos", F.col("_k") * n + F.col("idx"))
    step = F.floor(F.col("pos") / batch_size).cast("long")
    return (out.withColumn("step", step).withColumn("cycle", F.floor(step / steps))
            .withColumn("local_step", step % steps).drop("_k", "n"))


# ---- numeric columns -------------------------------------------------------------------------

def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in set(exclude)]


def finite(c: Column) -> Column:
    x = c.cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(None)).otherwise(x)


def unpivoted(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), finite(F.col(c)).alias("value")) for c in columns]))
    return df.select(*keys, pairs.alias("_p")).select(*keys, "_p.name", "_p.value")


def medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """Exact column medians: one number per column reaches the driver."""
    rows = exact_quantiles(unpivoted(df, columns), ["name"], "value", {"median": 0.5}).collect()
    return {r["name"]: r["median"] for r in rows}


def filled(df: DataFrame, columns: Sequence[str], values: Mapping[str, float] | float) -> DataFrame:
    """Not-finite values and nulls to a constant, or to each column's value and then the missing code."""
    for c in columns:
        v = values if isinstance(values, (int, float)) else values.get(c)
        df = df.withColumn(c, F.coalesce(finite(F.col(c)), F.lit(float(MISSING_CODE if v is None else v))))
    return df


@dataclass(frozen=True)
class StandardScale:
    """Column means and population deviations; a zero deviation counts as one."""

    stats: dict[str, tuple[float, float]]

    @classmethod
    def fit(cls, df: DataFrame, columns: Sequence[str]) -> StandardScale:
        aggs = [x for c in columns for x in (F.avg(c), F.stddev_pop(c))]
        row = df.agg(*aggs).first()
        return cls({c: (float(row[2 * i] or 0.0), float(row[2 * i + 1] or 0.0) or 1.0)
                    for i, c in enumerate(columns)})

    def apply(self, df: DataFrame) -> DataFrame:
        new = {c: (F.col(c) - m) / s for c, (m, s) in self.stats.items()}
        return df.withColumns(new)


def column_ranking(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Coverage times (sample deviation + 1e-6) per column."""
    got = unpivoted(df, columns).groupBy("name").agg(
        F.avg(F.col("value").isNotNull().cast("double")).alias("coverage"),
        F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("spread"))
    return got.withColumn("rank_score", F.col("coverage") * (F.col("spread") + 1e-6))


def top_columns(df: DataFrame, columns: Sequence[str], k: int) -> DataFrame:
    return column_ranking(df, columns).orderBy(F.desc("rank_score"), "name").limit(k)


def balanced_first_rows(batched: DataFrame, keys: Sequence[str], label: str, order: str, k: int) -> DataFrame:
    """First k/2 rows of each class in every batch, filled up with the batch's next rows.

    Groups are batches, whose size is bounded.
    """
    half = max(1, k // 2)
    by_class = Window.partitionBy(*keys, label).orderBy(order)
    out = batched.withColumn("_r", F.row_number().over(by_class))
    out = out.withColumn("_late", (F.col("_r") > half).cast("int"))
    fill = Window.partitionBy(*keys).orderBy("_late", order)
    return out.withColumn("_f", F.row_number().over(fill)).where(F.col("_f") <= k).drop("_r", "_late", "_f")


# ---- checks ----------------------------------------------------------------------------------

def label_warnings(df: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    """Warning codes per group of labels; a group is clean when the list is empty."""
    x = F.col(label).cast("double")
    bad = F.isnan(x) | (F.abs(x) == float("inf"))
    got = df.groupBy(*keys).agg(
        F.count(x).alias("n"), F.sum(F.coalesce(bad, F.lit(False)).cast("int")).alias("_bad"),
        F.sum(F.when(x.isNotNull() & ~x.isin(0.0, 1.0), 1).otherwise(0)).alias("_out"), F.avg(x).alias("_rate"))
    r = F.col("_rate")
    codes = F.array_compact(F.array(
        F.when(F.col("_out") > 0, "out_of_range_labels"),
        F.when(r == 0, "all_negative_labels").when(r == 1, "all_positive_labels")
        .when(r < 0.01, "extreme_class_imbalance_low").when(r > 0.99, "extreme_class_imbalance_high")))
    codes = (F.when(F.col("n") == 0, F.array(F.lit("empty_label_array")))
             .when(F.col("_bad") > 0, F.array(F.lit("non_finite_labels"))).otherwise(codes))
    return got.select(*keys, "n", codes.alias("warnings"))


def out_of_range_labels(df: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    """Distinct label values other than 0 and 1; values are counted apart before they meet in one list."""
    distinct = df.where(F.col(label).isNotNull() & ~F.col(label).isin(0, 1)).select(*keys, label).distinct()
    return distinct.groupBy(*keys).agg(F.sort_array(F.collect_list(label)).alias("out_of_range"))


def first_answers(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Idempotent replay: every repetition of a key carries the first answer, and is marked.

    The first answer is found by aggregation, so many repetitions of one key are no burden.
    """
    rest = [c for c in df.columns if c not in set(keys)]
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_first"))
    return first.select(*keys, "_first.*")


def redacted(schema: T.DataType, value: Column, depth: int = 0) -> Column:
    """Text-safe form of a value: long lists, float lists of five and more, bytes and deep values are masked."""
    if depth > 6:
        return F.lit("<redacted_deep>")
    if isinstance(schema, T.BinaryType):
        return F.when(value.isNotNull(), F.lit("<redacted_bytes>"))
    if isinstance(schema, T.ArrayType):
        n = F.size(value)
        plain = F.to_json(F.transform(value, lambda x: redacted(schema.elementType, x, depth + 1)))
        masked = F.when(n > MAX_LIST, F.concat(F.lit("<redacted_list_len_"), n.cast("string"), F.lit(">")))
        if isinstance(schema.elementType, (T.DoubleType, T.FloatType)):
            masked = masked.when(n >= FLOAT_LIST, F.concat(
                F.lit("<redacted_float_list_len_"), n.cast("string"), F.lit(">")))
        return F.when(value.isNull(), F.lit(None)).otherwise(masked.otherwise(plain))
    if isinstance(schema, T.StructType):
        return F.to_json(F.struct(*[
            redacted(f.dataType, value.getField(f.name), depth + 1).alias(f.name) for f in schema.fields]))
    if isinstance(schema, T.MapType):
        return F.to_json(F.transform_values(value, lambda k, v: redacted(schema.valueType, v, depth + 1)))
    return value


def event_worthy(decisions: DataFrame) -> DataFrame:
    """Batches with any action, recommendation, alert, retrain flag or budget limit."""
    quiet = ["none", "hold"]
    return decisions.where(
        ~F.col("action_taken").isin(quiet) | ~F.col("recommended_action").isin(quiet)
        | F.col("risk_alert") | F.col("retrain_recommended") | F.col("budget_limited"))

"""Ordered work per key that stays distributed when one key holds most of the rows.

Every operator here has two plans with the same result. When the largest key group is known to
fit one task, a plain window per key is used. Otherwise rows are range-partitioned and sorted by
(key, order), written once with their place or sum inside the partition, and what the earlier partitions
hold is added to each row from a small table: rows are shuffled once.
Folds with feedback are one sorted pass with a carried state; states whose steps compose are an
exact prefix over chunks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import WindowSpec

from driftgauge.session import settled, single_task_rows, stored

SLOT = "_slot"
ALL = "_all"
#: Steps of a chunk in a composed scan, and most chunks of a run, which is one group of one task.
SCAN_ROWS = 512
RUN_CHUNKS = 64
#: Most rows of the largest key that one range of a spread key should hold.
SLOT_ROWS = 500_000
#: Rows of a chunk of a long key under a finite window, unless the frames reach far.
WINDOW_ROWS = 32_768


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    """Rows of the biggest key group. One small aggregation over the key columns only."""
    if not keys:
        return df.count()
    row = df.groupBy(*keys).count().agg(F.max("count").alias("m")).first()
    return int(row["m"] or 0)


def _fits(df: DataFrame, keys: Sequence[str], rows: int | None) -> bool:
    limit = single_task_rows(df.sparkSession)
    return (largest_group(df, keys) if rows is None else rows) <= limit


def _keyed(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """A frame without keys gets one constant key, so both plans can treat it like any other."""
    return (df, list(keys)) if keys else (df.withColumn(ALL, F.lit(0)), [ALL])


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    values: Mapping[str, Column],
    rows: int | None = None,
) -> DataFrame:
    """Add inclusive running sums of `values` along `order` within `keys`.

    `rows` is an upper bound for the largest key group; without it one count is run.
    `order` must be total, up to rows that are equal in every column.
    """
    df, keys = _keyed(df, keys)
    if _fits(df, keys, rows):
        frame = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.select("*", *[F.sum(v).over(frame).alias(n) for n, v in values.items()]).drop(ALL)
    return _ranged_totals(df, keys, list(order), values, rows).drop(ALL)


def _slots(spark: SparkSession, rows: int) -> int:
    """Partitions for a key of so many rows: the session's number, more if these would grow large."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // SLOT_ROWS))


def _ranged_rows(df: DataFrame, keys: list[str], order: list[Column], rows: int | None) -> DataFrame:
    """Rows range-partitioned and sorted by (key, order), with their partition `_slot` and their place `_pos` in it."""
    slots = _slots(df.sparkSession, rows or 0)
    # The tie breaker spreads rows that are copies of each other over several partitions.
    tied = df.withColumn("_tie", F.monotonically_increasing_id())
    ranged = tied.repartitionByRange(slots, *[F.col(k) for k in keys], *order, F.col("_tie")).sortWithinPartitions(*keys, *order, "_tie")
    # The lower 33 bits count the rows of a partition.
    return ranged.drop("_tie").withColumns({SLOT: F.spark_partition_id(), "_pos": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})


def _with_heads(ranged: DataFrame, heads: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with what is known of their key and partition: at most one row for each, written first, so that it is seen to be small."""
    heads = stored(heads).withColumnsRenamed({k: f"_h{i}" for i, k in enumerate(keys)} | {SLOT: "_hs"})
    on = F.col(SLOT) == F.col("_hs")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_h{i}"))
    return ranged.join(heads, on).drop("_hs", *[f"_h{i}" for i in range(len(keys))])


def _summed(names: Sequence[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Running sums of whole numbers over all rows of a partition, in the columns `_w_`."""
    def run(batches):
        so_far = dict.fromkeys(names, 0)
        for batch in batches:
            for n in names:
                sums = np.cumsum(batch.column(f"_v_{n}").to_numpy(zero_copy_only=False)) + so_far[n]
                so_far[n] = sums[-1] if len(sums) else so_far[n]
                batch = batch.append_column(f"_w_{n}", pa.array(sums, pa.int64()))
            yield batch

    return run


def _ranged_totals(df: DataFrame, keys: list[str], order: list[Column],
                   values: Mapping[str, Column], most: int | None) -> DataFrame:
    kinds = df.select(*[v.alias(n) for n, v in values.items()]).schema
    if not all(isinstance(f.dataType, T.IntegralType) for f in kinds):
        return _window_totals(df, keys, order, values)
    # A running sum is null until its first value.
    counted = {n: f"{n}_known" for n in values if kinds[n].nullable}
    wide = {n: F.coalesce(v.cast("long"), F.lit(0).cast("long")) for n, v in values.items()} | {c: values[n].isNotNull().cast("long") for n, c in counted.items()}
    rows = _ranged_rows(df.select("*", *[v.alias(f"_v_{n}") for n, v in wide.items()]), keys, order, most)
    schema = T.StructType([*rows.schema, *[T.StructField(f"_w_{n}", T.LongType()) for n in wide]])
    ranged = stored(rows.mapInArrow(_summed(list(wide)), schema))
    sums = ranged.groupBy(*keys, SLOT).agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in wide], *[F.min_by(F.col(f"_w_{n}") - F.col(f"_v_{n}"), "_pos").alias(f"_b_{n}") for n in wide])
    before = Window.partitionBy(*keys).orderBy(SLOT).rowsBetween(Window.unboundedPreceding, -1)
    heads = sums.select(*keys, SLOT, *[(F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)) - F.col(f"_b_{n}")).alias(f"_h_{n}") for n in wide])
    out = _with_heads(ranged, heads, keys)
    total = lambda n: F.col(f"_w_{n}") + F.col(f"_h_{n}")
    return out.select(*df.columns, *[(F.when(total(counted[n]) > 0, total(n)) if n in counted else total(n)).alias(n) for n in values])


def _window_totals(df: DataFrame, keys: list[str], order: list[Column],
                   values: Mapping[str, Column]) -> DataFrame:
    """Sums of fractions, each in the order of the rows."""
    slots = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for name, value in values.items():
        df = df.withColumn(f"_v_{name}", value)
    tied = df.withColumn("_tie", F.monotonically_increasing_id())
    ranged = tied.repartitionByRange(slots, *[F.col(k) for k in keys], *order, F.col("_tie"))
    ranged = settled(ranged.withColumn(SLOT, F.spark_partition_id()))
    sums = ranged.groupBy(*keys, SLOT).agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in values])
    # At most one row per key and partition, so this window is small even for one huge key.
    before = Window.partitionBy(*keys).orderBy(SLOT).rowsBetween(Window.unboundedPreceding, -1)
    heads = sums.select(
        *keys, SLOT, *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_h_{n}") for n in values]
    )
    inner = Window.partitionBy(*keys, SLOT).orderBy(*order, F.col("_tie")).rowsBetween(
        Window.unboundedPreceding, 0)
    out = ranged.select("*", *[F.sum(f"_v_{n}").over(inner).alias(f"_w_{n}") for n in values])
    out = out.join(heads, [*keys, SLOT])
    for name in values:
        out = out.withColumn(name, F.col(f"_w_{name}") + F.col(f"_h_{name}"))
    drop = [c for n in values for c in (f"_v_{n}", f"_w_{n}", f"_h_{n}")]
    return out.drop("_tie", SLOT, *drop)


def row_index(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    rows: int | None = None,
    index: str = "idx",
    total: str | None = None,
) -> DataFrame:
    """Add a 0-based row number along `order` within `keys`, and optionally the group size."""
    order = list(order)
    df, keys = _keyed(df, keys)
    if _fits(df, keys, rows):
        part = Window.partitionBy(*keys)
        out = df.withColumn(index, F.row_number().over(part.orderBy(*order)).cast("long") - 1)
        out = out.withColumn(total, F.count(F.lit(1)).over(part)) if total else out
        return out.drop(ALL)
    ranged = stored(_ranged_rows(df, keys, order, rows))
    part = Window.partitionBy(*keys)
    before = part.orderBy(SLOT).rowsBetween(Window.unboundedPreceding, -1)
    per = ranged.groupBy(*keys, SLOT).agg(F.min("_pos").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    heads = per.select(*keys, SLOT, (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).alias("_ahead"), F.sum("_rows").over(part).alias("_all_rows"))
    size = [F.col("_all_rows").alias(total)] if total else []
    return _with_heads(ranged, heads, keys).select(*df.columns, (F.col("_pos") + F.col("_ahead")).alias(index), *size).drop(ALL)


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    quantiles: Mapping[str, float],
    rows: int | None = None,
) -> DataFrame:
    """Exact interpolated quantiles per key without holding a group's values in one task.

    Values are counted first, so copies collapse before the shuffle by order.
    """
    df, keys = _keyed(df, keys)
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    cum = running_totals(counts, keys, [F.col(value)], {"_cum": F.col("_n")}, rows)
    size = stored(counts.groupBy(*keys).agg(F.sum("_n").alias("_size")))
    joined = cum.join(size, keys)
    aggs = []
    for name, q in quantiles.items():
        pos = F.lit(float(q)) * (F.col("_size") - 1)
        aggs += [
            F.min(F.when(F.col("_cum") > F.floor(pos), F.col(value))).alias(f"_lo_{name}"),
            F.min(F.when(F.col("_cum") > F.ceil(pos), F.col(value))).alias(f"_hi_{name}"),
            F.max(pos - F.floor(pos)).alias(f"_f_{name}"),
        ]
    got = joined.groupBy(*keys).agg(*aggs)
    return got.select(
        *keys,
        *[(F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_f_{n}")).alias(n)
          for n in quantiles],
    ).drop(ALL)


State = Any
Block = Callable[[State, pd.DataFrame], tuple[State, pd.DataFrame]]


def ordered_fold(
    df: DataFrame,
    keys: Sequence[str],
    step: str,
    start: Sequence[float] | Callable[[], State],
    block: Block,
    fields: Sequence[T.StructField],
    keep: Sequence[str] = (),
) -> DataFrame:
    """Run `block(state, rows)` along the column `step` of each key: one shuffle, one sorted pass, constant memory.

    `block` gets the state before its first row and the rows sorted by `step`, and returns the state after its last row
    with one output row per input row. It is called once per key and Arrow batch, and the state is carried from batch to
    batch, so a block must not depend on where a key is cut. `start` is a list of numbers or makes a fresh state. The result has the
    key, `step`, `keep` and `fields` columns. States that can be composed are better served by `clamped_scan`.
    """
    keys, keep = list(keys), list(keep)
    schema = T.StructType([*(df.schema[c] for c in [*keys, step, *keep]), *fields])
    names = [f.name for f in schema]
    fresh = start if callable(start) else lambda: np.array(start, dtype=np.float64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, None
        for pdf in batches:
            if pdf.empty:
                continue
            k = pdf[keys]
            before = k.shift()
            cut = ~((k == before) | (k.isna() & before.isna())).all(axis=1).to_numpy()
            cut[0] = True
            places = [*np.flatnonzero(cut), len(pdf)]
            for a, b in zip(places, places[1:]):
                part = pdf.iloc[a:b].reset_index(drop=True)
                name = tuple(None if pd.isna(v) else v for v in part.loc[0, keys])
                if name != now:
                    now, state = name, fresh()
                state, out = block(state, part)
                yield pd.concat([part[[*keys, step, *keep]], out.reset_index(drop=True)], axis=1)[names]

    # Dealt by an expression of its own: a plain repartition is dropped after a join by the same keys, and a skewed join splits a key.
    return df.repartition(F.xxhash64(*keys)).sortWithinPartitions(*keys, step).mapInPandas(run, schema)


def _stepped(x: Column, y: Column, low: Column, high: Column, v: Column) -> Column:
    """min(high, max(low, x * v + y)); a slope of 0 forgets an infinite v."""
    return F.least(high, F.greatest(low, F.when(x == 0, y).otherwise(x * v + y)))


def _then(first: Column, second: Column, names: Sequence[str]) -> Column:
    """The maps (a, b, low, high) of `first` followed by those of `second`, by name."""
    def one(n: str) -> Column:
        f, g = first[n], second[n]
        past = lambda v: _stepped(g["a"], g["b"], g["low"], g["high"], v)
        return F.struct((g["a"] * f["a"]).alias("a"), (g["a"] * f["b"] + g["b"]).alias("b"), past(f["low"]).alias("low"), past(f["high"]).alias("high")).alias(n)

    return F.struct(*[one(n) for n in names])


def _applied(maps: Column, values: Column, names: Sequence[str]) -> Column:
    return F.struct(*[_stepped(maps[n]["a"], maps[n]["b"], maps[n]["low"], maps[n]["high"], values[n]).alias(n) for n in names])


def clamped_scan(
    df: DataFrame,
    keys: Sequence[str],
    step: str,
    maps: Mapping[str, tuple[Column, Column, float, float, float]],
    keep: Sequence[str] = (),
    chunk: int = SCAN_ROWS,
) -> DataFrame:
    """Running values `v = min(high, max(low, slope * v + shift))` along `step` of each key, for keys of any length.

    maps: name -> (slope >= 0, shift, low, high, start). Such maps compose to one of their kind, so steps are gathered into chunks of `chunk` steps and each
    is reduced to one map; up to `RUN_CHUNKS` chunks form a run, inside which the maps of earlier chunks are composed by a window; the
    few runs of a key give each run its exact start. All of it stays in the JVM, with one shuffle of the rows, by run; no task holds more than a run.
    """
    keys, keep, names = list(keys), list(keep), list(maps)
    free = float("inf")
    low, high, start = ({n: float(maps[n][i]) for n in names} for i in (2, 3, 4))
    # A row carries slope and shift only; the bounds are the same in all rows.
    maps_of = [c.cast("double").alias(f"_{ab}{i}") for i, n in enumerate(names) for ab, c in zip("ab", maps[n])]

    def map_of(r: Column) -> Column:
        return F.struct(*[F.struct(r[f"_a{i}"].alias("a"), r[f"_b{i}"].alias("b"), F.lit(low[n]).alias("low"), F.lit(high[n]).alias("high")).alias(n) for i, n in enumerate(names)])

    nothing = F.struct(*[F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b"), F.lit(-free).alias("low"), F.lit(free).alias("high")).alias(n) for n in names])
    initial = F.struct(*[F.lit(start[n]).alias(n) for n in names])
    place = F.floor(F.col(step) / chunk).cast("long")
    rows = df.select(*keys, F.floor(place / min(chunk, RUN_CHUNKS)).cast("long").alias("_run"), place.alias("_chunk"), F.struct(step, *keep, *maps_of).alias("_row"))
    # One shuffle serves the chunks and the window over them.
    chunks = rows.repartition(*keys, "_run").groupBy(*keys, "_run", "_chunk").agg(F.sort_array(F.collect_list("_row")).alias("_rows"))
    own = chunks.withColumn("_own", F.aggregate("_rows", nothing, lambda m, r: _then(m, map_of(r), names)))
    before = Window.partitionBy(*keys, "_run").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    led = own.withColumn("_led", F.aggregate(F.collect_list("_own").over(before), nothing, lambda m, c: _then(m, c, names)))
    runs = led.groupBy(*keys, "_run").agg(F.max_by(_then(F.col("_led"), F.col("_own"), names), "_chunk").alias("_all")) \
        .groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_run", "_all"))).alias("_runs"))
    ahead = F.aggregate("_runs", F.struct(initial.alias("v"), F.array().cast(f"array<struct<_run:bigint,_first:struct<{','.join(f'`{n}`:double' for n in names)}>>>").alias("out")),
                        lambda s, r: F.struct(_applied(r["_all"], s["v"], names).alias("v"), F.array_append(s["out"], F.struct(r["_run"].alias("_run"), s["v"].alias("_first"))).alias("out")))
    starts = runs.select(*keys, F.explode(ahead["out"]).alias("_s")).select(*keys, "_s.*")
    both = led.join(starts, [*keys, "_run"])
    values = F.aggregate("_rows", F.struct(_applied(F.col("_led"), F.col("_first"), names).alias("v"), F.array().cast(
        f"array<struct<{','.join(f'`{n}`:double' for n in names)}>>").alias("out")), lambda s, r: _follow(s, map_of(r), names), lambda s: s["out"])
    each = both.select(*keys, F.explode(F.arrays_zip(F.col("_rows").alias("r"), values.alias("v"))).alias("_z"))
    return each.select(*keys, *[F.col(f"_z.r.{c}").alias(c) for c in [step, *keep]], *[F.col(f"_z.v.{n}").alias(n) for n in names])


def _follow(s: Column, maps: Column, names: Sequence[str]) -> Column:
    v = _applied(maps, s["v"], names)
    return F.struct(v.alias("v"), F.array_append(s["out"], v).alias("out"))


def bounded_windows(
    df: DataFrame,
    keys: Sequence[str],
    step: str,
    reach: int,
    columns: Callable[[WindowSpec], Mapping[str, Column]],
    rows: int | None = None,
    ahead: int = 0,
) -> DataFrame:
    """Window columns whose frame reaches at most `reach` rows back and `ahead` rows forward.

    `step` numbers the rows of a key without gaps. Keys too long for one task are cut into chunks, and
    each chunk also gets the neighbouring rows its frames can see.
    """
    keys = list(keys)
    size = max(min(single_task_rows(df.sparkSession), WINDOW_ROWS), 4 * (reach + ahead + 1))
    if (largest_group(df, keys) if rows is None else rows) <= size:
        over = Window.partitionBy(*keys).orderBy(step)
        return df.select("*", *[c.alias(n) for n, c in columns(over).items()])
    s = F.col(step)
    seen = F.array_distinct(F.array(
        F.floor(F.greatest(s - ahead, F.lit(0)) / size), F.floor(s / size), F.floor((s + reach) / size)))
    spread = df.withColumn("_chunk", F.explode(seen))
    over = Window.partitionBy(*keys, "_chunk").orderBy(step)
    out = spread.select("*", *[c.alias(n) for n, c in columns(over).items()])
    return out.where(F.col("_chunk") == F.floor(s / size)).drop("_chunk")


def islands(df: DataFrame, keys: Sequence[str], step: str, flag: Column, rows: int | None = None) -> DataFrame:
    """Rows where `flag` holds, with `island`, equal for rows of one unbroken run."""
    quiet = running_totals(df.withColumn("_on", flag), keys, [F.col(step)],
                           {"island": (~F.col("_on")).cast("long")}, rows)
    return quiet.where(F.col("_on")).drop("_on")

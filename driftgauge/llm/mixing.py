"""Mixing sources to target weights by capped water-filling, with DataFrame functions only.

Shares: a budget of words is split by weight; a source stops at `epochs` times its size and its excess goes to the
others by weight. With sources ordered by cap / weight, the water level is the largest of
(budget - caps before) / (weights from here on), so one window over the sources replaces the rounds.

Repetitions: every document is taken floor(target / source size) times; one fractional repetition follows in the order of a
seeded digest of doc_id until the target is met. Digest buckets are summed first, so only the bucket in which the
target falls is ordered, never a whole source.

Defined cases: a null text has no words; a null source is a source, ordered last; a null doc_id has a digest of its own;
rows with one digest at the target share what is left by size; no words at all: targets of 0; extra columns pass
through (names that start with `mix_` are replaced).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftgauge.llm.common import WORD, shielded
from driftgauge.session import settled

#: Most sources whose plan is sent to every task; with more, documents are joined by a shuffle.
BROADCAST_SOURCES = 10_000
BUCKETS = 1024


def words(text: Column | str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def digest(seed: int, doc_id: str = "doc_id") -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))))


def bucket(key: Column) -> Column:
    """Buckets follow the order of the digests."""
    return F.floor(F.conv(F.substring(key, 1, 4), 16, 10).cast("int") / (65536 // BUCKETS)).cast("int")


def source_targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, epochs: float = 2.0) -> DataFrame:
    """(mix_source, mix_source_size) to targets: the window runs over one row per source, not over documents."""
    by_name = Window.orderBy(F.col("mix_source").asc_nulls_last())
    by_level = Window.orderBy((F.col("cap") / F.col("weight")), F.col("mix_source").asc_nulls_last())
    everything = Window.partitionBy()
    nth = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (nth + 1).cast("int"))
    ranked = sizes.withColumn("weight", weight).withColumn("cap", epochs * F.col("mix_source_size"))
    level = ((share * F.sum("mix_source_size").over(everything)
              - F.coalesce(F.sum("cap").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
             / F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing)))
    return (ranked.withColumn("level", level)
            .withColumn("mix_target", F.least(F.col("cap"), F.max("level").over(everything) * F.col("weight")))
            .select("mix_source", "mix_source_size", "mix_target"))


def _spread(docs: DataFrame, plan: DataFrame, few: bool) -> DataFrame:
    return docs.join(F.broadcast(plan) if few else plan, docs["mix_source"].eqNullSafe(plan["mix_plan_source"]), "left").drop("mix_plan_source")


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, epochs: float = 2.0,
        seed: int = 9, whole: bool = False) -> DataFrame:
    """Every document with mix_size, mix_source_size, mix_target, mix_taken (words taken, repetitions counted) and mix_copies (how often it appears).

    whole: the document at the target is taken as a whole or not, whichever is nearer, so mix_taken is a multiple of mix_size.
    """
    docs, own = shielded(docs, ("doc_id", "text", "source"), [c for c in docs.columns if c.lower().startswith("mix_")])
    keyed = docs.withColumns({"mix_source": F.col("source"), "mix_key": digest(seed)})
    sums = settled(keyed.select("mix_source", bucket(F.col("mix_key")).alias("mix_bucket"), words("text").alias("mix_size"))
                   .groupBy("mix_source", "mix_bucket").agg(F.sum("mix_size").alias("words")))
    targets = source_targets(sums.groupBy("mix_source").agg(F.sum("words").alias("mix_source_size")), weights, share, epochs)
    # At most `epochs` repetitions; what is left of the target is one further, fractional repetition.
    times = F.when(F.col("mix_source_size") > 0, F.floor(F.col("mix_target") / F.col("mix_source_size"))).otherwise(0).cast("long")
    need = F.round("mix_target").cast("long") - F.col("mix_times") * F.col("mix_source_size")
    targets = targets.withColumn("mix_times", times).withColumn("mix_need", need)
    named = targets.select(F.col("mix_source").alias("mix_plan_source"), *[c for c in targets.columns if c != "mix_source"])
    run = Window.partitionBy("mix_source").orderBy("mix_bucket")
    edges = (_spread(sums, named, False)
             .withColumn("upto", F.sum("words").over(run))
             .filter((F.col("upto") >= F.col("mix_need")) & (F.col("upto") - F.col("words") < F.col("mix_need")))
             .select("mix_source", "mix_bucket", (F.col("mix_need") - F.col("upto") + F.col("words")).alias("mix_left")))
    plan = settled(targets.join(edges, targets["mix_source"].eqNullSafe(edges["mix_source"]), "left")
                   .select(targets["mix_source"].alias("mix_plan_source"), "mix_source_size", "mix_target", "mix_times",
                           F.col("mix_bucket").alias("mix_edge"), "mix_left"))
    few = plan.count() <= BROADCAST_SOURCES
    # Rows of the bucket in which the target falls, in order.
    inside = (_spread(keyed.select("mix_source", "mix_key", "text"), plan.select("mix_plan_source", "mix_edge", "mix_left"), few)
              .filter(bucket(F.col("mix_key")) == F.col("mix_edge"))
              .groupBy("mix_source", "mix_key", "mix_left").agg(F.sum(words("text")).alias("tied")))
    order = Window.partitionBy("mix_source").orderBy("mix_key")
    at = (inside.withColumn("upto", F.sum("tied").over(order))
          .filter((F.col("upto") >= F.col("mix_left")) & (F.col("upto") - F.col("tied") < F.col("mix_left")))
          .select(F.col("mix_source").alias("at_source"), F.col("mix_key").alias("at_key"), F.col("tied").alias("at_tied"),
                  (F.col("mix_left") - F.col("upto") + F.col("tied")).alias("at_left")))
    plan = settled(plan.join(at, plan["mix_plan_source"].eqNullSafe(at["at_source"]), "left").drop("at_source", "mix_edge", "mix_left"))
    rows = _spread(keyed.withColumn("mix_size", words("text")), plan, few)
    part = F.when(F.lit(whole), F.when(2 * F.col("at_left") >= F.col("at_tied"), F.col("mix_size")).otherwise(0)) \
        .otherwise(F.least(F.col("mix_size"), F.floor(F.col("at_left") * F.col("mix_size") / F.col("at_tied"))))
    extra = F.when(F.col("mix_key") < F.col("at_key"), F.col("mix_size")).when(F.col("mix_key") == F.col("at_key"), part).otherwise(0)
    once_more = F.when((F.col("mix_key") < F.col("at_key")) | ((F.col("mix_key") == F.col("at_key")) & (part > 0)), 1).otherwise(0)
    return rows.withColumns({"mix_taken": (F.col("mix_times") * F.col("mix_size") + extra).cast("long"),
                             "mix_copies": (F.col("mix_times") + once_more).cast("int")}) \
        .select(*own, "mix_size", "mix_source_size", "mix_target", "mix_taken", "mix_copies")

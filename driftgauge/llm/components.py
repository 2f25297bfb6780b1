"""Connected components by alternating stars, with minima and joins only.

Each round points every vertex at the smallest vertex it knows: first for larger neighbours, then for smaller ones. Groups are only ever reduced
by a minimum, which is summed before the shuffle, so a hub with a third of all links is no single task's work. Rounds end when no link changes; links of
each round go to the checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftgauge.session import settled


def _star(links: DataFrame, large: bool) -> DataFrame:
    """links (a > b). large: neighbours above a vertex move to its minimum; small: neighbours below it do."""
    both = links.select(F.col("a").alias("v"), F.col("b").alias("w"))
    if large:
        both = both.union(links.select(F.col("b"), F.col("a")))
    least = both.groupBy("v").agg(F.min("w").alias("least")).withColumn("least", F.least("least", "v"))
    moved = both.join(least, "v")
    if large:
        moved = moved.filter(F.col("w") > F.col("v")).select(F.col("w").alias("a"), F.col("least").alias("b"))
    else:
        moved = moved.select(F.col("w").alias("a"), F.col("least").alias("b")).union(least.select(F.col("v"), F.col("least")))
    return moved.filter(F.col("a") > F.col("b")).groupBy("a", "b").agg(F.lit(1).alias("_")).drop("_")


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(a, b) links between long ids -> (id, component_id) of every id in a link between two different ids; component_id is the smallest id."""
    links = settled(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter(F.col("a") > F.col("b")))
    seen = None
    for _ in range(rounds):
        links = settled(_star(_star(links, True), False))
        now = tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == seen:
            return links.select(F.col("a").alias("id"), F.col("b").alias("component_id")) \
                .union(links.select(F.col("b"), F.col("b")).distinct())
        seen = now
    raise RuntimeError(f"components are not stable after {rounds} rounds")

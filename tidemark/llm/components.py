"""Connected components of links by alternating large-star and small-star steps, as joins over tables.

No link, component or neighbour list is collected: a step takes each node's least neighbour by an aggregate and joins
it back to the links, whose skewed keys Spark can split. Every step's links are a written table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import discard, materialise, settle


def _step(links: DataFrame, large: bool) -> DataFrame:
    """links: (a, b) with a > b. large: neighbours above a node go to the least around it; else those below, and itself."""
    if large:
        around = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = around.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        moved = around.filter(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = links.groupBy("a").agg(F.min("b").alias("m"))
        moved = links.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return moved.filter(F.col("a") != F.col("b")).distinct()


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of every node that has a link, from links (a, b) of longs, as a table; component is the least node."""
    return settle("components", lambda: _components(links, rounds))


def _components(links: DataFrame, rounds: int) -> DataFrame:
    now = links.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now, sign = materialise(now.distinct(), "links"), None
    for _ in range(rounds):
        after = materialise(_step(_step(now, True), False), "links")
        discard(now)
        now = after
        found = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if found == sign:
            break
        sign = found
    else:
        raise RuntimeError(f"no stable components after {rounds} rounds")
    stars = now.unionByName(now.select(F.col("b").alias("a"), "b")).distinct()
    return stars.select(F.col("a").alias("node"), F.col("b").alias("component"))

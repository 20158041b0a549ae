"""Measures of extraction and retrieval: means, nearest-rank percentiles, top hits, the best provider."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .ordered import ranked, running


def micro_and_macro(rows: DataFrame) -> DataFrame:
    """One row (micro, macro, n_cases) of rows (category, value): the mean, and the mean of the categories' means."""
    c = rows.groupBy("category").agg(F.sum("value").alias("s"), F.count("value").alias("n"), F.count(F.lit(1)).alias("all"))
    return c.agg(F.round(F.sum("s") / F.sum("n"), 9).alias("micro"), F.round(F.avg(F.col("s") / F.col("n")), 9).alias("macro"), F.sum("all").alias("n_cases"))


def nearest_ranks(rows: DataFrame, key: str, shares: dict[str, float]) -> DataFrame:
    """Values at index round((n - 1) * share), half to even, of each key's sorted values.

    Equal values are counted first, and counts are summed up in ranges of values, so that a key may hold most rows.
    """
    counted = rows.filter(F.col("value").isNotNull()).groupBy(key, "value").agg(F.count(F.lit(1)).alias("c"))
    n = counted.groupBy(F.col(key).alias("__key")).agg(F.sum("c").alias("n"))
    upto = running(ranked(counted, key, "value", "value"), key, "c", "upto").join(n, F.col(key).eqNullSafe(F.col("__key")))
    at = lambda s: F.min(F.when(F.col("upto") > F.bround((F.col("n") - 1) * s), F.col("value")))
    return upto.groupBy(key).agg(*[at(s).alias(name) for name, s in shares.items()])


def top_hits(results: DataFrame, ks: list[int]) -> DataFrame:
    """How many expected rows are among the first k of each query."""
    return results.groupBy("query").agg(*[F.count_if((F.col("rank") <= k) & F.col("expected")).alias(f"top{k}") for k in ks])


def best_provider(rows: DataFrame) -> DataFrame:
    """The provider of least macro mean of rows (provider, category, value)."""
    c = rows.groupBy("provider", "category").agg(F.avg("value").alias("v"))
    m = c.groupBy("provider").agg(F.round(F.avg("v"), 6).alias("macro"))
    return m.orderBy("macro", "provider").limit(1)


def eligible(providers: DataFrame, p95: float = 5.0, memory: float = 0.92) -> DataFrame:
    """Providers without errors whose latency and share of memory are within limits."""
    return providers.filter((F.col("errors") == 0) & (F.col("p95") <= p95) & (F.col("peak_memory") <= memory * F.col("total_memory")))

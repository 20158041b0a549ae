"""An inverted index of trigrams: candidates of a search without a scan of all texts, kept up by appends and deletions.

The index is a table (bucket, gram, id), partitioned by a hash of the gram, so that a search reads the buckets of its own
grams alone; a row a text and gram. Candidates hold all grams of a token and are then tested on their texts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..sources.sinks import rewrite

BUCKETS = 64


def _bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


def grams(ev: DataFrame, text: str = "ocr_text") -> DataFrame:
    """(bucket, gram, id): the distinct trigrams of each text in lower case."""
    # As an array of characters, since a place in a string is found from its start anew each time.
    chars = F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), "(?s)(?<=.)")
    gram = lambda c, i: F.concat(c, F.get("c", i + 1), F.get("c", i + 2))
    three = F.filter(F.transform("c", gram), lambda g: g.isNotNull() & (F.length(g) == 3))
    each = ev.select("id", chars.alias("c")).select("id", F.explode(F.array_distinct(three)).alias("gram"))
    return each.select(_bucket(F.col("gram")).alias("bucket"), "gram", "id")


def build(ev: DataFrame, path: str) -> None:
    """The whole index anew; readers see the old one until it stands."""
    grams(ev).repartition("bucket").sortWithinPartitions("bucket", "gram", "id").write.mode("overwrite").partitionBy("bucket").parquet(path)


def add(ev: DataFrame, path: str) -> None:
    """New events' grams are appended, a file a bucket."""
    grams(ev).repartition("bucket").sortWithinPartitions("bucket", "gram", "id").write.mode("append").partitionBy("bucket").parquet(path)


def remove(spark: SparkSession, ids: DataFrame, path: str) -> None:
    """The index without some ids; an update of a text is a removal and an addition."""
    rewrite(read(spark, path).join(ids.select("id"), "id", "left_anti").select("bucket", "gram", "id"), path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def candidates(index: DataFrame, tokens: list[str]) -> DataFrame:
    """(id) of texts that hold all trigrams of one of the tokens, which have three characters or more."""
    parts = []
    for token in dict.fromkeys(t.lower() for t in tokens if len(t) >= 3):
        own = sorted({token[i : i + 3] for i in range(len(token) - 2)})
        mine = index.filter(F.col("bucket").isin([b[0] for b in _buckets(index.sparkSession, own)]) & F.col("gram").isin(own))
        parts.append(mine.groupBy("id").agg(F.count_distinct("gram").alias("n")).filter(F.col("n") == len(own)).select("id"))
    return reduce(DataFrame.unionByName, parts).distinct() if parts else index.select("id").limit(0)


def _buckets(spark: SparkSession, own: list[str]) -> list:
    """The buckets of some grams, so that the filter is on literals and folders are left out when the plan is made."""
    return spark.createDataFrame([(g,) for g in own], "gram string").select(_bucket(F.col("gram"))).distinct().collect()


def holding(ev: DataFrame, index: DataFrame, tokens: list[str]) -> DataFrame:
    """Events that hold one of the tokens: candidates of the index, tested on their texts."""
    from .search import match_any

    return match_any(ev.join(candidates(index, tokens), "id", "left_semi"), tokens)

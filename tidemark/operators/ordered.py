"""Rows in order within a key, without a key's rows ever meeting in one task: ranks, neighbours and running sums.

A key may hold any share of all rows. Its rows are cut into ranges of time, which windows run over; what lies between
ranges comes from a table of one row a range.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: Rows that a window holds together, about.
ROWS = 50_000


def time_range(df: DataFrame, at: str, rows: int = ROWS) -> Column:
    """The number of a row's range of ``at``, which grows with it: between quantiles, about ``rows`` rows each."""
    value = F.col(at).cast("double") if dict(df.dtypes)[at] not in ("timestamp", "timestamp_ntz") else F.unix_micros(F.col(at).cast("timestamp")).cast("double")
    parts = min(1000, math.ceil(df.count() / rows))
    if parts < 2:
        return F.lit(0)
    found = df.select(value.alias("v")).agg(F.percentile_approx("v", [i / parts for i in range(1, parts)], 20_000)).first()[0]
    edges = F.array(*[F.lit(float(e)) for e in sorted(set(found or []))])

    def halve(a: Column, _: Column) -> Column:  # edges before lo are below the value, those from hi on aren't
        middle = F.floor((a["lo"] + a["hi"]) / 2).cast("int")
        below = F.get(edges, middle) < value
        open_ = a["lo"] < a["hi"]
        return F.struct(F.when(open_ & below, middle + 1).otherwise(a["lo"]).alias("lo"), F.when(open_ & ~below, middle).otherwise(a["hi"]).alias("hi"))

    steps = F.sequence(F.lit(1), F.lit(math.ceil(math.log2(parts + 1)) + 1))
    return F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.size(edges).alias("hi")), halve)["lo"]


def ranked(df: DataFrame, key: str, at: str, tie: str, rows: int = ROWS) -> DataFrame:
    """df with ``nth``, 1 for a key's first row by at, then tie."""
    d = df.withColumn("__range", time_range(df, at, rows))
    sizes = d.groupBy(key, "__range").agg(F.count(F.lit(1)).alias("__n"))
    before = W.partitionBy(key).orderBy("__range").rowsBetween(W.unboundedPreceding, -1)  # a row a range
    starts = sizes.select(F.col(key).alias("__key"), F.col("__range").alias("__of"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    local = d.withColumn("nth", F.row_number().over(W.partitionBy(key, "__range").orderBy(at, tie)))
    both = local.join(starts, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__range") == F.col("__of")))
    return both.withColumn("nth", (F.col("nth") + F.col("__before")).cast("long")).drop("__range", "__key", "__of", "__before")


def beside(df: DataFrame, key: str, at: str, tie: str, columns: dict, before: int = 1, after: int = 0, rows: int = ROWS) -> DataFrame:
    """df with nth and columns, each made by a function of the key's window by order, which may look at ``before`` rows and ``after`` rows around.

    Rows are cut by rank into blocks; those at a block's ends go to its neighbours too.
    """
    d = ranked(df, key, at, tie, rows)
    place, block = (F.col("nth") - 1) % rows, F.floor((F.col("nth") - 1) / rows)
    also = F.array(block, F.when(place < after, block - 1), F.when(place >= rows - before, block + 1))
    dealt = d.withColumn("__block", F.explode(F.filter(also, lambda b: b.isNotNull())))
    window = W.partitionBy(key, "__block").orderBy("nth")
    made = dealt.withColumns({name: make(window) for name, make in columns.items()})
    return made.filter(F.col("__block") == block).drop("__block")


def running(df: DataFrame, key: str, value: str, out: str, rows: int = ROWS) -> DataFrame:
    """df with nth, and in ``out`` the sum of value up to each row."""
    d = df.withColumn("__block", F.floor((F.col("nth") - 1) / rows))
    sums = d.groupBy(key, "__block").agg(F.sum(value).alias("__sum"))
    before = W.partitionBy(key).orderBy("__block").rowsBetween(W.unboundedPreceding, -1)  # a row a block
    starts = sums.select(F.col(key).alias("__key"), F.col("__block").alias("__of"), F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__before"))
    local = d.withColumn(out, F.sum(value).over(W.partitionBy(key, "__block").orderBy("nth").rowsBetween(W.unboundedPreceding, 0)))
    both = local.join(starts, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__block") == F.col("__of")))
    return both.withColumn(out, F.col(out) + F.col("__before")).drop("__block", "__key", "__of", "__before")

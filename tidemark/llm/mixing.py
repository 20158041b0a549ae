"""Mixing sources to target weights by repetition rates.

Sizes are words. The sources, in code point order with null last, have weights 1, 2, 3, repeating. A source's target is
its weight's share of all words, at most ``cap`` times its own words; what a cap leaves over goes to the others by
weight. A source's rate is its target over its words, and a document is taken floor(rate) times, plus once more where
a uniform number hashed from seed and doc_id is below the fraction. So a rerun takes the same copies.

Null or blank text: size 0, taken 0. Null doc_id: drawn by the text's hash. Repeated rows: each is drawn, with equal
outcome. Sources of one weight and size: the first by code point is capped first. A source without words has target 0
and rate 0. An empty table gives an empty result. Whole texts of any length are counted. Other columns, of any name, stay
in mix() and are ignored elsewhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import guarded

WORD = r"[^\x20\x09-\x0D]+"
SEED, CAP, CYCLE = "mix-1", 3, 3
#: A target table of more sources than this is joined without a broadcast hint.
BROADCAST_SOURCES = 100_000
SIZE, COPIES = "__mix_size", "__mix_copies"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, cap: int = CAP, cycle: int = CYCLE) -> DataFrame:
    """(source, source_size, target, rate), one row a source, from rows (source, size).

    Water filling in closed form: by ascending cap to weight the capped sources come first, so each one's level is what
    the sources before it leave, and the first uncapped one fixes the level of the rest. Windows run over sources only.
    """
    s = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("w", (F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1) % cycle + 1)
    every = W.partitionBy()
    before = W.orderBy(cap * F.col("source_size").cast("double") / F.col("w"), F.col("source").asc_nulls_last())
    before = before.rowsBetween(W.unboundedPreceding, -1)
    s = s.select(
        "*",
        (F.sum("source_size").over(every) - cap * F.coalesce(F.sum("source_size").over(before), F.lit(0))).alias("left"),
        (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0))).alias("left_w"),
    )
    full = F.col("w") * F.col("left") > cap * F.col("source_size") * F.col("left_w")
    s = s.withColumn("full", full)
    open_size = F.sum("source_size").over(every) - cap * F.coalesce(F.sum(F.when(F.col("full"), F.col("source_size"))).over(every), F.lit(0))
    open_w = F.sum("w").over(every) - F.coalesce(F.sum(F.when(F.col("full"), F.col("w"))).over(every), F.lit(0))
    target = F.when(F.col("full") | (F.col("source_size") == 0), (cap * F.col("source_size")).cast("double")).otherwise(
        (F.col("w") * open_size).cast("double") / open_w.cast("double")
    )
    s = s.select("source", "source_size", target.alias("target"))
    return s.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))


def uniform(doc_id: Column, text: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) from 52 bits of the md5 of seed and id, or text where there is no id."""
    hashed = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), text, F.lit("")))
    return F.conv(F.substring(F.md5(hashed.cast("binary")), 1, 13), 16, 10).cast("double") / float(1 << 52)


def plan_copies(docs: DataFrame, seed: str = SEED, cap: int = CAP) -> tuple[DataFrame, DataFrame]:
    """docs with SIZE and COPIES added, and the source table. Texts aren't shuffled unless sources are very many."""
    sized = docs.withColumn(SIZE, n_words(F.col("text")))
    targets = source_targets(sized.select("source", F.col(SIZE).alias("size")), cap)
    t = targets.select(F.col("source").alias("__mix_source"), "source_size", "target", F.col("rate").alias("__mix_rate"))
    t = t.select("__mix_source", F.col("source_size").alias("__mix_source_size"), F.col("target").alias("__mix_target"), "__mix_rate")
    if docs.select("source").distinct().limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        t = F.broadcast(t)
    rate = F.col("__mix_rate")
    out = sized.join(t, F.col("source").eqNullSafe(F.col("__mix_source")), "left").drop("__mix_source")
    extra = (uniform(F.col("doc_id"), F.col("text"), seed) < rate - F.floor(rate)).cast("long")
    return out.withColumn(COPIES, F.floor(rate).cast("long") + extra), targets


def mix(docs: DataFrame, seed: str = SEED, cap: int = CAP) -> DataFrame:
    """The mix itself: every document as often as it is taken, with the columns of docs."""
    return guarded(docs, lambda d: _mix(d, seed, cap))


def _mix(docs: DataFrame, seed: str, cap: int) -> DataFrame:
    planned, _ = plan_copies(docs, seed, cap)
    times = F.explode(F.sequence(F.lit(1), F.col(COPIES).cast("int"))).alias("__mix_nth")
    return planned.filter(F.col(COPIES) > 0).select(*docs.columns, times).drop("__mix_nth")


def mixed_sizes(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken of each document."""
    planned, _ = plan_copies(docs.select("doc_id", "source", "text"))
    return planned.select(
        "doc_id",
        F.col(SIZE).alias("size"),
        F.col("__mix_source_size").alias("source_size"),
        F.col("__mix_target").alias("target"),
        (F.col(SIZE) * F.col(COPIES)).alias("taken"),
    )


ORACLE = r"""
WITH d AS (SELECT doc_id, source, text, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS w FROM s),
l AS (SELECT *, (sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER b, 0))::BIGINT AS rest,
        (sum(w) OVER () - coalesce(sum(w) OVER b, 0))::BIGINT AS rest_w
      FROM w WINDOW b AS (ORDER BY 3 * source_size::DOUBLE / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, w * rest > 3 * source_size * rest_w AS hit FROM l),
t AS (SELECT source, source_size, CASE WHEN hit OR source_size = 0 THEN (3 * source_size)::DOUBLE ELSE
        (w * (sum(source_size) OVER () - 3 * coalesce(sum(CASE WHEN hit THEN source_size END) OVER (), 0)))::DOUBLE
        / (sum(w) OVER () - coalesce(sum(CASE WHEN hit THEN w END) OVER (), 0))::DOUBLE END AS target FROM f),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target,
        CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
        ('0x' || substr(md5('mix-1:' || coalesce(d.doc_id::VARCHAR, d.text, '')), 1, 13))::BIGINT / 4503599627370496.0 AS u
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM r
"""

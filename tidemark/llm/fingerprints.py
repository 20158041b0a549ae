"""Document fingerprints: threshold-scaled sketches of word shingles, in DataFrame functions alone.

A text's sketch keeps every hash of its five-word shingles that is below FRACTION of the hash range, so sketches of
very unequal texts stay comparable: their union is the sketch of both texts (merged()), and the share of one in the
other estimates containment(). The smallest hash always stays, so that a short text has a sketch too. A text of fewer
than five words is one shingle; one without words has an empty sketch.

Null text: taken as empty. Null doc_id: first in order. Rows with one doc_id, or none, and different texts: in the order
of their texts' 64-bit hashes. Repeated rows: one after the other, each but the last followed by its copy. The likeness
of two empty sketches is 1, of an empty and another 0. A table of one row is its own next document. An empty table gives
an empty result. Whole texts of any length are used; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import document_keys

SPACE = r"[\x20\x09-\x0D]+"
SHINGLE, FRACTION = 5, 1 / 4
#: Rows of a bucket of the order of doc_id, which a window holds in memory, and the most quantiles that part them.
BUCKET_ROWS, BUCKETS = 300, 1000
#: Tables of a row of 24 bytes a bucket, or a hot id, go to all executors up to this many rows, beyond by a shuffle.
BROADCAST_ROWS = 500_000
BLOCK = 1000
FIRST = 1 - (1 << 63)  # key of a null doc_id


def _let(value: Column, body) -> Column:
    """body of a value that is computed once."""
    return F.transform(F.array(value), body).getItem(0)


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def sketch(text: Column, fraction: float = FRACTION, k: int = SHINGLE) -> Column:
    """The sorted hashes that a text's sketch keeps."""
    limit = F.lit(-(1 << 63) + int(fraction * (1 << 64)))

    def shingles(w: Column) -> Column:
        many = F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)]))
        return F.when(F.size(w) == 0, F.array().cast("array<bigint>")).when(F.size(w) < k, F.array(F.xxhash64(F.array_join(w, " ")))).otherwise(many)

    def keep(h: Column) -> Column:
        return _let(F.filter(h, lambda x: x < limit), lambda low: F.when((F.size(low) == 0) & (F.size(h) > 0), F.array(F.array_min(h))).otherwise(F.sort_array(F.array_distinct(low))))

    return _let(words(text), lambda w: _let(shingles(w), keep))


def merged(a: Column, b: Column) -> Column:
    """The sketch of two texts together."""
    return F.sort_array(F.array_union(a, b))


def containment(a: Column, b: Column) -> Column:
    """The share of a's shingles that b has too; 0 where a has none."""
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a)).otherwise(0.0)


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two texts' shingles."""
    return F.when(F.size(a) + F.size(b) == 0, 1.0).otherwise(_let(F.size(F.array_intersect(a, b)), lambda i: i / (F.size(a) + F.size(b) - i)))


def written(s: Column) -> Column:
    """A sketch as a string: 12 hex digits, the upper 48 bits, of each hash."""
    return F.array_join(F.transform(s, lambda h: F.lpad(F.hex(F.shiftrightunsigned(h.bitwiseXOR(F.lit(-(1 << 63))), 16)), 12, "0")), "")


def _bucket(d: DataFrame, n: int) -> tuple[Column, int]:
    """A number that grows with key, of about BUCKET_ROWS rows: the range between two quantiles, cut evenly where they are too many; and a bound of it."""
    low, high = d.agg(F.min("key"), F.max("key")).first()
    wanted = math.ceil(n / BUCKET_ROWS)
    if wanted < 2 or low is None or low == high:
        return F.lit(0).cast("long"), 1
    parts = min(wanted, BUCKETS)
    found = d.agg(F.percentile_approx("key", [i / parts for i in range(1, parts)], 20_000)).first()[0]
    inner = sorted({b for b in found if low <= b < high})
    edges, key = F.array(*[F.lit(b).cast("long") for b in [low - 1, *inner, high]]), F.col("key")

    def halve(a: Column, _: Column) -> Column:  # the edges up to a.lo are below key, those from a.hi on aren't
        middle = F.floor((a["lo"] + a["hi"]) / 2).cast("int")
        below = F.get(edges, middle) < key
        return F.struct(F.when(below, middle).otherwise(a["lo"]).alias("lo"), F.when(below, a["hi"]).otherwise(middle).alias("hi"))

    steps = F.sequence(F.lit(1), F.lit(max(1, math.ceil(math.log2(len(inner) + 2)))))
    at = F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.lit(len(inner) + 1).alias("hi")), halve)["lo"]
    cuts = math.ceil(wanted / parts)

    def number(i: Column) -> Column:
        wide = "decimal(20,0)"  # a difference of two ids may be beyond a long
        start, end = F.get(edges, i).cast(wide), F.get(edges, i + 1).cast(wide)
        share = F.floor((key.cast(wide) - start - 1).cast("double") * cuts / (end - start).cast("double")).cast("long")
        return i.cast("long") * cuts + F.least(share, F.lit(cuts - 1).cast("long"))

    return _let(at, number), (len(inner) + 1) * cuts


def _small(rows: DataFrame, bound: int) -> DataFrame:
    return F.broadcast(rows) if bound <= BROADCAST_ROWS else rows


def _placed(docs: DataFrame) -> tuple[DataFrame, int]:
    """doc_id, text, key and bucket, and a bound of the number of buckets.

    Copies of a document that are more than a bucket should hold are dealt to buckets of their own, numbered below 0:
    each is followed by another copy, so those need no neighbours.
    """
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    d = document_keys(texts, F.coalesce(F.col("doc_id").cast("long"), F.lit(FIRST)), "key")
    n = d.count()
    number, bound = _bucket(d, n)
    hot = d.groupBy("key").count().filter(F.col("count") > 2 * BUCKET_ROWS).select("key", F.ceil(F.col("count") / BUCKET_ROWS).alias("lots"))
    if hot.isEmpty():
        return d.withColumn("bucket", number), bound
    d = d.join(_small(hot, n // (2 * BUCKET_ROWS)), "key", "left").withColumn("lot", F.floor(F.rand(7) * F.coalesce("lots", F.lit(1))))
    apart = -1 - F.shiftrightunsigned(F.xxhash64("key", "lot"), 1)
    return d.select("doc_id", "text", "key", F.when(F.col("lot") > 0, apart).otherwise(number).alias("bucket")), bound


def _followers(d: DataFrame, bound: int) -> DataFrame:
    """(bucket, after): the text that follows a bucket's last row, the first one of the next bucket, or of all after the last.

    What is compared are ids alone, in two levels: buckets of a block of BLOCK, then blocks.
    """
    block = F.floor(F.col("bucket") / BLOCK)
    least = d.filter("bucket >= 0").groupBy("bucket").agg(F.min("key").alias("key")).withColumn("block", block)
    last = least.groupBy("block").agg(F.max("bucket").alias("last"))
    across = W.orderBy("block")  # a row for BLOCK x BUCKET_ROWS documents
    whole = across.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    last = last.select("block", F.coalesce(F.lag("last").over(across), F.last("last").over(whole)).alias("before"))
    least = least.withColumn("own", F.lag("bucket").over(W.partitionBy("block").orderBy("bucket"))).join(last, "block")
    least = least.select("bucket", "key", F.coalesce("own", "before").alias("of"))
    return d.join(_small(least, bound), ["bucket", "key"]).groupBy(F.col("of").alias("bucket")).agg(F.min("text").alias("after"))


def with_next(docs: DataFrame) -> tuple[DataFrame, object]:
    """doc_id, text, bucket, the next document's text by ascending doc_id, the first one's after the last, and is_last in a bucket.

    Buckets are ranges of doc_id between quantiles, so one shuffle of texts brings neighbours together.
    """
    d, bound = _placed(docs)
    order = W.partitionBy("bucket").orderBy("key")
    placed = d.withColumn("lead_text", F.lead("text").over(order)).join(_followers(d, bound), "bucket", "left")
    placed = placed.withColumn("next_text", F.coalesce("lead_text", "after", "text"))
    return placed.select("doc_id", "text", "key", "bucket", "next_text", F.col("lead_text").isNull().alias("is_last")), order


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next; then containments."""
    placed, order = with_next(docs)
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next_text", F.lit(1), half))
    d = placed.withColumn("edited", edited).withColumns({"sketch": sketch(F.col("text")), "edited_sketch": sketch(F.col("edited"))})
    d = d.withColumn("next_sketch", F.lead("sketch").over(order))
    d = d.withColumn("next_sketch", F.when(F.col("is_last"), sketch(F.col("next_text"))).otherwise(F.col("next_sketch")))
    return d.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        written(F.col("sketch")).alias("fingerprint"),
        written(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
        containment(F.col("sketch"), F.col("edited_sketch")).alias("contained_in_edited"),
        containment(F.col("sketch"), F.col("next_sketch")).alias("contained_in_next"),
    )

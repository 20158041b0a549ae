"""Queries of the change detector and of enrichment over a table of observations."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from ..operators import enrich, stitch
from ..sources.views import events, table
from ..streaming import detector as D
from .registry import query


def observations(spark, sf_dir):
    """A recording a user; scores from values, times in seconds, 0.1 s an event's distance of 100 s."""
    e = table(spark, sf_dir, "events")
    at = F.unix_micros(e["ts"].cast("timestamp")) / 1e6 / 100.0
    score = F.when(e["value"] >= 20, e["value"] / 1000).otherwise(0.0)
    return e.select(F.col("user_id").alias("key"), at.alias("at"), score.alias("score"), F.lit(0.0).alias("watch"), F.col("event_id").alias("frame"))


@query()
def change_events(spark, sf_dir):
    return D.detect(observations(spark, sf_dir))


@query(
    """WITH o AS (SELECT user_id AS key, epoch_us(ts) AS t_at, CASE WHEN value >= 20 THEN value / 1000 ELSE 0 END >= 0.02 AS moving, value, event_id FROM events),
b AS (SELECT *, CASE WHEN moving AND NOT coalesce(lag(moving) OVER w, FALSE) THEN 1 ELSE 0 END AS starts FROM o WINDOW w AS (PARTITION BY key ORDER BY t_at, event_id)),
i AS (SELECT *, sum(starts) OVER (PARTITION BY key ORDER BY t_at, event_id ROWS UNBOUNDED PRECEDING) AS island FROM b)
SELECT key, island::BIGINT AS island, min(t_at) AS first_at, max(t_at) AS last_at, count(*) AS n, round(max(value), 6) AS peak FROM i WHERE moving GROUP BY key, island"""
)
def motion_islands(spark, sf_dir):
    """Runs of neighbouring moving observations of a recording, with their peak."""
    e = table(spark, sf_dir, "events")
    o = e.select(F.col("user_id").alias("key"), F.unix_micros(e["ts"].cast("timestamp")).alias("at"), (F.col("value") >= 20).alias("moving"), "value", "event_id")
    w = W.partitionBy("key").orderBy("at", "event_id")
    starts = F.when(F.col("moving") & ~F.coalesce(F.lag("moving").over(w), F.lit(False)), 1).otherwise(0)
    i = o.withColumn("starts", starts).withColumn("island", F.sum("starts").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return i.filter("moving").groupBy("key", "island").agg(F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.count(F.lit(1)).alias("n"), F.round(F.max("value"), 6).alias("peak"))


@query(
    """SELECT user_id AS key, floor(epoch_us(ts) / 1e6 / 3600)::BIGINT AS slot, min(event_id) AS frame FROM (SELECT *, row_number() OVER (PARTITION BY user_id, floor(epoch_us(ts) / 1e6 / 3600) ORDER BY ts, event_id) AS r FROM events) WHERE r = 1 GROUP BY ALL"""
)
def downsample(spark, sf_dir):
    """The first observation of each hour of a recording."""
    e = table(spark, sf_dir, "events")
    at = F.unix_micros(e["ts"].cast("timestamp")) / 1e6
    o = e.select(F.col("user_id").alias("key"), at.alias("at"), F.lit(0.0).alias("score"), F.lit(0.0).alias("watch"), F.col("event_id").alias("frame"))
    return D.downsampled(o, 1 / 3600).select("key", F.floor(F.col("at") / 3600).cast("long").alias("slot"), "frame")


@query()
def enrich_pending(spark, sf_dir):
    """Pending events through the plug-in extractor and embedder, with their error column."""
    pending = events(spark, sf_dir).filter(F.col("processed_at").isNull())
    found = enrich.enriched(pending.withColumn("frame", F.col("ocr_text").cast("binary")), enrich.TextFrames(), enrich.HashEmbedder())
    return found.select("id", "text", "confidence", F.size("embedding").alias("dim"), "attempts", "error")


@query(
    """WITH g AS (SELECT source AS session_id, doc_id, doc_id * 60.0 AS t_at FROM documents), b AS (SELECT *, CASE WHEN t_at - lag(t_at) OVER (PARTITION BY session_id ORDER BY t_at, doc_id) <= 1200 THEN 0 ELSE 1 END AS starts FROM g)
SELECT session_id, doc_id, sum(starts) OVER (PARTITION BY session_id ORDER BY t_at, doc_id ROWS UNBOUNDED PRECEDING)::BIGINT AS chain FROM b"""
)
def stitch_chains(spark, sf_dir):
    """Events of a session whose starts are close enough to belong to one page chain."""
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("session_id"), "doc_id", (F.col("doc_id") * 60.0).alias("at"))
    return stitch.chains(d, "at", "doc_id", seconds=1200).select("session_id", "doc_id", "chain")

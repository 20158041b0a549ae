"""What depends on deleted rows, and the regular maintenance of stored events and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from . import packs as P


def cascade(child: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """child without the rows whose parent (id) goes."""
    return child.join(gone.select(F.col("id").alias(key)), key, "left_anti").select(*child.columns)


def set_null(child: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """child with null instead of a reference to a row that goes."""
    marked = child.join(gone.select(F.col("id").alias("__gone")).distinct(), F.col(key) == F.col("__gone"), "left")
    return marked.withColumn(key, F.when(F.col("__gone").isNull(), F.col(key))).select(*child.columns)


def restricting(child: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """The rows of child that forbid a deletion."""
    return child.join(gone.select(F.col("id").alias(key)), key, "left_semi")


def delete_sessions(ids: DataFrame, sessions: DataFrame, ev: DataFrame, evidence: DataFrame, items: DataFrame) -> dict[str, DataFrame]:
    """What is left of each table after sessions go: events and their evidence with them, references to a previous event
    become null. Events that a document refers to forbid it."""
    lost = ev.join(ids.select(F.col("id").alias("session_id")), "session_id", "left_semi").select("id")
    if not restricting(items, "event_id", lost).isEmpty():
        raise ValueError("documents refer to events of these sessions")
    left = cascade(ev, "session_id", ids)
    if "previous_event_id" in ev.columns:
        left = set_null(left, "previous_event_id", lost)
    return {"sessions": sessions.join(ids.select("id"), "id", "left_anti"), "events": left, "evidence": cascade(evidence, "event_id", lost), "items": items}


def maintenance(packs: DataFrame, ev: DataFrame, items: DataFrame, now, days: int = 30) -> DataFrame:
    """(action, n) of an hourly round: documents that expire, events that are past their retention, and events that stay."""
    expired = packs.select((P.status_at(now) != F.col("status")).cast("long").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select(F.lit("expired").alias("action"), "n")
    victims = P.retention_victims(ev, items, now, days)
    gone = victims.agg(F.count(F.lit(1)).alias("n")).select(F.lit("retained out").alias("action"), "n")
    left = ev.join(victims.select("id"), "id", "left_anti").agg(F.count(F.lit(1)).alias("n")).select(F.lit("kept").alias("action"), "n")
    return expired.unionByName(gone).unionByName(left)


def counters(outcomes: DataFrame) -> DataFrame:
    """(processed, failed, dropped, retried) of rows (id, outcome, attempts)."""
    n = lambda x: F.count_if(F.col("outcome") == x)
    return outcomes.agg(n("processed").alias("processed"), n("failed").alias("failed"), n("dropped").alias("dropped"), F.count_if(F.col("attempts") > 1).alias("retried"))

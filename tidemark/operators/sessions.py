"""Recording sessions from appended facts, ordered selections of events, and guards before a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F


def session_states(facts: DataFrame) -> DataFrame:
    """(id, source_name, started_at, ended_at, status, error) of facts (id, kind start or end, source_name, at, error).

    A session without an end is running, one that ended with an error failed, another stopped.
    """
    end = F.max(F.when(F.col("kind") == "end", F.struct("at", "error")))
    start = F.min(F.when(F.col("kind") == "start", F.struct("at", "source_name")))
    s = facts.groupBy("id").agg(start.alias("s"), end.alias("e"))
    status = F.when(F.col("e").isNull(), "running").when(F.coalesce(F.col("e.error"), F.lit("")) != "", "failed").otherwise("stopped")
    return s.select("id", F.col("s.source_name").alias("source_name"), F.col("s.at").alias("started_at"), F.col("e.at").alias("ended_at"), status.alias("status"), F.col("e.error").alias("error"))


def events_per_session(sessions: DataFrame, ev: DataFrame) -> DataFrame:
    """Sessions with their number of events, 0 for none; events are counted before the join."""
    n = ev.groupBy(F.col("session_id").alias("id")).agg(F.count(F.lit(1)).alias("n_events"))
    return sessions.join(n, "id", "left").withColumn("n_events", F.coalesce("n_events", F.lit(0)))


def between(ev: DataFrame, session_id: str, first: int, last: int) -> DataFrame:
    """Events of a session from one chosen event to another, in either direction, both included."""
    own = ev.filter(F.col("session_id") == session_id)
    ends = own.filter(F.col("id").isin(first, last)).agg(F.min(F.struct("started_at", "id")).alias("a"), F.max(F.struct("started_at", "id")).alias("b"))
    at = F.struct("started_at", "id")
    return own.join(F.broadcast(ends), (at >= F.col("a")) & (at <= F.col("b"))).drop("a", "b")


def chronological(selected: DataFrame, newest_first: bool = False) -> DataFrame:
    """A selection of events, at most a document's, numbered by time."""
    order = [F.desc("started_at"), F.desc("id")] if newest_first else ["started_at", "id"]
    return selected.withColumn("position", F.row_number().over(W.orderBy(*order)) - 1)


def moved(ids: list[int], source: int, target: int) -> list[int]:
    """A selection's ids after one is dragged to another's place."""
    if source == target or source not in ids or target not in ids:
        return list(ids)
    at, out = ids.index(target), [i for i in ids if i != source]
    return [*out[:at], source, *out[at:]]


def unknown(page: DataFrame, shown: DataFrame) -> DataFrame:
    """A further page without the events that are shown already."""
    return page.join(shown.select("id"), "id", "left_anti")


def has_capacity(used: int, limit: int, free: int, least_free: int) -> bool:
    return free >= least_free and used < limit


def pages_of(events_per_page: DataFrame) -> DataFrame:
    """(event_id, page) of each event's first page, from (page, source_event_ids)."""
    each = events_per_page.select("page", F.explode("source_event_ids").alias("event_id"))
    return each.groupBy("event_id").agg(F.min("page").alias("page"))

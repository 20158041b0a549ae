"""What a service returns of searches, events and documents: bounded results as plain values or JSON.

A page has 200 hits at most and an event four neighbours, so these are read to the driver whole.
"""

from __future__ import annotations

import base64
import json

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.times import iso
from . import packs as P
from . import search as S


def _plain(rows: DataFrame) -> list[dict]:
    times = [c for c, kind in rows.dtypes if kind.startswith("timestamp")]
    return [json.loads(r[0]) for r in rows.withColumns({c: iso(F.col(c)) for c in times}).select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"})).collect()]


def results(ev: DataFrame, tokens: list[str], query: list[float] | None = None, start=None, end=None, limit: int = 60, offset: int = 0) -> dict:
    """A page of a search, or of the timeline without tokens: events, their sessions with counts, and how to go on."""
    limit = S.clamp(limit, 100)
    found = S.hybrid(ev, tokens, query, start, end, limit + 1, offset) if tokens else S.timeline(ev.drop("embedding"), start, end, limit + 1, offset)
    rows = _plain(found)
    shown, more = rows[:limit], len(rows) > limit
    ids = list(dict.fromkeys(r["session_id"] for r in shown))
    counted = ev.filter(F.col("session_id").isin(ids)).groupBy(F.col("session_id").alias("id")).agg(F.count(F.lit(1)).alias("event_count")) if ids else None
    total = None if tokens else S.timeline_count(ev, start, end).first()[0]
    return {"events": shown, "sessions": _plain(counted) if ids else [], "has_more": more, "next_offset": offset + len(shown), "total": total}


def detail(ev: DataFrame, event_id: int, n: int = 2) -> dict | None:
    """An event with its neighbours; None if there is none."""
    own = _plain(ev.drop("embedding").filter(F.col("id") == event_id).limit(1))
    if not own:
        return None
    around = _plain(S.neighbours(ev.drop("embedding"), event_id, n))
    return own[0] | {side: [{k: v for k, v in r.items() if k != "side"} for r in around if r["side"] == side] for side in ("before", "after")}


def public_list(packs: DataFrame, now, text: str | None = None) -> str:
    """Available documents as JSON; a blank search is an error, none lists all."""
    found = P.listed(packs, now, approved_only=True) if text is None else P.search(packs, now, text.strip())
    return json.dumps(_plain(P.public(found).orderBy(F.desc("created_at"), F.desc("id")).limit(1000)), ensure_ascii=False, indent=2)


def resource(pack_id: str, name: str, content: bytes, scheme: str = "tidemark") -> dict:
    """One document as an embedded resource: HTML as text, others as base64."""
    uri = f"{scheme}://documents/{pack_id}/{name}"
    if name.endswith(".html"):
        return {"uri": uri, "mimeType": "text/html", "text": content.decode("utf-8")}
    return {"uri": uri, "mimeType": "application/pdf", "blob": base64.b64encode(content).decode("ascii")}


def status(ev: DataFrame, used: Column, limit: int, free: int, least_free: int) -> DataFrame:
    """One row with a nested status document of storage and work that waits."""
    pending = F.count_if(F.col("processed_at").isNull())
    storage = F.struct(used.alias("used_bytes"), F.lit(limit).alias("limit_bytes"), F.lit(free).alias("free_bytes"), ((F.lit(free) >= least_free) & (used < limit)).alias("has_capacity"))
    work = F.struct(F.count(F.lit(1)).alias("events"), pending.alias("pending"))
    return ev.agg(F.to_json(F.struct(storage.alias("storage"), work.alias("index"))).alias("status"))

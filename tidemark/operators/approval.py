"""Approving or rebuilding a context document as one operation, and each event's text over the pages it is on."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, functions as F

from ..sources import sinks
from . import cleaning as C
from . import packs as P


def owned(pages: DataFrame) -> DataFrame:
    """Pages (…, event_id, safe) with the owner's id in each of their lines."""
    return pages.withColumn("safe", F.transform("safe", lambda x: F.struct(x["text"].alias("text"), x["confidence"].alias("confidence"), x["polygon"].alias("polygon"), F.col("event_id").alias("event_id"))))


def event_texts(pages: DataFrame) -> DataFrame:
    """(group, event_id, text): each event's own lines over all pages, cleaned as pages of their own, in page order.

    As C.cleaned() with an event's pages as a group, but its lines are made once and meet in one shuffle, as its text is one row in any case.
    """
    lines = pages.select("group", "page", "height", F.posexplode("safe").alias("pos", "x"))
    lines = lines.select("group", F.col("x.event_id").alias("event_id"), "page", "height", "pos", C.collapse(C.normalised(F.col("x.text"))).alias("line"), "x.polygon")
    center = C.bound(C.box(F.col("polygon")), lambda b: (b["top"] + b["bottom"]) / 2 / F.col("height"))
    edge = F.coalesce((F.col("height") > 0) & C.bound(center, C.outer), F.lit(False))
    noise = F.coalesce(C.collapsed_is_noise(F.col("line")), F.lit(True))  # so are blank lines; they count for the number of pages
    rows = lines.select("group", "event_id", F.lower("line").alias("key"), F.struct("page", "pos", "line", noise.alias("noise"), edge.alias("edge")).alias("at"))
    keys = rows.repartition("group", "event_id").groupBy("group", "event_id", "key").agg(F.collect_list("at").alias("at"))
    page = lambda x: x["page"]
    n_pages = lambda at: F.size(F.array_distinct(F.transform(at, page)))
    events = keys.select("group", "event_id", F.struct(n_pages(F.col("at")).alias("n"), "at").alias("k")).groupBy("group", "event_id").agg(F.collect_list("k").alias("keys"))

    def first(at: Column) -> Column:
        """The first line of each page."""
        return C.bound(F.array_sort(at), lambda s: F.filter(s, lambda x, i: (i == 0) | ~x["page"].eqNullSafe(F.get(s, i - 1)["page"])))

    def kept(least: Column) -> Column:
        lines = F.transform("keys", lambda k: first(F.filter(k["at"], lambda x: ~x["noise"] & ~((k["n"] >= least) & x["edge"]))))
        return F.array_join(F.transform(F.array_sort(F.flatten(lines)), lambda x: x["line"]), "\n")

    least = C.threshold(n_pages(F.flatten(F.transform("keys", lambda k: k["at"]))))
    return events.select("group", "event_id", C.bound(least, kept).alias("text"))


def approve(packs: DataFrame, items: DataFrame, texts: DataFrame, pack_id, root: str, now: dt.datetime, hours: int | None = None) -> dict:
    """Builds and publishes a draft or approved document; returns its new columns.

    texts: (pack_id, position, title, text). A failure while building leaves a draft with the error and the old artifact.
    """
    spark, own = packs.sparkSession, packs.filter(F.col("id") == pack_id)
    row = own.first()
    if row is None:
        raise KeyError(pack_id)
    if row["status"] not in ("draft", "approved"):
        raise ValueError("only active documents can be rebuilt")
    before = row["approved_at"] if "approved_at" in packs.columns else None
    start, end = P.window(before, row["expires_at"] if before else None, now, hours, row["status"] == "approved")
    try:
        mine = texts.filter(F.col("pack_id") == pack_id)
        manifest = P.manifest_json(own, items.filter(F.col("pack_id") == pack_id)).first()
        if manifest is None:
            raise ValueError("the document has no items")
        markdown, html = P.markdown(own, mine).first(), P.html(own, mine).first()
        built = sinks.publish(spark, root, str(pack_id), {**_json(manifest["manifest"]), "approved_at": start.isoformat(), "expires_at": end.isoformat()}, markdown["markdown"] if markdown else "", html["html"] if html else "")
    except Exception as e:  # noqa: BLE001  whatever fails, the document is a draft that names it
        return {"id": pack_id, "status": "draft", "build_error": f"{type(e).__name__}: {e}"[:2000]}
    return {"id": pack_id, "status": "approved", "approved_at": start, "expires_at": end, "artifact_path": built, "build_error": None}


def _json(text: str) -> dict:
    import json

    return json.loads(text)

"""Context documents: listing, search, items in order, expiry, revocation, retention, bounded deletion, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .search import bound, overlapping, wildcard

PUBLIC = ["id", "title", "query", "note", "status", "created_at", "expires_at", "item_count"]
STATES = ("draft", "approved", "revoked", "expired")
MOST_ITEMS, LEAST_HOURS, MOST_HOURS = 200, 1, 365 * 24


def with_counts(packs: DataFrame, items: DataFrame) -> DataFrame:
    """Documents with their number of items, 0 for none. Items are counted before the join."""
    n = items.groupBy("pack_id").agg(F.count("event_id").alias("item_count"))
    return packs.join(n, packs["id"] == n["pack_id"], "left").drop("pack_id").withColumn("item_count", F.coalesce("item_count", F.lit(0)))


def status_at(now) -> Column:
    """A document's status at a bound time: an approved one that is due is expired."""
    due = (F.col("status") == "approved") & (F.col("expires_at") <= bound(now))
    return F.when(due, "expired").otherwise(F.col("status"))


def listed(packs: DataFrame, now=None, approved_only: bool = False, text: str | None = None, escaped: bool = False) -> DataFrame:
    if approved_only:
        packs = packs.filter((F.col("status") == "approved") & (F.col("expires_at") > bound(now)))
    if text is not None:
        found = [wildcard(F.col(c), text, escaped) for c in ("title", "note", "query")]
        packs = packs.filter(found[0] | found[1] | found[2])
    return packs


def public(packs: DataFrame) -> DataFrame:
    return packs.select(*[c for c in PUBLIC if c in packs.columns])


def search(packs: DataFrame, now, text: str) -> DataFrame:
    """Approved documents by text; a blank search is an error."""
    if not text.strip():
        raise ValueError("a search needs text")
    return listed(packs, now, approved_only=True, text=text)


def readable(packs: DataFrame, now, pack_id: int) -> DataFrame:
    return listed(packs.filter(F.col("id") == pack_id), now, approved_only=True).limit(1)


def revoke(packs: DataFrame, pack_id: int, now) -> DataFrame:
    """Documents after one is revoked; only an approved or expired one may be."""
    may = (F.col("id") == pack_id) & status_at(now).isin("approved", "expired")
    return packs.withColumn("status", F.when(may, "revoked").otherwise(F.col("status")))


def window(old_approved, old_expires, now, hours: int | None, approved: bool):
    """The window of a rebuilt document: explicit hours start now, an approved one without keeps its own."""
    import datetime as dt

    if hours is None and approved and old_expires is not None:
        return old_approved, old_expires
    hours = 24 if hours is None else hours
    if not LEAST_HOURS <= hours <= MOST_HOURS:
        raise ValueError("expiry must be between an hour and a year")
    return now, now + dt.timedelta(hours=hours)


def items_in_order(items: DataFrame, ev: DataFrame) -> DataFrame:
    return items.join(ev, items["event_id"] == ev["id"], "inner")


def selected(ev: DataFrame, ids: list[int]) -> DataFrame:
    """Events of chosen ids in the given order, repeated ids once; a bounded list, so it's sent to the events."""
    ordered = list(dict.fromkeys(ids))
    if not ordered or len(ordered) > MOST_ITEMS:
        raise ValueError("choose between 1 and 200 events")
    spark = ev.sparkSession
    chosen = spark.createDataFrame(list(enumerate(ordered)), "position int, id long")
    return F.broadcast(chosen).join(ev, "id", "inner")


def unreferenced(ev: DataFrame, items: DataFrame) -> DataFrame:
    return ev.join(items.select(F.col("event_id").alias("id")), "id", "left_anti")


def retention_victims(ev: DataFrame, items: DataFrame, now, days: int = 30) -> DataFrame:
    """Unreferenced events that ended before the cutoff."""
    return unreferenced(ev.filter(F.col("ended_at") < bound(now) - F.expr(f"INTERVAL {days} DAYS")), items)


def deleted(ev: DataFrame, items: DataFrame, start=None, end=None, confirm: bool = False) -> tuple[DataFrame, DataFrame]:
    """Victims and survivors of a bounded deletion."""
    if not confirm or (start is None and end is None):
        raise ValueError("a deletion needs a bound and a confirmation")
    victims = unreferenced(overlapping(ev, start, end), items)
    return victims, ev.join(victims.select("id"), "id", "left_anti")


def latest(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The newest row of each key; Spark keeps one row a key and task before the shuffle."""
    ranked = rows.withColumn("__rank", F.row_number().over(W.partitionBy(key).orderBy(*order)))
    return ranked.filter(F.col("__rank") == 1).drop("__rank")


def manifests(packs: DataFrame, items: DataFrame) -> DataFrame:
    """Each document's ordered item ids as a list, with a digest of it. Few items belong to a document."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("position", "event_id"))), lambda x: x["event_id"].cast("string"))
    m = items.groupBy("pack_id").agg(F.array_join(ordered, ",").alias("event_ids"), F.count(F.lit(1)).alias("n_items"))
    m = packs.select("id", "title", "status").join(m, F.col("id") == F.col("pack_id"), "inner").drop("pack_id")
    return m.withColumn("digest", F.sha2(F.concat_ws("|", F.col("id").cast("string"), "title", "event_ids"), 256))


def manifest_json(packs: DataFrame, items: DataFrame, schema_version: int = 3) -> DataFrame:
    """(id, manifest) with nested items, as JSON text."""
    item = F.struct("position", "event_id", F.sha2(F.col("event_id").cast("string"), 256).alias("sha256"))
    m = items.groupBy("pack_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    both = packs.join(m, packs["id"] == m["pack_id"])
    return both.select("id", F.to_json(F.struct(F.lit(schema_version).alias("schema_version"), "id", "title", "note", "query", "items")).alias("manifest"))


def markdown(packs: DataFrame, texts: DataFrame) -> DataFrame:
    """(id, markdown) from documents and (pack_id, position, title, text) rows."""
    part = F.concat(F.lit("## "), (F.col("position") + 1).cast("string"), F.lit(". "), F.col("title"), F.lit("\n\n"), F.col("text"))
    body = texts.withColumn("part", part).groupBy("pack_id").agg(F.array_sort(F.collect_list(F.struct("position", "part"))).alias("parts"))
    both = packs.join(body, packs["id"] == body["pack_id"])
    text = F.array_join(F.transform("parts", lambda p: p["part"]), "\n\n")
    return both.select("id", F.concat(F.lit("# "), packs["title"], F.lit("\n\n"), text, F.lit("\n")).alias("markdown"))


def html(packs: DataFrame, texts: DataFrame) -> DataFrame:
    """(id, html): one self-contained page a document, all texts escaped."""
    from ..functions.text import escape_html

    part = F.concat(F.lit("<section><h2>"), escape_html(F.col("title")), F.lit("</h2><pre>"), escape_html(F.col("text")), F.lit("</pre></section>"))
    body = texts.withColumn("part", part).groupBy("pack_id").agg(F.array_sort(F.collect_list(F.struct("position", "part"))).alias("parts"))
    both = packs.join(body, packs["id"] == body["pack_id"])
    head = F.concat(F.lit('<!doctype html><html><head><meta charset="utf-8"><title>'), escape_html(packs["title"]), F.lit("</title></head><body>"))
    return both.select("id", F.concat(head, F.array_join(F.transform("parts", lambda p: p["part"]), ""), F.lit("</body></html>")).alias("html"))

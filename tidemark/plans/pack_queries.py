"""Queries over context documents and their items: lists, expiry, order, retention, deletion, manifests."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from ..operators import packs as P
from ..sources.views import EV_SQL, ITEM_SQL, PACK_SQL, events, pack_items, packs, table
from .registry import query

NOW = "1998-06-01 12:00:00"
RETENTION_NOW = "2024-01-31 06:00:00"
START, END = "2024-01-01 02:00:00", "2024-01-01 09:00:00"
CHOSEN = [42, 7, 300, 7, 150, 12]
_BOTH = f"WITH {PACK_SQL}, {ITEM_SQL}"
_FREE = "NOT EXISTS (SELECT 1 FROM item WHERE event_id = ev.id)"
_SOME = "item AS (SELECT l_partkey AS event_id FROM lineitem WHERE l_quantity >= 45)"


def _references(spark, sf_dir):
    """Items that refer to events, so that some events are referred to and others aren't."""
    return table(spark, sf_dir, "lineitem").filter(F.col("l_quantity") >= 45).select(F.col("l_partkey").alias("event_id"))


@query(f"{_BOTH} SELECT id, title, status, created_at, count(event_id) AS item_count FROM pack LEFT JOIN item ON item.pack_id = pack.id GROUP BY ALL ORDER BY created_at DESC, id DESC LIMIT 100")
def pack_list(spark, sf_dir):
    """The newest documents are chosen first, then only their items are counted."""
    top = packs(spark, sf_dir).orderBy(F.desc("created_at"), F.desc("id")).limit(100).select("id", "title", "status", "created_at")
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("pack_id"), F.col("l_partkey").alias("event_id"))
    own = items.join(F.broadcast(top.select(F.col("id").alias("pack_id"))), "pack_id", "left_semi")
    return P.with_counts(top, own).orderBy(F.desc("created_at"), F.desc("id"))


@query(f"{_BOTH} SELECT id, count(event_id) AS item_count FROM pack LEFT JOIN item ON item.pack_id = pack.id GROUP BY id")
def pack_item_counts(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("pack_id"), F.col("l_partkey").alias("event_id"))
    return P.with_counts(packs(spark, sf_dir).select("id"), items)


@query(f"WITH {PACK_SQL} SELECT id, title, query, note, status, created_at, expires_at FROM pack WHERE status = 'approved' AND expires_at > TIMESTAMP '{NOW}'")
def pack_list_approved(spark, sf_dir):
    return P.public(P.listed(packs(spark, sf_dir), NOW, approved_only=True))


@query(f"WITH {PACK_SQL} SELECT id, note FROM pack WHERE title ILIKE '%e_9%' OR note ILIKE '%e_9%' OR query ILIKE '%e_9%'")
def pack_search_wildcards(spark, sf_dir):
    return P.listed(packs(spark, sf_dir), text="e_9").select("id", "note")


@query(f"WITH {PACK_SQL} SELECT id, note FROM pack WHERE contains(lower(title), 'e_9') OR contains(lower(note), 'e_9') OR contains(lower(query), 'e_9')")
def pack_search_escaped(spark, sf_dir):
    return P.listed(packs(spark, sf_dir), text="e_9", escaped=True).select("id", "note")


@query(f"WITH {PACK_SQL} SELECT id, CASE WHEN status = 'approved' AND expires_at <= TIMESTAMP '{NOW}' THEN 'expired' ELSE status END AS status_now FROM pack")
def pack_expire_due(spark, sf_dir):
    return packs(spark, sf_dir).select("id", P.status_at(NOW).alias("status_now"))


@query(f"WITH {PACK_SQL} SELECT CASE WHEN status = 'approved' AND expires_at <= TIMESTAMP '{NOW}' THEN 'expired' ELSE status END AS status_now, count(*) AS n FROM pack GROUP BY 1")
def pack_status_counts(spark, sf_dir):
    return packs(spark, sf_dir).groupBy(P.status_at(NOW).alias("status_now")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {PACK_SQL} SELECT id, CASE WHEN id % 10 = 3 AND (status = 'approved') THEN 'revoked' ELSE status END AS status FROM pack")
def pack_revoke(spark, sf_dir):
    """Revoking a set of documents: approved or expired ones change, others don't."""
    may = (F.col("id") % 10 == 3) & P.status_at(NOW).isin("approved", "expired")
    return packs(spark, sf_dir).select("id", F.when(may, "revoked").otherwise(F.col("status")).alias("status"))


@query(f"WITH {EV_SQL}, {ITEM_SQL} SELECT pack_id, position, event_id, session_id, sha256(ocr_text) AS source_text_sha256, 0.0::DOUBLE AS bm25_score FROM item JOIN ev ON ev.id = item.event_id")
def pack_items_ordered(spark, sf_dir):
    """Items with their events; whole texts are digested before the join, which then moves no texts."""
    ev = events(spark, sf_dir).select("id", "session_id", F.sha2("ocr_text", 256).alias("source_text_sha256"))
    items = P.items_in_order(pack_items(spark, sf_dir), ev).withColumn("bm25_score", F.lit(0.0))
    return items.select("pack_id", "position", "event_id", "session_id", "source_text_sha256", "bm25_score")


@query(f"WITH {EV_SQL}, c(position, id) AS (VALUES (0, 42), (1, 7), (2, 300), (3, 150), (4, 12)) SELECT position, id, session_id, started_at FROM c JOIN ev USING (id)")
def ordered_lookup(spark, sf_dir):
    return P.selected(events(spark, sf_dir), CHOSEN).select("position", "id", "session_id", "started_at")


@query(
    """SELECT l_partkey, l_orderkey, l_linenumber, l_shipdate FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey
  ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC) AS r FROM lineitem) WHERE r = 1"""
)
def latest_per_key(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_shipdate")
    return P.latest(rows, "l_partkey", [F.desc("l_shipdate"), F.desc("l_orderkey"), F.desc("l_linenumber")])


@query(f"WITH {EV_SQL}, {_SOME} SELECT id, ended_at FROM ev WHERE ended_at < TIMESTAMP '{RETENTION_NOW}' - INTERVAL 30 DAYS AND {_FREE}")
def retention_victims(spark, sf_dir):
    return P.retention_victims(events(spark, sf_dir), _references(spark, sf_dir), RETENTION_NOW).select("id", "ended_at")


@query(
    f"""WITH {EV_SQL}, {_SOME}
SELECT id FROM ev WHERE NOT (ended_at >= TIMESTAMP '{START}' AND started_at <= TIMESTAMP '{END}' AND {_FREE})"""
)
def bounded_delete_survivors(spark, sf_dir):
    _, left = P.deleted(events(spark, sf_dir), _references(spark, sf_dir), START, END, confirm=True)
    return left.select("id")


@query(f"WITH {EV_SQL}, {_SOME} SELECT count(*) AS deleted FROM ev WHERE ended_at >= TIMESTAMP '{START}' AND started_at <= TIMESTAMP '{END}' AND {_FREE}")
def bounded_delete_count(spark, sf_dir):
    victims, _ = P.deleted(events(spark, sf_dir), _references(spark, sf_dir), START, END, confirm=True)
    return victims.agg(F.count(F.lit(1)).alias("deleted"))


@query(
    f"""{_BOTH}, m AS (SELECT pack_id, string_agg(event_id::VARCHAR, ',' ORDER BY position, event_id) AS event_ids, count(*) AS n_items FROM item GROUP BY pack_id)
SELECT id, title, status, event_ids, n_items, sha256(concat_ws('|', id::VARCHAR, title, event_ids)) AS digest FROM pack JOIN m ON m.pack_id = pack.id"""
)
def manifest_rollup(spark, sf_dir):
    return P.manifests(packs(spark, sf_dir), pack_items(spark, sf_dir))


@query("SELECT doc_id, sha256(text) AS digest, octet_length(encode(text))::BIGINT AS n_bytes FROM documents")
def content_digest(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.sha2("text", 256).alias("digest"), F.octet_length("text").cast("long").alias("n_bytes"))


@query("SELECT sum(octet_length(encode(text)))::BIGINT AS used_bytes, count(*) AS n_files FROM documents")
def usage_total(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.agg(F.sum(F.octet_length("text")).alias("used_bytes"), F.count(F.lit(1)).alias("n_files"))


@query(
    f"""{_BOTH}, w AS (SELECT pack_id, position, event_id, lag(event_id) OVER (PARTITION BY pack_id ORDER BY position) AS before FROM item)
SELECT pack_id, count(*) FILTER (before IS NOT NULL AND event_id < before) AS n_breaks FROM w GROUP BY pack_id"""
)
def pack_order_breaks(spark, sf_dir):
    order = W.partitionBy("pack_id").orderBy("position")
    w = pack_items(spark, sf_dir).withColumn("before", F.lag("event_id").over(order))
    return w.groupBy("pack_id").agg(F.count_if(F.col("before").isNotNull() & (F.col("event_id") < F.col("before"))).alias("n_breaks"))


@query("SELECT l_orderkey AS pack_id, count(*) AS n, count(DISTINCT (l_linenumber)) AS n_positions FROM lineitem GROUP BY 1 HAVING count(*) > count(DISTINCT (l_linenumber))")
def unique_position_check(spark, sf_dir):
    """Documents whose items break the uniqueness of positions, a check before publishing."""
    g = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("pack_id")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("l_linenumber").alias("n_positions"))
    return g.filter(F.col("n") > F.col("n_positions"))


@query(
    """WITH g AS (SELECT l_orderkey AS oid, (l_linenumber % 3) AS page, min(l_quantity) AS lo, max(l_quantity) + 5 AS hi FROM lineitem GROUP BY ALL)
SELECT a.oid, a.page AS upper_page, b.page AS lower_page, greatest(a.lo, b.lo) AS top, least(a.hi, b.hi) AS bottom
FROM g a JOIN g b ON a.oid = b.oid AND a.page < b.page AND a.lo < b.hi AND a.hi > b.lo"""
)
def page_bands_join(spark, sf_dir):
    """Bands of pages of one document that overlap: equal on the document, then by interval."""
    g = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("oid"), (F.col("l_linenumber") % 3).alias("page"))
    g = g.agg(F.min("l_quantity").alias("lo"), (F.max("l_quantity") + 5).alias("hi"))
    a, b = g.alias("a"), g.alias("b")
    on = (F.col("a.oid") == F.col("b.oid")) & (F.col("a.page") < F.col("b.page")) & (F.col("a.lo") < F.col("b.hi")) & (F.col("a.hi") > F.col("b.lo"))
    top, bottom = F.greatest("a.lo", "b.lo").alias("top"), F.least("a.hi", "b.hi").alias("bottom")
    return a.join(b, on).select("a.oid", F.col("a.page").alias("upper_page"), F.col("b.page").alias("lower_page"), top, bottom)


@query(
    """WITH l AS (SELECT l_orderkey, l_linenumber, l_quantity AS y, l_discount * 100 AS x FROM lineitem),
r AS (SELECT o_orderkey, o_custkey % 10 AS rx, o_custkey % 40 AS ry FROM orders)
SELECT l_orderkey, l_linenumber, round(x, 2) AS x, y FROM l WHERE NOT EXISTS (SELECT 1 FROM r WHERE o_orderkey = l_orderkey AND x < rx + 4 AND x + 1 > rx AND y < ry + 15 AND y + 1 > ry)"""
)
def region_overlap_anti(spark, sf_dir):
    """Lines that no rectangle of their document touches; touching edges don't count."""
    item = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("y"), (F.col("l_discount") * 100).alias("x"))
    r = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 10).alias("rx"), (F.col("o_custkey") % 40).alias("ry"))
    hit = (F.col("o_orderkey") == F.col("l_orderkey")) & (F.col("x") < F.col("rx") + 4) & (F.col("x") + 1 > F.col("rx")) & (F.col("y") < F.col("ry") + 15) & (F.col("y") + 1 > F.col("ry"))
    return item.join(r, hit, "left_anti").select("l_orderkey", "l_linenumber", F.round("x", 2).alias("x"), "y")

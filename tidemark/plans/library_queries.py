"""Queries of the library's smaller operators: times, renders, redaction, sessions, relations, indexes, counters, pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import times as T
from ..functions.noise import noise_sql
from ..functions.text import decoded, embedding_input, encoded
from ..operators import approval, cleaning as C, evaluate as E, inverted, packs as P, relations, search as S, sessions, stitch
from ..sources.views import EV_SQL, ITEM_SQL, PACK_SQL, events, pack_items, packs, table
from ..streaming import detector as D
from .registry import query
from .text_queries import LINES_SQL

NOW = "1998-06-01 12:00:00"
START, END = "2024-01-01 00:10:00", "2024-01-01 12:00:00"
_ISO = "strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(ts) % 1000000 > 0 THEN '.' || lpad((epoch_us(ts) % 1000000)::VARCHAR, 6, '0') ELSE '' END || '+00:00'"


@query(f"""SELECT event_id, {_ISO} AS iso, strftime(ts + INTERVAL 9 HOURS, '%Y/%m/%d %H:%M:%S') || ' JST' AS shown,
  'frames/' || strftime(ts, '%Y-%m-%d/%H%M%S') || '-' || lpad((epoch_us(ts) % 1000000)::VARCHAR, 6, '0') || '-' || substr(event_type, 1, 8) || '.webp' AS path FROM events""")
def iso_times(spark, sf_dir):
    """Instants as ISO text, as shown in Tokyo, and as the place of a frame."""
    e = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp_ntz").alias("at"), "event_type")
    iso = T.iso(F.col("at"))
    return e.select("event_id", T.utc_iso(iso).alias("iso"), T.displayed(iso, "Asia/Tokyo").alias("shown"), T.frame_path(F.col("at"), F.col("event_type")).alias("path"))


@query("SELECT doc_id, sha256(to_base64(encode(text))) AS digest, 'passage: ' || trim(text) = 'passage: ' || trim(text) AND trim(text) <> '' AS embeddable, text IS NOT NULL AS same FROM documents")
def base64_texts(spark, sf_dir):
    """Whole texts in base64 by digest, whether they come back the same, and whether an embedder gets them."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", encoded(F.col("text")).alias("b"))
    return d.select("doc_id", F.sha2("b", 256).alias("digest"), embedding_input(F.col("text")).startswith("passage: ").alias("embeddable"), (decoded(F.col("b")) == F.col("text")).alias("same"))


def _pages(spark, sf_dir) -> DataFrame:
    """Documents as pages of lines 18 high, four a group; every third page has a redaction on its left half."""
    d = table(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 4).alias("group"), F.col("doc_id").alias("page"), F.coalesce("text", F.lit("")).alias("ocr_text"))
    number = lambda x: x.cast("double")

    def line(x: Column, i: Column) -> Column:
        left, top = number(F.when(i % 5 == 4, 800).otherwise(10)), number(i * 18)
        right, bottom = left + number(F.least(F.length(x), F.lit(90)) * 8), top + 14
        corners = F.array(F.array(left, top), F.array(right, top), F.array(right, bottom), F.array(left, bottom))
        return F.struct(x.alias("text"), F.lit(0.9).alias("confidence"), corners.alias("polygon"))

    d = d.withColumn("height", (F.size(F.split("ocr_text", "\n")) * 18).cast("int")).withColumn("width", F.lit(1600))
    d = d.withColumn("metadata_json", F.to_json(F.struct(F.transform(F.split("ocr_text", "\n"), line).alias("lines"))))
    area = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.4).alias("width"), F.lit(0.5).alias("height"))
    none = F.array().cast("array<struct<x:double,y:double,width:double,height:double>>")
    return C.safe_lines(d.withColumn("redactions", F.when(F.col("page") % 3 == 0, F.array(area)).otherwise(none)))


_SAFE_SQL = LINES_SQL + """,
n AS (SELECT doc_id AS page, doc_id // 4 AS grp, len(string_split(coalesce(text, ''), chr(10))) * 18 AS height FROM documents),
b AS (SELECT l.page, n.grp, n.height, l.pos, l.line, l.key, CASE WHEN l.pos % 5 = 4 THEN 800 ELSE 10 END AS lft, l.pos * 18 AS top FROM l JOIN n USING (page)),
s AS (SELECT *, dense_rank() OVER (PARTITION BY page ORDER BY pos) - 1 AS nth FROM b WHERE NOT (page % 3 = 0 AND lft < 640 AND top < 0.5 * height AND top + 14 > 0))"""


@query(f"WITH {_SAFE_SQL} SELECT page, nth::INT AS nth, line, (18 * pos)::DOUBLE AS top FROM s")
def safe_line_boxes(spark, sf_dir):
    """Lines that no redaction touches, with the top of their boxes."""
    x = _pages(spark, sf_dir).select("page", F.posexplode("safe").alias("nth", "x"))
    return x.select("page", "nth", C.collapse(F.col("x.text")).alias("line"), C.box(F.col("x.polygon"))["top"].alias("top"))


@query(
    f"""WITH {_SAFE_SQL}, g AS (SELECT grp, count(DISTINCT page) AS n FROM n GROUP BY grp), f AS (SELECT grp, key, count(DISTINCT page) AS pages FROM s GROUP BY ALL),
k AS (SELECT s.page, s.pos, s.line, s.key FROM s JOIN g USING (grp) JOIN f USING (grp, key) WHERE NOT (pages >= greatest(2, ceil(g.n * 0.6)) AND ((top + 7.0) / height <= 0.14 OR (top + 7.0) / height >= 0.82)) AND NOT {noise_sql('s.line')}),
u AS (SELECT page, pos, line FROM (SELECT *, row_number() OVER (PARTITION BY page, key ORDER BY pos) AS r FROM k) WHERE r = 1)
SELECT n.page, coalesce(string_agg(u.line, chr(10) ORDER BY u.pos), '') AS text FROM n LEFT JOIN u USING (page) GROUP BY n.page"""
)
def cleaned_pages(spark, sf_dir):
    """Pages' distinct safe lines without noise and chrome that is repeated at a document's edges."""
    return C.cleaned(_pages(spark, sf_dir)).select("page", "text")


@query()
def event_texts(spark, sf_dir):
    """Each event's own lines over the pages of its group: here a page's lines belong to it and to the page before by turns."""
    pages = _pages(spark, sf_dir).withColumn("event_id", F.col("page") - F.col("page") % 2)
    return approval.event_texts(approval.owned(pages)).select("group", "event_id", F.sha2("text", 256).alias("digest"), F.length("text").alias("n_chars"))


_RENDER = f"WITH {PACK_SQL}, t AS (SELECT l_orderkey AS pack_id, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1)::INT AS position, p_name AS title, p_brand || ' <' || p_type || '> & \"' || p_size::VARCHAR || '\"' AS text FROM lineitem JOIN part ON p_partkey = l_partkey)"


def _parts(spark, sf_dir):
    """Items with a title and a text; positions count before the join, so that a part's absence leaves a gap."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("event_id"), F.col("p_name").alias("title"), F.concat("p_brand", F.lit(" <"), "p_type", F.lit('> & "'), F.col("p_size").cast("string"), F.lit('"')).alias("text"))
    return pack_items(spark, sf_dir).join(part, "event_id").select("pack_id", "position", "title", "text")


@query(rf"{_RENDER} SELECT id, '# ' || pack.title || chr(10) || chr(10) || string_agg('## ' || (position + 1)::VARCHAR || '. ' || t.title || chr(10) || chr(10) || text, chr(10) || chr(10) ORDER BY position) || chr(10) AS markdown FROM pack JOIN t ON pack_id = id GROUP BY id, pack.title")
def markdown_documents(spark, sf_dir):
    return P.markdown(packs(spark, sf_dir).select("id", "title"), _parts(spark, sf_dir))


def _escaped(x: str) -> str:
    return f"""replace(replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;')"""


@query(f"""{_RENDER} SELECT id, '<!doctype html><html><head><meta charset="utf-8"><title>' || {_escaped("pack.title")} || '</title></head><body>'
  || string_agg('<section><h2>' || {_escaped("t.title")} || '</h2><pre>' || {_escaped("text")} || '</pre></section>', '' ORDER BY position) || '</body></html>' AS html FROM pack JOIN t ON pack_id = id GROUP BY id, pack.title""")
def html_documents(spark, sf_dir):
    return P.html(packs(spark, sf_dir).select("id", "title"), _parts(spark, sf_dir))


@query(
    """WITH f AS (SELECT user_id AS id, CASE WHEN event_id % 3 = 0 THEN 'start' ELSE 'end' END AS kind, ts, event_type, CASE WHEN event_id % 11 = 1 THEN 'lost' END AS error FROM events),
s AS (SELECT id, min((ts, event_type)) FILTER (kind = 'start') AS s FROM f GROUP BY id), e AS (SELECT id, max((ts, coalesce(error, ''))) FILTER (kind = 'end') AS e FROM f GROUP BY id)
SELECT id, s[2] AS source_name, s[1] AS started_at, e[1] AS ended_at, CASE WHEN e IS NULL THEN 'running' WHEN e[2] <> '' THEN 'failed' ELSE 'stopped' END AS status FROM s JOIN e USING (id)"""
)
def session_states(spark, sf_dir):
    """Recordings' states from appended start and end facts."""
    kind = F.when(F.col("event_id") % 3 == 0, "start").otherwise("end")
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), kind.alias("kind"), F.col("ts").alias("at"), F.col("event_type").alias("source_name"), F.when(F.col("event_id") % 11 == 1, "lost").alias("error"))
    return sessions.session_states(e).drop("error")


@query(f"WITH {EV_SQL}, p AS (SELECT id FROM ev WHERE ended_at >= TIMESTAMP '{START}' ORDER BY started_at DESC, id DESC LIMIT 41 OFFSET 40) SELECT least(count(*), 40) AS n, count(*) > 40 AS more, 80 AS next_offset FROM p")
def page_of_timeline(spark, sf_dir):
    """A page, whether there are more, and where the next one begins."""
    hits = S.overlapping(events(spark, sf_dir), START).orderBy(F.desc("started_at"), F.desc("id"))
    page, more, after = S.page(hits, 40, 40)
    return page.agg(F.count(F.lit(1)).alias("n")).select("n", F.lit(more).alias("more"), F.lit(after).cast("int").alias("next_offset"))


@query(f"WITH {EV_SQL}, o AS (SELECT session_id AS s, min((started_at, id)) AS a FROM ev WHERE id IN (10, 90) GROUP BY ALL), x AS (SELECT (SELECT session_id FROM ev WHERE id = 10) AS s)"
  " SELECT ev.id FROM ev, x WHERE ev.session_id = x.s AND (started_at, id) >= (SELECT min((started_at, id)) FROM ev, x WHERE id IN (10, 90) AND session_id = x.s) AND (started_at, id) <= (SELECT max((started_at, id)) FROM ev, x WHERE id IN (10, 90) AND session_id = x.s)")
def selection_range(spark, sf_dir):
    """Events of a session from one chosen event to another; an event of another session is no end."""
    ev = events(spark, sf_dir)
    return sessions.between(ev, ev.filter("id = 10").first()["session_id"], 10, 90).select("id")


@query(f"WITH {EV_SQL} SELECT id, (row_number() OVER (ORDER BY started_at DESC, id DESC) - 1)::INT AS position FROM ev WHERE id IN (42, 7, 300, 150, 12)")
def reversed_selection(spark, sf_dir):
    chosen = P.selected(events(spark, sf_dir), [42, 7, 300, 7, 150, 12]).drop("position")
    return sessions.chronological(chosen, newest_first=True).select("id", "position")


@query("SELECT l_partkey AS event_id, min(l_orderkey) AS page FROM lineitem GROUP BY l_partkey")
def first_page_of_event(spark, sf_dir):
    each = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("page")).agg(F.collect_set("l_partkey").alias("source_event_ids"))
    return sessions.pages_of(each)


@query(f"WITH {EV_SQL}, s AS (SELECT id FROM ev ORDER BY started_at DESC, id DESC LIMIT 50) SELECT id FROM (SELECT id FROM ev ORDER BY started_at DESC, id DESC LIMIT 50 OFFSET 30) WHERE id NOT IN (SELECT id FROM s)")
def page_without_known(spark, sf_dir):
    """A further page that overlaps the one shown, without what is shown already."""
    ev = events(spark, sf_dir)
    return sessions.unknown(S.timeline(ev, limit=50, offset=30), S.timeline(ev, limit=50)).select("id")


@query(
    """WITH p AS (SELECT event_type AS provider, count(*) FILTER (value IS NULL) AS errors, avg(value) / 10 AS p95, max(value) AS peak_memory FROM events GROUP BY event_type)
SELECT provider, errors FROM p WHERE errors = 0 AND p95 <= 5 AND peak_memory <= 0.92 * 400"""
)
def eligible_providers(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("provider"))
    rows = e.agg(F.count_if(F.col("value").isNull()).alias("errors"), (F.avg("value") / 10).alias("p95"), F.max("value").alias("peak_memory"), F.lit(400.0).alias("total_memory"))
    return E.eligible(rows).select("provider", "errors")


@query("SELECT l_orderkey AS id, min(l_quantity) AS lft, max(l_quantity) AS rgt, min(l_discount) AS top, max(l_discount) AS bottom FROM lineitem GROUP BY l_orderkey")
def bounding_boxes(spark, sf_dir):
    polygon = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list(F.array("l_quantity", "l_discount")).alias("p"))
    b = polygon.select("id", C.box(F.col("p")).alias("b"))
    return b.select("id", F.col("b.left").alias("lft"), F.col("b.right").alias("rgt"), F.col("b.top").alias("top"), F.col("b.bottom").alias("bottom"))


@query(
    f"""WITH {EV_SQL}, gone AS (SELECT DISTINCT session_id AS id FROM ev WHERE id % 10 = 3 AND session_id IS NOT NULL ORDER BY id LIMIT 1), lost AS (SELECT id FROM ev WHERE session_id IN (SELECT id FROM gone)),
p AS (SELECT id, session_id, lag(id) OVER (ORDER BY id) AS previous_id FROM ev)
SELECT id, (CASE WHEN previous_id NOT IN (SELECT id FROM lost) THEN previous_id END)::DOUBLE AS previous_id FROM p WHERE id NOT IN (SELECT id FROM lost)"""
)
def delete_session(spark, sf_dir):
    """Events left after a session goes, whose references to a lost previous event are null."""
    ev = events(spark, sf_dir).select("id", "session_id")
    gone = ev.filter((F.col("id") % 10 == 3) & F.col("session_id").isNotNull()).select(F.col("session_id").alias("id")).distinct().orderBy("id").limit(1)
    before = ev.join(ev.select((F.col("id") + 1).alias("id"), F.col("id").alias("previous_event_id")), "id", "left")
    nothing = spark.createDataFrame([], "event_id long")
    left = relations.delete_sessions(gone, ev.select(F.col("session_id").alias("id")).distinct(), before, nothing, nothing)["events"]
    return left.select("id", F.col("previous_event_id").cast("double").alias("previous_id"))


@query(
    f"""WITH {PACK_SQL}, {EV_SQL}, item AS (SELECT l_partkey AS event_id FROM lineitem WHERE l_quantity >= 45), v AS (SELECT id FROM ev WHERE ended_at < TIMESTAMP '2024-01-31 06:00:00' - INTERVAL 30 DAYS AND id NOT IN (SELECT event_id FROM item))
SELECT 'expired' AS action, count(*) AS n FROM pack WHERE status = 'approved' AND expires_at <= TIMESTAMP '2024-01-31 06:00:00' UNION ALL SELECT 'retained out', count(*) FROM v UNION ALL SELECT 'kept', (SELECT count(*) FROM ev) - (SELECT count(*) FROM v)"""
)
def maintenance_round(spark, sf_dir):
    item = table(spark, sf_dir, "lineitem").filter("l_quantity >= 45").select(F.col("l_partkey").alias("event_id"))
    return relations.maintenance(packs(spark, sf_dir), events(spark, sf_dir), item, "2024-01-31 06:00:00")


@query("SELECT count(*) FILTER (event_id % 4 < 2) AS processed, count(*) FILTER (event_id % 4 = 2) AS failed, count(*) FILTER (event_id % 4 = 3) AS dropped, count(*) FILTER (event_id % 5 > 1) AS retried FROM events")
def intake_counters(spark, sf_dir):
    kind = F.when(F.col("event_id") % 4 < 2, "processed").when(F.col("event_id") % 4 == 2, "failed").otherwise("dropped")
    return relations.counters(table(spark, sf_dir, "events").select(kind.alias("outcome"), (F.col("event_id") % 5).alias("attempts")))


@query("SELECT event_id AS frame, (SELECT count(*) FROM events) - 8 AS dropped FROM events ORDER BY ts DESC, event_id DESC LIMIT 8")
def bounded_intake(spark, sf_dir):
    """The newest of a batch that a bounded queue keeps, and how many older ones it dropped."""
    e = table(spark, sf_dir, "events").select(F.struct("ts", "event_id").alias("at"), F.col("event_id").alias("frame"))
    kept, dropped = D.newest(e, 8)
    return kept.select("frame", F.lit(dropped).cast("long").alias("dropped"))


@query("SELECT user_id AS key, 'manual' AS kind, event_id AS frame, 0.0::DOUBLE AS change_score FROM events WHERE event_type = 'click'")
def manual_events(spark, sf_dir):
    """Manual events beside the detector's, here of an empty recording; they have score 0."""
    e = table(spark, sf_dir, "events").filter("event_type = 'click'").select(F.col("user_id").alias("key"), F.lit(0.0).alias("at"), F.col("event_id").alias("frame"))
    return D.with_manual(spark.createDataFrame([], D.EVENT), e).select("key", "kind", "frame", "change_score")


@query(f"WITH {EV_SQL} SELECT id FROM ev WHERE contains(lower(ocr_text), 'achte') OR contains(lower(ocr_text), 'aiaux')")
def indexed_search(spark, sf_dir):
    """The same events as a scan finds, through an inverted index of trigrams, which is made here for the query."""
    ev = events(spark, sf_dir)
    return inverted.holding(ev, inverted.grams(ev), ["achte", "aiaux", "of"]).select("id")


@query(f"WITH {EV_SQL} SELECT strftime(started_at, '%Y-%m-%d') AS day, count(*) AS n, count(*) FILTER (ocr_text <> '') AS with_text FROM ev GROUP BY 1")
def events_by_day(spark, sf_dir):
    ev = events(spark, sf_dir)
    return ev.groupBy(F.date_format("started_at", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("ocr_text") != "").alias("with_text"))


@query()
def stitched_pages(spark, sf_dir):
    """Pages of scrolled frames: each document is seen as two views of its first lines, the second one scrolled by three lines."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.slice(F.split(F.regexp_replace(F.coalesce("text", F.lit("")), r"(?<=[.!?]) ", "\n"), "\n"), 1, 12).alias("xs")).filter(F.size("xs") >= 10)
    number = lambda x: x.cast("double")
    box = lambda x, i: F.struct(x.alias("text"), F.lit(5.0).alias("left"), F.lit(200.0).alias("right"), number(20 + 18 * i).alias("top"), number(34 + 18 * i).alias("bottom"))
    views = d.select("doc_id", "xs", F.explode(F.array(F.lit(1), F.lit(4))).alias("first"))
    later = F.col("first") > 1
    frames = views.select(F.col("doc_id").cast("string").alias("session_id"), (F.col("doc_id") * 2 + later.cast("int")).alias("event_id"), F.when(later, 5.0).otherwise(0.0).alias("at"), F.lit(180).alias("height"), F.transform(F.slice("xs", F.col("first"), F.lit(7)), box).alias("lines"))
    frames = stitch.chains(frames, "at", "event_id")
    return stitch.stitched(frames, top=15, bottom=15).select("session_id", "page", "n_lines", "total_height", "confidence")


@query(f"WITH {EV_SQL}, {ITEM_SQL} SELECT ev.id, count(item.event_id) AS n_references FROM ev LEFT JOIN item ON item.event_id = ev.id GROUP BY ev.id")
def reference_counts(spark, sf_dir):
    """How many items refer to each event: items are counted before the join."""
    n = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return events(spark, sf_dir).select("id").join(n, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n_references"))

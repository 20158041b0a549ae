"""Queries over events: timeline, search, fusion, sessions, neighbours. Bounds, tokens and vectors are literals."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import ordered
from ..operators import search as S
from ..functions.vectors import hamming
from ..sources.views import EV_SQL, events, table
from .registry import query

START, END = "2024-01-01 00:10:00", "2024-01-01 12:00:00"
TOKENS = ["achte", "aiaux"]
#: Judged queries' tokens that are searched for together.
JUDGED = 20_000
HIT_SQL = "id, session_id, started_at, ended_at, substr(ocr_text, 1, 500) AS excerpt"
_BETWEEN = f"ended_at >= TIMESTAMP '{START}' AND started_at <= TIMESTAMP '{END}'"


def _vector(spark, sf_dir) -> list[float]:
    """The vector of vec_id 0, a point lookup, as a bound query."""
    row = table(spark, sf_dir, "embeddings").filter(F.col("vec_id") == 0).select("embedding").first()
    return [float(x) for x in row[0]]


def _hits(found):
    """Ranks as doubles: integers with nulls have no common form in the two engines' frames."""
    return found.withColumns({c: F.col(c).cast("double") for c in ("exact_rank", "semantic_rank")})


def _bm25_sql(where: str = "TRUE", tokens=TOKENS) -> str:
    f = lambda t: f"(CASE WHEN contains(low, '{t}') THEN (length(low) - length(replace(low, '{t}', ''))) // {len(t)} ELSE 0 END)::DOUBLE"
    idf = lambda i: f"(CASE WHEN ln((n - n{i} + 0.5) / (n{i} + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - n{i} + 0.5) / (n{i} + 0.5)) END)"
    part = lambda i, t: f"{idf(i)} * ({f(t)} * 2.2) / ({f(t)} + 1.2 * (0.25 + 0.75 * len / avg_len))"
    return f"""low AS (SELECT id, started_at, ended_at, lower(ocr_text) AS low, greatest(length(ocr_text) - 2, 0) AS len FROM ev),
stats AS (SELECT count(*) AS n, avg(len) AS avg_len, {", ".join(f"count(*) FILTER (contains(low, '{t}')) AS n{i}" for i, t in enumerate(tokens))} FROM low),
bm AS (SELECT id, round(-({" + ".join(part(i, t) for i, t in enumerate(tokens))}), 6) AS bm25 FROM low, stats
  WHERE ({" OR ".join(f"contains(low, '{t}')" for t in tokens)}) AND {where})"""


_Q = "(SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0)"


def _vector_sql(where: str = "TRUE") -> str:
    return f"""vs AS (SELECT v.vec_id AS id, round(list_inner_product(v.embedding::DOUBLE[], q.q) / sqrt(list_inner_product(v.embedding::DOUBLE[], v.embedding::DOUBLE[])), 6) AS score
  FROM embeddings v JOIN ev ON ev.id = v.vec_id, {_Q} q WHERE len(v.embedding) = len(q.q) AND list_inner_product(v.embedding::DOUBLE[], v.embedding::DOUBLE[]) > 0 AND {where}),
vt AS (SELECT *, row_number() OVER (ORDER BY score DESC, id)::INT AS semantic_rank FROM vs ORDER BY score DESC, id LIMIT 200)"""


def _hybrid_sql(limit: int, offset: int) -> str:
    return f"""WITH {EV_SQL}, {_bm25_sql()}, {_vector_sql()},
ex AS (SELECT id, row_number() OVER (ORDER BY bm25, id)::INT AS exact_rank FROM bm ORDER BY bm25, id LIMIT 200),
fu AS (SELECT id, round(coalesce(1.0 / (60 + exact_rank), 0)::DOUBLE + coalesce(1.0 / (60 + semantic_rank), 0)::DOUBLE, 9) AS score, exact_rank, semantic_rank FROM ex FULL JOIN vt USING (id))
SELECT {HIT_SQL}, fu.score AS score, exact_rank::DOUBLE AS exact_rank, semantic_rank::DOUBLE AS semantic_rank FROM fu JOIN ev USING (id) ORDER BY score DESC, started_at, id LIMIT {limit} OFFSET {offset}"""


@query(f"WITH {EV_SQL} SELECT {HIT_SQL}, 0.0::DOUBLE AS score, NULL::DOUBLE AS exact_rank, NULL::DOUBLE AS semantic_rank FROM ev WHERE {_BETWEEN} ORDER BY started_at DESC, id DESC LIMIT 50")
def timeline_page(spark, sf_dir):
    return _hits(S.timeline(events(spark, sf_dir), START, END))


@query(f"WITH {EV_SQL} SELECT {HIT_SQL}, 0.0::DOUBLE AS score, NULL::DOUBLE AS exact_rank, NULL::DOUBLE AS semantic_rank FROM ev WHERE {_BETWEEN} ORDER BY started_at DESC, id DESC LIMIT 40 OFFSET 40")
def timeline_page2(spark, sf_dir):
    return _hits(S.timeline(events(spark, sf_dir), START, END, limit=40, offset=40))


@query(f"WITH {EV_SQL} SELECT count(*) AS total FROM ev WHERE {_BETWEEN}")
def timeline_count(spark, sf_dir):
    return S.timeline_count(events(spark, sf_dir), START, END)


@query(f"WITH {EV_SQL} SELECT id, started_at FROM ev WHERE contains(translate(ocr_text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'trash') ORDER BY started_at DESC, id DESC LIMIT 200")
def like_search(spark, sf_dir):
    return S.like(events(spark, sf_dir), "TRASH").select("id", "started_at")


@query(f"WITH {EV_SQL} SELECT id FROM ev WHERE contains(lower(ocr_text), 'achte') OR contains(lower(ocr_text), 'aiaux')")
def fts_or_match(spark, sf_dir):
    return S.match_any(events(spark, sf_dir), [*TOKENS, "of"]).select("id")


@query(f"WITH {EV_SQL}, {_bm25_sql()} SELECT id, bm25 FROM bm ORDER BY bm25, id LIMIT 200")
def bm25_topk(spark, sf_dir):
    return S.bm25(events(spark, sf_dir), TOKENS).orderBy("bm25", "id").limit(S.BRANCH)


@query(f"WITH {EV_SQL}, {_bm25_sql(_BETWEEN)} SELECT id, bm25 FROM bm ORDER BY bm25, id LIMIT 200")
def bm25_topk_time(spark, sf_dir):
    return S.bm25(events(spark, sf_dir), TOKENS, START, END).orderBy("bm25", "id").limit(S.BRANCH)


@query(
    f"""WITH {EV_SQL}, {_bm25_sql()},
b AS (SELECT id, 0 AS branch, row_number() OVER (ORDER BY bm25, id) AS place FROM (SELECT * FROM bm ORDER BY bm25, id LIMIT 200)
  UNION ALL SELECT id, 1, row_number() OVER (ORDER BY started_at DESC, id DESC) FROM (SELECT * FROM ev WHERE contains(lower(ocr_text), 'ß') ORDER BY started_at DESC, id DESC LIMIT 200)),
f AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY branch, place) AS nth FROM b)
SELECT id, row_number() OVER (ORDER BY branch, place, id)::INT AS exact_rank FROM f WHERE nth = 1 ORDER BY branch, place, id LIMIT 200"""
)
def short_token_merge(spark, sf_dir):
    return S.exact_branch(events(spark, sf_dir), [*TOKENS, "ß"])


@query(f"WITH {EV_SQL}, {_vector_sql()} SELECT id, score, semantic_rank FROM vt")
def vector_topk(spark, sf_dir):
    return S.vector_top(events(spark, sf_dir, vectors=True), _vector(spark, sf_dir))


@query(f"WITH {EV_SQL}, {_vector_sql(_BETWEEN)} SELECT id, score, semantic_rank FROM vt")
def vector_topk_time(spark, sf_dir):
    return S.vector_top(events(spark, sf_dir, vectors=True), _vector(spark, sf_dir), START, END)


@query(_hybrid_sql(50, 0))
def hybrid_rrf(spark, sf_dir):
    return _hits(S.hybrid(events(spark, sf_dir, vectors=True), TOKENS, _vector(spark, sf_dir)))


@query(_hybrid_sql(40, 40))
def hybrid_rrf_page2(spark, sf_dir):
    return _hits(S.hybrid(events(spark, sf_dir, vectors=True), TOKENS, _vector(spark, sf_dir), limit=40, offset=40))


@query(
    f"""WITH {EV_SQL}, p AS (SELECT DISTINCT session_id FROM (SELECT * FROM ev WHERE {_BETWEEN} ORDER BY started_at DESC, id DESC LIMIT 50))
SELECT session_id, count(ev.id) AS n_events, min(started_at) AS first_at, max(ended_at) AS last_at FROM p LEFT JOIN ev USING (session_id) GROUP BY session_id"""
)
def session_counts(spark, sf_dir):
    ev = events(spark, sf_dir)
    shown = S.timeline(ev, START, END).select("session_id").distinct()
    counted = ev.join(F.broadcast(shown), "session_id", "left_semi").groupBy("session_id")
    counted = counted.agg(F.count("id").alias("n_events"), F.min("started_at").alias("first_at"), F.max("ended_at").alias("last_at"))
    return shown.join(counted, "session_id", "left").withColumn("n_events", F.coalesce("n_events", F.lit(0)))


@query(f"WITH {EV_SQL} SELECT session_id, id, row_number() OVER (PARTITION BY session_id ORDER BY started_at, id)::INT AS nth FROM ev WHERE {_BETWEEN}")
def session_timeline(spark, sf_dir):
    ev = S.overlapping(events(spark, sf_dir), START, END).select("session_id", "id", "started_at")
    return ordered.ranked(ev, "session_id", "started_at", "id").select("session_id", "id", F.col("nth").cast("int").alias("nth"))


@query(
    f"""WITH {EV_SQL}, o AS (SELECT started_at AS t FROM ev WHERE id = 100)
(SELECT id, 'before' AS side FROM ev, o WHERE started_at < t ORDER BY started_at DESC, id DESC LIMIT 2)
UNION ALL (SELECT id, 'after' FROM ev, o WHERE started_at > t ORDER BY started_at, id LIMIT 2)"""
)
def event_neighbors(spark, sf_dir):
    return S.neighbours(events(spark, sf_dir), 100).select("id", "side")


@query(f"WITH {EV_SQL} SELECT id, (lag(id) OVER (PARTITION BY session_id ORDER BY started_at, id))::DOUBLE AS previous_id FROM ev")
def prev_event(spark, sf_dir):
    return S.with_previous(events(spark, sf_dir).select("id", "session_id", "started_at")).select("id", F.col("previous_id").cast("double").alias("previous_id"))


@query(
    f"""WITH {EV_SQL}, w AS (SELECT id, list(id) OVER (PARTITION BY session_id ORDER BY started_at, id ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS b,
  list(id) OVER (PARTITION BY session_id ORDER BY started_at, id ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING) AS a FROM ev)
SELECT id, coalesce(array_to_string(b, ','), '') AS before_ids, coalesce(array_to_string(a, ','), '') AS after_ids FROM w"""
)
def neighbor_windows(spark, sf_dir):
    ids = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return S.with_neighbours(events(spark, sf_dir).select("id", "session_id", "started_at")).select("id", ids("before_ids"), ids("after_ids"))


@query(f"WITH {EV_SQL} SELECT id, started_at FROM ev WHERE processed_at IS NULL ORDER BY started_at, id LIMIT 100")
def pending_queue(spark, sf_dir):
    return events(spark, sf_dir).filter(F.col("processed_at").isNull()).orderBy("started_at", "id").limit(100).select("id", "started_at")


@query(f"WITH {EV_SQL} SELECT count(*) AS pending FROM ev WHERE processed_at IS NULL")
def pending_count(spark, sf_dir):
    return events(spark, sf_dir).filter(F.col("processed_at").isNull()).agg(F.count(F.lit(1)).alias("pending"))


@query("SELECT count(*) AS n, coalesce(max(vec_id), 0) AS max_id FROM embeddings WHERE len(embedding) = 64")
def cache_signature(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").filter(F.size("embedding") == 64)
    return v.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max("vec_id"), F.lit(0)).alias("max_id"))


@query("SELECT vec_id, label FROM embeddings WHERE vec_id > 400 AND len(embedding) = 64")
def incremental_delta(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").filter((F.col("vec_id") > 400) & (F.size("embedding") == 64)).select("vec_id", "label")


@query("SELECT vec_id, round(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm FROM embeddings")
def vector_norms(spark, sf_dir):
    from ..functions.vectors import norm

    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(norm(F.col("embedding")), 6).alias("norm"))


@query("WITH h AS (SELECT doc_id, substr(sha256(coalesce(text, '')), 1, 16) AS h FROM documents), b AS (SELECT doc_id, ('0x' || h)::UBIGINT AS h FROM h) SELECT x.doc_id, bit_count(xor(x.h, y.h))::INT AS distance FROM b x JOIN b y ON y.doc_id = x.doc_id + 1")
def phash_hamming(spark, sf_dir):
    h = table(spark, sf_dir, "documents").select("doc_id", F.substring(F.sha2(F.coalesce("text", F.lit("")), 256), 1, 16).alias("h"))
    after = h.select((F.col("doc_id") - 1).alias("doc_id"), F.col("h").alias("next"))
    return h.join(after, "doc_id").select("doc_id", hamming(F.col("h"), F.col("next")).alias("distance"))


@query(
    f"""WITH {EV_SQL}, q AS (SELECT item_id, lower(regexp_extract(text, '[\\p{{L}}\\p{{N}}_\\-.]+')) AS token FROM benchmark)
SELECT item_id, count(ev.id) AS n_events, min(ev.id)::DOUBLE AS first_event FROM q LEFT JOIN ev ON contains(lower(ev.ocr_text), q.token) GROUP BY item_id"""
)
def judged_first_token(spark, sf_dir):
    """Each judged query's first token against all events: one scan for some ten thousand different tokens."""
    from ..functions.text import query_tokens

    q = table(spark, sf_dir, "benchmark").select("item_id", F.lower(F.get(query_tokens(F.col("text")), F.lit(0))).alias("token"))
    ev, tokens = events(spark, sf_dir).select("id", "ocr_text"), q.select("token").filter(F.col("token") != "").distinct()
    found, parts = None, max(1, math.ceil(tokens.count() / JUDGED))
    for i in range(parts):
        some = [r["token"] for r in tokens.filter(F.pmod(F.xxhash64("token"), F.lit(parts)) == i).collect()]  # about JUDGED
        hits = S.holding_tokens(ev, some)
        found = hits if found is None else found.unionByName(hits)
    out = q.join(found, "token", "left")
    return out.select("item_id", F.coalesce("n_events", F.lit(0)).alias("n_events"), F.col("first_event").cast("double").alias("first_event"))

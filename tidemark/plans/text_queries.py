"""Queries over the lines and texts of documents, and over measures of extraction and retrieval."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from ..functions.noise import EXTENSIONS, collapsed_is_noise, noise_sql
from ..functions.text import character_error_rate, collapse, escape_html, normalise_text, normalised, query_tokens
from ..operators import cleaning as C
from ..operators import evaluate as E
from ..sources.views import events, table
from .registry import query

LINES_SQL = r"""raw AS (SELECT source AS "group", doc_id AS page, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
ln AS (SELECT "group", page, pos::INT AS pos, trim(regexp_replace(raw, '\s+', ' ', 'g')) AS line FROM raw),
l AS (SELECT *, lower(line) AS key FROM ln WHERE line <> '')"""


def _lines(spark, sf_dir):
    pages = table(spark, sf_dir, "documents").select(F.col("source").alias("group"), F.col("doc_id").alias("page"), F.col("text").alias("ocr_text"))
    return C.exploded(pages)


@query(f'WITH {LINES_SQL} SELECT "group", key, count(DISTINCT page) AS pages FROM l GROUP BY ALL')
def line_document_frequency(spark, sf_dir):
    return C.document_frequency(_lines(spark, sf_dir))


@query(
    f"""WITH {LINES_SQL}, n AS (SELECT source AS "group", count(DISTINCT doc_id) AS n FROM documents GROUP BY ALL), f AS (SELECT "group", key, count(DISTINCT page) AS pages FROM l GROUP BY ALL)
SELECT "group", key, pages FROM f JOIN n USING ("group") WHERE pages >= greatest(2, ceil(n * 0.05))"""
)
def repeated_chrome_lines(spark, sf_dir):
    """Lines of at least a twentieth of a group's pages; the rule of a document, 0.6 of its pages, finds none here."""
    rows = _lines(spark, sf_dir)
    n = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("group")).agg(F.count_distinct("doc_id").alias("n"))
    often = C.document_frequency(rows).join(F.broadcast(n) if n.count() < 100_000 else n, "group")
    return often.filter(F.col("pages") >= F.greatest(F.lit(2), F.ceil(F.col("n") * 0.05))).select("group", "key", "pages")


@query(f'WITH {LINES_SQL} SELECT "group", page, pos, key FROM (SELECT *, row_number() OVER (PARTITION BY page, key ORDER BY pos) AS r FROM l) WHERE r = 1')
def line_first_occurrence(spark, sf_dir):
    return C.first_occurrences(_lines(spark, sf_dir)).select("group", "page", "pos", "key")


@query(f'WITH {LINES_SQL} SELECT page, pos, {noise_sql("line")} AS noise FROM l')
def noise_classifier(spark, sf_dir):
    return _lines(spark, sf_dir).select("page", "pos", collapsed_is_noise(F.col("line"), F.col("key")).alias("noise"))


@query(
    f"""WITH {LINES_SQL}, u AS (SELECT page, line, row_number() OVER (PARTITION BY page ORDER BY pos) AS r FROM l WHERE NOT {noise_sql("line")})
SELECT d.doc_id, coalesce(string_agg(CASE WHEN length(line) > 140 THEN substr(line, 1, 137) || '...' ELSE line END, chr(10) ORDER BY r), '') AS important
FROM documents d LEFT JOIN (SELECT * FROM u WHERE r <= 8) u ON u.page = d.doc_id GROUP BY d.doc_id"""
)
def important_lines(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.array_join(C.important(normalised(F.coalesce("text", F.lit("")))), "\n").alias("important"))


@query(
    rf"""WITH {LINES_SQL}, f AS (SELECT *, regexp_extract(line, '(?i)(.+?\.(?:{EXTENSIONS}))', 1) AS found FROM l),
t AS (SELECT *, substr(line, length(found) + 1) AS rest_of, trim(list_last(regexp_split_to_array(regexp_replace(trim(regexp_replace(found, '(?i)\s*[-–—]\s*(PowerPoint|Word|Excel|Adobe Acrobat|Google Chrome|Microsoft Edge).*$', '')), '(?i)\.(?:{EXTENSIONS})$', ''), '\s*(?:>|\\|/)\s*'))) AS name FROM f),
c AS (SELECT "group", page, pos, 1 AS kind, name AS value FROM t WHERE found <> '' AND name <> '' AND NOT regexp_matches(rest_of, '^[ぁ-んァ-ヶー一-龠]')
  UNION ALL SELECT "group", page, pos, 0, line FROM t WHERE length(line) BETWEEN 5 AND 100 AND NOT {noise_sql("line")}),
g AS (SELECT "group", kind, value, count(*) AS n, min((page, pos)) AS first FROM c GROUP BY ALL)
SELECT "group", value AS title FROM (SELECT *, row_number() OVER (PARTITION BY "group" ORDER BY kind DESC, n DESC, length(value) DESC, first) AS r FROM g) WHERE r = 1"""
)
def auto_title(spark, sf_dir):
    return C.automatic_titles(_lines(spark, sf_dir))


@query(r"SELECT item_id, len(regexp_extract_all(text, '[\p{L}\p{N}_\-.]+')[1:32])::INT AS n_tokens, array_to_string(regexp_extract_all(text, '[\p{L}\p{N}_\-.]+')[1:32], ' ') AS tokens FROM benchmark")
def query_tokenizer(spark, sf_dir):
    t = query_tokens(F.col("text"))
    return table(spark, sf_dir, "benchmark").select("item_id", F.size(t).alias("n_tokens"), F.array_join(t, " ").alias("tokens"))


@query(r"""SELECT doc_id, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS escaped FROM documents""")
def html_escape(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", escape_html(F.col("text")).alias("escaped"))


@query(r"SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS collapsed FROM documents")
def whitespace_collapse(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", collapse(F.col("text")).alias("collapsed"))


@query()
def nfkc_normalize(spark, sf_dir):
    """Whole texts in normal form, by digest; no SQL has this normalisation."""
    t = table(spark, sf_dir, "documents").select("doc_id", normalise_text("text").alias("text"))
    return t.select("doc_id", F.sha2("text", 256).alias("digest"), F.length("text").alias("n_chars"))


@query()
def cer_macro(spark, sf_dir):
    """Error rate of a reading that lost its first three characters and reads m for rn, against each whole text.

    The SQL side counts bytes and takes the square of a text's length, so a test holds it against brute force.
    """
    cases = events(spark, sf_dir).select("session_id", F.col("ocr_text").alias("truth"), F.replace(F.substring("ocr_text", 4, 1 << 30), F.lit("rn"), F.lit("m")).alias("found"))
    rated = cases.select(F.col("session_id").alias("category"), character_error_rate(F.col("truth"), F.col("found")).alias("value"))
    return E.micro_and_macro(rated)


@query(
    """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type, max(CASE WHEN i = round_even((n - 1) * 0.5, 0) THEN value END) AS p50, max(CASE WHEN i = round_even((n - 1) * 0.95, 0) THEN value END) AS p95 FROM r GROUP BY event_type"""
)
def latency_nearest_rank(spark, sf_dir):
    return E.nearest_ranks(table(spark, sf_dir, "events").select(F.col("event_type"), "value"), "event_type", {"p50": 0.5, "p95": 0.95})


@query(
    """WITH r AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY round(list_sum(embedding::DOUBLE[]), 6) DESC, vec_id) AS rank FROM embeddings)
SELECT label, count(*) FILTER (rank <= 1 AND vec_id % 2 = 0) AS top1, count(*) FILTER (rank <= 5 AND vec_id % 2 = 0) AS top5 FROM r GROUP BY label"""
)
def topk_hits(spark, sf_dir):
    """Hits among the first and the first five of each ranking; even ids stand for the judged ones."""
    total = F.round(F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda a, x: a + x), 6)
    v = table(spark, sf_dir, "embeddings").select(F.col("label").alias("query"), F.col("vec_id").alias("id"), total.alias("score"))
    ranked = v.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "id")))
    return E.top_hits(ranked.withColumn("expected", F.col("id") % 2 == 0), [1, 5]).withColumnRenamed("query", "label")


@query(
    """WITH c AS (SELECT event_type, user_id % 5 AS provider, avg(value) AS v FROM events GROUP BY ALL), m AS (SELECT provider, round(avg(v), 6) AS macro FROM c GROUP BY provider)
SELECT provider, macro FROM m ORDER BY macro, provider LIMIT 1"""
)
def best_provider(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 5).alias("provider"), F.col("event_type").alias("category"), "value")
    return E.best_provider(rows)


@query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def json_props_extract(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("SELECT event_id, event_type, CASE WHEN props IS NOT NULL THEN json_object('event_id', event_id, 'event_type', event_type) END AS packed FROM events WHERE event_id < 1000000")
def json_serialise(spark, sf_dir):
    """Every event; the SQL leaves out ids from 1,000,000 on, which only tables above sf 1 have."""
    return table(spark, sf_dir, "events").select("event_id", "event_type", F.when(F.col("props").isNotNull(), F.to_json(F.struct("event_id", "event_type"), {"ignoreNullFields": "false"})).alias("packed"))

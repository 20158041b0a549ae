import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.operators import search as S
from tidemark.operators.enrich import HashEmbedder

BASE = dt.datetime(2026, 1, 1)


def events(spark, texts, embed=None, step=1):
    embed = embed or HashEmbedder().encode_document
    rows = [(i, "session", BASE + dt.timedelta(seconds=step * i), BASE + dt.timedelta(seconds=step * i), t, embed(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "id long, session_id string, started_at timestamp_ntz, ended_at timestamp_ntz, ocr_text string, embedding array<float>")


def ids(df):
    return [r["id"] for r in df.collect()]


def test_hybrid_finds_identifier_and_words(spark):
    ev = events(spark, ["error code ZX-4471 in module", "the quick report of the week", "nothing to see"])
    e = HashEmbedder()
    assert ids(S.hybrid(ev, ["ZX-4471"], e.encode_query("ZX-4471")))[0] == 0
    assert ids(S.hybrid(ev, ["weekly"], e.encode_query("report of the week")))[0] == 1
    assert ids(S.hybrid(ev, ["quick"], None)) == [1]  # no query vector: the exact branch alone


def test_time_filter_and_neighbours(spark):
    ev = events(spark, ["a note", "a note"], step=20)
    assert ids(S.timeline(ev, "2026-01-01T00:00:10Z")) == [1]
    assert ids(S.neighbours(ev, 1)) == [0]
    assert ids(S.neighbours(ev, 99)) == []


def test_invalid_bound_raises():
    with pytest.raises(ValueError):
        S.bound("yesterday")


def test_japanese_substrings(spark):
    ev = events(spark, ["東京都の天気予報です", "大阪"])
    assert ids(S.exact_branch(ev, ["天気予報"])) == [0]
    assert ids(S.exact_branch(ev, ["天気"])) == [0]


def test_short_and_long_tokens(spark):
    ev = events(spark, ["alpha beta", "only xy here"])
    assert ids(S.exact_branch(ev, ["alpha", "xy"])) == [0, 1]


def test_wildcards_are_plain_in_substring_search(spark):
    ev = events(spark, ["100% sure", "100 percent", "under_score"])
    assert ids(S.like(ev, "0%")) == [0]
    assert ids(S.like(ev, "r_s")) == [2]


def test_other_dimensions_and_zero_vectors(spark):
    e = HashEmbedder().encode_document
    vectors = {"one": e("one"), "other": [1.0] * 7, "zero": [0.0] * 32, "none": None}
    ev = events(spark, ["one", "other", "zero", "none"], embed=vectors.get)
    assert ids(S.vector_top(ev, e("one"))) == [0]


def test_pages_are_disjoint_and_complete(spark):
    ev = events(spark, [f"note {i}" for i in range(65)])
    hits = ev.orderBy(F.desc("started_at"), F.desc("id"))
    first, more, at = S.page(hits, 40)
    assert (len(ids(first)), more, at) == (40, True, 40)
    second, more, at = S.page(hits, 40, 40)
    assert (len(ids(second)), more, at) == (25, False, None)
    assert not set(ids(first)) & set(ids(second))


def test_fusion_is_symmetric(spark):
    a = spark.createDataFrame([(1, 1), (2, 2)], "id long, exact_rank int")
    b = spark.createDataFrame([(2, 1), (3, 2)], "id long, semantic_rank int")
    swapped = S.fuse(b.withColumnRenamed("semantic_rank", "exact_rank"), a.withColumnRenamed("exact_rank", "semantic_rank"))
    assert {r["id"]: r["score"] for r in S.fuse(a, b).collect()} == {r["id"]: r["score"] for r in swapped.collect()}


def test_overlapping_occurrences(spark):
    ev = events(spark, ["aaaaa", "banana bandana"])
    from tidemark.functions.text import occurrences

    assert [r[0] for r in ev.orderBy("id").select(occurrences(F.col("ocr_text"), "aaa")).collect()] == [3, 0]
    assert [r[0] for r in ev.orderBy("id").select(occurrences(F.col("ocr_text"), "ana")).collect()] == [0, 3]


def test_bm25_equals_sqlite(spark):
    import sqlite3

    texts = ["alpha beta gamma", "alpha alpha delta delta", "beta", "gamma delta epsilon zeta", "nothing here at all"] * 3
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE f USING fts5(t, tokenize='trigram')")
    con.executemany("INSERT INTO f(rowid, t) VALUES (?, ?)", list(enumerate(texts)))
    theirs = {i: round(s, 6) for i, s in con.execute("SELECT rowid, bm25(f) FROM f WHERE f MATCH '\"alpha\" OR \"delta\"'")}
    ours = {r["id"]: r["bm25"] for r in S.bm25(events(spark, texts), ["alpha", "delta"]).collect()}
    assert ours == theirs

"""Serving, approval, relations, the inverted index, cached vectors, times, files and pictures."""

import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import frames as P
from tidemark.functions import times as T
from tidemark.functions.text import decoded, embedding_input, encoded
from tidemark.operators import approval, inverted, relations, serving, stitch
from tidemark.operators import search as S
from tidemark.operators.vector_cache import VectorCache
from tidemark.sources import generate, sinks

EVENTS = "id long, session_id string, started_at timestamp_ntz, ended_at timestamp_ntz, ocr_text string, processed_at timestamp_ntz, embedding array<float>"


@pytest.fixture(scope="module")
def ev(spark):
    at = dt.datetime(2026, 1, 1)
    rows = [(i, "ab"[i % 2], at + dt.timedelta(seconds=i), at + dt.timedelta(seconds=i), f"event {i} of the Zebra" if i % 3 else f"other {i}", at if i % 4 else None, [1.0, float(i)]) for i in range(65)]
    return spark.createDataFrame(rows, EVENTS)


def test_results_and_detail(ev):
    first, second = serving.results(ev, [], limit=40), serving.results(ev, [], limit=40, offset=40)
    assert len(first["events"]) == 40 and first["has_more"] and first["next_offset"] == 40 and first["total"] == 65
    assert len(second["events"]) == 25 and not second["has_more"] and not {e["id"] for e in first["events"]} & {e["id"] for e in second["events"]}
    assert {s["id"]: s["event_count"] for s in first["sessions"]} == {"a": 33, "b": 32}
    found = serving.results(ev, ["zebra"], limit=3)
    assert found["total"] is None and found["has_more"] and all("Zebra" in e["excerpt"] for e in found["events"])
    one = serving.detail(ev, 10)
    assert one["started_at"] == "2026-01-01T00:00:10+00:00" and [e["id"] for e in one["before"]] == [9, 8] and [e["id"] for e in one["after"]] == [11, 12]
    assert serving.detail(ev, 999) is None


def test_status_and_resources(ev):
    got = json.loads(serving.status(ev, F.lit(5), 10, 3, 2).first()["status"])
    assert got == {"storage": {"used_bytes": 5, "limit_bytes": 10, "free_bytes": 3, "has_capacity": True}, "index": {"events": 65, "pending": 17}}
    assert serving.resource("p", "a.html", "<p>é".encode())["text"] == "<p>é"
    assert serving.resource("p", "a.pdf", b"\x00")["blob"] == "AA=="


def packs_of(spark, status="draft"):
    at = dt.datetime(2026, 1, 1)
    return spark.createDataFrame([(1, "A <b>", "q", "n", status, at, at + dt.timedelta(hours=24), None)], "id long, title string, query string, note string, status string, created_at timestamp_ntz, expires_at timestamp_ntz, approved_at timestamp_ntz")


def test_approval(spark, tmp_path):
    now, root = dt.datetime(2026, 2, 1), f"file://{tmp_path}"
    items = spark.createDataFrame([(1, 0, 7), (1, 1, 5)], "pack_id long, position int, event_id long")
    texts = spark.createDataFrame([(1, 0, "t", "x & y"), (1, 1, "u", "z")], "pack_id long, position int, title string, text string")
    got = approval.approve(packs_of(spark), items, texts, 1, root, now, hours=2)
    assert got["status"] == "approved" and got["expires_at"] == now + dt.timedelta(hours=2)
    manifest = json.loads((tmp_path / "1" / "manifest.json").read_text())
    assert [i["event_id"] for i in manifest["items"]] == [7, 5] and "x &amp; y" in (tmp_path / "1" / "context.html").read_text()
    failed = approval.approve(packs_of(spark, "approved"), items.limit(0), texts, 1, root, now)
    assert failed["status"] == "draft" and "no items" in failed["build_error"] and (tmp_path / "1" / "manifest.json").exists()
    assert sorted(p.name for p in tmp_path.iterdir()) == ["1"]
    with pytest.raises(ValueError):
        approval.approve(packs_of(spark, "revoked"), items, texts, 1, root, now)
    assert json.loads(serving.public_list(packs_of(spark, "approved"), "2026-01-01 01:00:00"))[0]["id"] == 1
    with pytest.raises(ValueError):
        serving.public_list(packs_of(spark), now, " ")


def test_event_texts(spark):
    line = lambda t, y: (t, 0.9, [[0.0, y], [50.0, y + 10]])
    rows = [("g", p, p, 100, [line("head line here", 2.0), line(f"text of page {p}", 40.0 + p), line("12:30", 90.0)]) for p in range(3)]
    pages = spark.createDataFrame(rows, "group string, page long, event_id long, height int, safe array<struct<text:string,confidence:double,polygon:array<array<double>>>>")
    got = {r["event_id"]: r["text"] for r in approval.event_texts(approval.owned(pages)).collect()}
    assert got == {p: f"head line here\ntext of page {p}" for p in range(3)}
    both = {r["event_id"]: r["text"] for r in approval.event_texts(approval.owned(pages.withColumn("event_id", F.lit(9)))).collect()}
    assert both == {9: "text of page 0\ntext of page 1\ntext of page 2"}  # the head is repeated at the top of its three pages


def test_event_texts_equal_cleaned_pages_in_one_scan(spark):
    import random

    from tidemark.operators import cleaning as C

    random.seed(5)
    words = ["Head line", "head LINE", "12:30", "a body  line", "é texte", "x", "", "foot words here", None]
    line = lambda i: (random.choice(words), 0.9, random.choice([[], [[0.0, i * 10.0], [50.0, i * 10.0 + 8]]]), random.randrange(2))
    rows = [(f"g{p % 3}", p, 100, [line(i) for i in range(10)]) for p in range(30)]
    pages = spark.createDataFrame(rows, "group string, page long, height int, safe array<struct<text:string,confidence:double,polygon:array<array<double>>,event_id:long>>")
    texts = approval.event_texts(pages)
    want = {}
    for e in range(2):
        own = pages.withColumn("safe", F.filter("safe", lambda x: x["event_id"] == e)).filter(F.size("safe") > 0)  # noqa: B023
        for r in C.cleaned(own).orderBy("page").collect():
            want.setdefault((r["group"], e), []).extend([r["text"]] if r["text"] else [])
    assert {(r["group"], r["event_id"]): r["text"] for r in texts.collect()} == {k: "\n".join(v) for k, v in want.items()}
    plan = texts._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate posexplode") == 1


def test_noise_is_judged_on_a_line_made_once(spark):
    from tidemark.functions.noise import collapsed_is_noise
    from tidemark.functions.text import collapse

    lines = spark.range(1).select(F.col("id").cast("string").alias("raw")).select(collapse(F.col("raw")).alias("line"))
    plan = lines.filter(~collapsed_is_noise(F.col("line"))).select("line")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("(?U)") <= 3  # what the filter binds, its lower case, and the line itself


def test_relations(spark):
    ev = spark.createDataFrame([(1, "a", None), (2, "b", 1), (3, "b", 2), (4, None, 3)], "id long, session_id string, previous_event_id long")
    sessions, evidence = spark.createDataFrame([("a",), ("b",)], "id string"), spark.createDataFrame([(1, "x"), (2, "y")], "event_id long, text string")
    gone, items = spark.createDataFrame([("a",)], "id string"), spark.createDataFrame([(2,)], "event_id long")
    left = relations.delete_sessions(gone, sessions, ev, evidence, items)
    assert sorted((r["id"], r["previous_event_id"]) for r in left["events"].collect()) == [(2, None), (3, 2), (4, 3)]
    assert [r["event_id"] for r in left["evidence"].collect()] == [2] and [r["id"] for r in left["sessions"].collect()] == ["b"]
    with pytest.raises(ValueError):
        relations.delete_sessions(gone, sessions, ev, evidence, spark.createDataFrame([(1,)], "event_id long"))


def test_inverted_index(spark, ev, tmp_path):
    path, ids = f"{tmp_path}/index", lambda d: sorted(r["id"] for r in d.collect())
    old, new = ev.filter("id < 30"), ev.filter("id >= 30")
    inverted.build(old, path)
    tokens = ["ZEBRA", "er 6", "of"]
    want = lambda d: ids(S.match_any(d, tokens))
    assert ids(inverted.holding(old, inverted.read(spark, path), tokens)) == want(old)
    inverted.add(new, path)
    assert ids(inverted.holding(ev, inverted.read(spark, path), tokens)) == want(ev)
    inverted.remove(spark, ev.filter("id % 2 = 0"), path)
    left = inverted.read(spark, path)
    assert ids(inverted.candidates(left, ["zebra"])) == [i for i in range(65) if i % 2 and i % 3]
    assert ids(inverted.candidates(left, ["of"])) == []


def test_vector_cache(ev):
    cache = VectorCache(2)
    assert cache.refresh(ev.filter("id < 10")).count() == 10 and cache.signature == (2, 10, 9)
    assert cache.refresh(ev).count() == 65 and cache.signature == (2, 65, 64) and len(cache.parts) == 2
    assert cache.refresh(ev).count() == 65 and len(cache.parts) == 2
    cache.invalidate()
    assert cache.parts == [] and cache.refresh(ev).count() == 65
    cache.invalidate()


def test_long_vectors(spark):
    ev = generate.events(spark, 300, 200)
    rows = {r["id"]: np.array(r["embedding"], float) for r in ev.collect()}
    assert all(abs(np.linalg.norm(v) - 1) < 1e-5 for v in rows.values())
    odd = spark.createDataFrame([(1000, [0.0] * 200), (1001, [float("nan")] * 200), (1002, [1.0])], "id long, embedding array<float>")
    every = ev.unionByName(odd, allowMissingColumns=True)
    query = [1.0] + [0.0] * 199
    got = [(r["id"], r["score"]) for r in S.vector_top(every, query, limit=20).orderBy("semantic_rank").collect()]
    want = sorted(((i, round(float(v[0] / np.linalg.norm(v)), 6)) for i, v in rows.items()), key=lambda r: (-r[1], r[0]))[:20]
    assert [s for _, s in got] == pytest.approx([s for _, s in want[: len(got)]], abs=2e-6) and len(got) >= 19  # what isn't finite takes a place


def test_times_and_encodings(spark):
    rows = [("2026-01-01T00:00:10Z",), ("2026-01-01T09:00:10.5+09:00",), ("2026-01-01 00:00:10",), ("soon",), ("",), (None,)]
    df = spark.createDataFrame(rows, "t string").select("t", T.utc_iso(F.col("t")).alias("iso"), T.displayed(F.col("t"), "Asia/Tokyo").alias("shown"))
    assert [r["iso"] for r in df.collect()] == ["2026-01-01T00:00:10+00:00", "2026-01-01T00:00:10.500000+00:00", "2026-01-01T00:00:10+00:00", "soon", "", None]
    assert [r["shown"] for r in df.collect()] == ["2026/01/01 09:00:10 JST"] * 3 + ["soon", "-", "-"]
    x = spark.createDataFrame([("é" * 90,), (" ",), (None,)], "t string").select(decoded(encoded(F.col("t"))).alias("same"), embedding_input(F.col("t"), "query").alias("q")).collect()
    assert [r["same"] for r in x] == ["é" * 90, " ", None] and [r["q"] for r in x] == ["query: " + "é" * 90, None, None]


def test_files(spark, tmp_path):
    inside, outside = tmp_path / "root" / "a.bin", tmp_path / "b.bin"
    inside.parent.mkdir()
    inside.write_bytes(b"12345"), outside.write_bytes(b"1")
    freed = sinks.remove_paths(spark, str(tmp_path / "root"), [str(inside), str(outside), f"{tmp_path}/root/../b.bin", f"{tmp_path}/root/none"])
    assert freed == 5 and not inside.exists() and outside.exists()
    table = str(tmp_path / "t")
    spark.range(5).write.parquet(table)
    sinks.rewrite(spark.read.parquet(table).filter("id > 2"), table)
    assert spark.read.parquet(table).count() == 2 and sorted(p.name for p in tmp_path.iterdir()) == ["b.bin", "root", "t"]


def test_pictures_of_scrolled_pages():
    rng = np.random.default_rng(1)
    tall = rng.integers(0, 255, (300, 64, 3), dtype=np.uint8)
    head, foot = np.full((10, 64, 3), 9, np.uint8), np.full((12, 64, 3), 7, np.uint8)
    view = lambda at: np.concatenate([head, tall[at : at + 100], foot])
    whole = P.canvas([(view(0), 0), (view(54), 54)], 10, 12)
    assert (whole == np.concatenate([head, tall[:154], foot])).all()
    see = stitch.seen_in({1: view(0), 2: view(54)}, 10, 12)
    assert see(1, 2, 54) == 1.0 and see(1, 2, 30) < 0.5 and see(1, 3, 0) == 0.0

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tidemark import schema
from tidemark.operators import enrich, evaluate, packs as P
from tidemark.sources import readers, sinks

NOW = dt.datetime(2026, 3, 1)


def documents(spark):
    rows = [(1, "a", "q", "n", "approved", NOW, NOW + dt.timedelta(hours=1)), (2, "b", "q", "n", "approved", NOW, NOW), (3, "c", "q", "n", "draft", NOW, NOW + dt.timedelta(days=1))]
    return spark.createDataFrame(rows, "id long, title string, query string, note string, status string, created_at timestamp_ntz, expires_at timestamp_ntz")


def test_expiry_and_revoke(spark):
    d = documents(spark)
    assert [r["id"] for r in P.listed(d, NOW, approved_only=True).collect()] == [1]
    assert {r["id"]: r["s"] for r in d.select("id", P.status_at(NOW).alias("s")).collect()} == {1: "approved", 2: "expired", 3: "draft"}
    assert {r["id"]: r["status"] for r in P.revoke(P.revoke(d, 2, NOW), 3, NOW).collect()} == {1: "approved", 2: "revoked", 3: "draft"}
    assert P.readable(d, NOW, 2).isEmpty()
    with pytest.raises(ValueError):
        P.search(d, NOW, "  ")


def test_window():
    old = (NOW - dt.timedelta(days=30), NOW - dt.timedelta(days=29))
    assert P.window(*old, NOW, 2, True) == (NOW, NOW + dt.timedelta(hours=2))
    assert P.window(*old, NOW, None, True) == old
    with pytest.raises(ValueError):
        P.window(*old, NOW, 0, True)


def test_retention_keeps_referenced(spark):
    ev = spark.createDataFrame([(1, NOW - dt.timedelta(days=40)), (2, NOW - dt.timedelta(days=40)), (3, NOW)], "id long, ended_at timestamp_ntz")
    items = spark.createDataFrame([(2,)], "event_id long")
    assert [r["id"] for r in P.retention_victims(ev, items, NOW).collect()] == [1]


def test_bounded_delete_guards(spark):
    ev = spark.createDataFrame([(1, NOW, NOW)], "id long, started_at timestamp_ntz, ended_at timestamp_ntz")
    items = spark.createDataFrame([], "event_id long")
    for kw in ({"confirm": True}, {"start": NOW}):
        with pytest.raises(ValueError):
            P.deleted(ev, items, **kw)
    victims, left = P.deleted(ev, items, start=NOW, confirm=True)
    assert victims.count() == 1 and left.count() == 0


def test_selected_order(spark):
    ev = spark.createDataFrame([(i,) for i in range(20)], "id long")
    assert [r["id"] for r in P.selected(ev, [9, 3, 9, 15]).orderBy("position").collect()] == [9, 3, 15]
    for bad in ([], list(range(201))):
        with pytest.raises(ValueError):
            P.selected(ev, bad)


def test_renders(spark):
    d = documents(spark)
    texts = spark.createDataFrame([(1, 1, "t2", "<b>"), (1, 0, "t1", "x & y")], "pack_id long, position int, title string, text string")
    assert P.markdown(d, texts).first()["markdown"] == "# a\n\n## 1. t1\n\nx & y\n\n## 2. t2\n\n<b>\n"
    html = P.html(d, texts).first()["html"]
    assert "x &amp; y" in html and "&lt;b&gt;" in html and html.index("t1") < html.index("t2")
    items = spark.createDataFrame([(1, 7, 0), (1, 5, 1)], "pack_id long, event_id long, position int")
    m = json.loads(P.manifest_json(d, items).first()["manifest"])
    assert m["schema_version"] == 3 and [i["event_id"] for i in m["items"]] == [7, 5]


def test_publish_and_read(spark, tmp_path):
    to = sinks.publish(spark, str(tmp_path), "p1", {"schema_version": 3, "id": "p1", "items": [{"position": 0, "event_id": 7}]}, "# t", "<p>")
    assert readers.manifest(spark, f"{to}/manifest.json").first()["items"][0]["event_id"] == 7
    with pytest.raises(TypeError):
        sinks.publish(spark, str(tmp_path), "p1", {"x": object()}, "", "")
    assert (tmp_path / "p1/context.md").read_text() == "# t" and not list(tmp_path.glob(".p1*"))


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, NOW), (2, NOW + dt.timedelta(days=1))], "id long, started_at timestamp_ntz")
    sinks.append_by_day(rows, str(tmp_path / "ev"))
    back = spark.read.parquet(str(tmp_path / "ev"))
    assert back.filter("day = '2026-03-01'").count() == 1
    sinks.append(rows, str(tmp_path / "t"))
    sinks.rewrite(spark.read.parquet(str(tmp_path / "t")).filter("id = 2"), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 1
    sinks.report(rows.select("id"), str(tmp_path / "r"), "Report")
    assert "| id |" in (tmp_path / "r.md").read_text()
    assert readers.used_bytes(spark, str(tmp_path / "r.md")).first()["n_files"] == 1
    assert sinks.numbered(rows.drop("id"), 10, ["started_at"]).agg(F.min("id")).first()[0] >= 11


def test_readers(spark, tmp_path):
    lines = ['"DirectShow video devices"', ' "Cam" (video)', '   Alternative name "@x"', ' "Cam" (video)', ' "Card" (none)', '"DirectShow audio devices"', ' "Mic" (audio)']
    listing = spark.createDataFrame(list(enumerate(lines)), "line_no long, line string")
    assert [r["name"] for r in readers.device_names(listing).orderBy("nth").collect() if "DirectShow" not in r["name"]] == ["Cam", "Card"]
    (tmp_path / "q.json").write_text('{"queries":[{"query":"a","expected_event_id":3,"kind":"exact"}]}')
    assert readers.judged_queries(spark, str(tmp_path / "q.json")).first()["expected_event_id"] == 3
    (tmp_path / "f.raw").write_bytes(bytes(range(24)) + b"short")
    frames = readers.raw_frames(spark, str(tmp_path / "f.raw"), 2, 2).orderBy("frame").collect()
    assert [bytes(r["data"]) for r in frames] == [bytes(range(12)), bytes(range(12, 24))]
    (tmp_path / "d/menu").mkdir(parents=True)
    (tmp_path / "d/menu/a.png").write_bytes(b"x")
    (tmp_path / "d/menu/a.txt").write_text("truth")
    assert readers.truth_cases(spark, str(tmp_path / "d")).first()["truth"] == "truth"
    (tmp_path / "s.json").write_text('{"retention_days": 7, "unknown": 1}')
    assert readers.settings(str(tmp_path / "s.json"), {"TIDEMARK_ANALYSIS_FPS": "4"}) == readers.Settings(retention_days=7, analysis_fps=4.0)
    (tmp_path / "s.json").write_text("[broken")
    assert readers.settings(str(tmp_path / "s.json"), {}) == readers.Settings()


def test_enrichment(spark):
    class Failing(enrich.TextFrames):
        def recognize(self, frame):
            if frame == b"bad":
                raise RuntimeError("no text")
            return super().recognize(frame)

    pending = spark.createDataFrame([(1, bytearray("テス卜 words".encode())), (2, bytearray(b"bad")), (3, bytearray(b""))], "id long, frame binary")
    got = {r["id"]: r for r in enrich.enriched(pending, Failing(), enrich.HashEmbedder()).collect()}
    assert got[1]["text"] == "テスト words" and len(got[1]["embedding"]) == 32 and got[1]["attempts"] == 1
    assert got[2]["text"] == "" and got[2]["attempts"] == 3 and "no text" in got[2]["error"]
    assert got[3]["embedding"] is None and got[3]["confidence"] is None
    ev = spark.createDataFrame([(1, "old"), (4, "old")], "id long, ocr_text string")
    index = spark.createDataFrame([(1, "first", 1), (1, "second", 2)], "id long, text string, indexed_at long")
    assert {r["id"]: r["ocr_text"] for r in enrich.current(ev, index).collect()} == {1: "second", 4: None}


def test_evaluation(spark):
    rows = spark.createDataFrame([("a", 0.0), ("a", 1.0), ("b", 0.25)], "category string, value double")
    r = evaluate.micro_and_macro(rows).first()
    assert (round(r["micro"], 6), r["macro"]) == (0.416667, 0.375)
    p = spark.createDataFrame([("x", 0, 4.0, 80, 100), ("y", 0, 6.0, 80, 100), ("z", 1, 1.0, 10, 100), ("w", 0, 1.0, 95, 100)], "provider string, errors int, p95 double, peak_memory int, total_memory int")
    assert [x["provider"] for x in evaluate.eligible(p).collect()] == ["x"]


def test_row_checks(spark):
    rows = spark.createDataFrame([(1, "frame"), (1, "odd"), (None, "ocr")], "id long, kind string")
    found = {r["rule"]: r["n"] for r in schema.violations(rows, ["id"], schema.ALLOWED["evidence"], ["id"]).collect()}
    assert found == {"not null id": 1, "allowed kind": 1, "unique id": 1}
    assert schema.with_missing(rows.select("id"), schema.EVIDENCE).columns[:3] == ["id", "event_id", "kind"]

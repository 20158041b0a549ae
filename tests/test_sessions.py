import datetime as dt

from tidemark.operators import enrich, sessions as S
from tidemark.sources import sinks

T = dt.datetime(2026, 1, 1)


def test_states(spark):
    rows = [("a", "start", "cam", T, None), ("a", "end", None, T, None), ("b", "start", "cam", T, None), ("c", "start", "cam", T, None), ("c", "end", None, T, "lost")]
    s = S.session_states(spark.createDataFrame(rows, "id string, kind string, source_name string, at timestamp_ntz, error string"))
    assert {r["id"]: r["status"] for r in s.collect()} == {"a": "stopped", "b": "running", "c": "failed"}
    ev = spark.createDataFrame([(1, "a"), (2, "a")], "id long, session_id string")
    assert {r["id"]: r["n_events"] for r in S.events_per_session(s, ev).collect()} == {"a": 2, "b": 0, "c": 0}


def test_selections(spark):
    ev = spark.createDataFrame([(i, "ab"[i % 2], T + dt.timedelta(seconds=i)) for i in range(10)], "id long, session_id string, started_at timestamp_ntz")
    assert sorted(r["id"] for r in S.between(ev, "a", 8, 4).collect()) == [4, 6, 8]
    assert [r["id"] for r in S.chronological(ev.limit(3), newest_first=True).orderBy("position").collect()] == [2, 1, 0]
    assert S.moved([1, 2, 3, 4], 1, 3) == [2, 3, 1, 4] and S.moved([1, 2, 3, 4], 4, 2) == [1, 4, 2, 3] and S.moved([1], 1, 9) == [1]
    assert S.unknown(ev, ev.filter("id < 8")).count() == 2
    pages = spark.createDataFrame([(0, [1, 2]), (1, [2, 3])], "page int, source_event_ids array<long>")
    assert {r["event_id"]: r["page"] for r in S.pages_of(pages).collect()} == {1: 0, 2: 0, 3: 1}
    assert S.has_capacity(1, 2, 3, 3) and not S.has_capacity(2, 2, 3, 3) and not S.has_capacity(1, 2, 2, 3)


def test_indexing_as_a_stream(spark, tmp_path):
    """Pending events arrive as files and leave as index rows; the newest result of an event wins."""
    spark.createDataFrame([(1, bytearray(b"first words")), (2, bytearray(b"second"))], "id long, frame binary").write.parquet(str(tmp_path / "pending"))
    stream = spark.readStream.schema("id long, frame binary").parquet(str(tmp_path / "pending"))
    q = sinks.stream_to(enrich.enriched(stream, enrich.TextFrames(), enrich.HashEmbedder()), str(tmp_path / "index"), str(tmp_path / "state"))
    q.awaitTermination()
    assert {r["id"]: r["text"] for r in spark.read.parquet(str(tmp_path / "index")).collect()} == {1: "first words", 2: "second"}

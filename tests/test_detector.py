import pytest

from tidemark.sources import readers, sinks
from tidemark.streaming import detector as D


def observations(spark, rows):
    return spark.createDataFrame([(k, float(t), float(s), float(w), i) for i, (k, t, s, w) in enumerate(rows)], "key long, at double, score double, watch double, frame long")


def kinds(df):
    return [(r["key"], r["kind"], r["started_at"], r["ended_at"]) for r in sorted(df.collect(), key=lambda r: (r["key"], r["ended_at"]))]


TIMELINE = [(1, 0, 0, 0), (1, 30, 0, 0), (1, 60, 0, 0), (1, 61, 0.5, 0), (1, 62, 0, 0), (1, 62.6, 0, 0)]


def test_stable_after_quiet(spark):
    assert kinds(D.detect(observations(spark, TIMELINE))) == [(1, "initial", 0, 0), (1, "heartbeat", 0, 60), (1, "stable", 60, 62.6)]


def test_stable_carries_last_moving_frame(spark):
    events = D.detect(observations(spark, TIMELINE)).collect()
    assert next(r for r in events if r["kind"] == "stable")["frame"] == 3


def test_continuous_motion(spark):
    rows = [(1, 0, 0, 0)] + [(1, t, 0.5, 0) for t in range(1, 12)]
    assert sum(k == "motion" for _, k, _, _ in kinds(D.detect(observations(spark, rows)))) == 2


def test_watched_region(spark):
    rows = [(1, 0, 0, 0), (1, 1, 0.001, 0.004), (1, 2.6, 0, 0)]
    assert [k for _, k, _, _ in kinds(D.detect(observations(spark, rows)))] == ["initial", "stable"]


def test_keys_are_apart(spark):
    rows = [(k, t, s, w) for k in (1, 2) for _, t, s, w in TIMELINE]
    found = kinds(D.detect(observations(spark, rows)))
    assert [x[1:] for x in found if x[0] == 1] == [x[1:] for x in found if x[0] == 2]


@pytest.mark.parametrize("files", [1, 3])
def test_stream_equals_batch(spark, tmp_path, files):
    rows = [(k, t * 7 % 61 + t / 3, (t * k % 5) / 100, 0) for k in (1, 2, 3) for t in range(60)]
    rows = sorted(rows, key=lambda r: r[1])
    obs = observations(spark, rows)
    for i in range(files):
        low, high = i * len(rows) // files, (i + 1) * len(rows) // files
        obs.filter(f"frame >= {low} AND frame < {high}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    import os
    import time

    parts = sorted(p for p in os.listdir(tmp_path / "in") if p.startswith("part"))
    order = sorted(parts, key=lambda p: spark.read.parquet(str(tmp_path / "in" / p)).agg({"frame": "min"}).first()[0])
    for i, p in enumerate(order):
        os.utime(tmp_path / "in" / p, (time.time() - 1000 + i * 10,) * 2)
    stream = D.detect_stream(readers.replay(spark, str(tmp_path / "in")))
    q = sinks.stream_to(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    q.awaitTermination()
    assert kinds(spark.read.parquet(str(tmp_path / "out"))) == kinds(D.detect(obs))


def test_downsample_queue_and_manual(spark):
    obs = observations(spark, [(1, t / 10, 0, 0) for t in range(30)])
    assert D.downsampled(obs, 2.0).count() == 6
    kept, dropped = D.newest(obs, 8)
    assert kept.count() == 8 and dropped == 22
    both = D.with_manual(D.detect(obs), spark.createDataFrame([(1, 1.0, 5)], "key long, at double, frame long"))
    assert {r["kind"] for r in both.collect()} == {"initial", "manual"}

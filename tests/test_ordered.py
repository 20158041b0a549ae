import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import ordered, search, stitch


@pytest.mark.parametrize("rows", [4, 50_000])
def test_ranks_neighbours_and_sums_of_a_hot_key(spark, rows):
    random.seed(1)
    data = [(i, None if i % 40 == 3 else "hot" if i % 3 else f"s{i % 7}", float(random.choice([1, 1, 2, 5, 9, 50]) if i % 2 else i)) for i in range(300)]
    df = spark.createDataFrame(data, "id long, k string, at double").repartition(4)
    around = {"last": lambda w: F.lag("id").over(w), "next": lambda w: F.lead("id", 2).over(w)}
    got = ordered.running(ordered.beside(df, "k", "at", "id", around, before=1, after=2, rows=rows).withColumn("one", F.col("id") % 3), "k", "one", "total", rows=rows).collect()
    want = []
    for k in {r[1] for r in data}:
        own = sorted((r for r in data if r[1] == k), key=lambda r: (r[2], r[0]))
        total = 0
        for n, r in enumerate(own):
            total += r[0] % 3
            want.append((r[0], n + 1, own[n - 1][0] if n else None, own[n + 2][0] if n + 2 < len(own) else None, total))
    assert sorted((r["id"], r["nth"], r["last"], r["next"], r["total"]) for r in got) == sorted(want)


def test_sessions_in_blocks(spark, monkeypatch):
    data = [(i, "a" if i < 60 else "b", f"2024-01-01 00:{i % 60:02}:00") for i in range(90)]
    ev = spark.createDataFrame(data, "id long, session_id string, at string").withColumn("started_at", F.col("at").cast("timestamp_ntz"))
    assert {r["id"]: r["previous_id"] for r in search.with_previous(ev).collect()} == {i: None if i in (0, 60) else i - 1 for i in range(90)}
    frames = spark.createDataFrame([("s", i, float(i * 10 + (i >= 5) * 500), 100 + (i >= 8)) for i in range(12)], "session_id string, event_id long, at double, height int")
    assert [r["chain"] for r in stitch.chains(frames, "at", "event_id").orderBy("event_id").collect()] == [1] * 5 + [2] * 3 + [3] * 4
    assert ordered.ranked(frames.limit(0), "session_id", "at", "event_id").count() == 0

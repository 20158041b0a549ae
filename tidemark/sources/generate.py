"""Generated tables for benches: events with unit vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import ship


def events(spark: SparkSession, n: int = 50_000, dimension: int = 384, seed: int = 42) -> DataFrame:
    """n events a second apart of one session, with texts `event 0`, `event 1`, …, and vectors of normal numbers, seeded by id, of length 1."""
    ship(spark)

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            raw = np.stack([np.random.default_rng((seed, i)).normal(size=dimension) for i in ids.to_pylist()]) if len(ids) else np.zeros((0, dimension))
            unit = (raw / np.linalg.norm(raw, axis=1, keepdims=True)).astype(np.float32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1, dtype=np.int32) * dimension), pa.array(unit.ravel()))
            yield pa.RecordBatch.from_arrays([ids, lists], ["id", "embedding"])

    vectors = spark.range(n).mapInArrow(run, "id long, embedding array<float>")
    at = F.expr("timestamp_ntz'2024-01-01 00:00:00' + INTERVAL '1' SECOND * id")
    text = F.concat(F.lit("event "), F.col("id").cast("string")).alias("ocr_text")
    return vectors.select("id", F.lit("bench").alias("session_id"), at.alias("started_at"), at.alias("ended_at"), text, at.alias("processed_at"), "embedding")

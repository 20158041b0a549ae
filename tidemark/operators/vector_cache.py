"""A cached matrix of vectors for repeated searches, which grows by new events and is dropped when old ones change."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


class VectorCache:
    """Persisted (id, started_at, ended_at, embedding) of one dimension, in parts: a refresh reads events above the highest id alone."""

    def __init__(self, dimension: int):
        self.dimension, self.parts, self.signature = dimension, [], (dimension, 0, -1)

    def refresh(self, ev: DataFrame) -> DataFrame:
        """All cached rows, after those that came since the last refresh."""
        rows = ev.select("id", "started_at", "ended_at", "embedding").filter((F.col("id") > self.signature[2]) & (F.size("embedding") == self.dimension)).persist()
        n, most = rows.agg(F.count(F.lit(1)), F.max("id")).first()
        if n or not self.parts:
            self.parts.append(rows)
            self.signature = self.dimension, self.signature[1] + n, most if most is not None else self.signature[2]
        else:
            rows.unpersist()
        out = self.parts[0]
        for p in self.parts[1:]:
            out = out.unionByName(p)
        return out

    def invalidate(self) -> None:
        """To be called when a stored vector changed in place."""
        for p in self.parts:
            p.unpersist()
        self.parts, self.signature = [], (self.dimension, 0, -1)

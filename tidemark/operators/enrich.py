"""Enrichment of pending events through plug-ins: text from frames, normalisation, vectors; the newest result wins."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.text import normalise
from .packs import latest

ATTEMPTS = 3
RESULT = "id long, text string, confidence double, lines array<struct<text:string,confidence:double,polygon:array<array<double>>>>, embedding array<float>, attempts int, error string"


class Extractor(Protocol):
    """Text of a frame. open() is called once a task, where a model may be loaded."""

    def open(self) -> None: ...

    def recognize(self, frame: bytes | None) -> dict: ...


class Embedder(Protocol):
    dimension: int

    def open(self) -> None: ...

    def encode_document(self, text: str) -> list[float] | None: ...

    def encode_query(self, text: str) -> list[float] | None: ...


class Nothing:
    """A disabled plug-in: no text, no vector."""

    dimension = 0

    def open(self) -> None:
        pass

    def recognize(self, frame: bytes | None) -> dict:
        return {"text": "", "confidence": None, "lines": []}

    def encode_document(self, text: str) -> list[float] | None:
        return None

    encode_query = encode_document


class TextFrames(Nothing):
    """Frames that are text themselves: one line each, confidence 0.99, none for an empty frame."""

    def recognize(self, frame: bytes | None) -> dict:
        text = (frame or b"").decode("utf-8", "replace")
        rows = [{"text": t, "confidence": 0.99, "polygon": []} for t in text.splitlines() if t]
        return {"text": text, "confidence": 0.99 if text else None, "lines": rows}


class HashEmbedder(Nothing):
    """Unit vectors of hashed token counts; null without tokens."""

    def __init__(self, dimension: int = 32):
        self.dimension = dimension

    def encode_document(self, text: str) -> list[float] | None:
        v = [0.0] * self.dimension
        for token in re.findall(r"\w+", text.lower()):
            v[int(hashlib.sha256(token.encode()).hexdigest()[:8], 16) % self.dimension] += 1.0
        size = sum(x * x for x in v) ** 0.5
        return [x / size for x in v] if size else None

    encode_query = encode_document


def enriched(pending: DataFrame, extractor: Extractor, embedder: Embedder) -> DataFrame:
    """A result a pending event (id, frame): normalised text, lines and vector. A failure after ATTEMPTS gives empty text and its error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        extractor.open()
        embedder.open()
        for pdf in batches:
            out = []
            for event_id, frame in zip(pdf["id"], pdf["frame"], strict=True):
                error = None
                for attempt in range(1, ATTEMPTS + 1):
                    try:
                        found = extractor.recognize(frame)
                        text = normalise(found["text"]) or ""
                        rows = [{**x, "text": normalise(x["text"])} for x in found["lines"]]
                        out.append((event_id, text, found["confidence"], rows, embedder.encode_document(text), attempt, None))
                        break
                    except Exception as e:  # noqa: BLE001  a plug-in may raise anything; the event keeps its error
                        error = f"{type(e).__name__}: {e}"
                else:
                    out.append((event_id, "", None, [], None, ATTEMPTS, error))
            yield pd.DataFrame(out, columns=["id", "text", "confidence", "lines", "embedding", "attempts", "error"])

    return pending.select("id", "frame").mapInPandas(run, RESULT)


def current(ev: DataFrame, index: DataFrame) -> DataFrame:
    """Events with their newest result of an append-only index (id, text, confidence, embedding, indexed_at)."""
    newest = latest(index, "id", [F.desc("indexed_at")])
    return ev.drop("ocr_text", "embedding", "processed_at").join(newest.withColumnsRenamed({"text": "ocr_text", "indexed_at": "processed_at"}), "id", "left")


def renormalised(rows: DataFrame, text: str = "ocr_text") -> tuple[DataFrame, DataFrame]:
    """Rows with normalised text, and those that change."""
    from ..functions.text import normalise_text

    out = rows.withColumn("normalised", normalise_text(F.col(text)))
    return out, out.filter(F.col(text) != F.col("normalised"))
